"""XML dumps of drugs: one table of drugs, one of the proteins that they act on, each read with the elements it needs only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of proteins, and the elements of a drug and of a protein that are read.
KINDS = ("target", "enzyme", "carrier", "transporter")
_DRUG = """`_type` string, `drugbank-id` array<struct<_VALUE: string, _primary: string>>, name string, description string, groups struct<group: array<string>>,
`atc-codes` struct<`atc-code`: array<struct<_code: string>>>, categories struct<category: array<struct<category: string>>>,
`calculated-properties` struct<property: array<struct<kind: string, value: string>>>, synonyms struct<synonym: array<struct<_VALUE: string, _language: string>>>,
products struct<product: array<struct<name: string>>>, `international-brands` struct<`international-brand`: array<struct<name: string>>>,
indication string, pharmacodynamics string, `mechanism-of-action` string, toxicity string, `protein-binding` string"""
_PROTEIN = """struct<organism: string, `known-action`: string, actions: struct<action: array<string>>,
references: struct<articles: struct<article: array<struct<`pubmed-id`: string, citation: string>>>>,
polypeptide: array<struct<`external-identifiers`: struct<`external-identifier`: array<struct<resource: string, identifier: string>>>>>>"""
_PROTEINS = f"`drugbank-id` array<struct<_VALUE: string, _primary: string>>, name string, {', '.join(f'{k}s struct<{k}: array<{_PROTEIN}>>' for k in KINDS)}"


def _primary() -> Column:
    return F.get(F.filter("drugbank-id", lambda x: x["_primary"] == "true"), F.lit(0))["_VALUE"]


def _property(kind: str) -> Column:
    found = F.filter("calculated-properties.property", lambda x: x["kind"] == kind)
    return F.get(found, F.lit(0))["value"]


def _joined(values: Column) -> Column:
    """Values by bars; none give an empty text."""
    return F.coalesce(F.array_join(values, "|"), F.lit(""))


def read_drug_table(spark: SparkSession, path: str, row: str = "drug") -> DataFrame:
    """(drug_id, name, type, groups, atc_codes, categories, inchikey, inchi, description, aliases, and texts): lists by bars.

    Aliases are the name, English synonyms, and the names of brands and products: distinct, sorted, as an array."""
    rows = spark.read.format("xml").option("rowTag", row).schema(_DRUG).load(path)
    none = F.array().cast("array<string>")
    english = F.filter("synonyms.synonym", lambda x: x["_language"].eqNullSafe(F.lit("English")))
    names = [F.array("name"), F.transform(english, lambda x: x["_VALUE"]), F.col("products.product.name"), F.col("international-brands.international-brand.name")]
    aliases = F.array_sort(F.array_distinct(F.array_compact(F.concat(*[F.coalesce(x, none) for x in names]))))
    texts = [F.col(f"`{c}`").alias(c.replace("-", "_")) for c in ("indication", "pharmacodynamics", "mechanism-of-action", "toxicity", "protein-binding")]
    return rows.select(
        _primary().alias("drug_id"), "name", F.col("_type").alias("type"), _joined(F.col("groups.group")).alias("groups"), _joined(F.col("atc-codes.atc-code._code")).alias("atc_codes"),
        _joined(F.col("categories.category.category")).alias("categories"), _property("InChIKey").alias("inchikey"), _property("InChI").alias("inchi"), "description", aliases.alias("aliases"), *texts,
    )


def read_drug_proteins(spark: SparkSession, path: str, row: str = "drug") -> DataFrame:
    """(drug_id, name, category, organism, known_action, actions, uniprot_id, pubmed_ids, citations) of proteins with one id.

    Only articles with an id that isn't empty count; without any, ids and citations are null."""
    rows = spark.read.format("xml").option("rowTag", row).schema(_PROTEINS).load(path)
    none = F.array().cast(f"array<{_PROTEIN}>")
    of = lambda kind: F.transform(F.coalesce(F.col(f"{kind}s.{kind}"), none), lambda x: F.struct(F.lit(kind).alias("category"), x.alias("p")))
    out = rows.select(_primary().alias("drug_id"), "name", F.explode(F.concat(*[of(k) for k in KINDS])).alias("x")).select("drug_id", "name", "x.*")
    every = F.flatten(F.array_compact(F.transform("p.polypeptide", lambda x: x["external-identifiers"]["external-identifier"])))
    ids = F.transform(F.filter(every, lambda x: x["resource"] == "UniProtKB"), lambda x: x["identifier"])
    articles = F.filter("p.references.articles.article", lambda x: x["pubmed-id"] != "")
    cited = lambda name: F.when(F.size(articles) > 0, F.array_join(F.transform(articles, lambda x: x[name]), "|"))
    return out.filter(F.size(ids) == 1).select(
        "drug_id", "name", "category", F.col("p.organism").alias("organism"), F.col("p.known-action").alias("known_action"), _joined(F.col("p.actions.action")).alias("actions"),
        ids[0].alias("uniprot_id"), cited("pubmed-id").alias("pubmed_ids"), cited("citation").alias("citations"),
    )


def approved_small_molecules(drugs: DataFrame) -> DataFrame:
    """Drugs of the table whose groups name an approval, of a known structure, and of small molecules."""
    return drugs.filter(F.contains("groups", F.lit("approved")) & F.col("inchi").isNotNull() & (F.col("type") == "small molecule"))
