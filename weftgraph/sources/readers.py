"""File formats of networks, labels, mappings and sets. Every reader has a fixed schema; gzip is read as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.lineage import materialize

#: The columns of a multi-channel network file, and the groups that they can be asked for by.
CHANNELS = [
    "neighborhood",
    "neighborhood_transferred",
    "fusion",
    "cooccurence",
    "homology",
    "coexpression",
    "coexpression_transferred",
    "experiments",
    "experiments_transferred",
    "database",
    "database_transferred",
    "textmining",
    "textmining_transferred",
]
CORE = ["neighborhood", "fusion", "cooccurence", "coexpression", "experiments", "database"]

EDGE = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("weight", T.DoubleType())])


def _tsv(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=schema, **options)


def channels(asked: str) -> list[str]:
    """Names and groups, by commas, as an ordered list without repeats."""
    groups = {"core": CORE, "nontransferred": [c for c in CHANNELS if not c.endswith("_transferred")], "all": CHANNELS}
    out: list[str] = []
    for name in asked.split(","):
        found = groups.get(name.strip(), [name.strip()])
        unknown = [c for c in found if c not in CHANNELS]
        if unknown:
            raise ValueError(f"no such channel: {unknown[0]}")
        out += [c for c in found if c not in out]
    return out


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight); a missing weight is 1."""
    return _tsv(spark, path, EDGE).withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def read_edge_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(channel, src, dst, weight, seq): a channel for each file; seq orders a channel's rows as its file does."""
    out = None
    for name, path in paths.items():
        one = read_edges(spark, path).withColumn("channel", F.lit(name)).withColumn("seq", F.monotonically_increasing_id())
        out = one if out is None else out.unionByName(one)
    return out


def read_channels(spark: SparkSession, path: str, asked: str, cutoff: float) -> tuple[DataFrame, DataFrame]:
    """Edges (channel, src, dst, weight) with weight above 0, and all nodes of rows whose combined score reaches cutoff."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("src", "dst")] + [T.StructField(c, T.DoubleType()) for c in [*CHANNELS, "combined_score"]])
    rows = _tsv(spark, path, schema).filter(F.col("combined_score") >= cutoff)
    nodes = rows.select(F.col("src").alias("node")).union(rows.select("dst")).distinct()
    return rows.unpivot(["src", "dst"], channels(asked), "channel", "weight").filter("weight > 0"), nodes


def read_label_table(spark: SparkSession, path: str) -> DataFrame:
    """(term, node, label) of a table with a column for each term; zeros aren't labels."""
    head = spark.read.text(path).filter("value not like '##%'").first()
    if head is None:
        return spark.createDataFrame([], "term string, node string, label int")
    terms = head[0].lstrip("#").split("\t")[1:]
    schema = T.StructType([T.StructField("node", T.StringType())] + [T.StructField(f"t{k}", T.IntegerType()) for k in range(len(terms))])
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=True)
    names = F.create_map(*[F.lit(x) for k, t in enumerate(terms) for x in (f"t{k}", t)])
    out = rows.unpivot(["node"], [f"t{k}" for k in range(len(terms))], "k", "label").filter("label <> 0")
    return out.select(F.element_at(names, F.col("k")).alias("term"), "node", "label")


def read_label_list(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """(term, node, label) of lines of a term, 1 or -1, and nodes by commas."""
    rows = _tsv(spark, path, "term string, label int, nodes string")
    rows = rows.filter(F.col("term").isin(terms)) if terms is not None else rows
    return rows.select("term", F.explode(F.split("nodes", ",")).alias("node"), "label")


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, members): ragged lines of a set's name, its description and its members."""
    cells = F.split("value", "\t", -1)
    rows = spark.read.text(path).filter("value not like '#%' and value <> ''").select(cells.alias("c"))
    members = F.filter(F.slice("c", 3, F.greatest(F.size("c") - 2, F.lit(0))), lambda x: x != "")
    return rows.select(F.col("c")[0].alias("name"), F.get("c", F.lit(1)).alias("description"), members.alias("members"))


def write_gmt(sets: DataFrame, path: str) -> None:
    sets.select(F.concat_ws("\t", "name", F.coalesce("description", F.lit("")), "members")).write.text(path)


def read_id_list(spark: SparkSession, path: str, namespaces: list[str] | None = None) -> DataFrame:
    """(canonical, namespace, alternate); namespaces in any case, or all."""
    rows = _tsv(spark, path, "canonical string, namespace string, alternate string")
    return rows if namespaces is None else rows.filter(F.lower("namespace").isin([n.lower() for n in namespaces]))


def read_id_table(spark: SparkSession, path: str, key: str, columns: list[str], separator: str | None = None) -> DataFrame:
    """(canonical, namespace, alternate) of some columns of a table; cells may hold lists."""
    rows = spark.read.csv(path, sep="\t", header=True)
    out = rows.select(key, *[F.col(f"`{c}`") for c in columns]).unpivot([key], columns, "namespace", "alternate").filter("alternate is not null")
    if separator:
        out = out.withColumn("alternate", F.explode(F.split("alternate", separator))).filter("alternate <> ''")
    return out.select(F.col(f"`{key}`").alias("canonical"), "namespace", "alternate")


def read_cells(spark: SparkSession, path: str, column: str, separator: str) -> DataFrame:
    """A table of comma-separated values with a row for each part of one column's cells."""
    rows = spark.read.csv(path, header=True)
    return rows.filter(F.col(f"`{column}`").isNotNull()).withColumn(column, F.explode(F.split(F.col(f"`{column}`"), separator)))


def read_xrefs(spark: SparkSession, path: str) -> DataFrame:
    """(name, xref) of one JSON object a file, each with an array of references."""
    rows = spark.read.json(path, schema="name string, xrefs array<string>", multiLine=True)
    return rows.select("name", F.explode("xrefs").alias("xref"))


def read_drugs(spark: SparkSession, path: str, row: str = "drug") -> DataFrame:
    """(drug_id, name, groups, target_id, actions) of an XML dump; targets with one id only."""
    schema = "`drug_id` string, name string, groups struct<group: array<string>>, targets struct<target: array<struct<id: array<string>, actions: struct<action: array<string>>>>>"
    rows = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    out = rows.select("drug_id", "name", F.array_join("groups.group", "|").alias("groups"), F.explode("targets.target").alias("t"))
    return out.filter(F.size("t.id") == 1).select("drug_id", "name", "groups", F.col("t.id")[0].alias("target_id"), F.array_join("t.actions.action", "|").alias("actions"))


def read_columns(spark: SparkSession, path: str, *places: int, separator: str = "\t") -> DataFrame:
    """Columns by their places from 1, as strings; lines that are too short go."""
    cells = F.split("value", separator, -1)
    rows = spark.read.text(path).filter("value not like '#%'").select(cells.alias("c")).filter(F.size("c") >= max(places))
    return rows.select(*[F.col("c")[p - 1].alias(f"c{p}") for p in places])


def read_styles(spark: SparkSession, path: str) -> DataFrame:
    """(item, other, style, value, description): styles of nodes, or of edges `a-b`; the last line of an item's style counts."""
    rows = _tsv(spark, path, "style string, value string, items string, description string").withColumn("line", F.monotonically_increasing_id())
    out = rows.withColumn("item", F.explode(F.split("items", r"\|")))
    last = Window.partitionBy("item", "style").orderBy(F.desc("line"))
    out = out.withColumn("k", F.row_number().over(last)).filter("k = 1")
    ends = F.split("item", "-", 2)
    edge = F.size(F.split("item", "-")) == 2
    return out.select(F.when(edge, ends[0]).otherwise(F.col("item")).alias("item"), F.when(edge, ends[1]).alias("other"), "style", "value", "description")


def split_by_group(edges: DataFrame, group: Column, path: str) -> None:
    """Edges by group, a folder for each, compressed."""
    edges.withColumn("group", group).filter("group is not null").write.partitionBy("group").csv(path, sep="\t", compression="gzip")


def within_groups(edges: DataFrame, mapping: DataFrame, groups: DataFrame, cutoff: float, wanted: list[str] | None = None) -> DataFrame:
    """Edges (src, dst, weight, ...) from a weight on, with both ends mapped (from_id, to_id; one image each) and both images in one
    group (node, group): the edges' columns, `group` and the ends' own group `own`, told by their first part."""
    one = mapping.join(groups.withColumnRenamed("node", "to_id"), "to_id").select("from_id", "to_id", "group")
    ends = lambda end: one.select(F.col("from_id").alias(end), F.col("to_id").alias(f"new_{end}"), F.col("group").alias(f"group_{end}"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    rows = edges.filter(F.col("weight") >= cutoff).join(ends("src"), "src").join(ends("dst"), "dst").filter("group_src = group_dst")
    rows = rows.filter(F.col("group_src").isin(wanted)) if wanted is not None else rows
    return rows.select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), *rest, F.col("group_src").alias("group"))


def group_counters(edges: DataFrame, group: Column) -> DataFrame:
    """(group, edges, nodes): edges of each group and distinct nodes in them."""
    rows = edges.select(group.alias("group"), F.explode(F.array("src", "dst")).alias("node"))
    return rows.groupBy("group").agg((F.count("*") / 2).cast("long").alias("edges"), F.count_distinct("node").alias("nodes"))


def split_by_mapping(edges: DataFrame, mapping: DataFrame, groups: DataFrame, path: str, cutoff: float, wanted: list[str] | None = None) -> DataFrame:
    """Write the edges within groups, a compressed folder for each; returns counters before, by the prefix of the ends' ids, and
    after: (group, edges_before, nodes_before, edges, nodes)."""
    kept = materialize(within_groups(edges, mapping, groups, cutoff, wanted), "within-groups")
    kept.write.partitionBy("group").csv(path, sep="\t", compression="gzip")
    before = group_counters(edges.filter(F.col("weight") >= cutoff), F.split_part("src", F.lit("."), F.lit(1)))
    before = before.select("group", F.col("edges").alias("edges_before"), F.col("nodes").alias("nodes_before"))
    return before.join(group_counters(kept, F.col("group")), "group", "full_outer").na.fill(0)


def write_edges(edges: DataFrame, path: str) -> None:
    """A network as lines of two nodes and a weight."""
    edges.select("src", "dst", "weight").write.csv(path, sep="\t")


def cached(spark: SparkSession, path: str, make, forced: bool = False) -> DataFrame:
    """A table kept at a path: made and written once, read from then on, and made anew if forced."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if forced or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Ranked scores (term, node, score) as text, four digits, the best first within each term; zeros aren't written."""
    rows = scores.filter("score <> 0").repartitionByRange("term", F.desc("score")).sortWithinPartitions("term", F.desc("score"), "node")
    rows.select(F.col("term").alias("#term"), F.col("node").alias("prot"), F.format_string("%.4e", F.col("score")).alias("score")).write.csv(path, sep="\t", header=True)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(term, node, score) of written scores."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="term string, node string, score double", enforceSchema=True)
    return rows.select("term", "node", "score")


def append_results(rows: DataFrame, path: str, *by: str) -> None:
    """Results added to a table partitioned by run; writers need no lock."""
    rows.write.mode("append").partitionBy(*by).parquet(path)


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path that were written to their end, whatever the store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    found = [x.getPath() for x in store.listStatus(at) if x.isDirectory()]
    return sorted(x.getName() for x in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def write_run(rows: DataFrame, path: str, run: str) -> None:
    """The results of one run; written again, they replace themselves. A run counts once its folder has its marker."""
    if not run or not all(c.isalnum() or c in "-_." for c in run):
        raise ValueError(f"no name of a run: {run!r}")
    rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/run={run}")


def open_runs(spark: SparkSession, path: str, wanted: list[str]) -> list[str]:
    """The wanted runs that have no results, or were cut off while these were written."""
    done = {name.removeprefix("run=") for name in committed(spark, path)}
    return [x for x in dict.fromkeys(wanted) if x not in done]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Results of all whole runs, with the column `run`; those of runs that were cut off don't count."""
    names = committed(spark, path)
    if not names:
        raise ValueError(f"no whole run in {path}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/{name}" for name in names]).withColumn("run", F.col("run").cast("string"))


def read_results(spark: SparkSession, path: str, **wanted) -> DataFrame:
    """Results of all runs, or of those whose partition columns have the values asked for; repeated rows count once."""
    rows = spark.read.parquet(path)
    for key, values in wanted.items():
        rows = rows.filter(F.col(key).isin(values))
    return rows.dropDuplicates()
