"""Filters, mappings, ranks, top-k, reshaping and reports over plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.order import Ordered


def keep_values(table: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows whose columns all hold one of the values given for them."""
    return reduce(lambda t, kv: t.filter(F.col(kv[0]).isin(kv[1])), wanted.items(), table)


def both_ways(mapping: DataFrame) -> DataFrame:
    """(from_id, to_id): a mapping and its reverse, distinct."""
    return mapping.select("from_id", "to_id").union(mapping.select("to_id", "from_id")).distinct()


def prefer_reviewed(mapping: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Where an id maps to any reviewed id, only those; else all."""
    flagged = mapping.join(reviewed.select(F.col("id").alias("to_id")).distinct().withColumn("is_rev", F.lit(True)), "to_id", "left")
    any_rev = F.max(F.coalesce("is_rev", F.lit(False))).over(Window.partitionBy("from_id"))
    return flagged.withColumn("any_rev", any_rev).filter(F.coalesce("is_rev", F.lit(False)) | ~F.col("any_rev")).select("from_id", "to_id")


def map_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends mapped, with every pair of their images; edges with an unmapped end go."""
    one = mapping.select(F.col("from_id").alias("src"), F.col("to_id").alias("new_src"))
    two = mapping.select(F.col("from_id").alias("dst"), F.col("to_id").alias("new_dst"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(one, "src").join(two, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), *rest)


def map_column(table: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """A column mapped with fan-out; the original stays as <column>_orig."""
    out = table.withColumnRenamed(column, f"{column}_orig")
    return out.join(mapping.select(F.col("from_id").alias(f"{column}_orig"), F.col("to_id").alias(column)), f"{column}_orig")


def mapping_statistics(before: DataFrame, after: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: distinct nodes and edges before and after, and nodes without an image."""
    ends = lambda e: e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    n = lambda t, name: t.agg(F.count("*").alias(name))
    pairs = lambda e: e.select(F.least("src", "dst"), F.greatest("src", "dst")).distinct()
    gone = ends(before).join(mapping.select(F.col("from_id").alias("node")), "node", "left_anti")
    rows = [n(ends(before), "nodes"), n(ends(after), "new_nodes"), n(pairs(before), "edges"), n(pairs(after), "new_edges"), n(gone, "unmapped")]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rows)  # one row each


def explode_cell(table: DataFrame, column: str, separator: str) -> DataFrame:
    """A row for each part of a delimited cell; null cells go."""
    return table.withColumn(column, F.explode(F.split(column, separator)))


def gene_sets(table: DataFrame, name: str, member: str, description: str) -> DataFrame:
    """(name, description, members): sorted distinct members and the least description."""
    return table.groupBy(F.col(name).alias("name")).agg(F.min(description).alias("description"), F.sort_array(F.collect_set(member)).alias("members"))


def ranked(scores: DataFrame, keys: list[str], node: str = "node") -> DataFrame:
    """Ranks from 1 by falling score, ties by node; without keys over the whole table, in ranges."""
    if not keys:
        return Ordered(scores, F.desc("score"), node).rank("rank").table()
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), node)).cast("long"))


def without_positives(scores: DataFrame, positives: DataFrame) -> DataFrame:
    return scores.join(positives.select("node").distinct(), "node", "left_anti")


def top_k(scores: DataFrame, keys: list[str], k: int | DataFrame, node: str = "node") -> DataFrame:
    """The first k nodes with a score of each key; k is a number, -1 for all, or a table (keys, k)."""
    rows = ranked(scores.filter("score <> 0"), keys, node)
    if isinstance(k, DataFrame):
        return rows.join(k, keys).filter("rank <= k").drop("k")
    return rows if k < 0 else rows.filter(F.col("rank") <= k)


def aggregate_ranks(ranks: DataFrame, key: str = "alg") -> DataFrame:
    """(node, median_rank, mean_rank): a key that does not rank a node counts with its last rank; halves round to even."""
    last = F.broadcast(ranks.groupBy(key).agg(F.max("rank").alias("last")))
    total = F.broadcast(last.agg(F.sum("last").alias("all_last"), F.count("*").alias("n_keys")))
    got = ranks.join(last, key).crossJoin(total)
    # Each node has the ranks it was given and, for the other keys, their last ranks.
    lasts = F.broadcast(last.agg(F.map_from_entries(F.collect_list(F.struct(key, "last"))).alias("lasts")))
    rows = got.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct(key, "rank"))).alias("own")).crossJoin(lasts)
    rows = rows.select("node", F.explode(F.map_values(F.transform_values("lasts", lambda k, v: F.coalesce(F.try_element_at("own", k), v)))).alias("rank"))
    return rows.groupBy("node").agg(F.bround(F.median("rank"), 1).alias("median_rank"), F.bround(F.avg("rank"), 1).alias("mean_rank"))


def outer_ranks(ranks: DataFrame, keys: list[str], key: str = "alg") -> DataFrame:
    """One row for each node, a column for each key; a key without the node has null."""
    return ranks.groupBy("node").pivot(key, keys).agg(F.first("rank"))


def expand_ks(ks: list[int], ranges: list[tuple[int, int, int]]) -> list[int]:
    """Single values and ranges with exclusive ends, sorted; 100 if there are none."""
    return sorted({*ks, *(x for a, b, step in ranges for x in range(a, b, step))}) or [100]


def first_cover(members: DataFrame, places: DataFrame) -> DataFrame:
    """(node, term): the first term by place that covers the node."""
    rows = members.join(places, "term")
    return rows.groupBy("node").agg(F.min_by("term", F.struct("place", "term")).alias("term"))


def median_deviation(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, mad): median and median absolute deviation."""
    mid = values.groupBy(*keys).agg(F.median(value).alias("median"))
    return values.join(mid, keys).groupBy(*keys).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def first_reaching(rows: DataFrame, keys: list[str], order: str, value: str, cutoff: float) -> DataFrame:
    """The first row by order whose value reaches the cutoff, else the last row."""
    hit = F.min(F.when(F.col(value) >= cutoff, F.col(order)))
    return rows.groupBy(*keys).agg(F.coalesce(hit, F.max(order)).alias(order))


def shares(pairs: DataFrame, key: str, part: str, least: float) -> DataFrame:
    """(key, part, n, share) of a key's rows, where the share is above least."""
    counts = pairs.groupBy(key, part).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    return counts.withColumn("share", share).filter(F.col("share") > least)


def set_report(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: nodes in both, in the first only, in the second only."""
    a, b = (t.select("node").distinct().withColumn(f"in_{k}", F.lit(1)) for k, t in enumerate((one, other)))
    both = a.join(b, "node", "full_outer")
    count = lambda c: F.sum(c.cast("long"))
    i, j = F.col("in_0").isNotNull(), F.col("in_1").isNotNull()
    return both.agg(count(i & j).alias("both"), count(i & ~j).alias("first_only"), count(~i & j).alias("second_only"))


def scaled(value: Column, low: Column, high: Column, a: float, b: float) -> Column:
    return (b - a) * F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0)) + a


def mean_over_repetitions(scores: DataFrame, keys: list[str], repetitions: int) -> DataFrame:
    """The sum of a node's scores over the number of repetitions; a missing score counts 0."""
    return scores.groupBy(*keys).agg((F.sum("score") / F.lit(repetitions)).alias("score"))


def short_name(name: Column, width: int | None = 25) -> Column:
    """A name for display: no quotes; over 50 characters the first 15 and `[...]`; over `width` broken into lines, each past the
    width, after spaces, or after hyphens where there is no space."""
    bare = F.replace(name, F.lit("'"), F.lit(""))
    out = bare
    if width is not None:
        mark = F.when(F.contains(bare, F.lit(" ")), " ").otherwise("-")
        pieces = F.split(bare, F.when(mark == " ", " ").otherwise("-"), -1)
        last = F.size(pieces) - 1
        ended = F.transform(pieces, lambda x, i: F.when(i < last, F.concat(x, mark)).otherwise(x))
        # A break follows a piece that brings its line past the width, unless it is the last.
        start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

        def step(at: Column, piece: Column) -> Column:
            begun = F.when(F.char_length(at["line"]) > width, F.concat(at["done"], at["line"], F.lit("\n"))).otherwise(at["done"])
            line = F.when(F.char_length(at["line"]) > width, piece).otherwise(F.concat(at["line"], piece))
            return F.struct(begun.alias("done"), line.alias("line"))

        wrapped = F.aggregate(ended, start, step, lambda at: F.concat(at["done"], at["line"]))
        out = F.when((F.char_length(bare) > width) & bare.rlike("[ -]"), wrapped).otherwise(bare)
    return F.when(F.char_length(bare) > 50, F.concat(F.substring(bare, 1, 15), F.lit("[...]"))).otherwise(out)


#: Where publications of a kind stand, the site's name, and the name that the link shows.
PUBLICATIONS = {
    "pubmed": ("http://www.ncbi.nlm.nih.gov/pubmed/", "PubMed", "pmid"),
    "doi": ("http://dx.doi.org/", "DOI", "doi"),
    "omim": ("http://omim.org/entry/", "OMIM", "omim"),
    "imex": ("http://www.ebi.ac.uk/intact/imex/main.xhtml?query=", "IMEX", "imex"),
    "phosphosite": ("http://www.phosphosite.org/siteAction.action?id=", "PSP", "phosphosite"),
    "netpath": ("http://www.netpath.org/reactions?path_id=", "NetPath", "netpath"),
}
#: Pathways have two pages; kinds whose hyphens mustn't break a line, and the hyphen that doesn't.
PATHWAYS = (("http://www.kegg.jp/kegg-bin/show_pathway?", "map"), ("http://www.kegg.jp/dbget-bin/www_bget?pathway+", "evidence"))
UNBROKEN, HYPHEN = ("doi", "imex"), "&#8209;"
#: Pages of nodes.
NODE_PAGES = {"uniprot": ("Uniprot ID", "http://www.uniprot.org/uniprot/", "UniProtKB"), "drugbank": ("DrugBank ID", "https://www.drugbank.ca/drugs/", "DrugBank")}


def _link(url: Column, site: str, text: Column) -> Column:
    return F.concat(F.lit('<a style="color:blue" href="'), url, F.lit(f'" target="{site}">'), text, F.lit("</a>"))


def publication_link(pub: Column) -> Column:
    """A link to a publication by the prefix of its id; other ids, and kinds without pages, give an empty text."""
    kind, value = F.split_part(pub, F.lit(":"), F.lit(1)), F.split_part(pub, F.lit(":"), F.lit(2))
    out = F.lit("")
    for prefix, (site, name, shown) in PUBLICATIONS.items():
        text = F.replace(value, F.lit("-"), F.lit(HYPHEN)) if prefix in UNBROKEN else value
        out = F.when(kind == prefix, _link(F.concat(F.lit(site), value), name, F.concat(F.lit(f"{shown}:"), text))).otherwise(out)
    pages = [_link(F.concat(F.lit(site), value), "KEGG", F.lit(name)) for site, name in PATHWAYS]
    return F.when(kind == "kegg", F.concat_ws(",&nbsp", *pages)).otherwise(out)


def _notes(notes: Column | None) -> Column:
    """Names and values (a map) as lines, in order of the names."""
    if notes is None:
        return F.lit("")
    rows = F.transform(F.sort_array(F.map_keys(notes)), lambda k: F.concat(F.lit("<b>"), k, F.lit("</b>: "), F.element_at(notes, k), F.lit("</br>")))
    return F.when(F.coalesce(F.size(notes), F.lit(0)) > 0, F.concat(F.lit("<hr />"), F.array_join(rows, ""))).otherwise("")


def node_popup(node: Column, kind: str = "uniprot", notes: Column | None = None) -> Column:
    """The text shown for a node: a link to its page, if its kind has one, and notes (a map)."""
    head = F.concat(node, F.lit("</br>"))
    if kind in NODE_PAGES:
        title, site, name = NODE_PAGES[kind]
        head = F.concat(F.lit(f"<b>{title}</b>: "), _link(F.concat(F.lit(site), node), name, node), F.lit("<br>"))
    return F.concat(head, _notes(notes))


def edge_popup(src: Column, dst: Column, names: tuple[Column, Column] | None = None, notes: Column | None = None) -> Column:
    """The text shown for an edge: its ends, their names where both have one, and notes (a map)."""
    pair = lambda a, b: F.concat(F.lit("<b>"), a, F.lit(" - "), b, F.lit("</b></br>"))
    named = F.coalesce(pair(*names), F.lit("")) if names else F.lit("")
    return F.concat(pair(src, dst), named, _notes(notes))


def large_enough(labels: DataFrame) -> DataFrame:
    """Labels of the terms with two positives and two negatives at least."""
    n = lambda label: F.count_if(F.col("label") == label)
    good = labels.groupBy("term").agg(n(1).alias("p"), n(-1).alias("n")).filter("p > 1 and n > 1")
    return labels.join(good.select("term"), "term", "left_semi")


def attach_evidence(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence (src, dst, ...) whose pair, in either direction, is an edge."""
    ends = F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")
    return evidence.select("*", *ends).join(edges.select(*ends).distinct(), ["u", "v"], "left_semi").drop("u", "v")


def fix_ranks(scores: DataFrame, keys: list[str], width: float) -> DataFrame:
    """scores with `fixed`: the interval [score, score + width] meets neither neighbour's in score order; 0 is never fixed."""
    order = Window.partitionBy(*keys).orderBy("score", "node")
    apart = F.coalesce(F.lag("score").over(order) + width < F.col("score"), F.lit(True)) & F.coalesce(F.col("score") + width < F.lead("score").over(order), F.lit(True))
    return scores.withColumn("fixed", apart & (F.col("score") > 0))


#: Fixed values of the layout: a cell's width and height, gaps between groups and rows of groups, the width for each group of a row.
CELL_X, CELL_Y, GROUP_GAP, ROW_GAP, GROUP_WIDTH = 75.0, 55.0, 30.0, 120.0, 400.0


def grid_layout(members: DataFrame) -> DataFrame:
    """(grp, node, x, y): each group a near-square grid of its nodes by name, the groups by falling size (ties by name) in rows.

    Where a group begins follows from a fold over the table of groups, of which a picture has few; nodes are placed by windows."""
    members = members.select("grp", "node").distinct()
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"))
    line = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "grp"))).alias("groups"))
    columns = lambda n: F.ceil(F.sqrt(n.cast("double"))).cast("double")
    limit = GROUP_WIDTH * columns(F.size("groups"))
    kind = "struct<x:double,y:double,low:double,placed:array<struct<grp:string,cols:double,x0:double,y0:double>>>"

    def step(at: Column, g: Column) -> Column:
        n = -g["minus"]
        cols = columns(n)
        bottom = F.greatest(at["low"], at["y"] + CELL_Y * (F.ceil(n / cols) - 1))
        right = at["x"] + cols * CELL_X + GROUP_GAP
        wrap = right > limit
        one = F.array(F.struct(g["grp"].alias("grp"), cols.alias("cols"), at["x"].alias("x0"), at["y"].alias("y0")))
        return F.struct(
            F.when(wrap, 0.0).otherwise(right).alias("x"),
            F.when(wrap, bottom + ROW_GAP).otherwise(at["y"]).alias("y"),
            F.when(wrap, 0.0).otherwise(bottom).alias("low"),
            F.concat(at["placed"], one).alias("placed"),
        ).cast(kind)

    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("low"), F.array().alias("placed")).cast(kind)
    places = line.select(F.inline(F.aggregate("groups", start, step)["placed"]))
    nth = F.row_number().over(Window.partitionBy("grp").orderBy("node")) - 1
    rows = members.withColumn("j", nth).join(places, "grp")
    return rows.select("grp", "node", (F.col("x0") + CELL_X * F.pmod("j", "cols")).alias("x"), (F.col("y0") + CELL_Y * F.floor(F.col("j") / F.col("cols"))).alias("y"))


def columns_at(table: DataFrame, *places: int) -> DataFrame:
    """Columns by their places from 0."""
    return table.select(*[F.col(f"`{table.columns[k]}`") for k in places])


def constant_weight(edges: DataFrame, weight: float = 1) -> DataFrame:
    """Distinct edges, all of one weight."""
    return edges.select("src", "dst").distinct().withColumn("weight", F.lit(weight))


def approved(drugs: DataFrame, groups: str, group: str, *needed: str) -> DataFrame:
    """Rows whose list of groups (parted by `|`) has the group, and whose needed columns are filled."""
    rows = drugs.filter(F.array_contains(F.split(F.col(groups), r"\|"), group))
    return rows.dropna(subset=list(needed)) if needed else rows


def below_false_discovery(rows: DataFrame, rate: Column, cutoff: float) -> DataFrame:
    return rows.filter(rate <= cutoff)


def labels_of(labels: DataFrame, term: str, label: int) -> DataFrame:
    """(node): a term's positives (1) or negatives (-1)."""
    return labels.filter((F.col("term") == term) & (F.col("label") == label)).select("node")


def aligned_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, term, label) for all nodes; 0 and no term for those without a label."""
    return nodes.join(labels, "node", "left").select("node", "term", F.coalesce("label", F.lit(0)).alias("label"))


def joined_list(column: str, separator: str, distinct: bool = False) -> Column:
    """The sorted values of a group as one text."""
    values = F.collect_set(column) if distinct else F.collect_list(column)
    return F.array_join(F.sort_array(values).cast("array<string>"), separator)


def attach_lists(rows: DataFrame, key: str, value: str, name: str, separator: str = "|", distinct: bool = False) -> DataFrame:
    """(key, n, name): the number of a key's values, and the sorted values as one text."""
    count = F.count_distinct(value) if distinct else F.count("*")
    return rows.groupBy(key).agg(count.alias("n"), joined_list(value, separator, distinct).alias(name))


def groups_of_nodes(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(grp, n, first): the groups of some nodes, their number of them and the least."""
    return groups.join(nodes.select("node").distinct(), "node").groupBy("grp").agg(F.count("*").alias("n"), F.min("node").alias("first"))


def pairs_of(scores: DataFrame, key: str = "alg") -> DataFrame:
    """(node, one, two, x, y): for each node its scores by each pair of keys."""
    one = scores.select("node", F.col(key).alias("one"), F.col("score").alias("x"))
    return one.join(scores.select("node", F.col(key).alias("two"), F.col("score").alias("y")), "node").filter("one < two").select("node", "one", "two", "x", "y")


def submatrix(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, weight, a, b): edges between labelled nodes, with both labels."""
    ends = lambda end, name: labels.select(F.col("node").alias(end), F.col("label").alias(name))
    return edges.join(ends("src", "a"), "src").join(ends("dst", "b"), "dst").select("src", "dst", "weight", "a", "b")


def reach_of_members(outer: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(outer, term, n): edges from an outer node's partners (outer, src) to the members of a term."""
    return outer.join(edges.select("src", F.col("dst").alias("node")).distinct(), "src").join(members, "node").groupBy("outer", "term").agg(F.count("*").alias("n"))


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def overview(rows: DataFrame, key: str, value: str, digits: int = 6) -> DataFrame:
    """(key, median, n) of a value."""
    return rows.groupBy(key).agg(F.round(F.median(value), digits).alias("median"), F.count("*").alias("n"))


def distinct_by(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count_distinct(value).alias(name))


def mean_by(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias(name))


def sum_by(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(value).alias(name))


def pivoted(scores: DataFrame, keys: list[str], key: str = "alg") -> DataFrame:
    """One row for each node, a column with its score for each of the keys."""
    return scores.groupBy("node").pivot(key, keys).agg(F.first("score")).select("node", *keys)


def prefix_of(name: Column, separator: str = ".") -> Column:
    """The part of a name before the separator: the group that some ids begin with."""
    return F.split_part(name, F.lit(separator), F.lit(1))


def places_by(rows: DataFrame, value: str, node: str) -> DataFrame:
    """rows with `place` from 1 by falling value, ties by node, in ranges of the whole table."""
    return Ordered(rows, F.desc(value), node).rank("place").table()
