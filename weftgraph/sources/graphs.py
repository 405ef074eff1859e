"""Styled graphs as files: a JSON object for each node and edge, with labels, texts, groups and styles.

The file is what a graph viewer reads, line by line; publishing it is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Styles of nodes and of edges where none is given, and the color of both.
NODE_STYLES = {"shape": "ellipse", "width": "45", "height": "45"}
EDGE_STYLES = {"width": "1.5", "line-style": "solid"}
COLOR = "#D8D8D8"
#: Edges of a task, on average.
TASK_EDGES = 1 << 18
ELEMENT = "group string, id string, label string, parent string, source string, target string, directed boolean, popup string, style map<string,string>"


def _given(styles: DataFrame, tasks: int, *by: str) -> DataFrame:
    """A map of styles for each item; of a style given twice, the greatest value."""
    one = styles.filter("style is not null and value is not null").repartition(tasks, *by).groupBy(*by, "style").agg(F.max("value").alias("value"))
    return one.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("style", "value"))).alias("given"))


def _over(defaults: dict[str, Column], given: Column) -> Column:
    """Defaults, and what is given instead of them or beside them, by name; `color` has become another style."""
    own = F.map_filter(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda k, _: k != "color")
    base = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), v)])
    both = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)
    return F.map_from_entries(F.array_sort(F.map_entries(both)))


def graph_elements(edges: DataFrame, nodes: DataFrame, styles: DataFrame) -> DataFrame:
    """Elements (ELEMENT) of a graph: edges (src, dst; directed, popup), nodes (node; label, popup, parent), styles (item, other,
    style, value; other null for nodes). The columns behind the semicolons may be missing or null.

    Ends of edges that `nodes` lacks are nodes too, without a label. A node without a label is called by its name. Of nodes with one
    label the first by name keeps it, others get their name behind it, so that no two nodes are drawn as one. Without a text a node shows
    its name, an edge its ends. Rows of null ends or nodes go; repeated ones count once, with the greatest values.

    Tasks are as many as the edges ask for, and nodes of a label never meet in one: that a node is its label's first is told by its name."""
    has = lambda df, *names: df.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in names if c not in df.columns])
    edges, nodes = has(edges, ("directed", "boolean"), ("popup", "string")), has(nodes, ("label", "string"), ("popup", "string"), ("parent", "string"))
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // TASK_EDGES))
    edges = edges.filter("src is not null and dst is not null").repartition(tasks, "src", "dst").groupBy("src", "dst").agg(F.max("directed").alias("directed"), F.max("popup").alias("popup"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).select("node", *[F.lit(None).cast("string").alias(c) for c in ("label", "popup", "parent")])
    nodes = nodes.select("node", "label", "popup", "parent").unionByName(ends).filter("node is not null")
    nodes = nodes.repartition(tasks, "node").groupBy("node").agg(*[F.max(c).alias(c) for c in ("label", "popup", "parent")]).withColumn("label", F.coalesce("label", "node"))
    first = nodes.groupBy("label").agg(F.min("node").alias("first"))
    shown = F.when(F.col("first").isNotNull(), F.col("label")).otherwise(F.concat_ws("-", "label", "node"))
    named = nodes.join(first.select("first"), F.col("node") == F.col("first"), "left").select("node", shown.alias("label"), "popup", "parent")
    style = named.join(_given(styles.filter("other is null"), tasks, "item"), F.col("node") == F.col("item"), "left")
    color = F.coalesce(F.get(F.map_values(F.map_filter("given", lambda k, _: k == "color")), F.lit(0)), F.lit(COLOR))
    node_style = _over({**{k: F.lit(v) for k, v in NODE_STYLES.items()}, "background-color": color, "border-color": color}, F.col("given"))
    null = lambda kind: F.lit(None).cast(kind)
    points = style.select(
        F.lit("nodes").alias("group"), F.col("node").alias("id"), "label", "parent", null("string").alias("source"), null("string").alias("target"), null("boolean").alias("directed"),
        F.coalesce("popup", "node").alias("popup"), node_style.alias("style"),
    )
    lines = edges.join(_given(styles.filter("other is not null"), tasks, "item", "other"), (F.col("src") == F.col("item")) & (F.col("dst") == F.col("other")), "left")
    names = named.select("node", "label")
    lines = lines.repartition(tasks, "src").join(names.select(F.col("node").alias("src"), F.col("label").alias("source")), "src")
    lines = lines.repartition(tasks, "dst").join(names.select(F.col("node").alias("dst"), F.col("label").alias("target")), "dst")
    edge_style = _over({**{k: F.lit(v) for k, v in EDGE_STYLES.items()}, "line-color": color}, F.col("given"))
    pair = F.concat_ws("-", "src", "dst")
    return points.unionByName(lines.select(
        F.lit("edges").alias("group"), pair.alias("id"), null("string").alias("label"), null("string").alias("parent"), "source", "target", F.coalesce("directed", F.lit(False)).alias("directed"),
        F.coalesce("popup", pair).alias("popup"), edge_style.alias("style"),
    ))


def write_graph(elements: DataFrame, path: str) -> None:
    """Elements as JSON lines, a folder for nodes and one for edges, committed at once: a job that fails leaves no marker."""
    elements.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").partitionBy("group").json(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a graph's file; one that was not written to its end is an error."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        raise ValueError(f"no whole graph in {path}")
    return spark.read.schema(ELEMENT).json(path)
