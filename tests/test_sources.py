"""Readers and writers over small files, and the stream of edges."""

import gzip

import pytest
from pyspark.sql import functions as F

from weftgraph.sources import drugs, graphs, readers
from weftgraph.streaming.edges import windowed_edges


def _file(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    return str(path)


def test_edges(spark, tmp_path):
    path = _file(tmp_path, "e.tsv.gz", "#head\na\tb\t2.5\nb\tc\n")
    assert sorted(map(tuple, readers.read_edges(spark, path).collect())) == [("a", "b", 2.5), ("b", "c", 1.0)]


def test_channels(spark, tmp_path):
    assert readers.channels("core,textmining,core") == [*readers.CORE, "textmining"] and len(readers.channels("all")) == 13
    with pytest.raises(ValueError):
        readers.channels("nothing")
    rows = [["a", "b", *["0"] * 12, "7", "500"], ["c", "d", *["0"] * 13, "900"], ["e", "f", *["1"] * 13, "100"]]
    path = _file(tmp_path, "c.tsv", "#x\n" + "\n".join("\t".join(r) for r in rows))
    edges, nodes = readers.read_channels(spark, path, "all", 400)
    assert [tuple(r) for r in edges.collect()] == [("a", "b", "textmining_transferred", 7.0)]
    assert sorted(r.node for r in nodes.collect()) == ["a", "b", "c", "d"]


def test_labels(spark, tmp_path):
    table = _file(tmp_path, "t.txt", "prots\tone\ttwo\na\t1\t0\nb\t-1\t1\n")
    assert sorted(map(tuple, readers.read_label_table(spark, table).collect())) == [("one", "a", 1), ("one", "b", -1), ("two", "b", 1)]
    lines = _file(tmp_path, "l-list.txt", "one\t1\ta,b\none\t-1\tc\ntwo\t1\td\n")
    assert sorted(map(tuple, readers.read_label_list(spark, lines, ["one"]).collect())) == [("one", "a", 1), ("one", "b", 1), ("one", "c", -1)]


def test_gmt(spark, tmp_path):
    sets = readers.read_gmt(spark, _file(tmp_path, "s.gmt", "#c\nx\tan x\ta\tb\ny\t\nz\td\tc\n"))
    assert sorted((r.name, r.description, r.members) for r in sets.collect()) == [("x", "an x", ["a", "b"]), ("y", "", []), ("z", "d", ["c"])]
    readers.write_gmt(sets, str(tmp_path / "out"))
    assert readers.read_gmt(spark, str(tmp_path / "out")).count() == 3


def test_mappings(spark, tmp_path):
    path = _file(tmp_path, "m.tsv", "p1\tGene\tg1\np1\tother\to1\n")
    assert [r.alternate for r in readers.read_id_list(spark, path, ["GENE"]).collect()] == ["g1"] and readers.read_id_list(spark, path).count() == 2
    table = _file(tmp_path, "t.tsv", "Entry\tGene names\tOrganism ID\np1\tg1 g2\t9606\np2\t\t9606\n")
    assert sorted(r.alternate for r in readers.read_id_table(spark, table, "Entry", ["Gene names"], " ").collect()) == ["g1", "g2"]


def test_cells_json_columns(spark, tmp_path):
    path = _file(tmp_path, "d.csv", 'k,Drug IDs\n1,"a; b"\n2,\n')
    assert sorted((r.k, r["Drug IDs"]) for r in readers.read_cells(spark, path, "Drug IDs", "; ").collect()) == [("1", "a"), ("1", "b")]
    js = _file(tmp_path, "p.json", '{"name": "p", "xrefs": ["u:1", "u:2"]}')
    assert sorted(r.xref for r in readers.read_xrefs(spark, js).collect()) == ["u:1", "u:2"]
    cols = _file(tmp_path, "x.txt", "#c\na\tb\tc\nshort\n")
    assert [tuple(r) for r in readers.read_columns(spark, cols, 3, 1).collect()] == [("c", "a")]


def test_drugs(spark, tmp_path):
    one = "<drug><drug_id>D1</drug_id><name>n</name><groups><group>approved</group><group>x</group></groups><targets><target><id>P1</id><actions><action>i</action></actions></target><target><id>P2</id><id>P3</id></target></targets></drug>"
    rows = readers.read_drugs(spark, _file(tmp_path, "d.xml", f"<all>{one}</all>")).collect()
    assert [tuple(r) for r in rows] == [("D1", "n", "approved|x", "P1", "i")]


def test_styles(spark, tmp_path):
    path = _file(tmp_path, "s.txt", "color\tred\ta|b|a-b\tfirst\ncolor\tblue\ta\tsecond\n")
    assert sorted((r.item, r.other or "", r.value) for r in readers.read_styles(spark, path).collect()) == [("a", "", "blue"), ("a", "b", "red"), ("b", "", "red")]


def test_written_scores_and_results(spark, tmp_path):
    scores = spark.createDataFrame([("t", "a", 0.5), ("t", "b", 0.0), ("t", "c", 0.25)], "term string, node string, score double")
    readers.write_scores(scores, str(tmp_path / "s"))
    back = spark.read.csv(str(tmp_path / "s"), sep="\t", header=True).collect()
    assert sorted((r.prot, r.score) for r in back) == [("a", "5.0000e-01"), ("c", "2.5000e-01")]
    for _ in range(2):
        readers.append_results(scores.withColumn("alg", F.lit("x")), str(tmp_path / "r"), "alg")
    assert readers.read_results(spark, str(tmp_path / "r"), alg=["x"]).count() == 3
    readers.split_by_group(spark.createDataFrame([("9606.a", "9606.b")], "src string, dst string"), F.split_part("src", F.lit("."), F.lit(1)), str(tmp_path / "g"))
    assert (tmp_path / "g" / "group=9606").is_dir()


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_edges(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 day")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("edges_now").start()
    query.processAllAvailable()
    query.stop()
    key = lambda t: sorted((str(r.start), r.src, r.dst, r.weight) for r in t.collect())
    assert key(spark.table("edges_now")) == key(windowed_edges(events, "1 day"))


def test_drug_dump(spark, tmp_path):
    protein = lambda ids, more="": f"<target><organism>Humans</organism><known-action>yes</known-action><actions><action>a</action><action>b</action></actions>{more}<polypeptide><external-identifiers>" + "".join(
        f"<external-identifier><resource>{r}</resource><identifier>{i}</identifier></external-identifier>" for r, i in ids
    ) + "</external-identifiers></polypeptide></target>"
    cited = "<references><articles><article><pubmed-id>1</pubmed-id><citation>x</citation></article><article><pubmed-id/><citation>y</citation></article><article><pubmed-id>2</pubmed-id><citation>z</citation></article></articles></references>"
    full = (
        '<drug type="small molecule"><drugbank-id>old</drugbank-id><drugbank-id primary="true">D1</drugbank-id><name>n</name><groups><group>approved</group><group>x</group></groups>'
        '<atc-codes><atc-code code="A1"><level code="A">l</level></atc-code></atc-codes><categories><category><category>c</category></category></categories>'
        "<calculated-properties><property><kind>InChI</kind><value>1S</value></property></calculated-properties>"
        '<synonyms><synonym language="English">s</synonym><synonym language="German">g</synonym></synonyms><products><product><name>b</name></product><product><name>n</name></product></products>'
        f"<targets>{protein([('UniProtKB', 'P1'), ('other', 'o')], cited)}{protein([('UniProtKB', 'P2'), ('UniProtKB', 'P3')])}</targets><enzymes/></drug>"
    )
    bare = '<drug type="biotech"><drugbank-id primary="true">D2</drugbank-id></drug>'
    path = _file(tmp_path, "dump.xml", f"<drugs>{full}{bare}</drugs>")
    table = {r.drug_id: r for r in drugs.read_drug_table(spark, path).collect()}
    one, two = table["D1"], table["D2"]
    assert (one.type, one.groups, one.atc_codes, one.categories, one.inchi, one.inchikey, one.aliases) == ("small molecule", "approved|x", "A1", "c", "1S", None, ["b", "n", "s"])
    assert (two.name, two.groups, two.inchi, two.aliases) == (None, "", None, [])
    assert [tuple(r) for r in drugs.read_drug_proteins(spark, path).collect()] == [("D1", "n", "target", "Humans", "yes", "a|b", "P1", "1|2", "x|z")]
    assert [r.drug_id for r in drugs.approved_small_molecules(drugs.read_drug_table(spark, path)).collect()] == ["D1"]


def test_graph_elements(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", True, None), ("a", "b", None, "text"), ("b", "c", None, None), ("a", None, None, None)], "src string, dst string, directed boolean, popup string")
    nodes = spark.createDataFrame([("a", "same", "g"), ("b", "same", None), ("d", None, None), (None, "x", None)], "node string, label string, parent string")
    styles = spark.createDataFrame([("a", None, "color", "red"), ("a", None, "width", "60"), ("a", None, "width", "50"), ("a", "b", "color", "blue"), ("a", "b", "arrow", "vee"), ("b", "a", "width", "9"), ("c", None, "border-color", None)], "item string, other string, style string, value string")
    path = str(tmp_path / "graph")
    graphs.write_graph(graphs.graph_elements(edges, nodes, styles), path)
    got = {r.id: r for r in graphs.read_graph(spark, path).collect()}
    assert set(got) == {"a", "b", "c", "d", "a-b", "b-c"}
    assert [got[x].label for x in "abcd"] == ["same", "same-b", "c", "d"] and got["a"].parent == "g" and got["a"].popup == "a"
    assert got["a"].style == {"background-color": "red", "border-color": "red", "height": "45", "shape": "ellipse", "width": "60"} and got["c"].style["border-color"] == "#D8D8D8"
    assert (got["a-b"].source, got["a-b"].target, got["a-b"].directed, got["a-b"].popup) == ("same", "same-b", True, "text")
    assert got["a-b"].style == {"arrow": "vee", "line-color": "blue", "line-style": "solid", "width": "1.5"} and got["b-c"].style["width"] == "1.5" and not got["b-c"].directed
    empty = graphs.graph_elements(edges.limit(0), nodes.limit(0), styles.limit(0))
    assert empty.collect() == []


def test_graph_that_fails_leaves_nothing(spark, tmp_path):
    bad = spark.range(8).select(F.lit("a").alias("src"), F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("dst"))
    none = spark.createDataFrame([], "item string, other string, style string, value string")
    with pytest.raises(Exception, match="broken"):
        graphs.write_graph(graphs.graph_elements(bad, spark.createDataFrame([], "node string"), none), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="no whole graph"):
        graphs.read_graph(spark, str(tmp_path / "bad"))
