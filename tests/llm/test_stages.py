"""The pipeline's stages on nulls, empty and long texts, repeated rows and clashing names: what each leaves."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

PROSE = "The river rose in the night, and by morning the lower fields were under water. Nobody had seen it so high since the old mill stood."
LONG = " ".join(f"word{k % 977} of{k}." for k in range(30_000))
ROWS = [
    (1, None, None),
    (2, "", 0),
    (3, PROSE, len(PROSE)),
    (3, PROSE, len(PROSE)),
    (4, PROSE + " Home at last.\nHome\nNews\nShop\nMail", -1),
    (None, LONG, len(LONG)),
    (5, PROSE.replace("river", "sea").replace("night", "spring") + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', 5),
    (6, "few words", 9),
]
DOCS = "doc_id long, text string, n_chars long, judged int, print string, overlap string, secrets string"


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("in"))
    spark.createDataFrame([(1, LONG[:300]), (None, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def _run(spark, bench, name, rows):
    docs = spark.createDataFrame([(*r, 7, "p", None, "s") for r in rows], DOCS)
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, bench)
    assert name.startswith("Sentence") or out.dtypes == docs.dtypes
    return sorted(((r.doc_id, r.text, r.n_chars, r.judged, r.print) if name[0] != "S" else (r.doc_id, r.n_tokens, r.round_trip) for r in out.collect()), key=repr)


def test_quality(spark, bench):
    got = _run(spark, bench, "quality rules", ROWS)
    menu = PROSE + " Home at last."
    want = [(3, PROSE, len(PROSE)), (3, PROSE, len(PROSE)), (4, menu, len(menu)), (None, LONG, len(LONG)), ROWS[6]]
    assert got == sorted(((*r, 7, "p") for r in want), key=repr)


def test_copies(spark, bench):
    got = _run(spark, bench, "n-gram Jaccard join", ROWS + [(9, LONG + " end", 1)])
    want = [ROWS[0], ROWS[1], ROWS[2], *ROWS[6:], (9, LONG + " end", 1)]
    shares = [r for r in got if r[0] == 4]
    assert sorted((r for r in got if r[0] != 4), key=repr) == sorted(((*r, 7, "p") for r in want), key=repr) and len(shares) <= 1


def test_contaminated(spark, bench):
    got = _run(spark, bench, "benchmark decontamination", [*ROWS, (8, LONG[:400], 8)])
    assert got == sorted(((*r, 7, "p") for r in ROWS), key=repr)


def test_secrets(spark, bench):
    got = _run(spark, bench, "secret scans", ROWS)
    assert [r for r in got if r[0] != 5] == sorted(((*r, 7, "p") for r in ROWS if r[0] != 5), key=repr)
    (hit,) = (r for r in got if r[0] == 5)
    assert "24be" not in hit[1] and hit[2] == len(hit[1])


def test_encoding(spark, bench):
    got = _run(spark, bench, "SentencePiece encoding and decoding", ROWS)
    assert len(got) == len(ROWS) and (1, 0, None) in got and (2, 0, True) in got and all(r[2] is not False for r in got)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_nothing_comes_of_nothing(spark, bench, name):
    assert _run(spark, bench, name, []) == []
