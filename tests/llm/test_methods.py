"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on the smallest tables."""

import random

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import decontaminate, html_extract, language_id, ngram_join, piece_codec, quality_rules, secret_scan, sharding, url_filter, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


def test_overlap(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = decontaminate.overlap_digest(docs, bench).collect()
    assert any(r.contaminated for r in rows)
    for r in rows:
        assert tuple(r)[1:6] == decontaminate.brute_force(texts[r.doc_id], items)
        assert sum(len(decontaminate.words_of(texts[r.doc_id][s.start : s.end].encode())) for s in r.spans) == r.n_hit


def test_overlap_in_blocks(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = decontaminate.overlap_digest(docs, bench).orderBy("doc_id").collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    assert len(decontaminate._blocks(bench, "item_id", "text")) > 3
    assert decontaminate.overlap_digest(docs, bench).orderBy("doc_id").collect() == whole


def _cluster(words, rng):
    base = [rng.choice(words) for _ in range(120)]
    out = [base]
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(copy[: rng.randrange(100, 121)])
    return out


def test_links(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = [t for _ in range(6) for t in _cluster(words, rng)]
    texts += [[*passage, *[rng.choice(words) for _ in range(rng.randrange(0, 20))]] for _ in range(60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(500, "A b c"), (501, "a B c"), (502, None), (503, ""), (504, "a b")]
    got = sorted(tuple(r) for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(ngram_join.brute_force(rows))


def test_links_of_groups(spark, monkeypatch):
    """Sets with equal prefixes and sizes make a group; its members are still told apart."""
    monkeypatch.setattr(ngram_join, "prefix_size", lambda n: 1 if n else 0)
    made = ngram_join._documents(spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j")], "key long, text string"), np.zeros(ngram_join.SKETCH, np.uint8))
    assert made.select("grp").distinct().count() == 2


def test_bitmaps_never_lose_a_link():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 700):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: max(1, n // 2)], rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64)]))
        assert ngram_join._apart(ngram_join._bitmap(x), ngram_join._bitmap(y)) <= len(np.setxor1d(x, y))


def test_secrets(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in secret_scan.secret_digest(docs).collect():
        assert tuple(r)[1:5] == secret_scan.brute_force(texts[r.doc_id])
    for t in ('secret:token:abcdefgh', "toKen == 'abc' api_key=\"x.y/z-123\"", "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 13, "ſecret=abcdefgh", "0" * 23 + "g" + "a" * 24):
        spans = secret_scan._chars(t.encode(), secret_scan.base_spans(t.encode()))
        assert tuple(sum(s[0] == k for s in spans) for k in secret_scan.KINDS[:3]) == secret_scan.brute_force(t)[:3]


def test_novelty():
    found = lambda t: secret_scan.Novelty().spans(t.encode(), secret_scan.base_spans(t.encode()))
    assert found("credential for the build is q8Zr4Lk0Wm2Xv9Tb7Yc1Pd5N, keep it") and not found("credential for the build is password_password_password_123, keep it")
    assert not found("a plain q8Zr4Lk0Wm2Xv9Tb7Yc1Pd5N with no context")


def test_codec(docs):
    vocabulary = piece_codec.Vocabulary(piece_codec.default_model())
    codec = piece_codec.Codec(vocabulary)
    texts = ["", " ", "a", "hello  world\n\nfoo ▁ bar", "日本語 𝄞\x00\t", "  x  " * 9] + [r.text for r in docs.collect() if r.text][:60]
    for t in texts:
        ids = codec.encode(t).tolist()
        assert ids == piece_codec.brute_force(t, vocabulary) and codec.decode(ids) == t


def test_codec_round_trip(docs):
    rows = piece_codec.encode_digest(docs).collect()
    assert all(r.round_trip for r in rows) and sum(r.n_tokens for r in rows) > 10_000
    both = piece_codec.decode_ids(piece_codec.encode_texts(docs)).filter("decoded <> text")
    assert both.count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_tables_equal_the_filters():
    net = language_id.ByteNet(["a", "b"])
    net.pair()
    rows, _, _ = language_id.windows_of(np.frombuffer("some bytes é".encode() * 30, np.uint8), np.array([0, 360]))
    direct = [max(sum(net.w[k][j][rows[0, i + j], f] for j in range(k)) for i in range(language_id.WINDOW - k + 1)) for k in net.WIDTHS for f in range(language_id.FILTERS)]
    hidden = np.maximum(np.array(direct, np.float32) + net.b, 0)
    assert np.allclose(net.predict(rows[:1]), language_id._softmax((hidden @ net.out + net.bias)[None]), atol=1e-5)


def test_shuffle_is_repeatable_and_spread(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "repeat('x', int(doc_id % 7)) as text")
    one, two = ({r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_records(x, "doc_id", 8, 5).collect()} for x in (rows, rows.repartition(3)))
    assert one == two and len(one) == 5000
    first = [k for k, (_, slot) in one.items() if slot < 100]
    assert abs(np.mean(first) - 2500) < 250


def test_shards_are_written(spark, tmp_path):
    rows = spark.range(300).selectExpr("id as doc_id", "cast(id as string) as text")
    sharding.write_shards(rows, "doc_id", str(tmp_path / "out"), 4, 3)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.doc_id for r in back) == list(range(300)) and {r.shard for r in back} == {0, 1, 2, 3}


def test_site_parts_go():
    html = """<html><body><header><h1>Site</h1></header><div id="main-menu"><a>x</a></div><main><article><header><h1>Title</h1></header>
    <p>One &amp; <b>t</b>wo<br>three</p><div class="cookie-notice">n</div><ul><li>a<li>b</ul><form>f<input></form><script>if (a<b) "</p>"</script>
    <section class="comments"><p>nice</p></section></article></main><aside>s</aside><div class="sidebar">q</div><div class="ad">buy</div><footer>f</footer></body>"""
    assert html_extract.main_text(html, None) == "Title\nOne & two three\na\nb"


def test_bloom_passes_all_listed(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '.example.com/') as key")
    bloom = url_filter.BlockedBloom(listed)
    keyed = listed.selectExpr("key as url", "array(key) as keys")
    assert bloom.possible(keyed).count() == 3000
    other = spark.range(3000).selectExpr("'u' as url", "array(concat('g', id, '.example.com/')) as keys")
    assert bloom.possible(other).count() < 60


def test_canonical_keys(spark):
    rows = spark.createDataFrame([("http://WWW.a.b.example.com:80//x/y/?q=1#z",)], "url string")
    keys = rows.select(url_filter.canonical_keys(url_filter.host_of(rows.url), url_filter.path_of(rows.url)).alias("k")).first().k
    assert {"a.b.example.com/x/y", "b.example.com/x/", "example.com/"} <= set(keys)
    assert rows.select(url_filter.canonical(rows.url).alias("c")).first().c == "a.b.example.com/x/y"


def test_warc_round_trip(spark, pages, tmp_path):
    records = warc.derivatives(pages)
    warc.write_warc(records.drop("page_id"), str(tmp_path / "members"))
    data = b"".join(r.member for r in spark.read.parquet(str(tmp_path / "members")).collect())
    back = {h["warc-record-id"]: (h, b) for h, b in (({k.lower(): v for k, v in h}, b) for h, b in warc.parse_warc(data))}
    rows, html = records.collect(), {r.page_id: r.html for r in pages.collect()}
    assert len(back) == len(rows) == 2 * pages.count()
    for r in rows:
        head, block = back[r.record_id]
        assert block.decode() == r.block and head["warc-refers-to"] == r.refers_to and head["warc-block-digest"] == r.block_digest == warc.digest(block)
        assert head["x-source-payload-digest"] == warc.digest(html[r.page_id].encode()) and head["x-source-header-content-type"] == "text/html; charset=utf-8"
    source = {r.record_id for r in warc.responses_of(pages).collect()}
    assert {r.refers_to for r in rows} == source


def test_responses_are_read(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nServer: s\r\n\r\n<p>Hello &amp; bye</p>"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(http)}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(head.encode() + http + b"\r\n\r\n")
    rows = {r.record_type: r for r in warc.derive(warc.read_responses(spark, str(tmp_path / "a.warc"))).collect()}
    assert rows["conversion"].block == "Hello & bye" and rows["conversion"].refers_to == "<urn:uuid:1>" and rows["conversion"].date == "2024-01-01T00:00:00Z"
    assert "source-header-Server: s" in rows["metadata"].block and ("header-Content-Type", "text/html") in [tuple(h) for h in rows["metadata"].headers]


def test_lines(spark):
    rows = spark.createDataFrame([(1, "\n".join(["A plain line with enough words to be kept in here."] * 3 + ["home | news | sport | mail | more"])), (2, "home | news | sport | mail | more\n" * 9), (3, "x " * 40)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(rows).collect()}
    assert got[2].n_dup_lines == 8 and not got[2].kept and got[3].n_repeat_words == 40 and got[3].base_failed


PROSE = "The river rose in the night, and by morning the lower fields were under water. Nobody had seen it so high since the old mill stood, and those who had kept their boats on the bank looked for them in vain along both sides of the bridge. "
LINES = [
    PROSE * 2,
    "",
    "Home\nAbout us\nOur team\nContact",
    "Home\nAbout us\nOur team",
    "Home\n\nAbout us\n\nOur team\n\nContact",
    "Read the whole story...",
    "  All Rights Reserved 2020",
    "buy " * 30,
    "one two, " + "three " * 30,
    "now!! only!! today!! yes!!",
    "a | b | c | d",
    "$$$ *** ### %%%",
    "A heading",
    "A heading\nA heading",
    "Ein Satz。",
    "\r\n \t\n",
    "word\u00a0word |",
]


def test_failing_lines_are_removed(spark):
    rng = random.Random(9)
    texts = [None, "", PROSE] + [PROSE + "\n" + x + "\n" + "And so it was left, as the people of the village say to this day, for the crows." for x in LINES]
    texts += ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, -1, k) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long, judged long")
    got = {r.doc_id: r for r in quality_rules.filter_quality(docs).collect()}
    verdict = {r.doc_id: r for r in quality_rules.quality_verdicts(docs).collect()}
    for k, text in enumerate(texts):
        kept, lines = quality_rules.brute_force(text)
        assert kept == (k in got) == verdict[k].kept, text
        if kept:
            assert got[k].text == "\n".join(lines) and got[k].judged == k
            assert got[k].n_chars == (-1 if verdict[k].n_failed_lines == 0 else len(got[k].text)) and verdict[k].n_failed_lines == text.count("\n") + 1 - len(lines)
    menus = [k for k in got if k > 2 and "Contact" in texts[k]]
    assert any("Contact" not in got[k].text for k in menus) and sum(v.n_failed_lines > 0 for v in verdict.values()) > 30


def test_many_lines_are_judged_by_sorting(spark):
    lines = [f"Line {k % 40_000} of a long text stands here, and it ends." for k in range(60_000)]
    row = quality_rules.quality_verdicts(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first()
    assert row.n_dup_lines == row.n_failed_lines == 20_000 and row.n_words == 660_000


def test_pipeline_equals_brute_force(spark, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    judged = [(r.doc_id, *quality_rules.brute_force(r.text)) for r in docs.orderBy("doc_id").collect()]
    rows = [(k, "\n".join(lines)) for k, kept, lines in judged if kept]
    rows = [row for row, (k, _, part) in zip(rows, ngram_join.brute_force(rows), strict=True) if k == part]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [row for row in rows if not decontaminate.brute_force(row[1], items)[4]]
    assert sorted(out) == [k for k, _ in rows]
    codec, novelty = piece_codec.Codec(piece_codec.Vocabulary(piece_codec.default_model())), secret_scan.Novelty()
    for k, text in rows:
        raw = text.encode()
        spans = secret_scan.base_spans(raw)
        text = secret_scan.redact(raw, spans + novelty.spans(raw, spans))
        assert codec.decode(out[k].ids) == text and out[k].round_trip


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_stars_are_the_same_however_rows_are_batched(size):
    rng = np.random.default_rng(5)
    token = np.repeat(np.arange(12), [1, 1, 30, 2, 1, 9, 1, 40, 1, 3, 1, 1])
    places = (rng.integers(0, 6, len(token)) << 32) | rng.choice([5, 10, 11, 12, 40, 44, 300], len(token))
    order = np.lexsort((places, token))
    columns = [token[order], places[order], rng.permutation(len(token))]
    cut = lambda n: [pa.RecordBatch.from_arrays([pa.array(c[a : a + n]) for c in columns], names=["token", "place", "node"]) for a in range(0, len(token), n)]
    rows = lambda n: sorted(tuple(r.values()) for b in ngram_join._stars(iter(cut(n))) for r in b.to_pylist())
    whole = rows(len(token))
    assert rows(size) == whole
    assert len(whole) == 30 + 2 + 9 + 40 + 3 and len({r[2] for r in whole}) == len(whole)


def test_long_texts_are_predicted_by_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"{a} {b} " * (40 + k), lang) for k in range(60) for a, b, lang in (("der und die", "nicht", "de"), ("the and of", "was", "en"))], "doc_id long, text string, lang string")
    net = language_id.train(language_id.sample(docs, docs.doc_id, docs.text, docs.lang))
    long = spark.createDataFrame([(1, "the and of was " * 20_000), (2, "")], "doc_id long, text string")
    row = language_id.identify(long, net).orderBy("doc_id").collect()
    assert row[0].lang_pred == "en" and row[0].n_windows == -(-(300_000 - 3) // 509) and row[1].lang_pred == "und"
    data = np.frombuffer(b"the and of was " * 200, np.uint8)
    rows, _, size = language_id.windows_of(data, np.array([0, len(data)]))
    assert (size[:-1] == 512).all() and rows.shape == (len(size), 512)
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError, match="2 languages"):
        language_id.sample(docs, docs.doc_id, docs.text, docs.lang)
