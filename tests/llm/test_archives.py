"""Archives: repeated headers, codings and character sets, digests of the archived bytes, long files."""

import gzip
import hashlib
import time
import zlib
from base64 import b32encode

from weftgraph.llm import warc


def _record(kind, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a/", "WARC-Date": "2024-01-01T00:00:00Z", **more, "Content-Length": str(len(block))}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def _http(body, *headers):
    return b"HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + body


def _derived(spark, tmp_path, *blocks, **more):
    data = b"".join(gzip.compress(_record("response", b, **{"WARC-Record-ID": f"<urn:uuid:{k}>", **more})) for k, b in enumerate(blocks))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(_record("warcinfo", b"x")) + data + gzip.compress(_record("request", b"GET /")))
    rows = warc.derive(warc.read_responses(spark, str(tmp_path / "a.warc.gz"))).collect()
    return {(r.refers_to[10:-1], r.record_type): r for r in rows}


def test_headers_digests_and_codings(spark, tmp_path):
    page = "<p>Grün &amp; naïve</p>"
    latin, packed = page.encode("latin-1"), gzip.compress(page.encode())
    chunks = b"".join(b"%x;x=y\r\n%s\r\n" % (len(c), c) for c in (packed[:7], packed[7:])) + b"0\r\n\r\n"
    got = _derived(
        spark,
        tmp_path,
        _http(latin, ("Content-Type", "text/html; charset=ISO-8859-1"), ("Set-Cookie", "a=1"), ("Set-Cookie", "b=2")),
        _http(chunks, ("Content-Type", "text/html"), ("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")),
        _http(zlib.compress(page.encode()), ("Content-Encoding", "deflate")),
        _http(b'<meta charset="windows-1252">' + "<p>“q”</p>".encode("cp1252")),
        _http(b"broken gzip", ("Content-Encoding", "gzip"), ("Content-Type", "text/html; charset=nonsense")),
        b"",
    )
    text = {k: r.block for (k, kind), r in got.items() if kind == "conversion"}
    assert text == {"0": "Grün & naïve", "1": "Grün & naïve", "2": "Grün & naïve", "3": "“q”", "4": "broken gzip", "5": ""}
    cookies = [h.value for h in got["0", "metadata"].headers if h.name == "header-Set-Cookie"]
    assert cookies == ["a=1", "b=2"] and got["0", "metadata"].block.count("source-header-Set-Cookie: ") == 2
    want = "sha1:" + b32encode(hashlib.sha1(latin).digest()).decode()
    assert dict(tuple(h) for h in got["0", "conversion"].headers)["payload-digest"] == want
    written = [dict((k.lower(), v) for k, v in h) for h, _ in warc.parse_warc(warc.record_bytes(got["0", "conversion"].asDict(recursive=True)))]
    assert written[0]["x-source-payload-digest"] == want and written[0]["warc-refers-to"] == "<urn:uuid:0>" and not any(k.startswith("warc-") and "source" in k for k in written[0])


def test_the_archives_digests_are_kept(spark, tmp_path):
    got = _derived(spark, tmp_path, _http(b"x"), **{"WARC-Payload-Digest": "sha1:AAA", "WARC-Block-Digest": "sha1:BBB"})
    kept = dict(tuple(h) for h in got["0", "metadata"].headers)
    assert kept["payload-digest"] == "sha1:AAA" and kept["block-digest"] == "sha1:BBB" and "source-block-digest: sha1:BBB" in got["0", "metadata"].block


def test_line_breaks_stay_out_of_headers():
    record = {"block": "b", "record_type": "conversion", "record_id": "<i>", "refers_to": None, "target_uri": "http://a/\r\nWARC-Type: response", "date": None, "content_type": "text/plain", "headers": [{"name": "header-x\r\ny", "value": "1\n2"}]}
    (headers, block), = warc.parse_warc(warc.record_bytes(record))
    assert [v for k, v in headers if k == "WARC-Type"] == ["conversion"] and ("X-Source-Header-X y", "1 2") in headers and block == b"b"


def test_files_are_read_in_time_that_grows_with_them():
    took = []
    for n in (2000, 8000):
        data = b"".join(gzip.compress(_record("response", b"%d" % k * 40), 1) for k in range(n))
        began = time.time()
        assert sum(1 for _ in warc.parse_warc(data)) == n
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 1
    whole = b"".join(_record("response", b"%d" % k) for k in range(50))
    for cut in range(0, len(whole), 997):
        got = [b for _, b in warc.parse_warc(whole[:cut])]
        assert got == [b"%d" % k for k in range(len(got))]
        assert [b for _, b in warc.parse_warc(gzip.compress(whole)[: len(whole)])] == [b"%d" % k for k in range(50)]
