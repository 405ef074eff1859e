"""Secret scans: fixed patterns, and novelty under a dictionary-primed zstandard compressor.

Patterns find assignments, access key ids and long hex runs. Beyond them, a candidate is a long mixed token that stands
soon after a word of a sensitive context, or after a reported token that does. Its novelty is the marginal cost: the compressed bytes of its surroundings
with it, less those without, under a compressor primed with usual identifiers. Tokens that
the primed compressor can't shorten are reported as kind `novel`; ordinary words and identifiers cost little. A private
key block with such a token is one span from its first character to its last, up to the END marker.

Defined results: null and empty texts have no span. Offsets are code points, ends exclusive. Repeated rows get a row
each. Texts and tokens of any length are read to their end. Where spans overlap they are reported each, and redacted as one.
An empty table gives an empty table. Other columns stay as they are; a clashing result name gets a trailing underscore.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import fresh, slices, utf8

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

#: A candidate begins within so many bytes after a context word or the last reported token.
REACH = 48
CONTEXT = re.compile(
    rb"(?i:password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|authorization|auth_key|client_id)"
)
#: Each alternative of CONTEXT has one of these.
HINTS = (b"passw", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer", b"authorization", b"client_id")
LEAST = 20
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Marks of private key blocks; a block without an END mark is read token by token.
KEY_MARK = re.compile(rb"PRIVATE KEY(?: BLOCK)?-----\s*+|-----(BEGIN|END) ")
#: Bytes of surroundings on either side.
AROUND = 256
#: Compressed bytes that a byte of an incompressible candidate costs at least.
NOVEL = 0.6
#: Identifiers and words that prime the compressor.
IDENTIFIERS = (
    "access_key access_token account_id admin api_key apikey auth_token authorization base64 bearer bucket client_id "
    "client_secret config connection_string const credential database default def demo dummy endpoint environment "
    "example export false function getenv header hostname https import include localhost nullptr number object "
    "os.environ password placeholder private_key process.env production public read refresh_token region request "
    "response return secret secret_key self server session settings static string struct test timeout token true "
    "undefined username value variable version void write your_api_key_here your_password xxxxxxxxxxxxxxxx "
    "0123456789abcdef ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789"
)


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes; patterns match ASCII only, so that bytes serve as well as code points."""
    spans = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return spans


def _apart(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs that overlapping spans make, in order."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _meets(starts: list[int], ends: list[int], a: int, b: int) -> bool:
    """Whether a span overlaps one of some runs in order."""
    k = bisect_left(starts, b) - 1
    return k >= 0 and ends[k] > a


def key_blocks(text: bytes) -> list[tuple[int, int]]:
    """Private key blocks from the first character after their mark to the last before the END mark, in one pass."""
    found, begun = [], None
    for m in KEY_MARK.finditer(text) if b"PRIVATE KEY" in text else ():
        if m[1] is None:
            begun = m.end() if begun is None else begun
        else:
            if m[1] == b"END" and begun is not None:
                found.append((begun, begun + len(text[begun : m.start()].rstrip())))
            begun = None
    return found


class Novelty:
    """Marginal compressed bytes of a token among its surroundings."""

    def __init__(self):
        import zstandard

        primer = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._size = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_checksum=False)

    def cost(self, text: bytes, start: int, end: int) -> int:
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        size = lambda x: len(self._size.compress(x))
        return size(before + after + text[start:end]) - size(before + after)

    def spans(self, text: bytes, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Candidates in a sensitive context that don't compress and don't overlap a span that is taken."""
        lower = text.lower()
        if not any(h in lower for h in HINTS):
            return []
        found, last = [], -1
        starts, ends = _apart(taken)
        for word in CONTEXT.finditer(text):
            near = word.end()
            # The bound only tells where a candidate may begin; it ends where its token does.
            while m := CANDIDATE.search(text, max(word.end(), last), near + REACH + LEAST):
                m = CANDIDATE.match(text, m.start())
                last = m.end()
                if _meets(starts, ends, *m.span()):
                    near = last
                elif self.novel(text, m):
                    found.append(("novel", *m.span()))
                    near = last
        whole = [(a, b) for a, b in key_blocks(text) if any(self.novel(text, m) for m in CANDIDATE.finditer(text, a, b))]
        if whole:
            starts, ends = [a for a, _ in whole], [b for _, b in whole]
            found = [s for s in found if not _meets(starts, ends, *s[1:])] + [("novel", a, b) for a, b in whole]
        return found

    def novel(self, text: bytes, token: re.Match) -> bool:
        mixed = any(48 <= c <= 57 for c in token[0]) and any(c >= 65 for c in token[0])
        return mixed and self.cost(text, *token.span()) >= NOVEL * len(token[0])


def _chars(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The same spans in code points, by start and kind."""
    marks = sorted({x for _, a, b in spans for x in (a, b)})
    at, n, place = 0, 0, {}
    for x in marks:
        n += len(text[at:x].decode())
        at, place[x] = x, n
    return sorted(((k, place[a], place[b]) for k, a, b in spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan_secrets(docs: DataFrame, text: str = "text", name: str = "secrets", redacted: str | None = None) -> DataFrame:
    """docs with an array of spans (kind, start, end); `redacted` names a column to be replaced by its redacted text."""
    name = fresh(docs, name)
    schema = docs.select("*", F.lit(None).cast(SPANS).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in slices(batches, 4 << 20, text):
            k = batch.schema.get_field_index(text)
            data, offsets = utf8(batch.column(k))
            data, out, hidden = data.tobytes(), [], {}
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                t = data[a:b]
                spans = base_spans(t)
                spans += novelty.spans(t, spans)
                out.append([{"kind": x, "start": s, "end": e} for x, s, e in _chars(t, spans)] if spans else [])
                if spans and redacted:
                    hidden[i] = redact(t, spans)
            columns = list(batch.columns)
            if hidden:
                values = columns[k].to_pylist()
                for i, t in hidden.items():
                    values[i] = t
                columns[k] = pa.array(values, columns[k].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(_SPAN))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def redact(text: bytes, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, as [secret]."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], b"[secret]"]
        at = max(at, b)
    return b"".join([*out, text[at:]]).decode()


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_assign, n_access, n_hex, base_sha256, spans, n_novel."""
    found = scan_secrets(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select(
        F.col("key").alias(key),
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
        count("novel").alias("n_novel"),
    )


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with their secrets redacted and, if they have it, the character count of the new text."""
    name = fresh(docs, "secrets")
    found = scan_secrets(docs, text, name, redacted=text)
    changed = F.size(F.col(name)) > 0
    if n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        found = found.withColumn(n_chars, F.when(changed, F.char_length(F.col(text)).cast(kind)).otherwise(F.col(n_chars)))
    return found.drop(name)


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base digest of one text straight from the patterns, over code points; for tests."""
    t = text or ""
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(map(letters, ("password", "passwd", "secret", "token"))) + "|" + letters("api") + "_?" + letters("key")
    found = [("assign", m.start(), m.end()) for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    n = [sum(s[0] == k for s in found) for k in KINDS[:3]]
    return *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
