"""Benchmark decontamination with one Aho-Corasick automaton over the words of all benchmark items.

Texts are lower-cased (A-Z) and cut into words; a word that occurs in the benchmark has a code of a few symbols, all others
share one that no item has. Every window of 13 words holds a run of 7 that begins at a multiple of 7 words in its item, so
the automaton has these runs only (an item with fewer than 13 words is one pattern), about a node for each word. It reads each
document once. A match is compared with the six words on either side of it in its items; from 13 words on, all windows in it
occur, and its words are hit. A run's places in an item with the same words around them are one, so that repetition in items
or texts costs no more. Hit words map back to code points of the original text.

The benchmark is the stated query set. It is cut into blocks of items, of BLOCK_WORDS words each, to bound a worker's
automaton; a larger benchmark takes several blocks, which are read in turn over batches of BUFFER bytes. The driver holds the
benchmark's texts compressed, and sends them so.

Defined results: a null or empty text has no words, hits or items and is not contaminated. Null items and items without
words have no window. An item with a null id hits words, but is not among the items found. Repeated items (equal item_id)
count once in n_items; equal texts of two items count for both. Repeated documents get a row each. Texts of any length are
read whole, one at a time. Other columns stay in `find_overlap`, whose result gets a trailing underscore where its name
clashes. Empty documents give an empty table; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import fresh, slices, utf8

WINDOW = 13
#: Words of a run that the automaton finds: any window has one that begins at a multiple of it.
RUN = (WINDOW + 1) // 2
#: Words of benchmark text in one automaton, and bytes of documents that several are read over in turn.
BLOCK_WORDS, BUFFER = 2_000_000, 32 << 20
#: Symbols for each place of a word's code: few, so that no node of the automaton has many children.
SYMBOLS = 512
#: A document is contaminated from one hit word in so many words.
SHARE = 20
#: Words in a text as it is; A-Z is lower-cased after the cut.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: UTF-8 bytes to lower case; bytes that are no part of a word to a space. Bytes from 0x80 are all parts of words.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Windows:
    """The automaton of some items: [(item id as a string or None, words)]."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        import ahocorasick

        self.ids = sorted({name for name, _ in items if name is not None})
        number = {name: k for k, name in enumerate(self.ids)}
        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        self.width = 1
        while SYMBOLS**self.width < len(vocabulary):
            self.width += 1
        self.unknown = "\x00" * self.width
        self.codes = {w: self._code(k) for w, k in vocabulary.items()}
        # A window reaches RUN - 1 words beyond a run of it at most, so that places with like words around them are one.
        found: dict[str, dict[tuple[int, str, str], None]] = {}
        for k, (_, words) in enumerate(items):
            text = "".join([self.codes[w] for w in words])
            if 0 < len(words) < WINDOW:
                found.setdefault(text, {})[number.get(items[k][0], -1), None, None] = None
            else:
                for at in range(0, len(words) - RUN + 1, RUN):
                    left, right = text[max(0, at - RUN + 1) * self.width : at * self.width], text[(at + RUN) * self.width : (at + 2 * RUN - 1) * self.width]
                    found.setdefault(text[at * self.width : (at + RUN) * self.width], {})[number.get(items[k][0], -1), left, right] = None
        self.empty = not found
        self.automaton = ahocorasick.Automaton()
        for pattern, places in found.items():
            self.automaton.add_word(pattern, (len(pattern) // self.width, self._widest(list(places))))
        if found:
            self.automaton.make_automaton()

    def _widest(self, places: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
        """Places less those at an item's ends whose words around them another place of the same item has as well."""
        full = (RUN - 1) * self.width
        short = [x for x in places if x[1] is not None and (len(x[1]) < full or len(x[2]) < full)]
        if not short or len(places) == 1:
            return places
        by_owner: dict[int, list[tuple[int, str, str]]] = {}
        for x in places:
            by_owner.setdefault(x[0], []).append(x)
        within = {x for x in short for y in by_owner[x[0]] if x != y and y[1] is not None and y[1].endswith(x[1]) and y[2].startswith(x[2])}
        return [x for x in places if x not in within]

    def _code(self, k: int) -> str:
        """A symbol for each place; places have symbols of their own, so that matches begin at words only."""
        out = []
        for place in range(self.width):
            out.append(chr(1 + place * SYMBOLS + k % SYMBOLS))
            k //= SYMBOLS
        return "".join(out)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The hit runs of words (start, end exclusive), and the numbers of the items found; -1 for those without an id."""
        runs: list[tuple[int, int]] = []
        owners: set[int] = set()
        if self.empty or not words:
            return runs, owners
        get, width, unknown = self.codes.get, self.width, self.unknown
        text = "".join([get(w, unknown) for w in words])
        last_run = (0, 0)
        for last, (length, places) in self.automaton.iter(text):
            end = (last + 1) // width
            start = end - length
            for owner, left, right in places:
                a, b = start, end
                if left is not None:
                    a -= _same_end(text, left, start * width, width)
                    b += _same_begin(text, right, end * width, width)
                    if b - a < WINDOW:
                        continue
                owners.add(owner)
                if a > last_run[1] or a < last_run[0]:
                    runs.append(last_run)
                    last_run = (a, b)
                elif b > last_run[1]:
                    last_run = (last_run[0], b)
        runs = [r for r in [*runs, last_run] if r[1] > r[0]]
        return _merge(runs), owners


def _same_begin(text: str, part: str, at: int, width: int) -> int:
    """How many of the first words of a part stand at a place."""
    if text.startswith(part, at):
        return len(part) // width
    n = 0
    while text.startswith(part[n * width : (n + 1) * width], at + n * width):
        n += 1
    return n


def _same_end(text: str, part: str, at: int, width: int) -> int:
    """How many of the last words of a part stand before a place."""
    if at >= len(part) and text.startswith(part, at - len(part)):
        return len(part) // width
    n, size = 0, len(part)
    while at > n * width and text.startswith(part[size - (n + 1) * width : size - n * width], at - (n + 1) * width):
        n += 1
    return n


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[bytes]:
    """Items [(id, text)] in blocks, pickled and compressed."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).filter("t is not null").toLocalIterator()
    blocks: list[bytes] = []
    block: list[tuple[str | None, bytes]] = []
    held = 0

    def close() -> None:
        if block:
            blocks.append(zlib.compress(pickle.dumps(block), 1))
            block.clear()

    for row in rows:
        raw = row.t.encode()
        n = len(words_of(raw))
        if n:
            if held + n > BLOCK_WORDS:
                close()
                held = 0
            block.append((row.i, raw))
            held += n
    close()
    return blocks


#: The automaton that a worker built last, and its name: tasks that follow use it again.
_built: list = [None, None]


def _windows(name: str, block: bytes) -> Windows:
    if _built[0] != name:
        _built[:] = [None, None]
        _built[:] = [name, Windows([(i, words_of(t)) for i, t in pickle.loads(zlib.decompress(block))])]
    return _built[1]


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


#: What a scan adds to its input.
FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"


def find_overlap(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", name: str = "overlap") -> DataFrame:
    """docs with a struct: words, hit words, ids of the items found, and hit spans in code points of the text."""
    blocks = docs.sparkSession.sparkContext.broadcast(_blocks(benchmark, item, item_text))
    own = uuid.uuid4().hex
    name = fresh(docs, name)
    schema = docs.select("*", F.lit(None).cast(FOUND).alias(name)).schema
    kind = pa.struct(
        [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )

    def read(batches: list[pa.RecordBatch], parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        found: list[dict[int, tuple[list, set]]] = [{} for _ in batches]
        sizes: list[list[int]] = [[] for _ in batches]
        for p, part in enumerate(parts or [b""]):
            windows = _windows(f"{own}-{p}", part) if part else Windows([])
            for k, batch in enumerate(batches):
                data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
                data = data.tobytes()
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    words = words_of(data[a:b])
                    if p == 0:
                        sizes[k].append(len(words))
                    runs, owners = windows.scan(words)
                    if runs:
                        held = found[k].setdefault(i, ([], set()))
                        held[0].extend(runs)
                        held[1].update(windows.ids[x] for x in owners if x >= 0)
        for k, batch in enumerate(batches):
            column, out = batch.column(batch.schema.get_field_index(text)), []
            for i, n in enumerate(sizes[k]):
                spans, hit, items = [], [], set()
                if i in found[k]:
                    hit, items = _merge(found[k][i][0]), found[k][i][1]
                    at = [m.span() for m in WORD.finditer(column[i].as_py())]
                    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in hit]
                out.append({"n_words": n, "n_hit": sum(b - a for a, b in hit), "items": sorted(items), "spans": spans})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = blocks.value
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in slices(batches, 4 << 20, text):
            held.append(batch)
            size += batch.column(batch.schema.get_field_index(text)).nbytes
            if len(parts) < 2 or size >= BUFFER:
                yield from read(held, parts)
                held, size = [], 0
        yield from read(held, parts)

    return docs.mapInArrow(run, schema)


def contaminated(overlap: str = "overlap"):
    n_hit, n_words = F.col(f"{overlap}.n_hit"), F.col(f"{overlap}.n_words")
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def overlap_digest(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = find_overlap(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), benchmark)
    return found.select(
        F.col("key").alias(key),
        "overlap.n_words",
        "overlap.n_hit",
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        "overlap.spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    name = fresh(docs, "overlap")
    return find_overlap(docs, benchmark, text, name=name).filter(~contaminated(name)).drop(name)


def brute_force(text: str | None, items: list[tuple[str | None, str | None]]) -> tuple[int, int, int, str, bool]:
    """The digest of one document by comparing every window with every place; for tests."""
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, owners = cut(text), set(), set()
    for name, item in items:
        own = cut(item)
        for k in range(max(1, len(own) - WINDOW + 1) if own else 0):
            window = own[k : k + WINDOW]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    owners.update([name] if name is not None else [])
    return len(words), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit) and SHARE * len(hit) >= len(words)
