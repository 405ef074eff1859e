"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton over all pieces reads a text once. At each place it gives, along its output links, every piece that ends
there, and each relaxes the best score of that place; the path back is the encoding. The score of a path is the sum of
its pieces' scores; ties go to the longer last piece. Characters without a piece become the bytes of their UTF-8 form.

Spaces are written as U+2581 in the vocabulary, and a space is put before a text. A U+2581 in a text itself becomes
bytes, so that decode(encode(text)) == text for every text. No piece has a space after another character, nor a newline
where the vocabulary has none: such places part a text without changing its best path, and the parts, mostly words, are
looked up in a bounded cache.

Defined results: a null text has null ids; an empty text has none. Unknown ids don't occur in encodings; decoding skips
control ids and replaces broken UTF-8. Repeated rows get a row each. Texts of any length are encoded whole, part by part.
Other columns stay; a clashing result name gets a trailing underscore, and `encode_digest` carries the key only. An empty
table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import fresh, slices

SPACE = "▁"
#: Encodings of parts that a worker keeps, and the longest part that it keeps.
CACHE, CACHED = 400_000, 32


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces and scores of a model file; small enough to be sent with a task."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces: list[tuple[str, float, int]] = []
        self.bytes = [-1] * 256
        self.raw: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.pieces.append((piece.replace(SPACE, " "), sp.get_score(i), i))
                self.raw.append(piece.replace(SPACE, " ").encode())
        if min(self.bytes) < 0:
            raise ValueError("the model has no piece for some byte")


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.raw, self.bytes = vocabulary.raw, vocabulary.bytes
        self.single = {p for p, _, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = min((s for _, s, _ in vocabulary.pieces), default=0.0) - 10
        self.automaton = ahocorasick.Automaton()
        for piece, score, i in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        spaced = any(" " in p.lstrip(" ") for p, _, _ in vocabulary.pieces)
        lined = any("\n" in p for p, _, _ in vocabulary.pieces)
        self.parts = re.compile("(?s).+" if spaced else " *[^ ]+| +" if lined else "\n| *[^ \n]+| +").findall
        self.cache: dict[str, bytes] = {}

    def segment(self, part: str) -> list[int]:
        n = len(part)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], done = 0.0, -1

        def reach(end: int) -> None:
            nonlocal done
            while done < end:
                done += 1
                if part[done] not in self.single:
                    best[done + 1], back[done + 1] = best[done] + self.unknown, done

        for end, (length, score, i) in self.automaton.iter(part):
            reach(end)
            value = best[end + 1 - length] + score
            if value > best[end + 1]:
                best[end + 1], back[end + 1], piece[end + 1] = value, end + 1 - length, i
        reach(n - 1)
        out, at = [], n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out += [self.bytes[b] for b in reversed(part[at - 1].encode())]
            at = back[at]
        return out[::-1]

    def packed(self, part: str) -> bytes:
        ids = np.array(self.segment(part), dtype=np.int32).tobytes()
        if len(part) <= CACHED:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[part] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        get, miss = self.cache.get, self.packed
        return np.frombuffer(b"".join([get(p) or miss(p) for p in self.parts(" " + text)]), dtype=np.int32)

    def decode(self, ids) -> str:
        raw = self.raw
        out = b"".join([raw[i] for i in ids])
        return out[1:].decode(errors="replace") if out[:1] == b" " else out.decode(errors="replace")


def encode_texts(docs: DataFrame, model: str | None = None, text: str = "text", name: str = "ids") -> DataFrame:
    """docs with their token ids (array of int)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(model or default_model()))
    name = fresh(docs, name)
    schema = docs.select("*", F.lit(None).cast("array<int>").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in slices(batches, 1 << 20, text):
            codec = codec or Codec(vocabulary.value)
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            ids = [None if t is None else codec.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0, *[0 if x is None else len(x) for x in ids]]).astype(np.int32)
    mask = pa.array([x is None for x in ids], pa.bool_())
    values = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()), mask=mask)


def decode_ids(tokens: DataFrame, model: str | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """tokens with the text of their ids; null ids have a null text."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(Vocabulary(model or default_model()))
    name = fresh(tokens, name)
    schema = tokens.select("*", F.lit(None).cast("string").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(vocabulary.value)
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                column = part.column(part.schema.get_field_index(ids))
                texts = [None if x is None else codec.decode(x) for x in (column[i].as_py() for i in range(len(column)))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, name])

    return tokens.mapInArrow(run, schema)


def encode_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """One row per document: key, n_chars, n_tokens, ids, and whether the ids decode to the text. Encoded and decoded in one pass."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(model or default_model()))
    lean = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in slices(batches, 1 << 20):
            codec = codec or Codec(vocabulary.value)
            texts = batch.column(1).to_pylist()
            ids = [None if t is None else codec.encode(t) for t in texts]
            same = [None if t is None else codec.decode(x.tolist()) == t for t, x in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t or "") for t in texts], pa.int64()),
                    pa.array([0 if x is None else len(x) for x in ids], pa.int64()),
                    _lists(ids),
                    pa.array(same, pa.bool_()),
                ],
                names=[key, "n_chars", "n_tokens", "ids", "round_trip"],
            )

    return lean.mapInArrow(run, f"`{key}` {kind}, n_chars bigint, n_tokens bigint, ids array<int>, round_trip boolean")


def brute_force(text: str, vocabulary: Vocabulary) -> list[int]:
    """The encoding by trying every piece at every place of the whole text; for tests."""
    scores = {p: (s, i) for p, s, i in vocabulary.pieces}
    longest = max(map(len, scores))
    unknown = min(s for s, _ in scores.values()) - 10
    t = " " + text if text else ""
    best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]  # score, begin and ids of the last piece
    for end in range(1, len(t) + 1):
        top = None
        for start in range(max(0, end - longest), end):  # the longest first
            if t[start:end] in scores:
                score, i = scores[t[start:end]]
                if top is None or best[start][0] + score > top[0]:
                    top = (best[start][0] + score, start, [i])
        if t[end - 1] not in scores:
            other = (best[end - 1][0] + unknown, end - 1, [vocabulary.bytes[b] for b in t[end - 1].encode()])
            top = other if top is None or other[0] >= top[0] else top
        best.append(top)
    out, at = [], len(t)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return [i for ids in reversed(out) for i in ids]
