"""Language identification by a byte-level convolutional network trained here in numpy.

Bytes are folded to classes (ASCII letters by case, digits, white space, other ASCII, each byte from 0x80 by itself).
Filters of two, three and four bytes run over fixed-length windows; the largest response of each filter in a window goes
through a rectifier and a softmax layer. As inputs are one-hot, a filter's response is a sum of table rows, and
prediction gathers rows of pair tables instead of multiplying. A text's prediction is the mean over all its windows,
weighted by their bytes.

Training takes at most SAMPLE texts of each language, chosen by a hash of their keys, and a stretch of STRETCH
characters from a hashed place of each; prediction reads whole texts, some windows at a time. More than MAX_LANGUAGES
languages are an error.

Defined results: rows with a null text or language are not learned; a null text and one without a letter are `und` with score 0. Ties go to the language first by name.
With no labelled rows at all, every text is `und`. Repeated rows get a row each. Very long texts are read whole. Other columns,
whatever their names, are not carried. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._common import materialize, slices, utf8

#: Most labelled stretches that are learned for a language, their characters, and most languages that a net is built for.
SAMPLE, STRETCH, MAX_LANGUAGES = 400, 1024, 5000
#: Windows that are expanded at a time in prediction; a text of any length takes this much memory besides itself.
CHUNK = 1024
WINDOW, OVERLAP = 512, 3
FILTERS = 16
EPOCHS, BATCH, RATE, SEED = 12, 32, 0.02, 7
UNKNOWN = "und"
#: Letters and, as they count as word characters, numerals such as a half or a Roman eight.
_LETTER = re.compile(r"[^\W\d_]")

#: ASCII letters 0-25, digits 26, white space 27, other ASCII 28, bytes from 0x80 by themselves, padding last.
CLASSES = 29 + 128 + 1
_CLASS = np.array([c - 97 if 97 <= c <= 122 else c - 65 if 65 <= c <= 90 else 26 if 48 <= c <= 57 else 27 if c in (32, *range(9, 14)) else 28 if c < 128 else 29 + c - 128 for c in range(256)], np.int32)
_PAD = CLASSES - 1


def plan_windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The start of all windows of some texts, the text of each window, and the bytes in it."""
    step = WINDOW - OVERLAP
    sizes = np.diff(offsets)
    counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - OVERLAP) // step)), 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][owner] + nth * step
    return start, owner, np.minimum(offsets[1:][owner] - start, WINDOW)


def window_rows(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte classes of some windows, padded."""
    at = np.minimum(start[:, None] + np.arange(WINDOW), max(len(data) - 1, 0))
    rows = _CLASS[data[at]]
    rows[np.arange(WINDOW) >= size[:, None]] = _PAD
    return rows


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte classes of all windows of some texts, the text of each window, and the bytes in it."""
    start, owner, size = plan_windows(offsets)
    return window_rows(data, start, size), owner, size


class ByteNet:
    """Filters as tables: w[k][j] has a row of FILTERS values for each byte class at place j of a filter of k bytes."""

    WIDTHS = (2, 3, 4)

    def __init__(self, languages: list[str]):
        random = np.random.default_rng(SEED)
        self.languages = languages
        self.w = {k: random.normal(0, 0.3, (k, CLASSES, FILTERS)).astype(np.float32) for k in self.WIDTHS}
        for k in self.WIDTHS:
            self.w[k][:, _PAD] = -4  # a filter that reaches into the padding does not win
        self.b = np.zeros(len(self.WIDTHS) * FILTERS, np.float32)
        self.out = random.normal(0, 0.1, (len(self.WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def train(self, rows: np.ndarray, labels: np.ndarray) -> None:
        random = np.random.default_rng(SEED)
        params = [*self.w.values(), self.b, self.out, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for _ in range(EPOCHS):
            order = random.permutation(len(rows))
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                x, y = rows[pick], labels[pick]
                tops, places = [], []
                for k in self.WIDTHS:
                    response = sum(self.w[k][j][x[:, j : WINDOW - k + 1 + j]] for j in range(k))
                    place = response.argmax(1)
                    places.append(place)
                    tops.append(np.take_along_axis(response, place[:, None], 1)[:, 0])
                pooled = np.concatenate(tops, 1) + self.b
                hidden = np.maximum(pooled, 0)
                p = _softmax(hidden @ self.out + self.bias)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.out.T) * (pooled > 0)
                grads = []
                for n, k in enumerate(self.WIDTHS):
                    g = np.zeros_like(self.w[k])
                    part = back[:, n * FILTERS : (n + 1) * FILTERS]
                    for j in range(k):
                        np.add.at(g[j], (np.take_along_axis(x, places[n] + j, 1), np.arange(FILTERS)[None]), part)
                    g[:, _PAD] = 0
                    grads.append(g)
                grads += [back.sum(0), hidden.T @ p, p.sum(0)]
                step += 1
                for value, grad, (m, v) in zip(params, grads, moments, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.pair()

    def pair(self) -> None:
        """Tables of pairs of byte classes, one row of a pair for every two places of a filter."""
        two = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        self.t2 = two(*self.w[2])
        self.t3 = two(*self.w[3][:2])
        self.t4 = two(*self.w[4][:2]), two(*self.w[4][2:])

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """A softmax row for each window."""
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for a in range(0, len(rows), 64):
            x = rows[a : a + 64]
            pairs = x[:, :-1] * CLASSES + x[:, 1:]
            top2 = self.t2[pairs].max(1)
            response = self.t3[pairs[:, :-1]]
            response += self.w[3][2][x[:, 2:]]
            top3 = response.max(1)
            response = self.t4[0][pairs[:, :-2]]
            response += self.t4[1][pairs[:, 2:]]
            pooled = np.concatenate([top2, top3, response.max(1)], 1) + self.b
            out[a : a + 64] = _softmax(np.maximum(pooled, 0) @ self.out + self.bias)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def remainder(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)), F.lit(0))


def has_letter(text: str) -> bool:
    """Whether a text has a character of the categories of letters."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def sample(docs: DataFrame, key: Column, text: Column, lang: Column) -> DataFrame:
    """At most SAMPLE stretches of text for each language, spread over the rows by a hash of the key."""
    # With the text, so that rows which share a key are spread as well.
    rows = docs.select(F.xxhash64(key, text).alias("h"), text.alias("text"), lang.alias("lang")).filter("text is not null and lang is not null")
    share = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    n = share.count()
    if n > MAX_LANGUAGES:
        raise ValueError(f"{n} languages: the network is built for {MAX_LANGUAGES} at most")
    rows = rows.join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(1 << 20)) * F.col("n") <= (1 << 20) * 2 * SAMPLE)
    start = F.pmod(F.xxhash64("h"), F.greatest(F.char_length("text") - STRETCH, F.lit(1))).cast("int") + 1
    rows = rows.select("lang", "h", F.substring("text", start, F.lit(STRETCH)).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    return rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SAMPLE).drop("k")


def train(stretches: DataFrame) -> ByteNet | None:
    rows = sorted(((r.lang, r.h, r.text) for r in stretches.collect()))
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    random = np.random.default_rng(SEED)
    texts, labels = [], []
    for lang, _, text in rows:
        raw = text.encode()
        short = int(random.integers(12, 200))
        at = int(random.integers(0, max(1, len(raw) - short)))
        for part in (raw[: WINDOW], raw[at : at + short]):
            if part:
                texts.append(part)
                labels.append(languages.index(lang))
    offsets = np.cumsum([0, *map(len, texts)])
    windows, owner, _ = windows_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
    net = ByteNet(languages)
    net.train(windows, np.array(labels)[owner])
    return net


def identify(docs: DataFrame, net: ByteNet | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, lang_pred, score, n_windows."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in slices(batches, 256 << 10):
            data, offsets = utf8(batch.column(1))
            n = batch.num_rows
            raw = data.tobytes()
            known = np.array([net is not None and has_letter(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], bool)
            best, score, count = np.zeros(n, int), np.zeros(n), np.zeros(n, np.int64)
            if known.any():
                total = np.zeros((n, len(net.languages)))
                start, owner, size = plan_windows(offsets)
                for a in range(0, len(start), CHUNK):
                    part = slice(a, a + CHUNK)
                    np.add.at(total, owner[part], net.predict(window_rows(data, start[part], size[part])) * size[part, None])
                count = np.bincount(owner, minlength=n)
                total /= np.maximum(total.sum(1, keepdims=True), 1e-30)
                best = total.argmax(1)
                score = np.clip(total.max(1), 0, 1)
            names = [net.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(count.astype(np.int64))],
                names=[key, "lang_pred", "score", "n_windows"],
            )

    lean = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    return lean.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, n_windows bigint")


def language_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on two thirds of the labelled documents and predict all: key, held_out, lang_pred, score, n_windows."""
    learn = docs.filter(remainder(F.col(key)) != 1)
    net = train(sample(learn, F.col(key), F.col(text), F.col(lang)))
    out = identify(docs, net, key, text)
    return out.select(F.col(key), (remainder(F.col(key)) == 1).alias("held_out"), "lang_pred", "score", "n_windows")
