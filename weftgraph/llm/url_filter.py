"""URL filters: host rules, and a list of canonical URLs behind a blocked Bloom filter.

A URL has a canonical key for each of its host suffixes times each of its path prefixes, up to the labels and folders
that a listed key has at most: longer ones can't be listed. A path and the
folder of that name are not told apart: a listed path, with or without a final slash, covers itself and all below. The listed
keys make a blocked Bloom filter (one 512-bit block for a key, one bit in each of its eight words) of bounded size.
Keys that the filter passes are joined with the list by equality, which removes the false positives; distinct URLs are
joined, so that a URL seen many times counts once.

Rules come first: a rule fits its host and all subdomains if the path starts with the rule's path; the longest wins.

Defined results: a null URL and one without `://` have an empty host and path, no rule and the verdict `allow`.
Repeated rows get a row each. Rules of equal length go by the order of their hosts' names. Very long URLs have as many keys as the
list's depth asks for, whatever their length. An empty table gives an empty table; with an empty list only the rules block. Other
columns, whatever their names, are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for each listed key, and most 512-bit blocks: 64 MB. A longer list has more false positives, not more memory.
KEY_BITS, MAX_BLOCKS = 16, 1 << 20
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The text of the longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def canonical_keys(host: Column, path: Column, labels: int | None = None, folders: int | None = None) -> Column:
    """host/path keys: the host without `www.` and all its parents, times `/`, all folders and the path, each with
    and without a final slash; of those, the ones with so many labels and folders at most."""
    bare = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    names = F.split(bare, r"\.", -1)
    n = F.size(names)
    first = F.lit(0) if labels is None else F.greatest(F.lit(0), n - labels)
    hosts = F.transform(
        F.sequence(first, n - 1),
        lambda k: F.array_join(F.slice(names, k + 1, n), "."),
    )
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", ""), "/", -1)
    most = F.size(parts) if folders is None else F.least(F.size(parts), F.lit(folders + 1))
    heads = F.transform(F.sequence(F.lit(1), most), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    paths = F.concat(F.filter(heads, lambda p: p != ""), F.transform(heads, lambda p: F.concat(p, F.lit("/"))))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def canonical(url: Column) -> Column:
    """The canonical form of a listed URL, with or without its scheme."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    bare = F.regexp_replace(F.regexp_replace(host_of(full), r":(80|443)$", ""), r"^www\.", "")
    clean = F.regexp_replace(F.regexp_replace(path_of(full), "/+", "/"), r"(?<=.)/$", "")
    return F.concat(bare, F.when(clean == "", F.lit("/")).otherwise(clean))


def hits(words: np.ndarray, block: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether all bits of some hashes are set in their blocks."""
    bits, hit = h.view(np.uint64), np.ones(len(block), bool)
    for w in range(8):
        hit &= (words[block, w] >> ((bits >> np.uint64(6 * w)) & np.uint64(63))) & np.uint64(1) == 1
    return hit


class BlockedBloom:
    """A blocked Bloom filter of the string column `key`; its size is bounded by MAX_BLOCKS."""

    def __init__(self, listed: DataFrame):
        path = F.regexp_extract("key", r"(?s)^[^/]*(.*)$", 1)
        parts = F.size(F.split(F.regexp_extract("key", "^[^/]*", 0), r"\.", -1)), F.size(F.split(path, "/", -1)) - 1
        # Nothing listed has more labels or folders than these, so that no longer key of a URL can be listed.
        n, labels, folders = listed.agg(F.count("*"), F.max(parts[0]), F.max(parts[1])).first()
        self.labels, self.folders = labels or 0, folders or 0
        self.blocks = max(1, min(MAX_BLOCKS, -(-n * KEY_BITS // 512)))
        hashes = listed.select(F.pmod(F.xxhash64("key"), F.lit(self.blocks)).alias("block"), F.xxhash64("key", F.lit(1)).alias("h"))
        rows = hashes.groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(h, {6 * w}), 64) as int))")).alias(f"w{w}") for w in range(8)])
        self.words = np.zeros((self.blocks, 8), np.int64)
        for row in rows.toLocalIterator():
            self.words[row["block"]] = row[1:]

    def hashes(self, key: Column) -> tuple[Column, Column]:
        """A string's block, and the hash that tells its bits."""
        return F.pmod(F.xxhash64(key), F.lit(self.blocks)), F.xxhash64(key, F.lit(1))

    def holds(self, key: Column) -> Column:
        """Whether a string may be among the keys: never false for one that is."""
        held = SparkSession.active().sparkContext.broadcast(self.words.view(np.uint64))

        def check(at: pa.Array, h: pa.Array) -> pa.Array:
            return pa.array(hits(held.value, at.to_numpy(), h.to_numpy()))

        return F.arrow_udf(check, "boolean")(*self.hashes(key))

    def possible(self, keyed: DataFrame) -> DataFrame:
        """The rows (url, keys) of which a key may be listed."""
        held, blocks = keyed.sparkSession.sparkContext.broadcast(self.words.view(np.uint64)), self.blocks
        hashed = keyed.select(
            "url",
            "keys",
            F.transform("keys", lambda k: F.pmod(F.xxhash64(k), F.lit(blocks))).alias("at"),
            F.transform("keys", lambda k: F.xxhash64(k, F.lit(1))).alias("h"),
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, h = batch.column(2), batch.column(3)
                sizes = np.diff(at.offsets.to_numpy())
                hit = hits(held.value, at.flatten().to_numpy(), h.flatten().to_numpy())
                rows = np.unique(np.repeat(np.arange(len(sizes)), sizes)[hit])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["url", "keys"]).take(pa.array(rows))

        return hashed.mapInArrow(run, "url string, keys array<string>")


def listed_urls(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """The distinct URLs of pages that have a listed key; listed has the column `key`."""
    bloom = BlockedBloom(listed)
    urls = pages.select(F.col(url).alias("url"))
    keyed = urls.withColumn("keys", canonical_keys(host_of(F.col("url")), path_of(F.col("url")), bloom.labels, bloom.folders))
    possible = bloom.possible(keyed).dropDuplicates(["url"])
    return possible.select("url", F.explode("keys").alias("key")).join(listed.select("key").distinct(), "key").select("url").distinct()


def judge_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, listed."""
    found = listed_urls(pages, listed, url).withColumn("listed", F.lit(True))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).join(found, "url", "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.select("key", host.alias("host"), path.alias("path"), F.coalesce("listed", F.lit(False)).alias("listed"))
    judged = judged.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    return judged.select(
        F.col("key").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(F.col("listed"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))).alias("verdict"),
        "listed",
    )
