"""URL filter by a Bloom filter cascade over the corpus's own keys.

A key is a host or one of its parent domains together with a leading piece of the path: what a rule could name.  A rule's path
is what ends in its last "/" and a rest; pieces of a page's path end in each "/" up to the rules' greatest depth, and go on by
each of the lengths that the rests have (0 where paths end in "/"), within the next part of the path.  The universe is every distinct key of the pages whose depth a rule can have.  Level 0 encodes the listed keys; level
1 the keys of the universe that pass level 0 though they aren't listed; level 2 the listed keys that pass level 1; and so
on, until no key is left over.  A key is listed if the first level that rejects it is an odd one, so membership is exact for
all keys of the universe and a page is judged without a join.  Blocked and allowed keys have a cascade each.

A cascade is at most CASCADE_BYTES: a longer list is cut into slices by the keys' hashes, each with a cascade of its own.  One
slice at a time is broadcast, and marks its keys in the pages, which are written between slices.

Edge cases: a null url, or one without "://", has an empty host and path, fits no rule and is judged by the method (an
empty host is not listed: allow).  An empty host name and empty path give no key.  Repeated pages are judged row by row;
extra columns are ignored.  A rule with an empty path fits all paths of its host; one whose path begins otherwise than with
"/" fits none.  Of rules of equal length the blocking ones come first, then the one with the longest host; a key listed both
ways is blocked; rules with a null are skipped.  An empty table gives an empty result.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

#: The rules (verdict, host, path) of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Host labels that mark a host as unwanted where no rule fits: the method's own list.
UNWANTED = ("spam-farm", "cheap-pills", "casino", "adult", "malware")
#: Bits for each key of a level, and hash functions.
BITS, HASHES = 12, 6
#: Bytes of the levels of one slice.
CASCADE_BYTES = 16 << 20

_U = np.uint64


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = common.lower_ascii(F.regexp_extract(F.coalesce(after, F.lit("")), r"^[^/?#]*", 0))
    path = F.regexp_extract(F.coalesce(after, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return host, path


def domains(host: Column) -> Column:
    """The host and its parents, the longest first; none for an empty host."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    all_ = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    return F.filter(all_, lambda d: d != "")


def prefixes(path: Column, depth: int, rests: list[int]) -> Column:
    """Leading pieces of the path, the longest first: up to each of its first `depth` slashes, and so many characters (rests)
    of the part behind it; the empty piece too if -1 is among the rests."""
    parts = F.split(path, "/", -1)
    n = F.least(F.size(parts) - 1, F.lit(depth))
    base = lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))
    longest = sorted((r for r in rests if r >= 0), reverse=True)
    after = lambda i: F.array(*[F.when(F.length(F.get(parts, i)) >= r, F.concat(base(i), F.left(F.get(parts, i), F.lit(r)))) for r in longest])
    pieces = F.array_compact(F.flatten(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), after))) if longest != [0] else F.transform(F.sequence(n, F.lit(1), F.lit(-1)), base)
    none = F.array(F.lit("")) if -1 in rests else F.array().cast("array<string>")
    return F.when(F.startswith(path, F.lit("/")), F.concat(pieces, none)).otherwise(none)


def keys(host: Column, path: Column, depth: int, rests: list[int]) -> Column:
    return F.flatten(F.transform(domains(host), lambda d: F.transform(prefixes(path, depth, rests), lambda p: F.concat(d, p))))


class Level:
    """One Bloom filter over 64-bit key hashes."""

    def __init__(self, n: int, seed: int):
        self.bits = max(64, 1 << math.ceil(math.log2(max(1, n) * BITS)))
        self.words = np.zeros(self.bits // 64, np.uint64)
        self.seed, self.hashes = seed, HASHES

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        a = common.mix(hashes + _U(self.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        b = common.mix(a) | _U(1)
        for i in range(self.hashes):
            yield (a + b * _U(i)) & _U(self.bits - 1)

    def add(self, hashes: np.ndarray) -> None:
        for at in self._places(hashes):
            np.bitwise_or.at(self.words, at >> _U(6), _U(1) << (at & _U(63)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            out &= (self.words[at >> _U(6)] >> (at & _U(63)) & _U(1)).astype(bool)
        return out


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """True for listed keys of the universe."""
        inside = np.ones(len(hashes), bool)
        passed = np.full(len(hashes), len(self.levels), np.int64)
        for k, level in enumerate(self.levels):
            ok = level.has(hashes)
            passed[inside & ~ok] = k
            inside &= ok
        return passed % 2 == 1

    @property
    def size(self) -> int:
        return sum(level.words.nbytes for level in self.levels)


def build(listed: DataFrame, universe: DataFrame) -> list[Cascade]:
    """A cascade for each slice; listed, universe: one column h each, distinct key hashes.

    Listed keys outside the universe are left out: no page has them.  As many slices are made as keep each within
    CASCADE_BYTES; how many false positives the universe gives is only known then, so slices are doubled until they do.
    """
    listed = common.written(listed.join(universe, "h", "left_semi"), "url-listed")
    universe = common.written(universe.join(listed, "h", "left_anti"), "url-universe")
    slices = 1
    while True:
        cascades = []
        for k in range(slices):
            own = F.pmod(F.col("h"), F.lit(slices)) == k
            cascades.append(_cascade(listed.where(own), universe.where(own)))
            if cascades[-1] is None:
                break
        else:
            return cascades
        slices *= 2


def _cascade(positives: DataFrame, negatives: DataFrame) -> Cascade | None:
    """None if it would be too large.

    Each level is made by the executors as partial bit arrays; the driver only joins them.  What is left over for the next
    level shrinks by the false-positive rate at each step, and is counted before a level of its size is made.
    """
    levels: list[Level] = []
    shelf = common.Shelf(positives.sparkSession)
    while n := positives.count():
        level = Level(n, len(levels) + 1)
        if n > 1 and sum(x.words.nbytes for x in (*levels, level)) > CASCADE_BYTES:
            return None
        parts = positives.mapInArrow(_partial(level), "word long, bits long")
        found = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        level.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        levels.append(level)
        # False positives of this level are the next level's keys.
        positives, negatives = shelf.put(negatives.mapInArrow(_passing(level), "h long"), f"url-level-{len(levels)}"), positives
        shelf.drop(f"url-level-{len(levels) - 2}")
    shelf.drop(*list(shelf.paths))
    return Cascade(levels)


def _partial(level: Level):
    def run(batches):
        own = copy.copy(level)
        own.words = np.zeros(len(level.words), np.uint64)
        for batch in batches:
            own.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        at = np.flatnonzero(own.words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(own.words[at].view(np.int64))], ["word", "bits"])

    return run


def _passing(level: Level):
    def run(batches):
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h[level.has(h.view(np.uint64))])], ["h"])

    return run


def _members(cascades: list[Cascade], k: int):
    """Whether each of the hashes of a row is listed, for those of slice k."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(cascades[k])
    slices = len(cascades)

    @F.pandas_udf("array<boolean>")
    def member(hashes: pd.Series) -> pd.Series:
        counts = np.array([len(x) for x in hashes], np.int64)
        flat = np.concatenate([np.asarray(x, np.int64) for x in hashes]) if len(hashes) else np.zeros(0, np.int64)
        found = shared.value.has(flat.view(np.uint64)) & (flat % slices == k)
        return pd.Series(np.split(found, np.cumsum(counts)[:-1]) if len(counts) else [])

    return member


def judge(pages: DataFrame, rules: DataFrame | None = None, unwanted=UNWANTED) -> DataFrame:
    """page_id, host, path, rule, verdict for each page.  rules: verdict (block or allow), host, path; RULES if none are given."""
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    rules = rules.where("verdict is not null and host is not null and path is not null")
    # Depths and lengths of paths are few, however many rules there are; -1 stands for an empty path.
    rest = F.when(F.col("path") == "", -1).otherwise(F.length(F.substring_index("path", "/", -1)))
    shape = rules.where("path = '' or path like '/%'").agg(F.coalesce(F.max(F.size(F.split("path", "/")) - 1), F.lit(1)).alias("depth"), F.collect_set(rest).alias("rests")).first()
    depth, rests = max(1, shape["depth"]), shape["rests"] or [0]
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    # Bare labels are keys too: the method's own list names labels of hosts.
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    split = split.withColumn("keys", F.concat(keys(F.col("host"), F.col("path"), depth, rests), F.transform(labels, lambda x: F.concat(F.lit("*"), x))))
    universe = common.written(split.select(F.explode("keys").alias("key")).select(F.xxhash64("key").alias("h")).distinct(), "url-keys")
    stars = spark.createDataFrame([(f"*{label}",) for label in unwanted], "key string")
    marked, shelf = split.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k))), common.Shelf(spark)
    for verdict in ("block", "allow"):
        named = rules.where(F.col("verdict") == verdict).select(F.concat("host", "path").alias("key"))
        listed = (named.unionByName(stars) if verdict == "block" else named).select(F.xxhash64("key").alias("h")).distinct()
        cascades = build(listed, universe)
        for k in range(len(cascades)):
            found = _members(cascades, k)(F.col("hashes"))
            marked = marked.withColumn(verdict, F.zip_with(verdict, found, lambda x, y: x | y) if k else found)
            if len(cascades) > 1:
                marked = shelf.put(marked, "url-marks")
    hits = lambda name: F.filter("keys", lambda k, i: F.get(F.col(name), i))
    bare = lambda found: F.filter(found, lambda k: ~F.startswith(k, F.lit("*")))
    marked = marked.select("page_id", "host", "path", hits("block").alias("block"), bare(hits("allow")).alias("allow"))
    rule = F.get(F.array_sort(F.concat(bare("block"), "allow"), lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    bad = F.exists("block", lambda k: F.startswith(k, F.lit("*")))
    by_rule = F.when(F.array_contains("block", rule), "block").otherwise("allow")
    verdict = F.when(rule.isNotNull(), by_rule).when(bad, "block").otherwise("allow")
    return marked.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
