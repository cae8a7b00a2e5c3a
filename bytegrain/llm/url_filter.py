"""URL filters: a cascade of Bloom filters gives exact membership of every key that the corpus can ask for, without joins."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import mapped, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """Fits `host` and all its subdomains where the url's path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path; both are empty where the url is null or has no ://."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), "path": F.regexp_extract(url, PARTS, 2)})


def candidates(host: str, path: str, lengths: Sequence[int]) -> list[str]:
    """All keys of a url, longest first (then the longer host): every parent domain with every prefix of a length that a rule's path has."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    found = [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return [f"{h}\x00{p}" for h, p in sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def _places(keys: list[str], bits: int, hashes: int, level: int) -> np.ndarray:
    """(keys, hashes): the bits of each key at a level."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k, level) for k in keys), np.uint64, len(keys))
    one, two = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((one[:, None] + np.arange(hashes, dtype=np.uint64) * two[:, None]) % np.uint64(bits)).astype(np.int64)


@dataclass
class Level:
    bits: np.ndarray  # packed
    size: int
    hashes: int
    number: int

    def may_hold(self, keys: list[str]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        at = _places(keys, self.size, self.hashes, self.number)
        return ((self.bits[at >> 3] >> (at & 7)) & 1).all(1)


class Cascade:
    """Levels by turns hold listed keys and what the level before took wrongly; the last takes nothing wrongly."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def contains(self, keys: list[str]) -> np.ndarray:
        """Exact for every key of the universe that the cascade was built over."""
        out, left = np.zeros(len(keys), bool), np.arange(len(keys))
        for k, level in enumerate(self.levels):
            if not len(left):
                return out
            hit = level.may_hold([keys[i] for i in left.tolist()])
            out[left[~hit]] = k % 2 == 1
            left = left[hit]
        out[left] = len(self.levels) % 2 == 1
        return out


def _level(keys: DataFrame, n: int, rate: float, number: int, max_bytes: int) -> Level | None:
    size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(size / max(n, 1) * math.log(2)))
    hashes = min(hashes, 16)
    if size > 8 * max_bytes:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_pylist(), size, hashes, number))
            word = at >> 6
            cut = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(at) else np.zeros(0, np.int64)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), cut) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[cut]), pa.array(mask.view(np.int64))], ["word", "mask"])

    got = keys.select("key").transform(mapped, run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(-(-size // 64), np.int64)
    words[np.asarray(got.column("word"))] = np.asarray(got.column("mask"))
    return Level(words.view(np.uint8), size, hashes, number)


def build_cascade(universe: DataFrame, listed: DataFrame, rates: tuple[float, float] = (0.05, 0.5), max_bytes: int = 64 << 20) -> Cascade | None:
    """A cascade over the keys of `universe` (column key, distinct) of which `listed` (column key) are listed.

    rates: of wrong answers, of the first level and of those after it. max_bytes: of one level; None is returned where that is not enough,
    and the caller falls back on a join.
    """
    inside = stored(universe.join(listed.select("key").distinct(), "key", "left_semi"))
    outside = universe.join(listed.select("key"), "key", "left_anti")
    levels: list[Level] = []
    while n := inside.count():
        level = _level(inside, n, rates[min(1, len(levels))], len(levels), max_bytes)
        if level is None:
            return None
        levels.append(level)
        sent = universe.sparkSession.sparkContext.broadcast(level)

        def wrong(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(sent.value.may_hold(batch.column(0).to_pylist()), pa.bool_()))

        inside, outside = stored(outside.select("key").transform(mapped, wrong, "key string")), inside
    return Cascade(levels)


def _keys(pages: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """The complete universe: every key that any url of the corpus can ask for, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set(zip(*(batch.column(c).to_pylist() for c in ("host", "path"))))
            keys = sorted({k for h, p in pairs for k in candidates(h, p, lengths)})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])

    longest = max(lengths, default=0)
    return pages.select("host", F.substring("path", 1, longest).alias("path")).distinct().transform(mapped, run, "key string").distinct()


#: What a key can be listed as: a rule that blocks or allows, or a blocked host.
LISTS = ("block", "allow", "host")


def _listed(spark: SparkSession, rules: Sequence[Rule] | DataFrame, blocked: Sequence[str] | DataFrame) -> DataFrame:
    """key and list of every listed key."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(h,) for h in blocked], "host string")
    nul = F.lit("\x00")
    keys = rules.select(F.concat("host", nul, "path").alias("key"), F.col("verdict").alias("list"))
    return keys.unionAll(blocked.select(F.concat("host", nul), F.lit("host"))).filter("key is not null").distinct()


def _judged(keys: list[str], found: dict[str, str], hosts: set[str]) -> tuple[str | None, str]:
    """Rule and verdict of a url by its keys, longest first; found: which of them are rules, and of what verdict."""
    rule = next((k for k in keys if k in found), None)
    if rule is not None:
        return rule.replace("\x00", ""), found[rule]
    return None, "block" if any(k in hosts for k in keys) else "allow"


RESULT = "page_id bigint, host string, path string, rule string, verdict string"


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, blocked: Sequence[str] | DataFrame = (), max_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule (its text, else null) and verdict for every row.

    The longest rule that fits decides (host and path together; of equal ones that with the longer host). Without one, a host that is
    listed in `blocked`, or lies under one that is, is blocked, any other allowed. rules (host, path, verdict) and blocked (host) are lists
    or tables of any size. Three cascades, of blocking rules, allowing rules and hosts, are all that the tasks get of them; where a level of
    one would take more than max_bytes, keys meet the lists by a join instead, with the same result. A key that is listed as blocking and
    allowing at once blocks. Null urls and urls without :// have an empty host and path and are allowed; repeated rows give equal rows; an
    empty table gives an empty one; other columns than page_id and url are not read.
    """
    spark = pages.sparkSession
    listed = stored(_listed(spark, rules, blocked))
    # rules of equal path lengths share keys; there are no more lengths than the longest path has characters
    found = listed.filter("list <> 'host'").select(F.length(F.substring_index("key", "\x00", -1)).alias("n")).distinct().collect()
    lengths = tuple(sorted({r["n"] for r in found} | {0}))
    held = with_parts(pages.select("page_id", "url")).select("page_id", "host", "path")
    universe = stored(_keys(held, lengths))
    cascades = {x: build_cascade(universe, listed.filter(F.col("list") == x), max_bytes=max_bytes) for x in LISTS}
    if None in cascades.values():
        return _by_join(held, listed, lengths)
    sent = spark.sparkContext.broadcast(cascades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, longest = sent.value, max(lengths)
        for batch in batches:
            pairs = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()))
            cut = [(h, p[:longest]) for h, p in pairs]
            asked = {pair: candidates(*pair, lengths) for pair in set(cut)}
            flat = sorted({k for ks in asked.values() for k in ks})
            held_by = {x: {k for k, hit in zip(flat, member[x].contains(flat).tolist()) if hit} for x in LISTS}
            rules = dict.fromkeys(held_by["allow"], "allow") | dict.fromkeys(held_by["block"], "block")
            judged = {pair: _judged(keys, rules, held_by["host"]) for pair, keys in asked.items()}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([judged[c][0] for c in cut], pa.string()), pa.array([judged[c][1] for c in cut], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return held.transform(mapped, run, RESULT)


def _by_join(held: DataFrame, listed: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """The same without filters: the distinct hosts and beginnings of paths ask the lists for all their keys."""
    longest = max(lengths)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, c, k, -rank) for h, c in zip(*(batch.column(x).to_pylist() for x in ("host", "cut"))) for rank, k in enumerate(candidates(h, c, lengths))]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["host", "cut", "key", "rank"])

    held = held.withColumn("cut", F.substring("path", 1, longest))
    asked = held.select("host", "cut").distinct().transform(mapped, ask, "host string, cut string, key string, rank bigint").join(listed, "key")
    rule = F.col("list") != "host"
    best = asked.groupBy("host", "cut").agg(F.max(F.when(rule, F.struct("rank", "list", "key"))).alias("rule"), F.bool_or(~rule).alias("under"))
    joined = held.join(best, ["host", "cut"], "left")
    return joined.select("page_id", "host", "path", F.replace(F.col("rule.key"), F.lit("\x00"), F.lit("")).alias("rule"), F.coalesce("rule.list", F.when(F.col("under"), "block"), F.lit("allow")).alias("verdict"))
