"""URL verdicts by a cascade of Bloom filters with exact membership over the corpus.

A rule names a host and the beginning of a path; it fits that host and all its subdomains. The
keys of a url are therefore all (parent domain, path beginning) pairs at the lengths that rules
have, longest first. The universe is every distinct key of the corpus.

Level 1 of a cascade holds the listed keys; level 2 the other keys of the universe that level 1
lets through; level 3 the listed keys that level 2 lets through; and so on until none are left.
A key of the universe is listed exactly if the first level that rejects it is an even one. So
each url is judged in place by a few bit tests, without a join and without a false verdict.

Level 1 is sized for a false positive rate of about |listed| / (1.4 |others|), every later level
for 1/2, which keeps the whole cascade at about |listed| * log2(|others| / |listed|) bits: its
size follows the list, not the corpus. Bits are set on the executors and or-ed in an aggregate.

Two cascades are used: rules (with a second one that tells blocking from allowing rules), and
the list of blocked hosts for urls that no rule fits.

Defined cases: a null url and one without "://" have empty host and path and no keys; they are
allowed; an empty list gives an empty cascade that lists nothing; repeated rows each get their
verdict; other columns are never looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import bit_array, bit_table, bits_at, cut

#: (verdict, host, path beginning)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Words that name a host for the blocked list, as a whole part between dots and hyphens.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam", "track")
LEVELS = 64


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parents, longest first; none for an empty host."""
    parts = F.split(host, r"\.")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(each)


def hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes, from which all bit positions are derived."""
    return [F.xxhash64(key), F.xxhash64(F.concat(F.lit("\u0001"), key, F.lit("\u0002")))]


def each_hash(keys: str, i: int) -> Column:
    return F.transform(keys, lambda k: hashes(k)[i])


@dataclass
class Level:
    bits: np.ndarray
    size: int
    probes: int


@dataclass
class Cascade:
    levels: list[Level]

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Membership of keys of the universe, given as their two hashes."""
        out = np.zeros(len(h1), dtype=bool)
        live = np.arange(len(h1))
        for number, level in enumerate(self.levels):
            passed = probe(level, number, h1[live], h2[live])
            # rejected by an odd level (counted from 1): not listed; by an even one: listed
            out[live[~passed]] = number % 2 == 1
            live = live[passed]
        # what passes the last level is what that level holds
        out[live] = len(self.levels) % 2 == 1
        return out


def turn(i: int, number: int) -> int:
    """By how many bits probe ``i`` of level ``number`` turns the second hash."""
    return 1 + (11 * i + 5 * number) % 63


def positions(h1: np.ndarray, h2: np.ndarray, i: int, number: int, size: int) -> np.ndarray:
    r, u = np.uint64(turn(i, number)), h2.view(np.uint64)
    turned = (u << r) | (u >> (np.uint64(64) - r))
    return (h1 ^ turned.view(np.int64)) % np.int64(size)


def position(i: int, number: int, size: int) -> Column:
    """The same as a column over h1, h2."""
    r = turn(i, number)
    turned = F.shiftleft("h2", r).bitwiseOR(F.shiftrightunsigned("h2", 64 - r))
    return F.pmod(F.col("h1").bitwiseXOR(turned), F.lit(size).cast("long"))


def probe(level: Level, number: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h1), dtype=bool)
    for i in range(level.probes):
        ok &= bits_at(level.bits, positions(h1, h2, i, number, level.size))
    return ok


def fill(keys: DataFrame, n: int, number: int, rate: float) -> Level:
    """A level for ``n`` keys (h1, h2) with about this rate of false positives."""
    probes = max(1, round(-math.log2(rate)))
    size = max(64, math.ceil(n * probes / math.log(2)))
    bits = bit_table(keys, [position(i, number, size) for i in range(probes)])
    return Level(bit_array(bits, size), size, probes)


def passing(keys: DataFrame, level: Level, number: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield batch.filter(pa.array(probe(level, number, h1, h2)))

    return keys.mapInArrow(run, keys.schema)


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """``listed`` and ``universe``: distinct keys (key). Listed keys outside the universe are kept."""
    h = [c.alias(f"h{i + 1}") for i, c in enumerate(hashes(F.col("key")))]
    inside = cut(listed.select(*h).distinct())
    outside = cut(universe.select(*h).distinct().join(inside, ["h1", "h2"], "left_anti"))
    sizes = [inside.count(), outside.count()]
    if not sizes[0]:
        return Cascade([])
    sides, levels = [inside, outside], []
    while True:
        number = len(levels)
        mine, other = sides[number % 2], sides[1 - number % 2]
        rate = 0.5 if number else min(0.5, sizes[0] / (1.4142 * max(sizes[1], 1)))
        level = fill(mine, sizes[number % 2], number, rate)
        levels.append(level)
        left = cut(passing(other, level, number))
        n = left.count()
        sides[1 - number % 2], sizes[1 - number % 2] = left, n
        if not n:
            return Cascade(levels)
        if number > LEVELS:
            raise RuntimeError("two keys share both hashes; the cascade cannot tell them apart")


def rule_keys(spark: SparkSession, rules) -> DataFrame:
    rows = [(host + path, verdict == "block") for verdict, host, path in rules]
    return spark.createDataFrame(rows, "key string, blocks boolean")


def parted(pages: DataFrame, key: str, url: str, lengths: list[int]) -> DataFrame:
    """(page_id, host, path, keys, domains): the rule keys of each url, longest first."""
    base = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    tops = F.array(*[F.lit(n) for n in sorted(lengths, reverse=True)]) if lengths else F.array().cast("array<int>")
    starts = F.transform(
        F.filter(tops, lambda n: F.length("path") >= n), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    # longest first: by length of host and path together, then by length of the host
    pairs = F.flatten(F.transform(F.col("domains"), lambda d: F.transform(F.col("starts"), lambda p: F.struct((-F.length(d) - F.length(p)).alias("l"), (-F.length(d)).alias("m"), F.concat(d, p).alias("k")))))
    return (
        base.withColumn("domains", domains_of(F.col("host")))
        .withColumn("starts", starts)
        .withColumn("keys", F.transform(F.array_sort(pairs), lambda x: x["k"]))
        .drop("starts")
    )


def judge(pages: DataFrame, blocked_hosts: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row. ``blocked_hosts``: (key), a list of hosts
    that block themselves and their subdomains where no rule fits."""
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, _, path in rules})
    parts = parted(pages, key, url, lengths)
    shapes = cut(parts.select("domains", "keys").distinct())
    universe = shapes.select(F.explode("keys").alias("key")).distinct()
    hosts = shapes.select(F.explode("domains").alias("key")).distinct()
    listed = rule_keys(spark, rules)
    in_rules = build_cascade(listed.select("key"), universe)
    blocks = build_cascade(listed.where("blocks").select("key"), listed.select("key"))
    in_list = build_cascade(blocked_hosts.select("key"), hosts)

    def run(batches):
        for batch in batches:
            keys, domains = batch.column(3), batch.column(4)
            rule, is_block = first_listed(in_rules, batch.column(3), batch.column(5), batch.column(6), blocks)
            host, _ = first_listed(in_list, domains, batch.column(7), batch.column(8), None)
            verdict = [
                ("block" if b else "allow") if r is not None else ("block" if h is not None else "allow")
                for r, b, h in zip(rule, is_block, host)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[key, "host", "path", "rule", "verdict"],
            )

    ready = parts.select(key, "host", "path", "keys", "domains", *[
        each_hash(name, i).alias(f"{name}_{i}") for name in ("keys", "domains") for i in (0, 1)
    ])
    kind = dict(pages.dtypes)[key]
    return ready.mapInArrow(run, f"{key} {kind}, host string, path string, rule string, verdict string")


def first_listed(cascade: Cascade, names: pa.Array, h1: pa.Array, h2: pa.Array, second: Cascade | None) -> tuple[list, list]:
    """For each row the first listed name, and whether ``second`` holds it."""
    n = len(names)
    a, b = h1.flatten().to_numpy(), h2.flatten().to_numpy()
    owner = np.repeat(np.arange(n), np.diff(h1.offsets.to_numpy()))
    hit = np.flatnonzero(cascade.holds(a, b)) if cascade.levels else np.zeros(0, np.int64)
    rows, first = np.unique(owner[hit], return_index=True)
    at = hit[first]
    flat = names.flatten()
    found: list = [None] * n
    also = [False] * n
    tells = second.holds(a[at], b[at]) if second is not None and second.levels else np.zeros(len(at), bool)
    for r, i, t in zip(rows.tolist(), at.tolist(), tells.tolist()):
        found[r], also[r] = flat[i].as_py(), t
    return found, also


def hosts_with_words(pages: DataFrame, url: str = "url", words=LISTED_WORDS) -> DataFrame:
    """(key): the hosts of the corpus that carry a listed word as a whole part of their name."""
    host = host_of(F.col(url))
    return pages.select(host.alias("key")).distinct().where(F.col("key").rlike(rf"(^|[.-])({'|'.join(words)})([.-]|$)"))
