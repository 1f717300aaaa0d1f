"""URL filters: a Bloom filter cascade that is exact over the corpus's keys, and host and path rules.

Keys are hosts and their parent domains; a host is listed if it or a parent domain of it stands in the list.  Level 0
holds the listed keys that the corpus asks for.  Level 1 holds the keys of the corpus that level 0 passes although
they are not listed, level 2 the listed keys that level 1 passes, and so on until a level passes no wrong key.  A
key's answer is the parity of the first level that refuses it.  Over the corpus's complete universe of keys the
answer is exact, so a page needs no join: the levels are constants of the plan.

A constant has at most MAX_BITS bits.  Where the keys need more, hosts are dealt by hash into parts, each with a
cascade of its own over the keys that its hosts ask for, and pages are judged part by part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import MAX_BITS, bitmap, drop, has_bit, stage


@dataclass
class Cascade:
    """levels: (bits, hashes, bitmap constant) from the listed keys downwards."""

    levels: list[tuple[int, int, Column]] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe; false for null."""
        if not self.levels:
            return F.lit(False)
        answer = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            bits, hashes, held = self.levels[depth]
            answer = F.when(_passes(key, depth, bits, hashes, held), answer).otherwise(F.lit(depth % 2 == 1))
        return F.when(key.isNull(), F.lit(False)).otherwise(answer)


def _slot(key: Column, depth: int, i: int, bits: int) -> Column:
    one, two = F.xxhash64(key, F.lit(2 * depth)), F.xxhash64(key, F.lit(2 * depth + 1))
    n = F.lit(bits)
    return F.pmod(F.pmod(one, n) + F.pmod(two, n) * i, n)


def _passes(key: Column, depth: int, bits: int, hashes: int, held: Column) -> Column:
    found = has_bit(held, _slot(key, depth, 0, bits))
    for i in range(1, hashes):
        found = found & has_bit(held, _slot(key, depth, i, bits))
    return found


def build(listed: DataFrame, universe: DataFrame, bits_per_key: int = 10) -> Cascade:
    """A cascade from one-column relations `key`: the listed keys and all keys that will be asked.

    Nulls and repeated keys count for nothing, and so do listed keys that nobody asks.  Each level is a pass over the
    keys that are still wrong, which shrink by the false-positive rate at each level; the hashes of each level are its
    own, so the levels end.
    """
    asked = stage(universe.where("key is not null").distinct(), "op2-universe")
    listed = listed.where("key is not null")
    inside = stage(asked.join(listed, "key", "left_semi"), "op2-listed")
    outside = stage(asked.join(listed, "key", "left_anti"), "op2-others")
    drop(asked)
    out = Cascade()
    while n := inside.count():
        depth = len(out.levels)
        bits = 64 * math.ceil(n * bits_per_key / 64)
        hashes = max(1, min(8, round(bits / n * math.log(2))))
        slots = inside.select(F.explode(F.array(*[_slot(F.col("key"), depth, i, bits) for i in range(hashes)])).alias("slot"))
        held = bitmap(slots, "slot", bits)
        out.levels.append((bits, hashes, held))
        wrong = stage(outside.where(_passes(F.col("key"), depth, bits, hashes, held)), "op2-level")
        drop(outside)
        inside, outside = wrong, inside
    drop(inside, outside)
    return out


@dataclass(frozen=True)
class Filter:
    """A cascade for each part of the hosts; one part unless a cascade's levels would be over MAX_BITS."""

    parts: tuple[Cascade, ...]

    def part(self, host: Column) -> Column:
        return F.pmod(F.xxhash64(host), F.lit(len(self.parts)))


#: A domain name has at most so many characters; longer parents of a host are never asked.
NAME = 253


def keys_of(host: Column) -> Column:
    """The host and its parent domains (of at most NAME characters)."""
    long = F.length(host) > NAME
    labels = F.split(F.when(long, F.right(host, F.lit(NAME + 1))).otherwise(host), r"\.")
    first = F.when(long, F.lit(2)).otherwise(F.lit(1))  # of a cut host the first label belongs to a longer name
    some = F.when(F.size(labels) >= first, F.transform(
        F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(host), some))


def filter_of(listed: DataFrame, hosts: DataFrame, bits_per_key: int = 10, max_bits: int = MAX_BITS) -> Filter:
    """The filter for one-column relations `key` (listed names) and `host` (every host that will be judged)."""
    hosts = stage(hosts.where("host is not null").distinct(), "op2-hosts")
    ask = lambda df: df.select(F.explode(keys_of(F.col("host"))).alias("key"))
    universe = ask(hosts).distinct()
    n, known = universe.count(), universe.join(listed.where("key is not null").distinct(), "key", "left_semi").count()
    # the second level holds what the first passes by mistake, about one key in a hundred
    parts = max(1, math.ceil(max(known, n / 64) * bits_per_key * 2 / max_bits))
    made = []
    for k in range(parts):
        mine = hosts if parts == 1 else hosts.where(F.pmod(F.xxhash64("host"), F.lit(parts)) == k)
        made.append(build(listed, ask(mine), bits_per_key))
    drop(hosts)
    return Filter(tuple(made))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; the path from
    there up to '?', '#' or the end.  Null or no '://': both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does.

    rules: (verdict, 'host/path').  A rule fits its host and all subdomains if the path starts with the rule's.
    Longest: most characters of the rule; a when chain in that order, so a url is judged in one pass.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]], held: Filter, url: str = "url") -> DataFrame:
    """pages with host, path, rule, listed and verdict: the rule's, else 'block' where the host or a parent is listed.

    Null urls and urls without '://' have an empty host and path, which no rule fits; they are allowed unless the empty
    name is listed.  Repeated rows are judged one by one; an empty relation gives an empty one.  Input columns named
    like one of the five are replaced, all others stay.  With several parts, each is a scan of its own.
    """
    host, path = split_url(F.col(url))
    rest = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "listed", "verdict")]
    split = pages.select(*[F.col(f"`{c}`") for c in rest], host.alias("host"), path.alias("path"))
    fit = matching_rule(F.col("host"), F.col("path"), rules)
    out: DataFrame | None = None
    for k, cascade in enumerate(held.parts):
        mine = split if len(held.parts) == 1 else split.where(held.part(F.col("host")) == k)
        listed = F.exists(keys_of(F.col("host")), lambda key: cascade.contains(key))
        judged = mine.withColumn("listed", listed).select(
            *[F.col(f"`{c}`") for c in rest], "host", "path", fit["rule"].alias("rule"), "listed",
            F.coalesce(fit["verdict"], F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
        out = judged if out is None else out.unionByName(judged)
    return out
