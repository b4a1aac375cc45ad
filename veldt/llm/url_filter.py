"""URL rules through a Bloom filter cascade, in DataFrame operations only.

Level 1 encodes the listed keys. The corpus's complete key universe is probed against it, and the keys that
pass without being listed form level 2; listed keys that pass level 2 form level 3, and so on until a level
lets nothing wrong through. Membership of every key of that universe is then exact, and judging a URL takes
bit probes into literals alone: no join, and no Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import drop_kept, keep

#: (action, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PROBES = 3
#: Words of one filter level, at most: 16,384 keys at 16 bits a key.
MOST_WORDS = 4096
#: Keys of the universe that may pass level 1 wrongly, about.
MOST_PASS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) by the plain rules: what follows the first ``://``; null or none of it gives two empty strings."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """All ``host-suffix + path-prefix`` keys by which a rule could fit: suffixes of up to ``labels`` labels, each listed prefix length.

    A rule of few labels never fits by more of them, so a host of many costs no more keys than one of few.
    """
    n = F.length(host) - F.length(F.translate(host, ".", "")) + 1
    each = [F.when((n >= k) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -k), F.lit("\n"), F.substring(path, 1, m))) for k in range(1, labels + 1) for m in lengths]
    return F.array_compact(F.array(*each))


def _slots(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 16 + j)), F.lit(bits)) for j in range(PROBES)]


def _level(keys: DataFrame, level: int, bits: int) -> list[int]:
    """The filter's words: set bits by bitwise-or aggregation; at most bits/64 rows reach the driver."""
    slots = keys.select(F.explode(F.array(*_slots(F.col("key"), level, bits))).alias("s"))
    rows = slots.groupBy(F.floor(F.col("s") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("s", F.lit(64)).cast("int"))).alias("v"))
    words = [0] * (bits // 64)
    for r in rows.collect():
        words[r.w] = r.v
    return words


def _bits_for(keys: int, share: float) -> float:
    """Bits of a filter of ``keys`` that other keys pass with probability ``share``."""
    return 0.0 if share >= 1 else PROBES * keys / -math.log1p(-(share ** (1 / PROBES)))


def _passes(key: Column, level: int, words: list[int]) -> Column:
    held = F.array(*[F.lit(w) for w in words]).cast("array<long>")
    out = F.lit(True)
    for s in _slots(key, level, len(words) * 64):
        word = F.get(held, F.floor(s / 64).cast("int"))
        out = out & (F.call_function("shiftrightunsigned", word, F.pmod(s, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def member(key: Column, levels: list[list[int]]) -> Column:
    """Exact membership: a key is listed if the first level that stops it is an even one."""
    if not levels:
        return F.lit(False)
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~_passes(key, i, levels[i]), F.lit(i % 2 == 1)).otherwise(out)
    return out


def cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 16) -> list[list[int]]:
    """Filter words by level, exact over ``universe`` and ``listed`` (both one string column ``key``).

    Sizes follow from counts: a level has bits_per_key bits a key that it encodes, and level 1 at least so many that
    no more than MOST_PASS keys of the universe are likely to pass it wrongly; a level of over MOST_WORDS is refused,
    since its words travel with the plan, which only a list of over 16,384 keys can bring about. Keys that pass are told
    from listed ones by one aggregation of both, without a join. An empty list gives no level. Null keys are not
    members. Repeated keys count once.
    """
    listed = listed.filter("key is not null").distinct()
    good, wrong = listed, universe.filter("key is not null")
    levels: list[list[int]] = []
    while True:
        n = good.count()
        if n == 0:
            return levels
        size = max(1, math.ceil(n * bits_per_key / 64))
        if not levels:
            size = max(size, min(MOST_WORDS, math.ceil(_bits_for(n, MOST_PASS / max(1, wrong.count())) / 64)))
        if size > MOST_WORDS:
            raise ValueError(f"{n} keys need {size} filter words; at most {MOST_WORDS} travel with a plan")
        words = _level(good, len(levels), 64 * size)
        passed = wrong.filter(_passes(F.col("key"), len(levels), words)).select("key")
        if levels:
            passed = passed.distinct()
        else:  # the only place where the universe is told from the list
            both = passed.select("key", F.lit(0).alias("known")).union(listed.select("key", F.lit(1).alias("known")))
            passed = both.groupBy("key").agg(F.max("known").alias("known")).filter("known = 0").select("key")
        levels.append(words)
        good, wrong = passed, good


def _fits(levels: list[list[int]], action: str) -> Column:
    """The keys of a row that are listed, longest first once sorted."""
    listed = F.filter(F.col("keys"), lambda k: member(k, levels))
    return F.transform(listed, lambda k: F.struct((-F.length(k)).alias("n"), (-F.instr(k, "\n")).alias("h"), F.translate(k, "\n", "").alias("rule"), F.lit(action).alias("verdict")))


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    The longest fitting rule decides (ties: the longer host). Where none fits, the cascades hold no key of the
    url, and that absence allows it. Null or malformed urls have empty host and path and are allowed. Repeated
    rows and null ids stay as they are; an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(f"`{url}`"))
    parts = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    lengths = sorted({len(p) for _, _, p in rules})
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    universe = keep(keyed.select(F.explode_outer("keys").alias("key")).distinct())  # pages are read once for all levels
    found = {}
    for action in ("block", "allow"):
        names = F.array(*[F.lit(f"{h}\n{p}") for a, h, p in rules if a == action]).cast("array<string>")
        levels = cascade(spark.range(1).select(F.explode(names).alias("key")), universe)
        found[action] = _fits(levels, action)
    drop_kept(universe)
    ranked = keyed.select("page_id", "host", "path", F.array_sort(F.flatten(F.array(*found.values()))).alias("fits"))
    best = F.get("fits", F.lit(0))
    return ranked.select("page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit("allow")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url; see judge() for nulls, malformed urls, ties and repeats."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP8_SQL = r"""
with u as (select page_id, case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) else '' end rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u)
select page_id, host, path,
  case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule,
  case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'allow'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'block'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'allow'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'block' else 'allow' end as verdict
from p
"""
