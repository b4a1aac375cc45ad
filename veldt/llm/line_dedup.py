"""Fuzzy line deduplication in DataFrame operations only.

Lines are normalised, and equal ones are one node from there on. Nodes meet in sixteen blocks of four least hashes of
their pairs of neighbouring words (of words and fours of characters in lines of few words), two bits of each least
hash tell apart what meets by chance, edit similarity verifies, verified pairs close into groups, and of each group
only the first occurrence stays. Blocks of a SimHash would need three differing bits at most: one word changed in
twenty turns over about six, and most similar lines would never meet. That form is kept: without ``whole``, lines meet
by pigeonhole in pairs of SimHash blocks.

In a small block all lines are compared. In a large one every line is first compared with a few pivots; once those
links have closed, only lines outside the block's largest group are compared with the others, so that a block in
which thousands of lines are alike costs a comparison a line, not one a pair, and no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.llm.common import drop_kept, keep, release_shuffles, unused
from veldt.llm.graph import components

RADIUS, SIMILAR = 3, 0.8
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Lines up to this many characters are compared by characters, pairs with a longer one by words.
BY_CHARS = 1280
#: Lines of a shard that are compared pair by pair; larger shards are led by a pivot.
SMALL = 8
#: Lines up to this many characters have under 2^14 words, which four lanes of 16 bits count; longer ones take two of 32.
NARROW = 32_000
#: Least hashes of a line, and the four that each band takes: every one serves two bands.
LEAST = 32
BANDS = tuple(tuple((b * 2 + step) % LEAST for step in (0, 5, 11, 22)) for b in range(LEAST // 2))
MASKS = np.random.default_rng(10).integers(-(1 << 31), 1 << 31, LEAST).tolist()
#: Lines of fewer words meet by words instead of pairs of words; lines of at most MANY words meet by fours of characters
#: besides, so that similar lines on both sides of FEW have a kind in common.
FEW, MANY = 10, 16
#: Of the least hashes' last two bits, how many may differ for a pair to be verified, by kind.
UNLIKE = (10, 13, 14)
#: Pivots that the lines of a large shard are compared with before the rest are compared with each other.
PIVOTS = 2
#: How many words on an equal word is looked for when two lines are compared word by word in turn.
AHEAD = 8


#: ASCII, Latin-1, general and CJK punctuation, white space and controls; and those of them that are white space or controls.
MARKS = r"[\x00-/:-@\[-`{-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f]+"
BLANKS = r"[\x00-\x20\x7f\u00a0\u2000-\u200b\u3000]+"


def normalise(line: Column) -> Column:
    """Lower case; every run of MARKS as one space, none at the ends. A line of such marks alone keeps those that are not BLANKS."""
    low = F.lower(line)
    plain = F.trim(F.regexp_replace(low, MARKS, " "))
    return F.when(plain != "", plain).otherwise(F.trim(F.regexp_replace(low, BLANKS, " ")))


def normal_lines(raw: DataFrame) -> DataFrame:
    """doc_id, line_no, norm of (doc_id, line_no, line): as normalise(), each pattern run once a line and no filter that would run it again."""
    low = raw.select("doc_id", "line_no", F.lower("line").alias("low"))
    plain = low.select("doc_id", "line_no", "low", F.trim(F.regexp_replace("low", MARKS, " ")).alias("plain"))
    return plain.select("doc_id", "line_no", F.when(F.col("plain") != "", F.col("plain")).otherwise(F.trim(F.regexp_replace("low", BLANKS, " "))).alias("norm"))


def _counted(lines: DataFrame, lanes: int) -> DataFrame:
    """doc_id, line_no, hash, sim of (doc_id, line_no, norm), with that many lanes to a long.

    Distinct words are exploded and counted where they are, in generated code: 64 counters lie in 64 / lanes sums.
    (With repeats, one common word or a bar between columns would decide the bits of all its lines alike.) In each
    lane n + half - 2 x count keeps its top bit unless over half of the words have the bit.
    """
    width = 64 // lanes
    ones = sum(1 << width * k for k in range(lanes))
    guards = ones << (width - 2)
    words = lines.select("doc_id", "line_no", F.xxhash64("norm").alias("hash"), F.explode_outer(F.array_distinct(F.split("norm", " "))).alias("w")).filter("w <> ''").select("doc_id", "line_no", "hash", F.xxhash64("w").alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(ones)).alias(f"c{j}") for j in range(width)]
    counted = words.groupBy("doc_id", "line_no", "hash").agg(*sums, F.count(F.lit(1)).alias("n"))
    room = F.col("n") * F.lit(ones) + F.lit(guards)
    sim = F.lit(0).cast("long")
    for j in range(width):
        over = F.shiftrightunsigned(F.bitwise_not(F.col("room") - F.col(f"c{j}") * 2), width - 2).bitwiseAND(ones)
        sim = sim.bitwiseOR(F.shiftleft(over, j))
    return counted.withColumn("room", room).select("doc_id", "line_no", "hash", F.lit(0).alias("kind"), sim.alias("sim"))


def hashed_lines(raw: DataFrame) -> DataFrame:
    """doc_id, line_no, hash, sim of the lines (doc_id, line_no, line) that hold anything but white space.

    A line is known by the 64-bit hash of its normal form. Bit b of sim is 1 if over half of its distinct words' hashes have it.
    """
    size = F.length("line")
    return _counted(normal_lines(raw.filter(size <= NARROW)), 4).union(_counted(normal_lines(raw.filter(size > NARROW)), 2))


def least_hashes(parts: DataFrame) -> DataFrame:
    """hash, kind, sim, b0 ...: two bits of each least hash with the line's length, and a hash of each band of them, of (hash, kind, len, h), a row for each part's hash h.

    Equal lines have equal parts, so that repeats of a line change nothing.

    A least hash is the smallest of 32 bits of the parts' hashes, each from another place on and turned over by another
    mask: bits from one place would put the parts in much the same order again and again.
    """
    bits = [F.shiftright(F.shiftleft("h", i), 32).cast("int") for i in range(LEAST)]
    found = parts.groupBy("hash", "kind").agg(F.max("len").alias("len"), *[F.min(x.bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, (x, m) in enumerate(zip(bits, MASKS, strict=True))])
    sim = F.lit(0).cast("long")
    for i in range(LEAST):
        sim = sim.bitwiseOR(F.shiftleft(F.hash(f"m{i}").bitwiseAND(3).cast("long"), 2 * i))
    return found.select("hash", "kind", F.struct(sim.alias("bits"), "len").alias("sim"), *[F.hash(*[f"m{i}" for i in band]).alias(f"b{b}") for b, band in enumerate(BANDS)])


def banded_lines(raw: DataFrame) -> DataFrame:
    """hash, kind, sim, b0 ... of the distinct lines that hold anything but white space.

    Kind 0 is by pairs of neighbouring words; lines of fewer than FEW words have kind 2, by words, instead. Lines of at
    most MANY words also have kind 1, by fours of neighbouring characters: threes are syllables that unlike lines share. The outer explode keeps Spark from testing,
    and so computing, the array beforehand.
    """
    split = normal_lines(raw).select("norm", F.xxhash64("norm").alias("hash"), F.split("norm", " ").alias("ws"))
    sized = split.select("norm", "hash", "ws", F.size("ws").cast("int").alias("n"), F.length("norm").alias("len"))
    parts = sized.select("hash", "len", "n", F.when(F.col("n") <= MANY, F.concat("ws", F.split("norm", ""))).otherwise(F.col("ws")).alias("parts"))
    each = parts.select("hash", "len", "n", "parts", F.posexplode_outer("parts").alias("at", "part")).filter("part <> ''")
    chars = F.col("at") >= F.col("n")
    near = [F.when(chars | ((F.col("n") >= FEW) & (F.col("at") + 1 < F.col("n"))), F.get("parts", F.col("at") + 1)), *[F.when(chars, F.get("parts", F.col("at") + k)) for k in (2, 3)]]
    return least_hashes(each.select("hash", "len", F.when(chars, 1).when(F.col("n") < FEW, 2).otherwise(0).alias("kind"), F.xxhash64("part", *near).alias("h")))


def raw_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, line_no, line of the rows with an id and a text."""
    split = df.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("doc_id"), F.posexplode_outer(F.split(F.col(f"`{text}`"), "\n")).alias("line_no", "line"))
    return split.filter("line is not null")


def comparable(norm: Column, whole: bool = False) -> list[Column]:
    """The line by characters if it is short, and as a letter a word if it is long; by characters at any length if ``whole``."""
    if whole:
        return [norm.alias("chars"), F.lit(None).cast("string").alias("words")]
    n = F.length(norm)
    spelled = F.array_join(F.transform(F.split(norm, " "), lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(0xD800))), 4, "0")), "")
    return [F.when(n <= BY_CHARS, norm).alias("chars"), F.when(n >= int(BY_CHARS * SIMILAR), F.decode(F.unhex(spelled), "UTF-16BE")).alias("words")]


def same_start(x: Column, y: Column) -> Column:
    """Into how many elements two arrays are equal from their start."""
    differ = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(x)).cast("int")


def in_turn(x: Column, y: Column) -> Column:
    """A distance of two arrays of words, each with its space, that is never below their edit distance.

    A word of x meets the next of y that equals it, at most AHEAD words on; what lies between two meetings is replaced.
    """
    chars = lambda w: F.aggregate(w, F.lit(0), lambda n, v: n + F.length(v) + 1)

    def turn(s: Column, w: Column) -> Column:
        k = F.array_position(F.slice(y, s["at"] + 1, AHEAD), w).cast("int")
        met = F.struct((s["at"] + k).alias("at"), F.lit(0).alias("left"), (s["cost"] + F.greatest(s["left"], F.when(k > 1, chars(F.slice(y, s["at"] + 1, k - 1))).otherwise(0))).alias("cost"))
        return F.when(k > 0, met).otherwise(F.struct(s["at"].alias("at"), (s["left"] + F.length(w) + 1).alias("left"), s["cost"].alias("cost")))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("left"), F.lit(0).alias("cost"))
    return F.aggregate(x, start, turn, lambda s: s["cost"] + F.greatest(s["left"], chars(F.slice(y, s["at"] + 1, F.size(y)))))


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose edit similarity is SIMILAR or more.

    Words that both lines start or end with do not count towards the distance, and what lies between is never further
    apart than the longer of the two. Else it is compared word by word in place, then by words met in turn: neither sum
    is ever below the distance, and they settle most pairs; the rest is compared by characters, within the distance allowed.
    Each step is a projection of its own and the last filter stands behind a generator, since a filter that Spark
    pushes into projections computes them once for every use.
    """
    side = lambda x: held.select(F.col("node").alias(x), F.col("chars").alias(f"{x}_chars"), F.col("words").alias(f"{x}_words"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    pick = F.col("a_chars").isNotNull() & F.col("b_chars").isNotNull()
    both = both.select("a", "b", F.when(pick, F.col("a_chars")).otherwise(F.col("a_words")).alias("x"), F.when(pick, F.col("b_chars")).otherwise(F.col("b_words")).alias("y"))
    room = F.floor((1 - SIMILAR + 1e-9) * F.greatest(F.length("x"), F.length("y"))).cast("int")
    both = both.filter(F.abs(F.length("x") - F.length("y")) <= room).select("a", "b", room.alias("room"), F.split("x", " ").alias("x"), F.split("y", " ").alias("y"))
    rest = both.select("a", "b", "room", "x", "y", same_start(F.col("x"), F.col("y")).alias("head"))
    rest = rest.select("a", "b", "room", *[F.slice(F.reverse(w), 1, F.size(w) - F.col("head")).alias(w) for w in "xy"])
    rest = rest.select("a", "b", "room", "x", "y", same_start(F.col("x"), F.col("y")).alias("tail"))
    rest = rest.select("a", "b", "room", *[F.reverse(F.slice(w, F.col("tail") + 1, F.size(w))).alias(w) for w in "xy"])
    span = lambda w: F.when(F.size(w) > 0, F.length(F.array_join(w, " ")) + 1).otherwise(0)
    rest = rest.select("a", "b", "room", "x", "y", F.greatest(span("x"), span("y")).alias("most"))
    step = lambda p, q: F.when(p.eqNullSafe(q), 0).when(p.isNull(), F.length(q) + 1).when(q.isNull(), F.length(p) + 1).otherwise(F.levenshtein(p, q))
    in_place = F.when(F.col("most") > F.col("room"), F.aggregate(F.zip_with("x", "y", step), F.lit(0), lambda n, d: n + d)).otherwise(0)
    placed = rest.select("a", "b", "room", "x", "y", in_place.alias("placed"))
    led = placed.select("a", "b", "room", "x", "y", F.when(F.col("placed") > F.col("room"), in_turn(F.col("x"), F.col("y"))).otherwise(0).alias("turns"))
    spaced = [F.when(F.size(w) > 0, F.concat(F.lit(" "), F.array_join(w, " "))).otherwise("") for w in "xy"]
    near = F.when(F.col("turns") <= F.col("room"), True).otherwise(F.call_function("levenshtein", *spaced, F.col("room")) >= 0)
    return led.select(F.explode_outer(F.when(near, F.array(F.struct("a", "b")))).alias("pair")).filter("pair is not null").select("pair.a", "pair.b")


def shards(nodes: DataFrame) -> DataFrame:
    """hash, shard (an int): the ten pairs of blocks of each node's SimHash."""
    block = [F.shiftrightunsigned("sim", low).bitwiseAND((1 << width) - 1) for low, width in BLOCKS]
    keys = [F.lit(t << 26).bitwiseOR(F.shiftleft(block[x], 13)).bitwiseOR(block[y]).cast("int") for t, (x, y) in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))]
    return nodes.select("hash", F.explode(F.array(*keys)).alias("shard"))


def met_in_bands(cards: DataFrame, bands: int, step: int = 4) -> DataFrame:
    """shard, size, hash, sim of the nodes that share a band with another, of (hash, kind, sim, b0 ...); ``step`` bands at a time, so that little lies on disk."""
    met = None
    for at in range(0, bands, step):
        keys = [F.shiftleft(F.col("kind").cast("long") * bands + b, 32).bitwiseOR(F.col(f"b{b}").cast("long").bitwiseAND((1 << 32) - 1)) for b in range(at, min(at + step, bands))]
        dealt = cards.select("hash", "sim", F.explode(F.array(*keys)).alias("shard"))
        some = keep(dealt.select("shard", F.count(F.lit(1)).over(Window.partitionBy("shard")).alias("size"), "hash", "sim").filter("size > 1"))
        met = some if met is None else met.union(some)
        release_shuffles(cards.sparkSession)
    return met


def met_in_blocks(cards: DataFrame) -> DataFrame:
    """shard, size, hash, sim of the nodes that share two blocks of their SimHash with another."""
    dealt = shards(cards)
    shared = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return keep(dealt.join(shared.hint("shuffle_hash"), "shard").join(cards.select("hash", "sim"), "hash").select("shard", "size", "hash", "sim"))


Near = Callable[[Column, Column, Column], Column]


def distinct_lines(places: DataFrame) -> DataFrame:
    """hash, first, n: each line's first place and how often it occurs, of (doc_id, line_no, hash)."""
    return places.groupBy("hash").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))


def distinct_cards(numbered: DataFrame) -> DataFrame:
    """hash, kind and the other columns of (doc_id, line_no, hash, kind ...), a row for each hash and kind."""
    carried = [c for c in numbered.columns if c not in ("doc_id", "line_no", "hash", "kind")]
    return numbered.groupBy("hash", "kind").agg(*[F.min(c).alias(c) for c in carried])


def joined(named: DataFrame, more: DataFrame) -> DataFrame:
    """node, component once the links (a, b) of more are closed too: only the components that they touch are closed anew."""
    own = lambda x: named.select(F.col("node").alias(x), F.col("component").alias(f"{x}_own"))
    ends = keep(more.join(own("a"), "a", "left").join(own("b"), "b", "left").select("a", "b", F.coalesce("a_own", "a").alias("a_own"), F.coalesce("b_own", "b").alias("b_own")))
    roots = keep(components(ends.select(F.col("a_own").alias("a"), F.col("b_own").alias("b"))))
    fresh = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(named, "node", "left_anti").select("node", F.col("node").alias("component"))
    every = named.union(fresh).select("node", F.col("component").alias("own")).join(roots.select(F.col("node").alias("own"), "component"), "own", "left")
    after = keep(every.select("node", F.coalesce("component", "own").alias("component")))
    for done in (named, ends, roots):
        drop_kept(done)
    return after


def groups(raw: DataFrame, nodes: DataFrame, cards: DataFrame, met: Callable[[DataFrame], DataFrame], near: Near, hold: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """hash, group, first: the lines that occur twice or link to another, what names their group, and where they occur first.

    raw: doc_id, line_no, line; nodes: hash, first, n; cards: a kept table of hash, kind and what met needs, dropped once
    read. met: shard, size, hash, sim of the nodes that meet; near: whether two sims of a shard are
    near enough to compare; hold: node and what a comparison needs of (node, line); check: the pairs (a, b) of nodes that are alike.
    """
    spark = raw.sparkSession
    meetings = met(cards)
    drop_kept(cards)
    release_shuffles(spark)
    few, many = meetings.filter(F.col("size") <= SMALL), meetings.filter(F.col("size") > SMALL)
    other = few.select(F.col("shard").alias("b_shard"), F.col("hash").alias("b"), F.col("sim").alias("b_sim"))
    close = few.join(other, (F.col("shard") == F.col("b_shard")) & (F.col("hash") < F.col("b")) & near(F.col("sim"), F.col("b_sim"), F.col("shard"))).select(F.col("hash").alias("a"), "b")

    def led(lines: DataFrame, of: DataFrame, turn: int) -> DataFrame:
        """The lines with a pivot of their shard, taken from another table of shards, that are near it."""
        at = F.xxhash64("hash", F.lit(turn))
        pivots = of.groupBy("shard").agg(F.min_by("hash", at).alias("pivot"), F.min_by("sim", at).alias("pivot_sim"))
        return lines.join(pivots, "shard").filter((F.col("hash") != F.col("pivot")) & near(F.col("sim"), F.col("pivot_sim"), F.col("shard"))).select(F.col("pivot").alias("a"), F.col("hash").alias("b"))

    def once(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    stars = keep(once(close.union(led(many, many, 0))))
    wanted = stars.select(F.explode(F.array("a", "b")).alias("hash")).union(many.select("hash")).distinct()
    places = wanted.join(nodes, "hash").select("hash", "first.doc_id", "first.line_no")
    held = keep(hold(places.hint("merge").join(raw, ["doc_id", "line_no"]).select(F.col("hash").alias("node"), "line")).dropDuplicates(["node"]))
    release_shuffles(spark)
    named = keep(components(keep(check(stars, held))))
    tried = [stars]
    for turn in range(1, PIVOTS + 1):
        own = many.join(named, F.col("hash") == F.col("node"), "left").select("shard", "hash", "sim", F.coalesce("component", "hash").alias("own"))
        most = own.groupBy("shard", "own").count().groupBy("shard").agg(F.max_by("own", "count").alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
        crowd = keep(own.join(most, "shard").select("shard", "hash", "sim", "own", (F.col("own") != F.col("main")).alias("out")))
        if turn < PIVOTS:
            pairs = led(crowd.filter("out"), crowd.filter("not out"), turn)
        else:  # what no pivot has joined meets all others of its shard
            # a pair meets in the first only of the shards that both stand in; those below 0 may be very many to a node, and are no homes
            homes = crowd.groupBy("hash").agg(F.array_sort(F.collect_set(F.when(F.col("shard") >= 0, F.col("shard")))).alias("homes"))
            placed = keep(crowd.join(homes, "hash"))
            left, right = (placed.select(*[F.col(c).alias(f"{x}_{c}") for c in placed.columns]) for x in "lr")
            apart = (F.col("l_own") != F.col("r_own")) & (~F.col("r_out") | (F.col("l_hash") < F.col("r_hash"))) & near(F.col("l_sim"), F.col("r_sim"), F.col("l_shard"))
            first = (F.col("l_shard") < 0) | (F.get(F.array_intersect("l_homes", "r_homes"), F.lit(0)) == F.col("l_shard"))
            pairs = left.filter("l_out").join(right, (F.col("l_shard") == F.col("r_shard")) & apart & first).select(F.col("l_hash").alias("a"), F.col("r_hash").alias("b"))
        fresh = once(pairs)
        for before in tried:  # what was compared in an earlier turn and not alike is not compared again
            fresh = fresh.join(before, ["a", "b"], "left_anti")
        tried.append(keep(fresh))
        more = keep(check(tried[-1], held))
        drop_kept(crowd)
        release_shuffles(spark)
        if not more.isEmpty():
            named = joined(named, more)
    for done in (meetings, held, *tried):
        drop_kept(done)
    release_shuffles(spark)
    rooted = nodes.join(named, F.col("hash") == F.col("node"), "left").filter("component is not null or n > 1")
    return rooted.select("hash", F.coalesce("component", "hash").alias("group"), "first")


def alike_lines(raw: DataFrame, nodes: DataFrame, cards: DataFrame, whole: bool) -> DataFrame:
    """hash, low: the lines that occur twice or link to another, with their group's first occurrence."""
    hold = lambda lines: lines.select("node", *comparable(normalise(F.col("line")), whole))

    def near(a: Column, b: Column, shard: Column) -> Column:
        if not whole:
            return F.bit_count(a.bitwiseXOR(b)) <= RADIUS
        x, gap = a["bits"].bitwiseXOR(b["bits"]), F.abs(a["len"] - b["len"]) <= (1 - SIMILAR + 1e-9) * F.greatest(a["len"], b["len"])
        unlike = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(sum(1 << 2 * i for i in range(LEAST))))
        return gap & (unlike <= F.when(shard < len(BANDS) << 32, UNLIKE[0]).when(shard < 2 * len(BANDS) << 32, UNLIKE[1]).otherwise(UNLIKE[2]))

    met = (lambda cards: met_in_bands(cards, len(BANDS))) if whole else met_in_blocks
    found = keep(groups(raw, nodes, cards, met, near, hold, verified))
    low = found.groupBy("group").agg(F.min("first").alias("low"))
    return found.join(low, "group").select("hash", "low")


def fuzzy_line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """df with every line removed that repeats, or nearly repeats, a line earlier by (id, place).

    Lines of white space alone stay. Columns, also others of any name, keep their order; rows keep their
    number: a text may lose all its lines and become empty. A null text stays null. Rows with a null id are
    left as they are and compared with nothing. Rows that share an id are one document: what one loses the other
    loses. An empty table stays empty. ``whole`` compares all lines that share a band, else those within RADIUS bits.
    """
    raw = raw_lines(df, key, text)
    if whole:
        # a filter on the normal form would run it twice
        places = keep(normal_lines(raw).select("doc_id", "line_no", F.when(F.col("norm") != "", F.xxhash64("norm")).alias("hash"))).filter("hash is not null")
        cards = keep(banded_lines(raw))
    else:
        numbered = keep(hashed_lines(raw))
        cards, places = keep(distinct_cards(numbered)), keep(numbered.select("doc_id", "line_no", "hash"))
        drop_kept(numbered)
    release_shuffles(df.sparkSession)
    nodes = keep(distinct_lines(places))
    release_shuffles(df.sparkSession)
    drops = places.join(alike_lines(raw, nodes, cards, whole), "hash").filter(F.struct("doc_id", "line_no") != F.col("low"))
    left = keep(drops.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone")))
    for done in (places, nodes):
        drop_kept(done)
    release_shuffles(df.sparkSession)
    own, lost, parts = unused(df, "id"), unused(df, "gone"), unused(df, "lines")
    joined = df.join(left.select(F.col("doc_id").alias(own), F.col("gone").alias(lost)), F.col(f"`{key}`") == F.col(own), "left")
    split = joined.withColumn(parts, F.when(F.col(lost).isNotNull(), F.split(F.col(f"`{text}`"), "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost))  # by a hash set, in linear time
    cut = F.when(F.col(lost).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(parts), i)), "\n"))
    return split.select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that repeat, or nearly repeat, an earlier one; see fuzzy_line_dedup() for nulls, ties and repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    after = fuzzy_line_dedup(docs, whole=True)
    return after.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
