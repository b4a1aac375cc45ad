"""Exact substring deduplication by prefix-free parsing.

A rolling hash triggers phrase ends: in every 100-byte string the place of its least 32-byte hash is a trigger, so
the string alone decides its trigger, wherever it stands, and no string is without one. A phrase holds the starts
that share a trigger, extended by the bytes their strings reach into. The dictionary is the set of distinct
extended phrases, the parse the list of their places by document.

Only triggers that occur twice matter. Within the phrases of one trigger, the suffixes of the dictionary are put
in order to a depth of 100 bytes, ties in the order of the parse: this piece of the corpus's suffix array shows
each string next to its equals, the earliest first, and all that follow it start a repeat. A phrase that occurs
again as a whole needs no suffix: all its strings are repeats there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import bound_batches, drop_kept, keep, release_shuffles, texts

DEPTH, GRAM = 100, 32
WIDE = DEPTH - GRAM + 1
#: Starts parsed at a time; their places fit into the low bits of a hash.
BITS = 17
SEGMENT = 1 << BITS
#: Distinct phrases of one trigger that one task sorts; strings of commoner triggers are counted by hash instead.
CROWD = 8192

_BASE = 0x9E3779B97F4A7C15 | 1
_TURN = pow(_BASE, -1, 1 << 64)


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, SEGMENT + DEPTH), _powers(_TURN, SEGMENT + DEPTH)


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, from one running sum modulo 2^64."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _DOWN[:n], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * _UP[: n - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def parse(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By segment: triggers' hashes, first starts, numbers of starts and triggers' places of the phrases of raw."""
    data, starts = np.frombuffer(raw, np.uint8), len(raw) - DEPTH + 1
    for at in range(0, max(starts, 0), SEGMENT):
        h = rolling(data[at : min(at + SEGMENT + DEPTH - 1, len(raw))])
        least = h & np.uint64((1 << 64) - SEGMENT * 2) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= WIDE:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < WIDE:
            least = np.minimum(least[: len(least) - (WIDE - width)], least[WIDE - width :])
        place = (least & np.uint64(SEGMENT * 2 - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        count = np.diff(np.append(first, len(place)))
        trigger = place[first]
        yield h[trigger], first + at, count, trigger + at


PHRASE = "trigger long, phrase long, doc_id long, start int, n int"


def phrases(source: DataFrame) -> DataFrame:
    """The parse: for each phrase its trigger's hash, its own digest, document, first start and number of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = t.as_py().encode()
                for h, first, count, trigger in parse(raw):
                    own = [digest(raw[s : s + n + DEPTH - 1], q) for s, n, q in zip(first.tolist(), count.tolist(), (trigger - first).tolist(), strict=True)]
                    cols = [pa.array(h.view(np.int64)), pa.array(np.array(own, np.uint64).view(np.int64)), pa.array(np.full(len(h), i, np.int64)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["trigger", "phrase", "doc_id", "start", "n"])

    return source.filter("doc_id is not null and octet_length(text) >= 100").mapInArrow(run, PHRASE)


def runs(starts: set[int]) -> Iterator[tuple[int, int]]:
    """Byte spans covered by the strings that start at the given places, neighbours as one."""
    first = last = None
    for s in sorted(starts):
        if last is not None and s == last + 1:
            last = s
            continue
        if last is not None:
            yield first, last + DEPTH
        first = last = s
    if last is not None:
        yield first, last + DEPTH


def repeats(rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """rows: doc_id, first start and bytes of the distinct phrases of one trigger, each at its first place.

    Yields (doc_id, from, to) of what their strings repeat.
    """
    suffixes = sorted([(body[j : j + DEPTH], doc, start + j) for doc, start, body in rows for j in range(len(body) - DEPTH + 1)])
    found: dict[int, set[int]] = {}
    before, first = None, None
    for head, doc, at in suffixes:
        if head != before:
            before, first = head, (doc, at)
        elif (doc, at) != first:  # rows that share an id show the same place twice
            found.setdefault(doc, set()).add(at)
    for doc, starts in found.items():
        for a, b in runs(starts):
            yield doc, a, b


SPAN = "doc_id long, a int, b int"


def bodies(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """trigger, doc_id, start, body: the bytes of the wanted phrases, read from their documents."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("trigger", "start", "n", "crowd")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, want in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                raw, want = t.as_py().encode(), want.as_py()
                ok = [w for w in want if len(raw) >= w["start"] + w["n"] + DEPTH - 1]
                cols = [pa.array([w["trigger"] for w in ok], pa.int64()), pa.array([i] * len(ok), pa.int64()), pa.array([w["start"] for w in ok], pa.int32()), pa.array([w["crowd"] for w in ok], pa.bool_()), pa.array([raw[w["start"] : w["start"] + w["n"] + DEPTH - 1] for w in ok], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["trigger", "doc_id", "start", "crowd", "body"])

    return source.join(lists, "doc_id").select("doc_id", "text", "want").mapInArrow(run, "trigger long, doc_id long, start int, crowd boolean, body binary")


def sorted_repeats(held: DataFrame) -> DataFrame:
    """Repeats among the phrases of each trigger; no trigger has more than CROWD of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def solve() -> None:
            if len(rows) > 1:
                out.extend(repeats(rows))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "a", "b"])
            out.clear()
            return done

        for b in batches:
            for trigger, doc, start, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if trigger != now:
                    solve()
                    now, rows = trigger, []
                rows.append((doc, start, body))
            if len(out) > 4096:
                yield batch()
        solve()
        if out:
            yield batch()

    return held.select("trigger", "doc_id", "start", "body").repartition("trigger").sortWithinPartitions("trigger").mapInArrow(run, SPAN)


def counted_repeats(held: DataFrame) -> DataFrame:
    """The same for crowded triggers: every string by its hash, the earliest by aggregation, so that no task holds a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for trigger, doc, start, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                n = len(body) - DEPTH + 1
                both = [xxhash.xxh3_128_intdigest(body[j : j + DEPTH]) for j in range(n)]
                high, low = np.array([x >> 64 for x in both], np.uint64), np.array([x & (1 << 64) - 1 for x in both], np.uint64)
                cols = [pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(np.full(n, doc, np.int64)), pa.array(np.arange(start, start + n, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["high", "low", "doc_id", "a"])

    strings = held.select("trigger", "doc_id", "start", "body").mapInArrow(run, "high long, low long, doc_id long, a int")
    first = strings.groupBy("high", "low").agg(F.min(F.struct("doc_id", "a")).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    later = strings.join(first, ["high", "low"]).filter(F.struct("doc_id", "a") != F.col("first"))
    return later.select("doc_id", "a", (F.col("a") + DEPTH).alias("b"))


def repeated_spans(source: DataFrame) -> DataFrame:
    """doc_id, a, b: byte spans, possibly overlapping, that together are all repeats. source: doc_id, text."""
    spark = source.sparkSession
    parsed = phrases(source)
    twice = parsed.groupBy("trigger").count().filter("count > 1").select("trigger")
    shared = keep(parsed.join(twice, "trigger"))
    release_shuffles(spark)
    kinds = keep(shared.groupBy("trigger", "phrase", "n").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("times")))
    again = shared.join(kinds.filter("times > 1").select("trigger", "phrase", "n", "first"), ["trigger", "phrase", "n"]).filter(F.struct("doc_id", "start") != F.col("first"))
    whole = keep(again.select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("n") + DEPTH - 1).alias("b")))
    release_shuffles(spark)
    several = kinds.groupBy("trigger").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    wanted = kinds.join(several, "trigger").select("trigger", "first.doc_id", "first.start", "n", (F.col("kinds") > CROWD).alias("crowd"))
    held = keep(bodies(source, wanted))
    release_shuffles(spark)
    part = sorted_repeats(held.filter("not crowd")).union(counted_repeats(held.filter("crowd")))
    out = keep(whole.union(part))
    for x in (shared, kinds, whole, held):
        drop_kept(x)
    release_shuffles(spark)
    return out


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    out, removed, count, end = [], 0, 0, -1
    for a, b in sorted(spans):
        b = min(b, len(raw))
        if a >= b:
            continue
        if a > end:
            count += 1
            out.append(raw[max(end, 0) : a])
            removed += b - a
            end = b
        elif b > end:
            removed += b - end
            end = b
    out.append(raw[max(end, 0) :])
    return b"".join(out), removed, count


def substring_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) with every byte removed that lies in a 100-byte string starting earlier too.

    Texts are UTF-8 bytes; a null text is empty, and a text under 100 bytes loses nothing. Rows that share an id
    are one document: they lose what is found in any of them, and nothing to each other at the same place. Rows
    with a null id keep everything and take nothing from others. Repeated rows each give a row; an empty table
    gives none; other columns are not read.
    """
    bound_batches(df.sparkSession)
    source = texts(df, key, text)
    lists = repeated_spans(source).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                raw = t.as_py().encode()
                left, removed, count = cut(raw, [(s["a"], s["b"]) for s in spans.as_py() or []])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([removed], pa.int64()), pa.array([count], pa.int64()), pa.array([left], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return source.join(lists, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once 100-byte repeats of earlier text go; a null text counts as empty."""
    done = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
