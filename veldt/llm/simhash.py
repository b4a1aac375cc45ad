"""SimHash near-duplicates, found by sharded BK-trees.

Distinct fingerprints are dealt to shards by pigeonhole: a fingerprint has five blocks of bits, and two that
differ in at most three bits agree in two whole blocks, so they meet in the shard of one of the ten pairs of
blocks. A shard's fingerprints form BK-trees of bounded size, children keyed by the integer distance to their
parent; every tree of a shard is sent to each slice of that shard's fingerprints, and a search follows only the
edges within the radius. Of the links in a shard, a spanning forest is kept; components close over all shards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import bound_batches, keep, release_shuffles, texts
from veldt.llm.graph import components

SEED, WORDS, RADIUS = 42, 3, 3
#: (lowest bit, width) of the blocks; RADIUS differing bits leave len(BLOCKS) - RADIUS blocks whole.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints in a tree.
TREE = 1024
#: Shingles whose bits are counted at a time.
SHINGLES = 1 << 16


def shingle_hashes(text: str, width: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of each run of width words, SHINGLES at a time; fewer words are one run, and no words none."""
    words = text.encode().lower().split()  # bytes: A-Z alone, and split at \x20 and \x09-\x0D alone
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES):
        s, e = starts[at : at + SHINGLES].tolist(), ends[at : at + SHINGLES].tolist()
        yield np.fromiter([digest(line[a:b], SEED) for a, b in zip(s, e, strict=True)], "<u8", len(s))


def majority(parts: Iterable[np.ndarray]) -> int:
    """Bit b is 1 if over half of the hashes have it; none give 0."""
    counts, n = np.zeros(64, np.int64), 0
    for h in parts:
        for at in range(0, len(h), SHINGLES):
            some = h[at : at + SHINGLES]
            counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(some)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int = WORDS) -> int:
    """The SimHash of a text's runs of width words, repeats included."""
    return majority(shingle_hashes(text, width))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter([fingerprint(t.as_py()) for t in b.column(1)], np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return texts(df, key, text).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Nodes are places in a list of fingerprints; a child hangs from its parent by their distance."""

    def __init__(self) -> None:
        self.points: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, point: int) -> None:
        self.points.append(point)
        self.children.append({})
        new, at = len(self.points) - 1, 0
        while new:
            d = (self.points[at] ^ point).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = new
                return
            at = below

    def within(self, point: int, radius: int) -> list[int]:
        """The points at distance radius or less."""
        found, todo = [], [0] if self.points else []
        while todo:
            at = todo.pop()
            d = (self.points[at] ^ point).bit_count()
            if d <= radius:
                found.append(self.points[at])
            for edge, below in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(below)
        return found


def shard_links(grown: list[int], asked: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among grown (when nothing is asked), or between asked and grown."""
    tree, parent, out = BKTree(), {}, []

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def link(x: int) -> None:
        for y in tree.within(x, radius):
            if (a := root(x)) != (b := root(y)):
                parent[a] = b
                out.append((x, y))

    for x in grown:
        if not asked:
            link(x)
        tree.add(x)
    for x in asked:
        link(x)
    return out


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column fp, enough of them to join all that are connected."""
    spark = prints.sparkSession
    fp = F.col("fp")
    block = [F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1) for low, width in BLOCKS]
    keys = [F.lit(t << 26).bitwiseOR(F.shiftleft(block[x], 13)).bitwiseOR(block[y]) for t, (x, y) in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - radius))]
    dealt = prints.select("fp", F.explode(F.array(*[k.cast("long") for k in keys])).alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = dealt.join(sizes, "shard").withColumn("k", F.ceil(F.col("n") / TREE).cast("int"))
    own = placed.withColumn("c", F.pmod(F.xxhash64("fp", "shard"), F.col("k")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pieces = own.select("shard", F.least("c", "o").alias("tree"), F.greatest("c", "o").alias("slice"), (F.col("c") > F.col("o")).alias("asks"), "fp")
    met = pieces.repartition("shard", "tree", "slice").sortWithinPartitions("shard", "tree", "slice", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        rest = None

        def solve(rows: np.ndarray) -> None:
            """rows: asks, fp of one shard's tree and slice."""
            grown, asked = rows[rows[:, 0] == 0, 1].tolist(), rows[rows[:, 0] == 1, 1].tolist()
            for x, y in shard_links([v & (1 << 64) - 1 for v in grown], [v & (1 << 64) - 1 for v in asked], radius):
                a.append(x)
                b.append(y)

        def out() -> pa.RecordBatch:
            both = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
            a.clear(), b.clear()
            return pa.RecordBatch.from_arrays(both, ["a", "b"])

        for batch in batches:
            where = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            what = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4)], axis=1)
            if rest is not None:
                where, what = np.concatenate([rest[0], where]), np.concatenate([rest[1], what])
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
            last = 0
            for cut in cuts.tolist():
                if cut - last > 1:
                    solve(what[last:cut])
                last = cut
            rest = where[last:], what[last:]
            if len(a) > 4096:
                yield out()
        if rest is not None and len(rest[0]) > 1:
            solve(rest[1])
        if a:
            yield out()

    bound_batches(spark)
    return met.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of radius bits or fewer.

    Documents with equal fingerprints are one node, however many copies there are, and no pair of copies is ever
    made. A null text is empty; empty texts have fingerprint zero and link like any other. Repeated rows each
    give a row; a null id is never the smallest unless all of its component are null. An empty table gives no
    rows; other columns are not read.
    """
    prints = keep(fingerprints(df, key, text))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = keep(links(nodes, radius))
    release_shuffles(df.sparkSession)
    joined = nodes.join(components(found), nodes.fp == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents by three-word SimHash and the groups within three bits; nulls count as empty, rows with repeated or null ids as in the operator."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
