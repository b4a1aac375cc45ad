"""The trie of conversation prefixes, read off globally sorted turn arrays.

A turn becomes a digest, a conversation the array of its turns' digests, and all arrays are range-sorted, so that every
node of the trie is an interval of neighbours that share a prefix. Each task sweeps its sorted rows once: the longest
common prefix with the row before says how many nodes of the stack close. Nodes on the first and on the last row of a
task may go on beyond it and stay open; a second, small sweep over these rows alone, two for each task, stitches them.
Copies of one conversation are ordered by conv_id, so that a group of any size is spread over tasks like any other rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.llm.common import bound_batches, drop_kept, keep

#: A conversation's place among its neighbours that lend it turns, and the most turns lent.
LENDER, MOST = 20, 4
#: Ids of one piece of a list of members.
PIECE = 8192
ROWS = 4096

#: up: the parent's nid. A node's ends are null where its members lie in pieces.
NODES = "pid int, nid long, up long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
#: kind 0: a closed node; 1: an open node of the first (side 0) or last row; 2: piece number ``at`` of a node's members.
SWEPT = f"kind int, side int, at long, turn binary, words long, {NODES}"


def turn_digest(role: Column, text: Column) -> Column:
    """The first 16 bytes of a turn's SHA-256; the role's length keeps role and text apart."""
    whole = F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text))
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def turn_arrays(turns: DataFrame) -> DataFrame:
    """conv_id, own: the (digest, words) of a conversation's turns in order; null turns come first, and equal turn numbers are ordered by digest.

    Null roles and texts are empty; rows with a null conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    n = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    t = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("there"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), turn_digest(role, text).alias("d"), n.alias("w")).alias("t"))
    lender = F.col("conv_id") - F.col("conv_id") % LENDER
    placed = t.withColumn("lender", lender).repartition("lender")  # conversations that share a lender meet once, here
    own = F.transform(F.sort_array(F.collect_list("t")), lambda x: F.struct(x["d"].alias("d"), x["w"].alias("w")))
    return placed.groupBy("lender", "conv_id").agg(own.alias("own"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation with its first h turns taken from its lender (none, if that is absent), h = crc32(conv_id) mod 4.

    The lender of c is c - c % 20, the remainder having the sign of c.
    """
    c = turn_arrays(turns)
    lent = F.max(F.when(F.col("conv_id") == F.col("lender"), F.slice("own", 1, MOST - 1))).over(Window.partitionBy("lender"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("int")
    first = F.coalesce(F.slice("lent", F.lit(1), F.col("h")), F.array().cast(c.schema["own"].dataType))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))
    return c.withColumns({"lent": lent, "h": h}).select("conv_id", F.concat(first, rest).alias("turns"))


def shared(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Node:
    """A node of the stack with what its finished part is known to hold."""

    __slots__ = ("nid", "depth", "turn", "words", "conv_id", "convs", "children", "leaves", "saved", "ids", "pieces")

    def __init__(self, nid: int, depth: int, turn: bytes, words: int):
        self.nid, self.depth, self.turn, self.words = nid, depth, turn, words
        self.conv_id, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ids: list[str] = []
        self.pieces = 0

    def member(self, conv_id: int, n: int = 1) -> None:
        self.convs += n
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)

    def close(self, up: Node | None) -> tuple[int, int]:
        """(leaves, saved tokens) of the whole subtree, once all of it has been seen; the parent takes them up."""
        leaves, saved = self.leaves or 1, self.saved + (self.convs - 1) * self.words
        if up:
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
        return leaves, saved


class Out:
    """Rows by column, handed on in batches."""

    def __init__(self, schema: str):
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        self.fields = [(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in schema.split(", ")]
        self.rows: list[tuple] = []

    def full(self) -> bool:
        return len(self.rows) >= ROWS

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(self.fields)], [n for n, _ in self.fields])


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closed nodes, open nodes of the first and last row, and long lists of members, of one task's sorted rows."""
    pid, out, made = TaskContext.get().partitionId(), Out(SWEPT), 0
    first: list[Node] = []  # nodes of the first row, which may have begun before it
    stack: list[Node] = []
    before: list[bytes] | None = None

    def piece(n: Node) -> None:
        if n.ids:
            out.rows.append((2, None, n.pieces, None, None, pid, n.nid, None, n.depth, None, None, None, None, None, ",".join(n.ids)))
            n.ids, n.pieces = [], n.pieces + 1

    def close(n: Node) -> None:
        leaves, saved = n.close(stack[-1])
        ends = None
        if n.pieces:
            piece(n)
        else:
            ends = hashlib.sha256(",".join(n.ids).encode()).hexdigest()
        out.rows.append((0, None, None, None, None, pid, n.nid, stack[-1].nid, n.depth, n.conv_id, n.convs, n.children, leaves, saved, ends))

    for b in batches:
        for conv_id, digests, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            common = 0 if before is None else shared(before, digests)
            if before is None:
                stack = [Node(0, 0, b"", 0)]
            while len(stack) > common + 1:
                n = stack.pop()
                if n.depth >= len(first) or first[n.depth] is not n:
                    close(n)
            for d in range(common, len(digests)):
                made += 1
                stack.append(Node(made, d + 1, digests[d], counts[d]))
            if before is None:
                first = list(stack)
            for n in stack:
                n.member(conv_id)
            stack[-1].ids.append(str(conv_id))
            if len(stack[-1].ids) >= PIECE:
                piece(stack[-1])
            before = digests
            if out.full():
                yield out.batch()
    both = sum(1 for a, b in zip(first, stack) if a is b)
    for side, nodes in ((0, first), (1, stack[both:])):
        for n in nodes:
            piece(n)
            out.rows.append((1, side, None, n.turn, n.words, pid, n.nid, None, n.depth, n.conv_id, n.convs, n.children, n.leaves, n.saved, None))
    if out.rows:
        yield out.batch()


#: kind 0: a node; 1: the open node (pid, nid) is part of the node ``up``.
STITCHED = f"kind int, {NODES}"


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes, by task, side and depth, joined over the borders of tasks; only one row's path is held."""
    out, made = Out(STITCHED), 0
    stack: list[Node] = []
    at, same = None, True

    def pop(depth: int) -> None:
        while len(stack) > depth:
            n = stack.pop()
            up = stack[-1] if stack else None
            leaves, saved = n.close(up)
            out.rows.append((0, -1, n.nid, up.nid if up else None, n.depth, n.conv_id, n.convs, n.children, leaves, saved, None))

    for b in batches:
        for side, turn, words, pid, nid, depth, conv_id, convs, children, leaves, saved in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            if (pid, side) != at:
                at, same = (pid, side), side == 0  # the last row of a task leaves its first row's path at once
            same = same and depth < len(stack) and stack[depth].turn == turn
            if not same:
                pop(depth)
                stack.append(Node(made, depth, turn, words))
                made += 1
            n = stack[depth]
            n.member(conv_id, convs)
            n.children, n.leaves, n.saved = n.children + children, n.leaves + leaves, n.saved + saved
            out.rows.append((1, pid, nid, n.nid, depth, None, None, None, None, None, None))
            if out.full():
                yield out.batch()
    pop(0)
    if out.rows:
        yield out.batch()


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order."""
    out, at, sha = Out("pid int, nid long, hashed string"), None, hashlib.sha256()
    for b in batches:
        for pid, nid, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (pid, nid) == at:
                sha.update(b",")
            else:
                if at:
                    out.rows.append((*at, sha.hexdigest()))
                at, sha = (pid, nid), hashlib.sha256()
            sha.update(text.encode())
            if out.full():
                yield out.batch()
    if at:
        out.rows.append((*at, sha.hexdigest()))
    if out.rows:
        yield out.batch()


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Of turns, conv_id, turn, role and text are read; null roles and texts are empty, null turns come first, equal turn
    numbers of one conversation are ordered by the turn's digest, repeated rows are turns of their own, and rows with
    a null conv_id belong to no conversation. A conversation left without turns ends at the root. No conversations
    give no rows. Equal digests of 128 bits count as equal turns. Besides the sort no task holds more than a path of
    the trie; the stitching task reads two paths for each task of the sort. The hash of one node's members is
    sequential by its definition, so one task streams them, in pieces of PIECE ids.
    """
    bound_batches(turns.sparkSession)
    rows = keep(rebuilt(turns).select("conv_id", F.transform("turns", lambda x: x["d"]).alias("turns"), F.transform("turns", lambda x: x["w"]).alias("words")))
    swept = keep(rows.repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id").mapInArrow(sweep, SWEPT))
    drop_kept(rows)
    paths = swept.filter("kind = 1").select("side", "turn", "words", "pid", "nid", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    joined = keep(paths.coalesce(1).sortWithinPartitions("pid", "side", "depth").mapInArrow(stitch, STITCHED))
    columns = [c.split(" ")[0] for c in NODES.split(", ")]
    nodes = swept.filter("kind = 0").select(columns).union(joined.filter("kind = 0").select(columns))
    part_of = joined.filter("kind = 1").select("pid", "nid", F.col("up").alias("whole"))
    whole = joined.filter("kind = 0").select(F.col("nid").alias("whole"), F.col("conv_id").alias("parent_conv_id"))
    names = nodes.select("pid", F.col("nid").alias("up"), F.col("conv_id").alias("parent_conv_id")).union(part_of.join(whole, "whole").select("pid", F.col("nid").alias("up"), "parent_conv_id"))
    pieces = swept.filter("kind = 2").select("pid", "nid", "at", "ends").join(part_of, ["pid", "nid"], "left")
    pieces = pieces.select(F.when(F.col("whole").isNull(), F.col("pid")).otherwise(-1).alias("owner"), F.coalesce("whole", "nid").alias("node"), "pid", "at", "ends")
    ends = pieces.repartition("owner", "node").sortWithinPartitions("owner", "node", "pid", "at").select("owner", "node", "ends").mapInArrow(hashed, "pid int, nid long, hashed string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = keep(nodes.join(names, ["pid", "up"], "left").join(ends, ["pid", "nid"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", "hashed", none).alias("ends_sha256")))
    drop_kept(swept)
    drop_kept(joined)
    return out


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole of conversations; see prefix_trie() for nulls, ties, repeats and empty tables."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
