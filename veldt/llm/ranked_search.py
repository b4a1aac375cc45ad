"""Ranked search by dual-sorted wavelet trees, one for each shard of documents.

A term's postings are ordered by impact, all terms' lists stand one behind the other, and a wavelet matrix over their
document numbers divides them by halves of the document range without disturbing that order. So in any node (a range
of documents) a term's postings are an interval, and its first entry is the most that the term can give to a document
there. The sum of these over a query's terms bounds the subtree; the nodes of all terms are met together, best bound
first, until none left can reach the k-th best score. A leaf is one document, and its bound is its score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.llm.common import bound_batches, drop_kept, keep, texts
from veldt.llm.words import ALNUM, words_of

TOP = 50
#: Items, and characters of items, that one pass over the documents carries; more take more passes.
PASS_ITEMS, PASS_CHARS = 1024, 1 << 20
#: Postings of a shard, and nodes opened at a time.
SHARD, OPENED = 1 << 20, 256
#: Fixed values of the score: an impact's numerator, and the percentage of a document's length that counts.
SCALE, SHARE = 1_000_000_000, 50


class Shard:
    """The wavelet matrix of one shard: rank tables and impacts by level, documents numbered by ascending id."""

    def __init__(self, doc_ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        self.doc_ids = doc_ids
        order = np.lexsort((doc, -impact, term))
        seq, imp = doc[order].astype(np.int64), impact[order].astype(np.int32)
        self.starts = np.searchsorted(term[order], np.arange(terms + 1))
        self.height = max(1, int(len(doc_ids) - 1).bit_length())
        self.ranks = np.zeros((self.height, len(seq) + 1), np.int32)
        self.zeros = np.zeros(self.height, np.int64)
        self.impacts = np.zeros((self.height + 1, len(seq) + 1), np.int32)
        self.impacts[0, :-1] = imp
        for level in range(self.height):
            low = (seq >> (self.height - 1 - level)) & 1 == 0
            np.cumsum(low, out=self.ranks[level, 1:])
            self.zeros[level] = self.ranks[level, -1]
            seq, imp = np.concatenate([seq[low], seq[~low]]), np.concatenate([imp[low], imp[~low]])
            self.impacts[level + 1, :-1] = imp

    def bounds(self, level: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
        best = np.where(left < right, self.impacts[level[:, None], left], 0).astype(np.int64)
        return best @ weight

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, documents): all that may be among the k best; ``least``: a score that k documents are known to reach."""
        left, right = self.starts[terms][None, :], self.starts[terms + 1][None, :]
        level, place = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self.bounds(level, left, right, weight)
        scores, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            open_ = bound >= max(least, 1)
            bound, level, place, left, right = bound[open_], level[open_], place[open_], left[open_], right[open_]
            if not len(bound):
                return scores, docs
            if len(bound) > OPENED:
                order = np.argpartition(-bound, OPENED)
                now, rest = order[:OPENED], order[OPENED:]
            else:
                now, rest = np.arange(len(bound)), np.zeros(0, np.int64)
            at = level[now]
            l0, r0 = self.ranks[at[:, None], left[now]].astype(np.int64), self.ranks[at[:, None], right[now]].astype(np.int64)
            zero = self.zeros[at][:, None]
            new_left = np.concatenate([l0, zero + left[now] - l0])
            new_right = np.concatenate([r0, zero + right[now] - r0])
            new_level, new_place = np.concatenate([at + 1, at + 1]), np.concatenate([place[now] * 2, place[now] * 2 + 1])
            new_bound = self.bounds(new_level, new_left, new_right, weight)
            leaf = (new_level == self.height) & (new_bound > 0)
            if leaf.any():
                scores, docs = np.concatenate([scores, new_bound[leaf]]), np.concatenate([docs, new_place[leaf]])
                if len(scores) > k:
                    least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    scores, docs = scores[scores >= least], docs[scores >= least]
            inner = (new_level < self.height) & (new_bound >= max(least, 1))
            bound, level, place = np.concatenate([bound[rest], new_bound[inner]]), np.concatenate([level[rest], new_level[inner]]), np.concatenate([place[rest], new_place[inner]])
            left, right = np.concatenate([left[rest], new_left[inner]]), np.concatenate([right[rest], new_right[inner]])


POSTINGS = "doc_id long, n long, terms array<int>, tfs array<long>"


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (all terms with repeats), and the listed terms of each document with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(terms, pa.large_string())
        for b in batches:
            n, flat = words_of(b.column(1), ALNUM)
            found = pc.index_in(flat, value_set=asked)
            there = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            doc = np.repeat(np.arange(len(n)), n)[there]
            pair, tf = np.unique(doc * max(1, len(terms)) + found.take(pa.array(there)).to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            doc, term = np.divmod(pair, max(1, len(terms)))
            ends = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, POSTINGS)


def item_terms(text: str) -> list[str]:
    return words_of(pa.array([text]), ALNUM)[1].unique().to_pylist()


def passes(items: DataFrame) -> Iterator[list[tuple[int, int | None, list[str]]]]:
    """(number, item_id, terms) of items with terms, a pass's worth at a time; the driver never holds more."""
    now, size, number = [], 0, 0
    for r in items.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).filter("t is not null").toLocalIterator():
        found = item_terms(r.t)
        if now and (len(now) >= PASS_ITEMS or size + len(r.t) > PASS_CHARS):
            yield now
            now, size = [], 0
        if found:
            now.append((number, r.i, found))
            number, size = number + 1, size + len(r.t)
    if now:
        yield now


HITS = "number long, item_id long, doc_id long, score long"


def best(posted: DataFrame, queries: list[tuple[int, int | None, np.ndarray, np.ndarray]], terms: int, docs: int, length: int, k: int) -> DataFrame:
    """Each task's k best documents (ties included) of every query; shards are built and searched one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]

        def search() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            t = t.sort_by("doc_id")  # null ids come last
            ids, n, lists = t["doc_id"], t["n"].to_numpy(), t["terms"].combine_chunks()
            ids = ids.fill_null(NO_ID).to_numpy()
            doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            tf = t["tfs"].combine_chunks().flatten().to_numpy()
            m = 100 - SHARE + SHARE * n * docs // max(length, 1)
            shard = Shard(ids, doc, lists.flatten().to_numpy(), SCALE * tf // (1000 * tf + 20 * m[doc]), terms)
            for q, (_, _, which, weight) in enumerate(queries):
                scores, found = kept[q]
                least = int(scores.min()) if len(scores) >= k else 0
                s, d = shard.search(which, weight, k, least)
                scores, found = np.concatenate([scores, s]), np.concatenate([found, shard.doc_ids[d]])
                order = np.lexsort((found, -scores))[:k]
                kept[q] = scores[order], found[order]

        for b in batches:
            held.append(b)
            size += len(b.column(2).flatten())
            if size >= SHARD:
                search()
                held, size = [], 0
        if size:
            search()
        for (number, item, _, _), (scores, found) in zip(queries, kept, strict=True):
            if len(scores):
                ids = pa.array(found, mask=found == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int64()), pa.array([item] * len(ids), pa.int64()), ids, pa.array(scores)], [c.split(" ")[0] for c in HITS.split(", ")])

    return posted.mapInArrow(run, HITS)


#: Stands for a null id, behind all others.
NO_ID = (1 << 63) - 1


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item, equal scores by ascending doc_id.

    Null texts have no terms. Rows of documents with equal ids are documents of their own; one with a null id is named
    null and comes last among equals. Every row of items with a term is an item of its own, with null or repeated ids
    too. Empty tables give no rows; other columns are not read. Documents are read once a pass; only the postings of
    the pass's terms are indexed, and only k rows a task and item are shuffled.
    """
    bound_batches(docs.sparkSession)
    source, held_hits = texts(docs, key, text), []
    for chosen in passes(items):
        terms = sorted({t for _, _, own in chosen for t in own})
        number = {t: i for i, t in enumerate(terms)}
        posted = keep(postings(source, terms))
        docs_n, length = posted.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        held = {r.t: r.n for r in posted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
        weight = np.array([math.floor(1000 * math.log((2 * docs_n + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
        queries = [(q, item, which := np.array([number[t] for t in own]), weight[which]) for q, item, own in chosen]
        held_hits.append(keep(best(posted, queries, len(terms), docs_n, length or 0, k)))
        drop_kept(posted)
    if not held_hits:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = reduce(DataFrame.union, held_hits)
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    out = keep(every.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    for hits in held_hits:
        drop_kept(hits)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all items of benchmark over the whole of documents; see rank() for nulls, ties, repeats and empty tables."""
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
