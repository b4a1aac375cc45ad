"""Ranked search, conversation trie and language model against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.llm import common, kneser_ney, prefix_trie, ranked_search

DOCS = "doc_id long, text string, n long, number int, __x int, terms string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """rows of (id, text) with columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, 1, 2, 3, "z") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(8)
    text = lambda n: " ".join(r.choice(("Ab", "ab", "c", "dé", "É", "x-y", "z_9", "日本", "the", "the", "the", f"w{r.randrange(40)}")) for _ in range(n))
    rows = [(i, text(r.randint(0, 60))) for i in range(60)] + [(60 + i, "the same text Ab") for i in range(70)]
    return rows + [(200, None), (201, ""), (202, " \x00\t\x1c-- "), (203, "KK ſ İ"), (204, text(9000)), (5, "the other row of five"), (None, "the w1 dé"), (None, None), (206, "the w1 dé")]


def brute_rank(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counts = [collections.Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    total, n_docs = sum(sizes), sum(n > 0 for n in sizes)
    df = collections.Counter(x for c in counts for x in c)
    out = []
    for item, text in items:
        found = []
        for (i, _), c, n in zip(docs, counts, sizes, strict=True):
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * (50 + 50 * n * n_docs // total))) for x in set(terms(text)) if c[x])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_rank(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(ranked_search, "OPENED", 3)
    run = ranked_search.best.__globals__
    monkeypatch.setitem(run, "SHARD", shard)
    monkeypatch.setattr(ranked_search, "PASS_ITEMS", 4)
    items = [(1, "The same text"), (2, "w1 w2 w3 日本 nowhere"), (3, None), (4, ""), (5, "-- ."), (6, "é É DÉ x y 9"), (None, "w1"), (7, "the"), (7, "the ab"), (8, "k ſ")]
    got = ranked_search.rank(table(spark, docs).repartition(3), table(spark, items).withColumnRenamed("doc_id", "item_id"), 12)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_rank(docs, items, 12)


def test_rank_empty(spark, docs):
    none, some = table(spark, []), table(spark, docs)
    items = lambda df: df.withColumnRenamed("doc_id", "item_id")
    assert ranked_search.rank(none, items(some)).count() == 0
    assert ranked_search.rank(some, items(none)).count() == 0
    assert ranked_search.rank(table(spark, [(1, "--"), (2, None)]), items(some)).count() == 0


def brute_trie(rows):
    conv = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in conv.items()}
    built = {c: conv.get(c - int(math.fmod(c, 20)), [])[: zlib.crc32(str(c).encode()) % 4] + v[zlib.crc32(str(c).encode()) % 4 :] for c, v in conv.items()}
    members = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    below, out = collections.defaultdict(list), {}
    for n in members:
        if n:
            below[n[:-1]].append(n)
    for n in sorted(members, key=len, reverse=True):
        leaves = sum(out[k][5] for k in below[n]) or 1
        saved = sum(out[k][6] for k in below[n]) + ((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0)
        ends = ",".join(map(str, sorted(c for c in members[n] if len(built[c]) == len(n))))
        out[n] = (min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(below[n]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


TURNS = "conv_id long, turn long, role string, text string, pid int, up string, turns int, depth long"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "u", 2, 3) for r in rows], TURNS)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_trie(spark, monkeypatch, parts):
    r = random.Random(parts)
    monkeypatch.setattr(prefix_trie, "MOST", 4)
    rows = []
    for c in range(400):
        for t in range(r.choice((1, 1, 2, 3, 4, 9))):
            rows.append((c, t, r.choice(("user", "system", None)), r.choice(("hello\x0bworld a", "b", "", None, "very  long " * 40))))
    rows += [(c, t, "user", f"turn {t}") for c in range(1000, 1300) for t in range(3)]  # copies
    rows += [(2000, t, "u", "deep") for t in range(300)] + [(2020, None, "u", "first"), (2020, 0, "u", "second"), (-7, 1, "u", "x"), (3000, 1, "a", "bc"), (3001, 1, "ab", "c")]
    rows += [(None, 1, "u", "x"), (None, None, None, None), (2021, 1, "u", "twice"), (2021, 1, "u", "twice")]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.prefix_trie(turns_of(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((tuple(x) for x in got), key=str) == brute_trie(rows)


def test_trie_pieces(spark):
    """A list of members of several pieces, over several tasks."""
    rows = [(c, 0, "u", "same") for c in range(20000)]
    got = prefix_trie.prefix_trie(turns_of(spark, rows)).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_trie(rows)


def test_trie_empty(spark):
    assert prefix_trie.prefix_trie(turns_of(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(turns_of(spark, [(None, 1, "u", "x")])).count() == 0


def lm_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


class BruteModel:
    """The same model from dictionaries, word by word."""

    def __init__(self, docs, order):
        self.order, self.counts = order, {}
        top, self.words = collections.Counter(), collections.Counter()
        for t in docs:
            w = [""] * (order - 1) + lm_tokens(t)
            self.words.update(w[order - 1 :])
            top.update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
        for m in range(order, 0, -1):
            self.counts[m] = top
            top = collections.Counter(g[1:] for g in top)
        self.d = {m: [0, *kneser_ney.discounts(*[sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])] for m, c in self.counts.items()}
        self.after = {m: collections.defaultdict(list) for m in self.counts}
        for m, c in self.counts.items():
            for g, v in c.items():
                self.after[m][g[:-1]].append(v)

    def p(self, context, word):
        out = 1 / (len(self.words) + 1)
        for m in range(1, self.order + 1):
            h = tuple(context[len(context) - m + 1 :])
            seen, d = self.after[m].get(h), self.d[m]
            if seen:
                n = self.counts[m][(*h, word)]
                out = (n - d[min(n, 3)]) / sum(seen) + sum(d[min(v, 3)] for v in seen) / sum(seen) * out
        return out


@pytest.mark.parametrize("order, flush, bits", [(2, 1 << 22, None), (2, 50, 3), (3, 200, 2), (4, 1 << 22, 0)])
def test_language_model(spark, docs, monkeypatch, order, flush, bits):
    monkeypatch.setitem(kneser_ney.counted.__globals__, "FLUSH", flush)
    if bits:
        monkeypatch.setattr(kneser_ney, "SPAN", 700 / 2**bits)
    got = kneser_ney.perplexity(table(spark, docs).repartition(4), order).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    model = BruteModel([t for i, t in docs if not out(i)], order)
    n, v = sum(model.words.values()), len(model.words)
    want = []
    for i, t in docs:
        w = lm_tokens(t)
        padded = [""] * (order - 1) + w
        s = sum(math.log10(model.p(padded[: k + order - 1], w[k])) for k in range(len(w)))
        base = sum(math.log10((model.words[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want.append((i, out(i), len(w), sum(model.words[x] > 0 for x in w), n, base, s))
    spell = lambda rows: sorted(str((*r[:5], round(r[5], 6), round(r[6], 6))) for r in rows)
    assert spell(got) == spell(want)


def test_language_model_sums_to_one(docs):
    model = BruteModel([t for _, t in docs], 3)
    for context in (("", ""), ("", "the"), ("the", "the"), ("ab", "c"), ("never", "met")):
        assert math.isclose(sum(model.p(context, w) for w in model.words) + model.p(context, "no such word"), 1)


def test_language_model_empty(spark):
    assert kneser_ney.perplexity(table(spark, [])).count() == 0
    (r,) = kneser_ney.perplexity(table(spark, [(1, None)]).filter(F.col("doc_id") > 0)).collect()
    assert r.n_tokens == 1 and r.score <= 0 and r.base_score <= 0
    with pytest.raises(ValueError):
        kneser_ney.train(table(spark, [(1, "a")]), 1)


def test_language_model_leaves_no_files(spark, docs, tmp_path, monkeypatch):
    for module in (kneser_ney, common):
        monkeypatch.setattr(module, "shared_dir", lambda _: str(tmp_path))
    assert kneser_ney.perplexity(table(spark, docs)).count() == len(docs)
    assert len(list(tmp_path.iterdir())) == 1  # the scores


def test_hashes():
    a = np.arange(1000, dtype=np.uint64)
    assert len(np.unique(kneser_ney.mixed(a, a[::-1]))) == 1000
    assert (kneser_ney.mixed(a, a + np.uint64(1)) != kneser_ney.mixed(a + np.uint64(1), a)).all()
