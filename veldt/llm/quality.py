"""Quality classifier: a sparse ensemble of rules.

Small boosted trees are grown on statistics of labelled texts; every path to a node becomes a conjunctive rule;
a lasso logistic regression weights the rules and drops most. The rules that stay are compiled into Spark column
expressions over the statistics, so that scoring is one projection without labels, language, source or id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm.common import bound_batches, texts

#: Labelled rows that a fit takes at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
THRESHOLD = 0.3
TREES, DEPTH, LEAF, SHRINK, CUTS = 40, 3, 10, 0.3, 48
LASSO, STEPS = 0.002, 400

STATS = ("words", "lines", "chars_a_word", "words_a_line", "upper", "digit", "symbol", "space", "other", "bang", "bar", "stop_marks", "distinct_words", "top_word", "repeated_next", "distinct_lines", "top_line", "short_words", "long_words", "capital_words", "odd_ends", "entropy")

_UPPER, _DIGIT, _SPACE = (np.zeros(256) for _ in range(3))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_SPACE[[32, *range(9, 14)]] = 1
_SYMBOL = np.zeros(256)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum()]] = 1
_SYMBOL[[ord(c) for c in ".,;:'\"-?!|()"]] = 0
_OTHER = np.zeros(256)
_OTHER[128:] = 1


def describe(text: str) -> list[float]:
    """The statistics of a whole text, in the order of STATS; an empty text has zeros."""
    raw = text.encode()
    words = text.split()
    if not words:
        return [0.0] * len(STATS)
    lines = [x for x in text.split("\n") if x]
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, w, share = len(raw), len(words), count / len(raw)
    sizes = np.fromiter(map(len, words), np.int64, w)
    kinds, line_kinds = Counter(words), Counter(lines)
    used = share[share > 0]
    return [
        float(w), float(len(lines)), float(sizes.mean()), w / len(lines), float(share @ _UPPER), float(share @ _DIGIT), float(share @ _SYMBOL), float(share @ _SPACE), float(share @ _OTHER),
        float(share[33]), float(share[124]), float((count[46] + count[63] + count[33]) / w), len(kinds) / w, max(kinds.values()) / w, sum([a == b for a, b in zip(words, words[1:])]) / w,
        len(line_kinds) / len(lines), max(line_kinds.values()) / len(lines), float((sizes <= 3).mean()), float((sizes >= 14).mean()), sum([x[0].isupper() for x in words]) / w,
        sum([not x[-1].isalnum() and x[-1] not in ".,;:?)\"'" for x in words]) / w, float(-(used @ np.log2(used))),
    ]


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and STATS of every whole text."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([describe(t.as_py()) for t in b.column(1)], np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(c)) for c in x.T]], ["doc_id", *STATS])

    return texts(df, key, text).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[int, bool, float], ...]


def _grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], path: Rule, rules: list[Rule], score: np.ndarray) -> None:
    """A regression tree by Newton gains; every path joins rules, leaves add to score."""
    g, h = residual[rows].sum(), weight[rows].sum()
    best = (1e-6, -1, 0.0)
    if len(path) < DEPTH and len(rows) >= 2 * LEAF:
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            place = np.searchsorted(c, x[rows, j], side="left")  # place k: above k cuts
            n = np.bincount(place, minlength=len(c) + 1).cumsum()[:-1]
            gl = np.bincount(place, residual[rows], len(c) + 1).cumsum()[:-1]
            hl = np.bincount(place, weight[rows], len(c) + 1).cumsum()[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < LEAF) | (n > len(rows) - LEAF)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(c[k]))
    if best[1] < 0:
        score[rows] += SHRINK * g / (h + 1)
        return
    _, j, cut = best
    low = x[rows, j] <= cut
    for side, part in ((True, rows[low]), (False, rows[~low])):
        step = (*path, (j, side, cut))
        rules.append(step)
        _grow(x, residual, weight, part, cuts, step, rules, score)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, low, cut in rule:
        out &= (x[:, j] <= cut) == low
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, Rule]]]:
    """(intercept, weighted rules). One class alone, or nothing, gives the intercept of its rate."""
    n = len(y)
    rate = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate / (1 - rate)))
    if n == 0 or y.min() == y.max():
        return base, []
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1]))
        cuts.append(q[q < x[:, j].max()])
    found: list[Rule] = []
    score = np.full(n, base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        _grow(x, y - p, p * (1 - p), np.arange(n), cuts, (), found, score)
    rules, seen, cols = [], set(), []
    for r in dict.fromkeys(found):
        col = holds(r, x)
        mark = col.tobytes()
        if mark not in seen and 0 < col.sum() < n:
            seen.add(mark)
            rules.append(r)
            cols.append(col)
    z = np.array(cols, np.float64).T
    mean, scale = z.mean(axis=0), np.maximum(z.std(axis=0), 0.05)
    z = (z - mean) / scale
    # accelerated proximal gradient; the penalty spares the intercept
    w, b, v, vb, t = np.zeros(z.shape[1]), base, np.zeros(z.shape[1]), base, 1.0
    u = np.ones(z.shape[1])
    for _ in range(20):
        u = z.T @ (z @ u)
        u /= np.linalg.norm(u)
    step = 4 / (np.linalg.norm(z @ u) ** 2 / n + 1)
    for _ in range(STEPS):
        gap = 1 / (1 + np.exp(-(z @ v + vb))) - y
        nw = v - step * (z.T @ gap) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * LASSO, 0)
        nb = vb - step * gap.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    kept = [(float(a / s), r) for a, s, r in zip(w, scale, rules, strict=True) if abs(a) > 1e-6]
    return float(b - (w * mean / scale).sum()), kept


def compile_score(model: tuple[float, list[tuple[float, Rule]]], prefix: str = "") -> Column:
    """The ensemble as one column expression over STATS."""
    total = F.lit(model[0])
    for weight, rule in model[1]:
        test = F.lit(True)
        for j, low, cut in rule:
            test = test & (F.col(prefix + STATS[j]) <= F.lit(cut) if low else F.col(prefix + STATS[j]) > F.lit(cut))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def remainder(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5))


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[float, list[tuple[float, Rule]]]:
    """Fit on at most ``sample`` labelled rows whose crc32(id) mod 5 is not 0. Null labels and ids are passed over; of repeated labels the largest counts."""
    known = labels.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.filter(remainder(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids, ys = [], {}
    for r in known.collect():  # at most sample rows
        ids.append(r.doc_id)
        ys[r.doc_id] = r.y
    if not ids:
        return fit(np.zeros((0, len(STATS))), np.zeros(0))
    wanted = df.filter(F.col(f"`{key}`").isin(ids)) if len(ids) <= 200 else df.join(F.broadcast(df.sparkSession.createDataFrame([(i,) for i in ids], f"`{key}` long")), key, "left_semi")
    rows = statistics(wanted, key, text).orderBy("doc_id", *STATS).collect()
    return fit(np.array([[r[s] for s in STATS] for r in rows]).reshape(-1, len(STATS)), np.array([ys[r.doc_id] for r in rows]))


def score_table(df: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score. Null and empty texts have the score of all-zero statistics; a row gives a row; no shuffle."""
    return statistics(df, key, text).select("doc_id", compile_score(model).alias("score"))


def scored(df: DataFrame, model, text: str = "text") -> DataFrame:
    """df with a column __score, in place: no row moves and none is joined by its id. A null text counts as empty."""
    bound_batches(df.sparkSession)
    place = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"__{s}", T.DoubleType()) for s in STATS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([describe(t.as_py() or "") for t in b.column(place)], np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(np.ascontiguousarray(c)) for c in x.T]], [*b.schema.names, *[f"__{s}" for s in STATS]])

    return df.mapInArrow(run, schema).withColumn("__score", compile_score(model, "__")).drop(*[f"__{s}" for s in STATS])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by the rule ensemble fitted on labelled rows that are not held out; an empty text is scored like any other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_table(docs, model)
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
