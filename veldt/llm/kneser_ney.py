"""Language-model scores by an interpolated modified Kneser-Ney n-gram model.

Counting tasks turn words into 64-bit hashes and send sorted blocks of distinct n-grams, dealt by the hash of their
context; the task that gets a range of contexts merges its blocks, keeps the counts as one sorted hash array, and
passes the distinct n-grams without their first word on to the next lower order, whose counts are thus numbers of
distinct continuations. The arrays lie as plain files in the shared folder; scoring tasks map them into memory and
search them, so a worker holds one batch of texts and the pages it touches, never the model.
"""

from __future__ import annotations

import math
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import bound_batches, drop_kept, keep, release_shuffles, shared_dir, texts
from veldt.llm.words import LOWER, words_of

#: Words of an n-gram. Two by default: README.md has the figures.
ORDER = 2
#: n-grams (with repeats) that one file stands for on average, and that a task gathers before it merges or sends them.
SPAN, FLUSH = 1 << 21, 1 << 21
#: Bytes of text looked at together; a longer text is looked at whole.
LOOK = 1 << 21
#: Files mapped by a worker at a time.
MAPPED = 128
#: No discount comes nearer to 0, or to the count that it is taken from.
EDGE = 0.05
SEED = 11
END, BEGIN = (np.uint64(xxhash.xxh64_intdigest(x, SEED)) for x in (b" ", b"\t"))  # no word holds white space
HIGH = np.uint64(0xFFFF) << np.uint64(48)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two; not symmetric."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def gram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """An n-gram's hash: its first 16 bits are the context's, so that files by context are sorted throughout."""
    return (context & HIGH) | (mixed(context, word) & ~HIGH)


def looks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch by rows, so many at a time that their texts (column 1) have LOOK bytes, one at least."""
    size = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
    a = 0
    while a < b.num_rows:
        z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + LOOK)))
        yield b.slice(a, z - a)
        a = z


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with an end after each text, place of each text's first token, the text's tokens)."""
    n, flat = words_of(column, LOWER)
    coded = flat.dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    out = np.full(len(flat) + len(n), END, np.uint64)
    starts = np.concatenate([[0], np.cumsum(n + 1)[:-1]]).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    inside = np.ones(len(out), bool)
    inside[starts + n] = False
    if len(flat):
        out[inside] = known[coded.indices.to_numpy()]
    return out, starts, n + 1


def contexts(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """The hashes of the last 1, 2 ... order - 1 words before each token; before a text's start stand begin marks."""
    out: list[np.ndarray] = []
    for j in range(1, order):
        before = np.full(len(words), BEGIN, np.uint64)
        before[j:] = words[:-j]
        for k in range(j):
            at = starts + k
            before[at[at < np.append(starts[1:], len(words))]] = BEGIN
        out.append(before if j == 1 else mixed(out[-1], before))
    return out


def folded(columns: list[np.ndarray], counts: list[np.ndarray], key: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Rows of one key become one row with the counts summed, by ascending key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    summed = [np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts]
    return [c[order[first]] for c in columns], summed, key[first]


def blocks(level: int, bits: int, columns: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[tuple]:
    """(level, file, rows, packed columns): rows must be sorted by their first column, which picks the file."""
    if not len(columns[0]):
        return
    file = (columns[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(columns[0]), np.int64)
    cuts = np.flatnonzero(np.diff(file)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(file)]):
        raw = b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in (*columns, *(x.astype(np.uint64) for x in counts)))
        yield level, int(file[a]), int(b - a), pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(rows: int, block: bytes, width: int) -> list[np.ndarray]:
    raw = pa.decompress(block, decompressed_size=rows * width * 8, codec="zstd", asbytes=True)
    return list(np.frombuffer(raw, np.uint64).reshape(width, rows))


BLOCK = "level int, file int, n long, block binary"
STATS = "s0 long, s1 long, s2 long, s3 long, s4 long, s5 long, s6 long"


def batch_of(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(schema)], [n for n, _ in schema])


BLOCK_FIELDS = [("level", pa.int32()), ("file", pa.int32()), ("n", pa.int64()), ("block", pa.binary())]
STAT_FIELDS = [(f"s{i}", pa.int64()) for i in range(7)]


def counted(batches: Iterator[pa.RecordBatch], order: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of distinct n-grams of the highest order (columns: contexts from the longest down, word, count) and, as level 0, of words."""
    held: list[tuple[list[np.ndarray], np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        words = np.concatenate([w for _, w in held])
        ctx = [np.concatenate([c[j] for c, _ in held]) for j in range(order - 1)][::-1]
        one = np.ones(len(words), np.uint64)
        (*ctx, ends), n, _ = folded([*ctx, words], [one], gram(ctx[0], words))
        _, total, distinct = folded([], [one], words)
        for row in (*blocks(order, bits, *by_first([*ctx, ends], n)), *blocks(0, bits, [distinct], total)):
            yield batch_of([row], BLOCK_FIELDS)

    for b in (x for batch in batches for x in looks(batch)):
        words, starts, _ = tokens(b.column(1))
        if len(words):
            held.append((contexts(words, starts, order), words))
            size += len(words)
        if size >= FLUSH:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def by_first(columns: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    at = np.argsort(columns[0], kind="stable")
    return [c[at] for c in columns], [c[at] for c in counts]


def written(folder: str, level: int, file: int, arrays: list[np.ndarray]) -> None:
    """One file of 64-bit arrays behind their lengths, put in place whole: a task that runs twice writes the same file again."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{level}-{file}"
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(np.array([len(arrays), *(len(a) for a in arrays), *(a.dtype.itemsize for a in arrays)], np.int64).tobytes())
        for a in sorted(range(len(arrays)), key=lambda i: -arrays[i].dtype.itemsize):
            f.write(arrays[a].tobytes())
    os.replace(part, path)


def opened(path: str) -> list[np.ndarray]:
    """The arrays of one file, mapped into memory."""
    with open(path, "rb") as f:
        k = int(np.frombuffer(f.read(8), np.int64)[0])
        head = np.frombuffer(f.read(16 * k), np.int64)
    whole, at, out = np.memmap(path, np.uint8, "r"), 8 + 16 * k, [None] * k
    for a in sorted(range(k), key=lambda i: -head[k + i]):
        n, width = int(head[a]), int(head[k + a])
        out[a] = whole[at : at + n * width].view(f"u{width}")
        at += n * width
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32) if not len(a) or a.max() < 1 << 32 else a


def merged(held: list[list[np.ndarray]], keys: int) -> list[np.ndarray]:
    """keys key columns, then counts; rows of one n-gram (first key and last key) become one."""
    cols = [np.concatenate([h[i] for h in held]) for i in range(len(held[0]))]
    key = cols[0] if keys == 1 else gram(cols[0], cols[keys - 1])
    own, counts, _ = folded(cols[:keys], cols[keys:], key)
    return [*own, *counts]


def merge_file(batches: Iterator[pa.RecordBatch], level: int, bits: int, folder: str) -> Iterator[pa.RecordBatch]:
    """One file of a level: its sorted arrays are written, its figures and the blocks of the level below returned.

    Words counted beside n-grams of a higher order come as a group of their own and are merged for later.
    """
    held: list[list[np.ndarray]] = []
    size, file, keys, words = 0, 0, max(level, 1), False
    for b in batches:
        for kind, file, n, block in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if kind == 0 and level > 1:
                keys, words = 1, True
            cols = unpacked(n, block, keys + 1)
            if level == 1:  # continuations, raw count
                none = np.zeros(n, np.uint64)
                cols = [cols[0], none, cols[1]] if kind == 0 else [cols[0], cols[1], none]
            held.append(cols)
            size += n
            if size > 2 * FLUSH and len(held) > 1:
                held = [merged(held, keys)]
                size = len(held[0][0])
                if size > FLUSH:  # distinct ones: wait until there are as many again
                    size = FLUSH
    cols = merged(held, keys)
    if words:
        for row in blocks(0, bits, cols[:1], cols[1:]):
            yield batch_of([(*row, *[0] * 7)], BLOCK_FIELDS + STAT_FIELDS)
        return
    count = cols[keys]
    of = [int((count == i).sum()) for i in (1, 2, 3, 4)]
    if level == 1:
        written(folder, 1, file, [cols[0], narrow(cols[1]), narrow(cols[2])])
        stats = [*of, int((count > 0).sum()), int(count.sum()), int(cols[2].sum())]
        yield batch_of([(1, file, 0, b"", *stats)], BLOCK_FIELDS + STAT_FIELDS)
        return
    own, (total, n1, n2, n3), ctx = folded([], [count, (count == 1).astype(np.uint64), (count == 2).astype(np.uint64), (count > 2).astype(np.uint64)], cols[0])
    written(folder, level, file, [gram(cols[0], cols[keys - 1]), narrow(count), ctx, total, narrow(n1), narrow(n2), narrow(n3)])
    yield batch_of([(level, file, 0, b"", *of, 0, 0, 0)], BLOCK_FIELDS + STAT_FIELDS)
    below = cols[1:keys]
    key = below[0] if len(below) == 1 else gram(below[0], below[-1])
    below, n, _ = folded(below, [np.ones(len(key), np.uint64)], key)
    for row in blocks(level - 1, bits, *by_first(below, n)):
        yield batch_of([(*row, *[0] * 7)], BLOCK_FIELDS + STAT_FIELDS)


def merger(level: int, bits: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merge_file(batches, level, bits, folder)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of counts 1, 2 and 3 or more; (0.5, 1, 1.5) where a corpus is too small to estimate them."""
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(i - EDGE, max(EDGE, i - (i + 1) * y * b / a)) for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]


def local_path(spark: SparkSession) -> str:
    """A folder for one model in the shared folder, which workers must see as a path, for they map its files."""
    folder = f"{shared_dir(spark)}/veldt-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    scheme = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    if scheme != "file":
        raise ValueError(f"model files are mapped into memory: spark.checkpoint.dir must be a mounted folder, not {scheme}:")
    return path.toUri().getPath()


def train(docs: DataFrame, order: int = ORDER) -> dict:
    """Count (doc_id, text) into a model of n-grams of ``order`` words (two at least): its folder and a few figures.

    One shuffle of blocks for each order; a block's range of contexts depends on hashes alone. Which files a model
    has follows from the number of tokens, taken from a first look at text lengths. No documents give a model
    without words, under which every token has probability 1 / (V + 1) = 1.
    """
    if order < 2:
        raise ValueError("the order is two at least")
    spark = docs.sparkSession
    bound_batches(spark)
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(16, max(0, math.ceil(math.log2(max(1, letters / 6 / SPAN)))))
    folder = local_path(spark)
    counts, figures, held = docs.mapInArrow(lambda x: counted(x, order, bits), BLOCK), {}, []
    for level in range(order, 0, -1):
        if held:
            rows = held[-1].filter(F.col("level") == level).select("level", "file", "n", "block")
            groups = (rows.union(held[0].filter("level = 0").select(rows.columns)) if level == 1 else rows).groupBy("file")
        else:
            groups = counts.groupBy("level", "file")
        held.append(keep(groups.applyInArrow(merger(level, bits, folder), f"{BLOCK}, {STATS}")))
        sums = held[-1].filter(F.col("level") == level).agg(*[F.sum(f"s{i}") for i in range(7)]).first()
        figures[level] = [x or 0 for x in sums]
        release_shuffles(spark)
    for df in held:
        drop_kept(df)
    n1, n2, _, _, kinds, total, count = figures[1]
    return {"folder": folder, "order": order, "bits": bits, "discounts": {m: discounts(*f[:4]) for m, f in figures.items()}, "ones": (n1, n2, kinds - n1 - n2), "total": total, "tokens": count, "words": kinds}


def forget(spark: SparkSession, model: dict) -> None:
    """Delete a model's files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{model['folder']}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Reader:
    """Probabilities from the mapped files of a model."""

    def __init__(self, model: dict):
        self.m = model
        self.maps: OrderedDict[tuple[int, int], list[np.ndarray] | None] = OrderedDict()

    def arrays(self, level: int, file: int) -> list[np.ndarray] | None:
        key = (level, file)
        if key not in self.maps:
            path = f"{self.m['folder']}/{level}-{file}"
            self.maps[key] = opened(path) if os.path.exists(path) else None
            if len(self.maps) > MAPPED:
                self.maps.popitem(last=False)
        self.maps.move_to_end(key)
        return self.maps[key]

    def found(self, level: int, queries: np.ndarray, keys: int, values: list[int]) -> list[np.ndarray]:
        """For each query the values beside it in the sorted array number ``keys``; 0 where it is not there."""
        asked, back = np.unique(queries, return_inverse=True)
        out = [np.zeros(len(asked), np.float64) for _ in values]
        bits = self.m["bits"]
        file = (asked >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(asked), np.int64)
        cuts = np.flatnonzero(np.diff(file)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(file)]) if len(asked) else ():
            arrays = self.arrays(level, int(file[a]))
            if arrays is None or not len(arrays[keys]):
                continue
            q = asked[a:b]
            at = np.minimum(np.searchsorted(arrays[keys], q), len(arrays[keys]) - 1)
            hit = arrays[keys][at] == q
            for o, v in zip(out, values, strict=True):
                o[a:b][hit] = arrays[v][at[hit]]
        return [o[back] for o in out]

    def scores(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token log10 of its probability, its count in training, and log10 of its probability by words alone."""
        m = self.m
        base, (ones, twos, more) = m["words"] + 1, m["ones"]
        kinds, count = self.found(1, words, 0, [1, 2])
        d = np.array([0.0, *m["discounts"][1]])
        p = np.full(len(words), 1.0 / base)
        if m["total"]:
            p = (kinds - d[np.minimum(kinds, 3).astype(np.int64)]) / m["total"] + (d[1] * ones + d[2] * twos + d[3] * more) / m["total"] * p
        for level, context in enumerate(contexts(words, starts, m["order"]), 2):
            d = np.array([0.0, *m["discounts"][level]])
            (n,) = self.found(level, gram(context, words), 0, [1])
            total, n1, n2, n3 = self.found(level, context, 2, [3, 4, 5, 6])
            seen = total > 0
            t = np.where(seen, total, 1.0)
            p = np.where(seen, (n - d[np.minimum(n, 3).astype(np.int64)]) / t + (d[1] * n1 + d[2] * n2 + d[3] * n3) / t * p, p)
        plain = np.log10((count + 0.5) / (m["tokens"] + 0.5 * base))
        return np.log10(p), count, plain


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of (doc_id, text); documents do not move."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in (x for batch in batches for x in looks(batch)):
            words, starts, n = tokens(b.column(1))
            p, count, plain = reader.scores(words, starts)
            known = np.add.reduceat((count > 0).astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(known), pa.array(np.add.reduceat(plain, starts)), pa.array(np.add.reduceat(p, starts))], [c.split(" ")[0] for c in SCORES.split(", ")])

    return docs.mapInArrow(run, SCORES)


def held_out(key: Column) -> Column:
    """Whether the crc32 of an id as text leaves 1 when divided by 5; a null id does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def perplexity(df: DataFrame, order: int = ORDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row, by a model of the rows that are not held out.

    A null or empty text has one token, its end. Rows with a null id are trained on; repeated rows count, and are
    scored, once each; an empty table gives no rows; other columns are not read. 10 ** (-score / n_tokens) is the
    perplexity. The model's files are deleted once the scores are written.
    """
    spark = df.sparkSession
    docs = texts(df, key, text)
    model = train(docs.filter(~held_out(F.col("doc_id"))), order)
    kept = keep(score(docs, model))
    forget(spark, model)
    return kept.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op13_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole of documents; see perplexity() for nulls, repeats and empty tables."""
    return perplexity(spark.read.parquet(f"{sf_dir}/documents.parquet"))
