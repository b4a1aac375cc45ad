"""Document fingerprints by content-defined chunking.

A gear hash over the last 64 bytes sets boundaries, normalised: a stricter mask before the usual size, a looser
one after it. A fingerprint is the set of chunk digests with their lengths; since boundaries follow content, an
insertion shifts text without changing the chunks after it. Likeness is containment weighted by length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import bound_batches, texts

MIN, USUAL, MAX = 16, 48, 192
#: Bits that must be zero at a boundary before and after the usual size.
STRICT, LOOSE = 7, 4
#: Bytes hashed at a time.
BLOCK = 1 << 20
#: How hard texts that travel are compressed.
LEVEL = 1

GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum over the 64 bytes up to it of GEAR << age, by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16, 32):
        if len(h) > k:
            older = h[:-k] << np.uint64(k)
            h[k:] += older
    return h


def boundaries(raw: bytes) -> list[int]:
    """Chunk ends, the last being len(raw)."""
    data, n = np.frombuffer(raw, np.uint8), len(raw)
    loose, strict = [], []
    for at in range(0, n, BLOCK):
        start = max(0, at - 63)
        top = gear(data[start : at + BLOCK])[at - start :] >> np.uint64(64 - STRICT)
        p = np.flatnonzero((top >> np.uint64(STRICT - LOOSE)) == 0)
        loose.append(p + (at + 1))
        strict.append(top[p] == 0)
    ends, hard = (np.concatenate(loose), np.concatenate(strict)) if loose else (np.empty(0, int), np.empty(0, bool))
    easy, firm = ends.tolist(), ends[hard].tolist()
    out, last, i, j = [], 0, 0, 0
    while n - last > MIN:
        low, mid, high = last + MIN, last + USUAL, min(last + MAX, n)
        while j < len(firm) and firm[j] < low:
            j += 1
        if j < len(firm) and firm[j] < mid and firm[j] < high:
            cut = firm[j]
        else:
            while i < len(easy) and easy[i] < mid:
                i += 1
            cut = easy[i] if i < len(easy) and easy[i] < high else high
        out.append(cut)
        last = cut
    if last < n:
        out.append(n)
    return out


def chunks(raw: bytes) -> dict[int, int]:
    """Digest to length of the distinct chunks."""
    out, last, digest = {}, 0, xxhash.xxh3_64_intdigest
    for end in boundaries(raw):
        out[digest(raw[last:end])] = end - last
        last = end
    return out


def spell(found: dict[int, int]) -> str:
    """The set as text: digest:length in digest order, so equal sets and equal texts give equal strings."""
    return ",".join([f"{d:016x}:{n}" for d, n in sorted(found.items())])


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Length shared over the smaller total; two empty sets are alike, one empty set is like nothing."""
    if not a or not b:
        return float(not a and not b)
    small, other = (a, b) if len(a) <= len(b) else (b, a)
    return sum([n for d, n in small.items() if d in other]) / min(sum(a.values()), sum(b.values()))


def spread(text: str, head: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of head."""
    half = len(text) // 2
    return text[: len(text) - half] + head[:half]


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint of every whole text (null: empty). One row a row, no shuffle."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [spell(chunks(t.as_py().encode())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return texts(df, key, text).mapInArrow(run, "doc_id long, fingerprint string")


def against_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and how like its own and the next document's are.

    The next document is that of the next smaller id, after the smallest the largest; null ids come last.
    Rows that share an id are ordered by their text. A null text is empty. An empty table gives no rows and a
    single row is its own next. Other columns are not read.

    Rows are dealt to tasks by ranges of ids whose ends are ids of the table; the row at a range's top travels
    twice, since it is also the next of the range above. Texts travel once, compressed; no task needs more than
    the rows of its range, one after the other.
    """
    import zstandard

    spark = df.sparkSession
    bound_batches(spark)
    source = texts(df, key, text)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts)]
    stats = source.agg(F.percentile_approx("doc_id", shares or [0.5], max(10_000, 10 * parts)).alias("cuts"), F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("n_ids")).first()
    tops = np.array(sorted({*(stats.cuts or []), *([stats.top] if stats.top is not None else [])}), np.int64)
    nulls = stats.n - stats.n_ids  # rows without an id stand below every range

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in batches:
            cols: dict[str, list] = {"part": [], "doc_id": [], "rank": [], "only_next": [], "digest": [], "body": []}
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = t.as_py().encode()
                places = [(0, False) if i is None else (int(np.searchsorted(tops, i)) + 1, False)]
                if i is not None and i in (tops[places[0][0] - 1],):  # the top of its range: next of the range above
                    above = places[0][0] + 1
                    places.append((above, True) if above <= len(tops) else (0 if nulls else 1, True))
                elif i is None:
                    places.append((1, True))
                body, digest = shrink(raw), hashlib.sha256(raw).digest()
                for place, only in places:
                    for k, v in zip(cols, (place, i, int(i is None), only, digest, body), strict=True):
                        cols[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols["part"], pa.int32()), pa.array(cols["doc_id"], pa.int64()), pa.array(cols["rank"], pa.int32()), pa.array(cols["only_next"], pa.bool_()), pa.array(cols["digest"], pa.binary()), pa.array(cols["body"], pa.binary())], list(cols))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        last = None  # the document that still waits for its next
        part = None
        done: list[tuple] = []

        def finish(doc: tuple, after: tuple) -> tuple:
            i, t, found, sha = doc
            changed = spread(t, after[1])
            raw = changed.encode()
            own = found if changed == t else chunks(raw)
            return (i, len(t), hashlib.sha256(raw).hexdigest(), spell(found), spell(own), likeness(found, own), likeness(found, after[2]))

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], OUT)

        for b in batches:
            for p, i, only, sha, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
                if p != part:
                    last, part = None, p
                elif last is None:
                    continue  # the part's one next has been used; rows that repeat its id come after it
                t = last[1] if last and last[3] == sha else expand(body.as_py()).decode()
                found = last[2] if last and last[3] == sha else chunks(t.encode())
                now = (i, t, found, sha)
                if last is not None:
                    done.append(finish(last, now))
                last = None if only else now
            if len(done) >= 64:
                yield out()
                done = []
        if done:
            yield out()

    packed = source.mapInArrow(pack, "part int, doc_id long, rank int, only_next boolean, digest binary, body binary")
    order = ["part", F.col("only_next"), F.col("rank"), F.col("doc_id").desc(), "digest"]
    dealt = packed.repartitionById(parts + 1, "part").sortWithinPartitions(*order)
    return dealt.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are; a null text counts as empty."""
    return against_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
