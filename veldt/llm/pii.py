"""Personal data by candidate gradient boosting.

Plain rules (the base) find e-mail addresses, IP addresses, card and phone numbers; what they find always stays.
Generators of high recall propose further spans, overlapping ones too: pieces of longer digit runs, numbers
without a plus sign, addresses spelled around. Boosted trees score each proposal by its format and its context. They
learn from what the base confirmed in running text and from what it would not confirm anywhere; what only its
neighbours kept the base from confirming is left for them to judge. Fits and thresholds count the candidates of all
documents. A threshold calibrated on held-out candidates
selects, and of overlapping selections the best scored stays.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import bound_batches, drop_kept, keep, texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The plain patterns; e-mail is searched from each @, and ip from the start of a digit run, which finds the same in linear time.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Proposals of high recall; every place a proposal could start at is tried.
PROPOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\s?[\[(]\s?at\s?[\])]\s?)[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[A-Za-z0-9-]+)+", re.I),
    "ip": re.compile(r"(?<![0-9.])(?=([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?![0-9]))"),
    "card": re.compile(r"(?<![0-9])(?=([0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}(?:[\x20-]?[0-9]{1,3})?)(?![0-9]))"),
    "phone": re.compile(r"(?<![0-9+])(?=((?:\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{4})(?![0-9]))"),
}
DIGIT, AROUND = re.compile(r"[0-9]"), re.compile(r"[\[(]\s?(?:at|AT)\s?[\])]")
FOURS = re.compile(r"[0-9]{4}(?:[\x20-]?[0-9]{4}){3}")
#: Places where trees may cut a feature, all of which are whole numbers: each number up to 24, then steps of about a quarter.
GRID = np.array(sorted({k + 0.5 for k in range(24)} | {round(24 * 1.25**k) + 0.5 for k in range(40)}))
#: Sums of gradients are whole multiples of 1 / UNIT, which add up to the same in any order; scores over one half fall into STEPS bins.
UNIT, STEPS = 1 << 20, 1 << 14
ROUNDS, DEPTH, RATE, PRECISION = 30, 3, 0.3, 0.98
CUE = re.compile(r"(mail|e-mail|phone|tel|call|fax|card|visa|ip|host|server|address|contact)\W*$", re.I)

FEATURES = ("kind_email", "kind_ip", "kind_card", "kind_phone", "length", "digits", "groups", "luhn", "octets", "plus", "brackets", "dots", "dashes", "spaces", "letters", "digit_before", "digit_after", "letter_before", "letter_after", "mark_before", "mark_after", "cue", "lead_zero", "distinct")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def octet(s: str) -> bool:
    """At most 255, however many zeros lead."""
    least = s.lstrip("0")
    return len(least) <= 3 and int(least or "0") <= 255


def valid(kind: str, s: str) -> bool:
    """The base's test of a match."""
    if kind == "ip":
        return all(map(octet, s.split(".")))
    if kind == "card":
        d = digits_of(s)
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(digits_of(s)) <= 15
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base's spans by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for kind in KINDS[1:]:
            out += [(kind, m.start(), m.end()) for m in BASE[kind].finditer(text) if valid(kind, m[0])]
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Candidate spans of every kind; they may overlap."""
    out = []
    kinds = [*KINDS[:1] * bool("@" in text or AROUND.search(text)), *KINDS[1:] * bool(DIGIT.search(text))]
    for kind in kinds:
        for m in PROPOSE[kind].finditer(text):
            s, e = m.span(1 if m.re.groups else 0)
            if kind == "ip" and not valid(kind, text[s:e]):
                continue  # no address, whatever stands around it
            out.append((kind, s, e))
            if kind == "card":  # a trailing group may belong to what follows
                short = FOURS.match(text, s, e)
                if short and short.end() < e and not text[short.end()].isdigit():
                    out.append((kind, s, short.end()))
    return out


def describe(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format and context of a candidate, in the order of FEATURES."""
    kind, s, e = span
    body, d = text[s:e], digits_of(text[s:e])
    before, after = text[s - 1 : s], text[e : e + 1]
    octets = body.split(".")
    return [
        *[float(kind == k) for k in KINDS], float(e - s), float(len(d)), float(len(re.findall(r"[0-9]+", body))), float(luhn(d)) if d else 0.0,
        float(len(octets) == 4 and all(o.isdigit() and octet(o) for o in octets)), float(body.startswith("+") or before == "+"), float("(" in body), float(body.count(".")), float(body.count("-")),
        float(body.count(" ")), float(sum([c.isalpha() for c in body])), float(text[max(0, s - 2) : s].strip()[-1:].isdigit()), float(text[e : e + 2].strip()[:1].isdigit()),
        float(before.isalpha()), float(after.isalpha()), float(bool(before) and before in ".-_/:\"'"), float(bool(after) and after in "-_/:\"'@"), float(bool(CUE.search(text[max(0, s - 24) : s]))),
        float(d[:1] == "0"), float(len(set(d))),
    ]


Tree = list[tuple[int, float, int, int, float]]


def _value(tree: Tree, x: list[float]) -> float:
    at = 0
    while tree[at][0] >= 0:
        j, cut, left, right, _ = tree[at]
        at = left if x[j] < cut else right
    return tree[at][4]


def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """bins (a row a vector), y, n of a batch of vectors."""
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, len(FEATURES))
    return bins, batch.column("y").to_numpy().astype(float), batch.column("n").to_numpy().astype(float)


def places(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node of the tree at which each row of bins ends."""
    at, cuts = np.zeros(len(bins), np.int64), [int(np.searchsorted(GRID, cut)) for _, cut, *_ in tree]
    for node, (j, _, left, right, _) in enumerate(tree):  # children follow their parents
        if j >= 0:
            here = at == node
            at[here] = np.where(bins[here, j] <= cuts[node], left, right)
    return at


def scores(model: tuple[float, list[Tree]], bins: np.ndarray) -> np.ndarray:
    out = np.full(len(bins), model[0])
    for tree in model[1]:
        out += np.array([node[4] for node in tree])[places(tree, bins)]
    return 1 / (1 + np.exp(-out))


def histograms(vectors: DataFrame, model: tuple[float, list[Tree]], tree: Tree, level: list[int]) -> np.ndarray:
    """Sums of gradients and curvatures by node of the level, feature and bin, over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(level), len(FEATURES), len(GRID) + 1))
        for b in batches:
            bins, y, n = unpack(b)
            p, at = scores(model, bins), places(tree, bins)
            for v, of in enumerate((np.rint((y - p) * UNIT) * n, np.rint(p * (1 - p) * UNIT) * n)):
                for k, node in enumerate(level):
                    here = at == node
                    for j in range(len(FEATURES)):
                        total[v, k, j] += np.bincount(bins[here, j], of[here], len(GRID) + 1)
        k, j, c = np.nonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (k, j, c, total[0, k, j, c], total[1, k, j, c])], ["k", "j", "c", "g", "h"])

    out = np.zeros((2, len(level), len(FEATURES), len(GRID) + 1))
    for r in vectors.mapInArrow(run, "k long, j long, c long, g long, h long").groupBy("k", "j", "c").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        out[:, r.k, r.j, r.c] = r.g / UNIT, r.h / UNIT
    return out


def grow(vectors: DataFrame, model: tuple[float, list[Tree]]) -> Tree:
    """One more tree by Newton gains, a pass over all vectors a level."""
    tree: Tree = [(-1, 0.0, 0, 0, 0.0)]
    level = [0]
    for _ in range(DEPTH):
        below = []
        for node, (g, h) in zip(level, histograms(vectors, model, tree, level).swapaxes(0, 1), strict=True):
            gs, hs, gl, hl = g[0].sum(), h[0].sum(), g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            j, k = np.unravel_index(int(gain.argmax()), gain.shape)
            tree[node] = (-1, 0.0, 0, 0, RATE * gs / (hs + 1))
            if gain[j, k] > 1e-6:
                tree[node] = (int(j), float(GRID[k]), len(tree), len(tree) + 1, 0.0)
                below += [len(tree), len(tree) + 1]
                tree += [(-1, 0.0, 0, 0, float(RATE * x / (y + 1))) for x, y in ((gl[j, k], hl[j, k]), (gs - gl[j, k], hs - hl[j, k]))]
        if not below:
            break
        level = below
    return tree


def boost(vectors: DataFrame) -> tuple[float, list[Tree]]:
    """(base score, trees) by Newton boosting of the logistic loss over all vectors (bins, y, n)."""
    n, right = vectors.agg(F.sum("n"), F.sum(F.col("n") * F.col("y"))).first()
    n, right = n or 0, right or 0
    rate = (right + 0.5) / (n + 1)
    model: tuple[float, list[Tree]] = (float(np.log(rate / (1 - rate))), [])
    for _ in range(ROUNDS if 0 < right < n else 0):
        model[1].append(grow(vectors, model))
    return model


def thresholds(vectors: DataFrame, model: tuple[float, list[Tree]]) -> dict[str, float]:
    """By kind, halfway below the least score from which on PRECISION of all candidates are right; at least one half, and over 1 where no score reaches it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, y, n = unpack(b)
            p = scores(model, bins)
            step = np.where(p >= 0.5, (p * 2 * STEPS).astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array(step), pa.array(p), pa.array((y * n).astype(np.int64)), b.column("n")], ["kind", "step", "p", "y", "n"])

    cuts = {kind: 2.0 for kind in KINDS}
    seen = vectors.mapInArrow(run, "kind string, step long, p double, y long, n long").groupBy("kind", "step").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.sum("y").alias("y"), F.sum("n").alias("n")).collect()
    for kind in KINDS:
        steps, n, right = sorted([r for r in seen if r.kind == kind], key=lambda r: -r.step), 0, 0
        for r, below in zip(steps, [*[r.high for r in steps[1:]], 0.0]):
            n, right = n + r.n, right + r.y
            if right >= PRECISION * n and r.step:
                cuts[kind] = max(0.5, (r.low + below) / 2)
    return cuts


def probability(model: tuple[float, list[Tree]], x: list[float]) -> float:
    return float(1 / (1 + np.exp(-(model[0] + sum([_value(t, x) for t in model[1]])))))


def teach(text: str, found: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[int | None]:
    """The labels of candidates, as far as the base knows them.

    1 for a candidate that the base found in its surroundings, with these very borders. 0 for one that crosses a span
    of the base with other borders, or that stands free and fails its kind's own test: a wrong check digit, a part over
    255, a phone number without country or area mark. None, and not learnt from, for a free one that would pass had
    it other neighbours: those are what the trees are to judge.
    """
    known, edges = set(base), reach(base)
    out: list[int | None] = []
    for kind, s, e in found:
        if (kind, s, e) in known:
            out.append(1)
        elif crosses(edges, s, e):
            out.append(0)
        elif kind == "email":
            out.append(None)
        elif kind == "phone":
            out.append(None if "(" in text[s:e] and text[s:e].count("(") == text[s:e].count(")") else 0)
        else:
            out.append(None if BASE[kind].fullmatch(text, s, e) and valid(kind, text[s:e]) else 0)
    return out


def reach(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts of the spans in order, and how far the spans up to each of them reach."""
    edges = sorted([(s, e) for _, s, e in spans])
    return [s for s, _ in edges], list(accumulate([e for _, e in edges], max))


def crosses(reached: tuple[list[int], list[int]], s: int, e: int) -> bool:
    """Whether s to e overlaps one of the spans behind reach()."""
    k = bisect_left(reached[0], e)
    return k > 0 and reached[1][k - 1] > s


def train(df: DataFrame, sample: int | None = None, key: str = "doc_id", text: str = "text") -> tuple[tuple[float, list[Tree]], dict[str, float]]:
    """(model, threshold by kind) from the candidates of all documents, or of at most ``sample`` if it is given.

    Spark counts the candidates by kind, binned features and label; the trees take their sums from these counts, a
    pass a level. Three of four candidates fit the trees, the fourth, by a hash of its place and its document, calibrates. The same
    rows give the same model however they are partitioned; a sample has the smallest hashes of id and text.
    """
    bound_batches(df.sparkSession)
    some = texts(df, key, text).filter(F.col("text").rlike(r"[0-9@]|[\[(]\s?(?i:at)\s?[\])]")).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    if sample is not None:
        some = some.join(some.select("h").distinct().orderBy("h").limit(sample), "h", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, bins, ys, held = [], [], [], []
            for h, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                body = t.as_py()
                found = proposals(body)
                for c, y in zip(found, teach(body, found, base_spans(body)), strict=True):
                    if y is not None:
                        kinds.append(c[0])
                        bins.append(np.searchsorted(GRID, describe(body, c)).astype(np.uint8).tobytes())
                        ys.append(y)
                        held.append(zlib.crc32(f"{h}:{c}".encode()) % 4 == 0)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(bins, pa.binary()), pa.array(ys, pa.int32()), pa.array(held, pa.bool_())], ["kind", "bins", "y", "held"])

    vectors = keep(some.mapInArrow(run, "kind string, bins binary, y int, held boolean").groupBy("kind", "bins", "y", "held").agg(F.count(F.lit(1)).alias("n")))
    model = boost(vectors.filter("not held"))
    cuts = thresholds(vectors.filter("held"), model)
    drop_kept(vectors)
    return model, cuts


def find(text: str, model: tuple[float, list[Tree]], cuts: dict[str, float], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and, of what the trees select, the best scored that overlap neither a span of the base nor each other; by kind, then start."""
    taken, scored = reach(base), []
    for c in proposals(text):
        if not crosses(taken, c[1], c[2]) and (p := probability(model, describe(text, c))) >= cuts[c[0]]:
            scored.append((-p, c[1] - c[2], c))
    out, won = list(base), []
    for *_, c in sorted(scored):
        k = bisect_left(won, c[1:])
        if (k == len(won) or won[k][0] >= c[2]) and (k == 0 or won[k - 1][1] <= c[1]):
            won.insert(k, c[1:])
            out.append(c)
    return sorted(out, key=lambda c: (KINDS.index(c[0]), c[1], c[2]))


def spans_table(df: DataFrame, model, cuts, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans of every whole text.

    Places are code points, ends exclusive. A null text is empty: no spans, the digest of nothing. Repeated rows and
    null ids give a row each; an empty table gives no rows; other columns are not read. No shuffle.
    """
    bound_batches(df.sparkSession)
    spell = lambda spans: ",".join([f"{k}:{s}:{e}" for k, s, e in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, found = [], [], []
            for t in b.column(1):
                body = t.as_py()
                base = base_spans(body)
                counts.append([sum([k == kind for k, *_ in base]) for kind in KINDS])
                shas.append(hashlib.sha256(spell(base).encode()).hexdigest())
                found.append(spell(find(body, model, cuts, base)))
            cols = [pa.array([c[j] for c in counts], pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(shas, pa.string()), pa.array(found, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return texts(df, key, text).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document: the base's spans and those that the trees add; a null text counts as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spans_table(docs, *train(docs))
