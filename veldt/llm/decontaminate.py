"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters with an error budget of k is split into k + 1 pieces. Wherever the item occurs in a
document with k edits or fewer, one piece at least occurs unchanged; so the documents are searched for the exact
pieces of all items in one pass, and around each hit Myers' bit-parallel algorithm finds the true edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import bound_batches, texts

#: Edits allowed for each character of an item.
BUDGET = 0.1
#: Characters of test items that one pass over the documents carries; more items take more passes.
PASS_CHARS = 8 << 20
SPACE = [chr(c) for c in (*range(9, 14), *range(28, 32), 133, 160)]


def plain(text: str) -> str:
    """Lower case and every white space as a space, letter for letter, so that places stay those of the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join([x if len(x := c.lower()) == 1 else c for c in text])
    for c in SPACE:
        low = low.replace(c, " ")
    return low


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(start, piece): budget + 1 pieces of even length that make up the item."""
    n = budget + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def beside(parts: list[tuple[int, str]], i: int) -> list[tuple[int, str]]:
    """(place in the item, letters): what piece i's partner leaves, if it has one edit at most; nothing if i has no partner.

    Pieces 2j and 2j + 1 are partners. Budget + 1 pieces leave some pair with one edit or a last single piece with
    none, so a hit whose partner shows neither half, that beside it in place or the far one up to a letter off, need
    not be looked at: another hit of the same occurrence passes.
    """
    j = i ^ 1
    if j >= len(parts):
        return []
    start, piece = parts[j]
    half = len(piece) // 2
    near, far = ((start, piece[:half]), (start + half, piece[half:])) if j > i else ((start + half, piece[half:]), (start, piece[:half]))
    return [near, *((far[0] + shift, far[1]) for shift in (0, -1, 1))]


class Matcher:
    """Finds the items of one pass in a text."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        import ahocorasick

        self.items, self.masks = [], []
        found: dict[str, list[tuple[int, int, list[tuple[int, str]]]]] = {}
        for item_id, text in items:
            if not (item := plain(text).strip()):
                continue
            allowed, masks = int(len(item) * budget), {}
            for i, c in enumerate(item):
                masks[c] = masks.get(c, 0) | 1 << i
            parts = pieces(item, allowed)
            for i, (start, piece) in enumerate(parts):
                found.setdefault(piece, []).append((len(self.items), start, beside(parts, i)))
            self.items.append((item_id, item, allowed))
            self.masks.append(masks)
        self.search = None
        if found:
            self.search = ahocorasick.Automaton()
            for piece, places in found.items():
                self.search.add_word(piece, (len(piece), places))
            self.search.make_automaton()

    def distance(self, k: int, text: str, start: int, end: int) -> tuple[int, int]:
        """(least distance of item k to any stretch of text[start:end], where that stretch ends)."""
        _, item, allowed = self.items[k]
        masks, m = self.masks[k], len(item)
        full, top = (1 << m) - 1, 1 << m - 1
        up, down, d = full, 0, m
        best, at = allowed + 1, -1
        for i in range(start, end):
            eq = masks.get(text[i], 0)
            x = eq | down
            diag = (((eq & up) + up) ^ up) | eq
            plus = down | ~(diag | up) & full
            minus = up & diag
            if plus & top:
                d += 1
            elif minus & top:
                d -= 1
            plus = plus << 1 & full
            minus = minus << 1 & full
            up = minus | ~(x | plus) & full
            down = plus & x
            if d < best:
                best, at = d, i + 1
                if not d:
                    break
        return best, at

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, place where the best stretch ends, its length at most): one a matching item."""
        if self.search is None or not text:
            return []
        body, spans = plain(text), {}
        starts = body.startswith
        for end, (size, places) in self.search.iter(body):
            for k, start, tests in places:
                line = end + 1 - size - start
                if not tests or any([starts(x, line + o) for o, x in tests if line + o >= 0]):
                    spans.setdefault(k, []).append(line)
        out = []
        for k, lines in spans.items():
            item_id, item, allowed = self.items[k]
            best, at, lines = allowed + 1, -1, sorted(lines)
            i = 0
            while i < len(lines) and best:
                low = high = lines[i]
                while i < len(lines) and lines[i] - high <= 2 * allowed + len(item):
                    high = lines[i]
                    i += 1
                # stretches around the hits' diagonals, at most allowed letters off on either side
                low, high = max(0, low - allowed), min(len(body), high + len(item) + allowed)
                d, e = (0, body.find(item, low, high) + len(item)) if item in body[low:high] else self.distance(k, body, low, high)
                if d < best:
                    best, at = d, e
            if best <= allowed:
                out.append((item_id, best, at, len(item)))
        return sorted(out)


def item_passes(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The distinct items in passes of at most PASS_CHARS characters (one item at least), by id."""
    now, size = [], 0
    rows = items.select(F.col(f"`{key}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).filter("i is not null and t is not null").distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        if now and size + len(r.t) > PASS_CHARS:
            yield now
            now, size = [], 0
        now.append((r.i, r.t))
        size += len(r.t)
    if now:
        yield now


def find_items(df: DataFrame, items: DataFrame, budget: float = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, match_end: every test item that a whole document holds with floor(budget x its length) edits or fewer.

    Case and kinds of white space do not count. Null texts hold nothing; null or blank items match nothing; items
    with a null id are left out; repeated items and rows each count once or give their rows again, respectively.
    No items or no documents give no rows; other columns are not read. Documents do not move: the items of a
    pass, of bounded size, travel with the task.
    """
    bound_batches(df.sparkSession)
    source, out = texts(df, key, text), None

    def search(chosen: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Matcher(chosen, budget)
            for b in batches:
                rows = [(i, *m[:3]) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for m in finder.matches(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "item_id", "distance", "match_end"])

        return source.mapInArrow(run, "doc_id long, item_id long, distance long, match_end long")

    for chosen in item_passes(items):
        found = search(chosen)
        out = found if out is None else out.union(found)
    return out if out is not None else search([])


def clean(df: DataFrame, items: DataFrame, budget: float = BUDGET, text: str = "text") -> DataFrame:
    """df without the rows whose text holds a test item; the other rows, null texts too, stay as they are."""
    bound_batches(df.sparkSession)
    out = df
    place, schema = df.columns.index(text), df.schema

    def keep_clean(now: DataFrame, chosen: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Matcher(chosen, budget)
            for b in batches:
                yield b.filter(pa.array([not (t.is_valid and finder.matches(t.as_py())) for t in b.column(place)], pa.bool_()))

        return now.mapInArrow(run, schema)

    for chosen in item_passes(items):
        out = keep_clean(out, chosen)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a whole document holds within its edit budget; see find_items() for nulls, repeats and empty tables."""
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
