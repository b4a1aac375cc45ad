"""The text operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veldt.llm import bpe, decontaminate, fingerprint, graph, html_text, line_dedup, pii, quality, simhash, similar, substring_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, node int, __x int"


def table(spark, rows, schema=SCHEMA):
    """rows of (id, text); the other columns clash with names used inside."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "z", 1, 2) for i, t in rows], schema)


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    r = random.Random(4)
    base = [words(r, r.randint(20, 120)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(8, 40):
        t = r.choice(base).split(" ")
        for _ in range(r.choice((0, 0, 1, 1, 2, 9))):
            t[r.randrange(len(t))] = "xyz"
        rows.append((i, r.choice(("", "", "Ein Wort ")) + " ".join(t)))
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "Word"), (44, "WORD"), (45, "é ñ\n日本"), (46, "a" * 5000), (47, words(r, 3000)), (47, base[0]), (None, base[1]), (None, None), (48, base[2]), (48, base[2])]
    return rows


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def close(items, linked):
    """Index to the least index reachable."""
    root = list(range(len(items)))
    for a, b in itertools.combinations(range(len(items)), 2):
        if linked(items[a], items[b]):
            x, y = root[a], root[b]
            root = [min(x, y) if v in (x, y) else v for v in root]
    return root


def test_simhash(spark, docs):
    got = sorted([(r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, docs)).collect()])
    prints = [(i, brute_fingerprint(t)) for i, t in docs]
    root = close(prints, lambda a, b: (a[1] ^ b[1]).bit_count() <= 3)
    low = {}
    for (i, _), c in zip(prints, root, strict=True):
        low[c] = min([x for x in (low.get(c), i) if x is not None], default=None)
    assert got == sorted((i if i is not None else -1, f"{p:016x}", low[c]) for (i, p), c in zip(prints, root, strict=True))
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_simhash_large_shard(spark, monkeypatch):
    """Many fingerprints that share their blocks are dealt over several trees; no link between components is lost."""
    monkeypatch.setattr(simhash, "TREE", 16)
    r = random.Random(1)
    some = sorted({r.getrandbits(38) & r.getrandbits(38) & r.getrandbits(38) for _ in range(300)})
    got = simhash.links(spark.createDataFrame([(x,) for x in some], "fp long")).collect()
    root = list(range(len(some)))
    for e in got:
        assert (e.a ^ e.b).bit_count() <= 3
        x, y = root[some.index(e.a)], root[some.index(e.b)]
        root = [min(x, y) if v in (x, y) else v for v in root]
    assert root == close(some, lambda a, b: (a ^ b).bit_count() <= 3)


def test_bk_tree():
    r = random.Random(2)
    tree, points = simhash.BKTree(), [r.getrandbits(12) for _ in range(200)]
    for p in points:
        tree.add(p)
    for q in points[:30]:
        assert sorted(tree.within(q, 3)) == sorted(p for p in points if (p ^ q).bit_count() <= 3)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    root = close(nodes, lambda a, b: (a, b) in edges or (b, a) in edges)
    assert got == {n: nodes[c] for n, c in zip(nodes, root, strict=True)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(spark):
    r = random.Random(5)
    rows = [(i, words(r, 60) if i % 4 else (words(r, 60).upper().replace(" ", "!! "))) for i in range(400)] + [(400, None), (401, ""), (None, "x y"), (7, words(r, 50))]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(9, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    frame = table(spark, rows)
    model = quality.train(frame, labels)
    got = {(x.doc_id): x.score for x in quality.score_table(frame, model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 > 0) for i in range(400)) and all(0 <= s <= 1 for s in got.values()) and got[400] == got[401]
    assert quality.score_table(frame, model).count() == len(rows)
    assert quality.fit(quality.np.zeros((0, 22)), quality.np.zeros(0))[1] == []
    assert quality.score_table(table(spark, []), quality.train(table(spark, []), labels.limit(0))).count() == 0
    kept = quality.scored(frame, model)
    assert kept.columns == [*frame.columns, "__score"] and {x.doc_id: x["__score"] for x in kept.collect()} == got
    # a compiled rule says what the rule says
    x = quality.np.array([quality.describe(t or "") for _, t in rows])
    z = model[0] + sum(w * quality.holds(rule, x) for w, rule in model[1])
    assert sorted(1 / (1 + quality.np.exp(-z))) == pytest.approx(sorted(v.score for v in quality.score_table(frame, model).collect()))


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="with-sidebar"><header>Site</header><nav><ul><li><a href="/">Home</a><li>Two</ul></nav>
<div class="cookie-notice">We use cookies.</div><main><h1>A &amp; B</h1><p>First&nbsp;para  with <b>bo</b>ld<br>line.<p>Ok.<div class="ad">Buy!</div><ul><li>one<li>two</ul><form><label>Mail</label><button>Go</button></form>
<script>if (a < b) document.write("</p>")</script><!-- no --><p>Last&#33;</p><div id="comments"><article><p>Nice read, thank you.</p></article></div></main><aside>More</aside><footer>&copy; Me</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (None, "v", "", 0), (3, "w", "<p>hi there, all of you.<b", 0), (3, "w", "<p>hi there, all of you.<b", 0), (4, "x", "<nav>only</nav>", 0), (5, "y", "<article>" + "<p>word " * 3000 + "</article>", 0)], "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got[:6]] == [(1, "u", "A & B First para with bold line. Ok. one two Last!", 50), (2, None, "", 0), (None, "v", "", 0), (3, "w", "hi there, all of you.", 21), (3, "w", "hi there, all of you.", 21), (4, "x", "", 0)]
    assert got[6].text == " ".join(["word"] * 3000)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_digit_share_of_whole_block():
    assert html_text.features(("a" * 5000 + "7" * 5000, 0, (), "p", 0))[6] == 0.5


def test_nested_page():
    page = "<div>" * 20_000 + "<p>One two three.</p>" * 3 + "</div>" * 20_000
    assert html_text.main_text(page, html_text.PRIOR) == "One two three. One two three. One two three."
    assert html_text.main_text("<b>" * 20_000 + "<p>One two three." * 20_000, html_text.PRIOR).count("One") == 20_000


def test_cut_moves_labels():
    """A short block between long ones goes with them, one among links does not; judged alone both would be boilerplate."""
    long, link = "<p>" + "Words of an article, and more of them. " * 5 + "</p>", "<li><a href=x>menu</a></li>"
    for page, good in ((f"<div>{long}<p>Yes</p>{long}</div>", True), (f"<ul>{link * 3}</ul><p>Yes</p><ul>{link * 3}</ul>", False)):
        blocks = html_text.blocks_of(page)
        at = [b[0] for b in blocks].index("Yes")
        assert not html_text.label(blocks, html_text.PRIOR, 0.0)[at] and html_text.label(blocks, html_text.PRIOR)[at] == good


def test_min_cut():
    r = random.Random(6)
    for _ in range(300):
        n = r.randint(1, 7)
        s, t = [[r.random() for _ in range(n)] for _ in "ab"]
        edges = [(a, b, r.random()) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]

        def cost(one, s=s, t=t, edges=edges):
            return sum(t[v] if x else s[v] for v, x in enumerate(one)) + sum(c for a, b, c in edges if one[a] != one[b])

        assert cost(html_text.min_cut(s, t, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def brute_cut(rows):
    seen, out = set(), {}
    for i, t in sorted((i, t or "") for i, t in rows):
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(x for x, y in zip(raw, gone, strict=True) if not y)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [8192, 1])
def test_substring(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    r = random.Random(7)
    base = [words(r, 60) for _ in range(4)]
    rows = [(i, "".join(r.choice(base)[r.randint(0, 60) : r.randint(90, 400)] + words(r, r.randint(0, 3)) for _ in range(r.randint(0, 5)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "a" * 700), (43, "ab" * 300 + "é" * 120), (44, "x" * 99), (45, base[0] + base[1]), (46, base[0] + base[1])]
    got = substring_dedup.substring_dedup(table(spark, rows)).withColumn("sha", F.sha2("kept", 256))
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.sha) for x in got.collect()} == brute_cut(rows)


def test_substring_edges(spark):
    odd = [(None, "z" * 300), (None, "z" * 300), (1, "q" * 50 + "z" * 120), (2, "w " * 200), (2, "w " * 200)]
    got = sorted([(x.doc_id or 0, x.n_bytes, x.n_removed) for x in substring_dedup.substring_dedup(table(spark, odd)).collect()])
    assert got == [(0, 300, 0), (0, 300, 0), (1, 170, 119), (2, 400, 398), (2, 400, 398)]
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0


def test_segments():
    """Phrases cover every start once, across the cuts between segments."""
    r = random.Random(8)
    raw = bytes(r.choice(b"abcd ") for _ in range(substring_dedup.SEGMENT + 500))
    starts = [s for _, first, count, _ in substring_dedup.parse(raw) for f, n in zip(first.tolist(), count.tolist(), strict=True) for s in range(f, f + n)]
    assert starts == list(range(len(raw) - 99))


def distance(p, t):
    col, best = list(range(len(p) + 1)), len(p)
    for c in t:
        prev = col[0]
        for i in range(1, len(p) + 1):
            prev, col[i] = col[i], min(prev + (p[i - 1] != c), col[i] + 1, col[i - 1] + 1)
        best = min(best, col[-1])
    return best


def test_decontaminate(spark):
    r = random.Random(9)
    items = [(k, words(r, 12)) for k in range(6)] + [(6, None), (None, "x"), (7, "  "), (0, "short one")]
    rows = []
    for i in range(60):
        t = list(items[r.randrange(6)][1])
        for _ in range(r.randint(0, 14)):
            p = r.randrange(len(t))
            t[p : p + r.randint(0, 1)] = r.choice(("", "x", "Y", "\n"))
        rows.append((i, words(r, 8) + " " + "".join(t) + " " + words(r, 8)))
    rows += [(60, None), (61, ""), (None, items[0][1].upper()), (62, items[1][1]), (62, items[1][1])]
    held = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.item_id, x.distance) for x in decontaminate.find_items(table(spark, rows), held).collect())
    want = []
    for i, t in rows:
        for k, x in items:
            if k is not None and x and (q := decontaminate.plain(x).strip()):
                d = distance(q, decontaminate.plain(t or ""))
                if t and d <= int(len(q) * 0.1):
                    want.append((i if i is not None else -1, k, d))
    assert got == sorted(want) and len(want) > 20
    dirty = {w[0] for w in want}
    clean = decontaminate.clean(table(spark, rows), held)
    assert clean.columns == table(spark, []).columns
    assert sorted(x.doc_id if x.doc_id is not None else -1 for x in clean.collect()) == sorted(i for i, _ in [(i if i is not None else -1, t) for i, t in rows] if i not in dirty)
    assert decontaminate.find_items(table(spark, rows), held.limit(0)).count() == 0 and decontaminate.find_items(table(spark, []), held).count() == 0


def test_decontaminate_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_CHARS", 10)
    held = spark.createDataFrame([(1, "one two three four"), (2, "five six seven eight")], "item_id long, text string")
    got = decontaminate.find_items(table(spark, [(1, "so one two three four so"), (2, "five six seven eight"), (3, "none")]), held)
    assert sorted((x.doc_id, x.item_id) for x in got.collect()) == [(1, 1), (2, 2)]
    assert [x.doc_id for x in decontaminate.clean(table(spark, [(1, "so one two three four so"), (2, "five six seven eight"), (3, "none")]), held).collect()] == [3]


@pytest.mark.parametrize("nulls", [False, True])
def test_fingerprint(spark, docs, nulls):
    rows = [x for x in docs if nulls or x[0] is not None]
    ranked = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.sha256((x[1] or "").encode()).digest()))
    want = []
    for k, (i, t) in enumerate(ranked):
        t, after = t or "", ranked[(k + 1) % len(ranked)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, e, n = (fingerprint.chunks(x.encode()) for x in (t, edited, after))
        want.append((i or -1, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.spell(a), fingerprint.spell(e), fingerprint.likeness(a, e), fingerprint.likeness(a, n)))
    got = [(x.doc_id or -1, *x[1:]) for x in fingerprint.against_next(table(spark, rows)).collect()]
    assert sorted(got) == sorted(want)
    assert fingerprint.against_next(table(spark, [])).count() == 0
    assert fingerprint.against_next(table(spark, [(5, "ab")])).first().edited_sha256 == hashlib.sha256(b"aa").hexdigest()


def test_chunks_resist_shifts():
    r = random.Random(11)
    text = words(r, 2000)
    a, b = fingerprint.chunks(text.encode()), fingerprint.chunks(("inserted " + text).encode())
    assert fingerprint.likeness(a, b) > 0.97 and fingerprint.likeness(a, a) == 1
    ends = fingerprint.boundaries(text.encode())
    assert ends[-1] == len(text) and all(0 < y - x <= fingerprint.MAX for x, y in zip([0, *ends], ends, strict=False))
    data = fingerprint.np.frombuffer(text[:300].encode(), fingerprint.np.uint8)
    h, want = 0, []
    for c in data.tolist():
        h = (h * 2 + int(fingerprint.GEAR[c])) & (1 << 64) - 1
        want.append(h)
    assert fingerprint.gear(data).tolist() == want


def test_bpe(spark, docs):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    truth = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*docs, (60, "I'll  say 'tis\u00a0so <|endoftext|> ␟ 🙂\x00 日本語"), (61, "x" * 20000)]
    want = []
    for i, t in rows:
        ids = truth.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    frame = table(spark, rows)
    assert sorted((x.doc_id or -1, *x[1:]) for x in bpe.round_trip(frame, path, P.PATTERN).collect()) == sorted(want)
    back = bpe.decode_table(bpe.encode_table(frame, path, P.PATTERN), path, P.PATTERN)
    assert sorted((x.doc_id or -1, x.text) for x in back.collect()) == sorted((i or -1, t or "") for i, t in rows)


URLS = [None, "", "nothing", "http://a.example.net/en/x?q#f", "http://example.net/en", "https://example.net/fr/", "HTTP://EXAMPLE.COM/de/1", "http://xexample.com/de/", "http://a.org/fr/1", "http://org/fr/", "http://b.net", "http://b.net?x", "http://NET/#a", "http:///en/", "x://y://z.net/a", "http://example.com/DE/", "http://a.example.net/en/x?q#f"]


def test_url_filter(spark):
    got = url_filter.judge(spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS)] + [(None, "http://b.net/", "k")], "page_id long, url string, key string")).collect()
    for row in got:
        url = (URLS[row.page_id] if row.page_id is not None else "http://b.net/") or ""
        rest = url.partition("://")[2]
        host, path = re.match("[^/?#]*", rest)[0].lower(), re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, best[1], best[2])
    assert len(got) == len(URLS) + 1
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_of_many_labels(spark):
    host = ".".join(["a"] * 50_000) + ".example.net"
    rows = [(1, f"http://{host}/en/x"), (2, f"http://{host}/de/"), (3, "http://" + "." * 20_000 + "/fr/"), (4, "http://org/fr/")]
    got = {x.page_id: (x.rule, x.verdict, len(x.host)) for x in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("example.net/en/", "allow", len(host)), 2: ("net/", "block", len(host)), 3: (None, "allow", 20_000), 4: ("org/fr/", "allow", 3)}
    with pytest.raises(ValueError):
        url_filter.cascade(spark.range(20_000).select(F.col("id").cast("string").alias("key")), spark.range(5).select(F.col("id").cast("string").alias("key")))


def test_cascade_of_a_large_universe(spark):
    """Two listed keys among two million: level 1 grows with the universe, so that later levels stay small."""
    universe = spark.range(2_000_000).select(F.concat(F.lit("host"), "id").alias("key"))
    levels = url_filter.cascade(universe.filter("key in ('host7', 'host1999999')"), universe)
    assert 64 * len(levels[0]) >= url_filter._bits_for(2, 1024 / 2_000_000) and all(len(w) <= url_filter.MOST_WORDS for w in levels)
    got = {r.key for r in universe.filter(url_filter.member(F.col("key"), levels)).collect()}
    assert got == {"host7", "host1999999"}
    assert url_filter._bits_for(2, 1024 / 24_000_000) < url_filter._bits_for(2, 1024 / 10**15) < 64 * url_filter.MOST_WORDS


def test_cascade_is_exact(spark):
    """Small filters let many wrong keys through; the cascade still tells all keys of its universe apart."""
    universe, listed = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key")), spark.range(0, 4000, 37).select(F.concat(F.lit("k"), "id").alias("key"))
    levels = url_filter.cascade(listed, universe, bits_per_key=3)
    assert len(levels) > 2
    found = universe.filter(url_filter.member(F.col("key"), levels))
    assert sorted(x.key for x in found.collect()) == sorted(x.key for x in listed.collect())
    assert url_filter.cascade(listed.limit(0), universe) == []


def plain_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: [int(c) for c in s if c.isdigit()]
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return out


def test_pii(spark):
    r = random.Random(12)
    for _ in range(5000):
        t = "".join(r.choice("a1.@ -+()25%_9") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t)
    cards = ["4929348385146306", "4952935900253052"]
    rows = [(i, r.choice((f"mail me at x.{i}@mail.example.com now", f"call +1 ({100 + i}) 555-0{100 + i} or", f"host 10.2.{i}.7 is", f"card {cards[i % 2]} end", f"build 4952935900253{100 + i} and 1.2.3.{300 + i}"))) for i in range(150)]
    rows += [(200, f"{cards[0]} {cards[1]} both"), (201, None), (202, ""), (None, "a@b.c"), (203, "é🙂 a@b.c"), (203, "é🙂 a@b.c")]
    frame = table(spark, rows)
    model = pii.train(frame)
    got = {x.doc_id: x for x in pii.spans_table(frame, *model).collect()}
    for i, t in rows:
        base = plain_spans(t or "")
        spelled = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x[0] for x in base) for k in pii.KINDS)
        assert got[i].base_sha256 == hashlib.sha256(spelled.encode()).hexdigest() and set(filter(None, spelled.split(","))) <= set(got[i].spans.split(","))
    assert got[200].spans == "card:0:16,card:17:33" and got[203].spans == "email:3:8"
    assert pii.spans_table(table(spark, []), *pii.train(table(spark, []))).count() == 0


def test_pii_of_long_texts(spark):
    assert pii.base_spans("0" * 5000 + ".1.2.3 " + "9" * 5000 + ".1.2.3") == [("ip", 0, 5006)]
    text = " ".join(f"x{i}@mail.example.com or 10.0.{i % 200}.7" for i in range(50_000))
    base = pii.base_spans(text)
    assert len(base) == 100_000 and pii.find(text, (0.0, []), {k: 0.5 for k in pii.KINDS}, base) == base
    nested = pii.reach([("email", 0, 100), ("ip", 5, 9), ("ip", 20, 30)])
    assert pii.crosses(nested, 50, 60) and not pii.crosses(nested, 100, 110) and not pii.crosses(([], []), 0, 9)


def test_pii_selects_what_neighbours_hide(spark):
    """Numbers that stand beside other digits are missed by the base; decoys with a wrong check digit stay out."""
    r, rows = random.Random(5), []
    cards = [n for n in range(4929348385146000, 4929348385148000) if pii.luhn(str(n))]
    for i in range(300):
        rows += [(5 * i, f"{r.choice(('call', 'so', 'of it', 'tel'))} +1 ({100 + i}) 555-0{100 + i} {r.choice(('or', 'and', '. So'))}"), (5 * i + 1, f"card {cards[i % len(cards)]} end"), (5 * i + 2, f"order {4929348385140001 + i * 7} sent")]
        rows += [(5 * i + 3, f"host 10.2.{i % 250}.7 is"), (5 * i + 4, f"mail x{i}@mail.example.com")]
    rows = [x for x in rows if x[0] % 5 != 2 or not pii.luhn(x[1].split()[1])]
    r.shuffle(rows)
    model = pii.train(table(spark, rows), sample=len(rows))
    added = lambda t: sorted(set(pii.find(t, *model, pii.base_spans(t))) - set(pii.base_spans(t)))
    hidden = [f"so +1 (222) 555-{k:04d} 190.137.22.9" for k in range(100)]
    assert not any(pii.base_spans(t)[-1][0] == "phone" for t in hidden)
    assert sum(("phone", 3, 20) in added(t) for t in hidden) >= 90
    assert not any(added(f"order {n} sent") for n in range(4929348385146300, 4929348385146400))


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("small", [8, 1])
def test_line_dedup(spark, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    r = random.Random(13)
    base = [words(r, 30) for _ in range(10)]
    near = [x.replace(" ", "  ", 2).upper() for x in base[:5]] + [" ".join([*x.split(" ")[:-1], "changed"]) for x in base] + [" ".join(["new", *x.split(" ")[1:]]) for x in base]
    rows = [(i, "\n".join(r.choice([*base, *near, words(r, 12), "", "--", "The."]) for _ in range(r.randint(0, 6)))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, base[0]), (52, base[1]), (52, base[1]), (53, words(r, 900)), (54, "ñandú 日本\nñandú 日本")]
    frame = table(spark, rows)
    raw = line_dedup.raw_lines(frame, "doc_id", "text")
    norms = raw.select("doc_id", "line_no", line_dedup.normalise(F.col("line")).alias("norm")).filter("norm <> ''")
    nodes = line_dedup.hashed_lines(raw).select("doc_id", "line_no", "sim").join(norms, ["doc_id", "line_no"]).distinct().collect()
    assert all(x.sim & (1 << 64) - 1 == brute_line(spark, x.norm) for x in nodes[:20])
    monkeypatch.setattr(line_dedup, "NARROW", 40)  # some lines now count in wide lanes
    wide = line_dedup.hashed_lines(raw).select("doc_id", "line_no", "sim").distinct().collect()
    assert sorted(wide) == sorted((x.doc_id, x.line_no, x.sim) for x in nodes)
    kinds = sorted({(x.norm, x.sim) for x in nodes})
    root = close(kinds, lambda a, b: ((a[1] ^ b[1]) & (1 << 64) - 1).bit_count() <= 3 and edit(a[0], b[0]) <= 0.2 * max(len(a[0]), len(b[0])) + 1e-6)
    group = {n: c for (n, _), c in zip(kinds, root, strict=True)}
    first = {}
    for x in sorted(nodes, key=lambda x: (x.doc_id, x.line_no)):
        first.setdefault(group[x.norm], (x.doc_id, x.line_no))
    norm = {(x.doc_id, x.line_no): x.norm for x in nodes}
    want = []
    for i, t in rows:
        if i is None or t is None:
            want.append((-1 if i is None else i, t))
        else:
            want.append((i, "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in norm or first[group[norm[i, k]]] == (i, k))))
    got = line_dedup.fuzzy_line_dedup(frame)
    assert got.columns == frame.columns
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.text or "") for x in got.collect()) == sorted((i, t or "") for i, t in want)
    assert line_dedup.fuzzy_line_dedup(table(spark, [])).count() == 0


def test_line_dedup_whole(spark):
    """Brute force by edit similarity alone, with no gate before it."""
    r = random.Random(23)
    rows, n = [], 0
    for size in (4, 6, 9, 14, 20, 40):
        for _ in range(8):
            w = words(r, size).split(" ")
            rows.append((n, " ".join(w)))
            for _ in range(3):
                v = list(w)
                for k in r.sample(range(size), max(1, size // 12)):
                    v[k] = words(r, 1)
                rows.append((n := n + 1, " ".join(v)))
            n += 1
    rows += [(9000, "日本語の文章はここにありますとても長い文"), (9001, "日本語の文章はここにありますとても短い文")]
    texts = [t for _, t in rows]
    bags = {t: collections.Counter(t) for t in texts}
    unlike = lambda a, b: max((bags[a] - bags[b]).total(), (bags[b] - bags[a]).total())  # noqa: E731  never above the edit distance
    root = close(texts, lambda a, b: unlike(a, b) <= (k := 0.2 * max(len(a), len(b)) + 1e-6) and edit(a, b) <= k)
    want = {i for k, (i, _) in enumerate(rows) if root[k] == k}
    got = {x.doc_id for x in line_dedup.fuzzy_line_dedup(table(spark, rows), whole=True).filter("text <> ''").collect()}
    assert want <= got and len(rows) - len(got) >= 0.97 * (len(rows) - len(want))
    assert line_dedup.fuzzy_line_dedup(table(spark, []), whole=True).count() == 0


def test_long_lines_by_characters(spark):
    w = words(random.Random(3), 300).split(" ")
    a, b = " ".join(w), " ".join(x[:-1] + "z" if k % 4 == 0 else x for k, x in enumerate(w))
    assert len(a) > line_dedup.BY_CHARS
    lines = spark.createDataFrame([(1, a), (2, b)], "node long, line string").select("node", *line_dedup.comparable(F.col("line"), True))
    assert line_dedup.verified(spark.createDataFrame([(1, 2)], "a long, b long"), lines).count() == 1


def test_line_normal_form(spark):
    same = ["Hello, world! Well", "hello world well", "Hello\u3000world\u2003well", "hello\x01world \u200b well", "(hello) world: well."]
    rows = [*enumerate(same), (10, "--"), (11, " --\t"), (12, "**"), (13, "\u3000 \t"), (14, "\u2003")]
    got = {x.doc_id: x.norm for x in table(spark, rows).select("doc_id", line_dedup.normalise(F.col("text")).alias("norm")).collect()}
    assert {got[i] for i in range(5)} == {"hello world well"}
    assert [got[i] for i in range(10, 15)] == ["--", "--", "**", "", ""]


def brute_line(spark, norm):
    h = [x.h & (1 << 64) - 1 for x in spark.createDataFrame([(w,) for w in dict.fromkeys(norm.split(" "))], "w string").select(F.xxhash64("w").alias("h")).collect()]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicate_stage(spark):
    import corpus_pipeline

    r = random.Random(31)
    rows = []
    for k in range(25):
        w = words(r, 150).split(" ")
        rows.append((k * 10, " ".join(w)))
        for j in range(1, 4):
            v = list(w)
            for at in range(j):  # each changed word takes five runs
                v[20 + 40 * at] = words(r, 1) + "zz"
            rows.append((k * 10 + j, " ".join(v)))
        v = list(w)
        v[::9] = ["new"] * len(v[::9])
        rows.append((k * 10 + 5, " ".join(v)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (None, rows[0][1]), (904, rows[0][1]), (904, words(r, 50))]
    runs = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
    root = close(list(enumerate(runs)), lambda a, b: rows[a[0]][0] is not None and rows[b[0]][0] is not None and len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]))
    want = {i for k, (i, _) in enumerate(rows) if root[k] == k}
    frame = table(spark, rows)
    assert {x.doc_id for x in corpus_pipeline.near_duplicate_stage(spark, frame, "").collect()} == want
    assert corpus_pipeline.near_duplicate_stage(spark, table(spark, []), "").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(14)
    good = [(i, words(r, 80) + "\n" + words(r, 70)) for i in range(60)]
    junk = [(100 + i, words(r, 60).upper().replace(" ", "!! ")) for i in range(40)]
    item = words(r, 30)
    rows = [*good, *junk, (200, good[3][1]), (201, words(r, 40) + " " + item + " " + words(r, 40)), (202, None), (None, words(r, 50))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), *range(100, 140)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, str(tmp_path))
        assert k == 4 or after.columns == now.columns
        after.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        ids.append({x.doc_id for x in now.select("doc_id").collect()})
    assert set(range(60)) | {200, 201, None} <= ids[0] and not ids[0] & set(range(100, 140))
    assert ids[1] == ids[0] and set(range(60)) | {201, None} <= ids[2]
    assert 201 not in ids[3] and set(range(60)) <= ids[3] and ids[4] == ids[3]
    final = {x.doc_id: x for x in now.collect()}
    assert final[5].decoded_sha256 == hashlib.sha256(good[5][1].encode()).hexdigest()
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]


def test_line_dedup_across_word_counts(spark):
    """Lines of nine and ten words meet, whatever the edit: a word added, dropped or replaced, a letter in every third word."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(4, 8)))
    edits = [lambda w: [*w[:4], word(), *w[4:]], lambda w: w[:-1], lambda w: [*w[:3], *w[4:]], lambda w: [x[:-1] + "0" if i % 3 == 0 else x for i, x in enumerate(w)]]
    rows = []
    for n in (8, 9, 10, 11, 13, 16):
        for edit in edits:
            for _ in range(6):
                w = [word() for _ in range(n)]
                rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(edit(w)))]
    got = {x.doc_id: x.text for x in line_dedup.fuzzy_line_dedup(table(spark, rows), whole=True).collect()}
    assert all(got[i] == t for i, t in rows[::2])
    assert sum(got[i] == "" for i, _ in rows[1::2]) >= 0.9 * len(rows) / 2


def test_html_names_of_page_and_article():
    """Names on body describe the page; a discussion inside an article is part of it, readers' comments are not."""
    pages = [
        '<html class="has-comments"><body class="single comments-open notice"><article><p>The text of the article stands here, in full.</p></article></body></html>',
        '<body><article><p>The first part of a paper is here.</p><section id="discussion"><p>Its discussion follows, at some length.</p></section><div class="comments"><p>Nice paper, thanks.</p></div></article><section id="discussion"><p>I do not agree at all.</p></section></body>',
    ]
    got = [html_text.main_text(h, html_text.PRIOR) for h in pages]
    assert got == ["The text of the article stands here, in full.", "The first part of a paper is here. Its discussion follows, at some length."]


def test_in_turn_is_never_below_the_edit_distance(spark):
    r = random.Random(41)
    rows = []
    for k in range(200):
        w = words(r, r.randint(1, 30)).split(" ")
        v = list(w)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(v) + 1)
            v[at : at + r.randint(0, 2)] = words(r, r.randint(1, 2)).split(" ")
        rows.append((k, w, v))
    frame = spark.createDataFrame([*rows, (200, [], []), (201, [], ["ab"]), (202, ["ab", "c"], [])], "k int, x array<string>, y array<string>")
    got = {x.k: x.d for x in frame.select("k", line_dedup.in_turn(F.col("x"), F.col("y")).alias("d")).collect()}
    assert all(got[k] >= edit("".join(" " + w for w in x), "".join(" " + w for w in y)) for k, x, y in rows)
    assert (got[200], got[201], got[202]) == (0, 3, 5)
    shifted = spark.createDataFrame([(["new", "a", "b", "c"] * 9, ["a", "b", "c", "d"] * 9)], "x array<string>, y array<string>")
    assert shifted.select(line_dedup.in_turn(F.col("x"), F.col("y")).alias("d")).first().d <= 9 * 6


def test_unlike_short_lines_are_seldom_compared(spark, monkeypatch):
    """Lines of the same few syllables share many threes of characters though none is like another."""
    r, seen = random.Random(43), []
    syllables = "the tion ing er and of re on an or ha wh ou nd ea ti st en ed at is ble ly sh".split()
    line = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(8, 15)))
    check = line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, held: seen.append(pairs.count()) or check(pairs, held))
    rows = [(i, line()) for i in range(3000)]
    got = line_dedup.fuzzy_line_dedup(table(spark, rows), whole=True)
    assert got.filter("text <> ''").count() == 3000 and sum(seen) < 60


def test_pii_learns_from_every_document(spark, monkeypatch):
    """Documents beyond any sample of 4000 change the model, which is the same in any partitioning."""
    monkeypatch.setattr(pii, "ROUNDS", 2)
    cards = [n for n in range(4929348385100000, 4929348385148000) if pii.luhn(str(n))]
    rows = [(i, f"host 10.2.{i % 250}.{i % 240} is up") for i in range(5000)] + [(5000 + i, f"card {cards[i]} end") for i in range(50)] + [(6000 + i, f"order {4929348385140001 + 10 * i} sent") for i in range(50)]
    frame = table(spark, rows)
    model, cuts = pii.train(frame)
    assert (model, cuts) == pii.train(frame.repartition(5, "text")) and len(model[1]) == 2
    late = [i for _, i in sorted((x.h, x.doc_id) for x in frame.select(F.xxhash64("doc_id", "text").alias("h"), "doc_id").collect())[4000:]]
    assert pii.train(table(spark, [x for x in rows if x[0] not in late]))[0][0] != model[0]


def test_near_duplicates_meet_by_simhash():
    """Bands come from sums to which each shingle adds 1 or takes 1, and sets of similarity 0.8 meet at any size."""
    r = np.random.default_rng(3)
    draw = lambda n: r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, n, dtype=np.uint64)
    x, y = draw(200), draw(50)
    one, both, apart = similar.sums([x[:1]]), similar.sums([np.concatenate([x, y])]), similar.sums([x, y])
    assert set(np.unique(one)) == {-1.0, 1.0} and (both[0] == apart[0] + apart[1]).all()
    for same, own in ((4, 1), (8, 1), (40, 5), (160, 20), (800, 100)):
        sets = []
        for _ in range(200):
            h = draw(same + 2 * own)
            sets += [h[: same + own], np.concatenate([h[:same], h[same + own :]])] if own > 1 else [h[: same + own], h[:same]]
        bands = similar.surest(sets)
        assert (bands[::2] == bands[1::2]).any(axis=1).mean() >= 0.99 and (bands[::2] == np.roll(bands[1::2], 1, 0)).mean() < 1e-4


def test_repeated_lines_are_sketched_once(spark):
    """A line's sketch is one row a kind however often it occurs; the first place and all repeats are still known."""
    line = "a line of some seven words here"
    rows = [(i, f"{line}\n \n{'A ' * (i % 2)}{line}, own {i * i} {'xyz' * (i + 1)}") for i in range(12)] + [(20, " \n\t"), (21, None)]
    raw = line_dedup.raw_lines(table(spark, rows), "doc_id", "text")
    assert line_dedup.banded_lines(raw).groupBy("hash").agg(F.count(F.lit(1)).alias("k")).filter("k > 2").count() == 0
    got = {x.doc_id: x.text for x in line_dedup.fuzzy_line_dedup(table(spark, rows), whole=True).collect()}
    assert got[0] == rows[0][1] and all(line not in got[i].split("\n") for i in range(1, 12)) and got[20] == " \n\t" and got[21] is None


def test_runs_cut_a_text_once(spark):
    """The words of a text are found once, not for each of its runs."""
    r = random.Random(47)
    rows = [(0, ""), (1, "Ab  c"), (2, words(r, 90).upper()), (3, "a b c d e f a b c d e"), (4, words(r, 5))]
    frame = similar.runs(spark.createDataFrame(rows, "node long, line string"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == plan.count("regexp_replace(") == 1 and plan.count("translate(") == 1
    got = {x.node: x.runs for x in frame.collect()}
    for i, t in rows:
        w = t.lower().split()
        assert len(got[i]) == len(set(got[i])) == len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    long = spark.createDataFrame([(0, words(r, 20_000))], "node long, line string")
    began = time.time()
    assert similar.runs(long).select(F.size("runs").alias("n")).first().n == 19_996 and time.time() - began < 20


def test_no_pair_of_lines_is_compared_twice(spark, monkeypatch):
    """Pairs that were unlike in one turn, or in a small block, meet again in large ones but are not compared again."""
    r, seen = random.Random(53), []
    check = line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, held: seen.extend(tuple(sorted(x)) for x in pairs.collect()) or check(pairs, held))
    monkeypatch.setattr(line_dedup, "SMALL", 3)
    base, rows = words(r, 60).split(" "), []
    for k in range(40):
        w = list(base)
        for at in r.sample(range(60), r.randint(6, 16)):
            w[at] = words(r, 1)
        rows.append((k, " ".join(w)))
    got = {x.doc_id for x in line_dedup.fuzzy_line_dedup(table(spark, rows), whole=True).filter("text <> ''").collect()}
    assert len(seen) == len(set(seen)) >= 5 and 0 in got


def test_near_duplicates_that_no_band_brings_together(spark):
    """Texts of similarity 0.8 that share none of 128 bands are still one group, and so is every pair of sets of that similarity."""
    import corpus_pipeline

    pairs = [("edf ca beb cdd hgbeaf cd fagdeb ece", "dcccfe"), ("hgegc gdag bac efabd ade ahaa gddg abhdd", "eg")]
    sets = [[np.unique(np.concatenate(list(simhash.shingle_hashes(t, 5)))) for t in (a, f"{a} {b}")] for a, b in pairs]
    assert not any((similar.surest(x)[0] == similar.surest(x)[1]).any() for x in sets)
    rows = [(2 * k + j, a if j == 0 else f"{a} {b}") for k, (a, b) in enumerate(pairs) for j in (0, 1)]
    assert {x.doc_id for x in corpus_pipeline.near_duplicate_stage(spark, table(spark, rows), "").collect()} == {0, 2}
    r = np.random.default_rng(8)
    counts = r.integers(0, 5, similar.COUNTERS).astype(np.int32)
    for same, own in ((0, 1), (1, 0), (4, 1), (5, 1), (8, 2), (16, 4), (40, 10), (41, 10), (400, 100)):
        for _ in range(50):
            h = r.integers(-(1 << 62), 1 << 62, same + own)
            for a, b in ((h, h[:same]), (h[: same + own // 2], np.concatenate([h[:same], h[same + own // 2 :]]))):
                if len(np.union1d(a, b)) and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                    assert set(similar.first_shingles(a, counts)) & set(similar.first_shingles(b, counts))


def test_near_duplicate_stage_judges_every_row(spark):
    """A near copy goes though its id has another text that stays; of repeated rows one stays; rows without an id are compared with each other."""
    import corpus_pipeline

    r = random.Random(61)
    one, two, three = (words(r, 60) for _ in range(3))
    rows = [(1, one), (2, one + " end"), (2, two), (3, three), (3, three), (None, one), (None, one + " end"), (None, None), (None, ""), (4, None)]
    got = corpus_pipeline.near_duplicate_stage(spark, table(spark, rows), "").collect()
    assert sorted((x.doc_id, x.text) for x in got if x.doc_id is not None) == [(1, one), (2, two), (3, three), (4, None)]
    none = [x.text or "" for x in got if x.doc_id is None]
    assert len(none) == 2 and "" in none and one in none[0] + none[1]
