"""Decontamination, Orchard clustering and collocations against brute force."""

import hashlib
import math
import os
import random
import re
import sys
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
import pytest  # noqa: E402
from cases import documents, frame  # noqa: E402

from outlane.llm import collocations, decontamination, key_filter, orchard, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
_UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
lower = lambda text: (text or "").translate(_UPPER)


# -- decontamination -------------------------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def leaky():
    """Documents with passages of items, and items of all sizes."""
    rng = random.Random(5)
    rows = documents()
    words = [f"t{rng.randrange(400)}" for _ in range(60)]
    items = [(1, " ".join(words[:30])), (2, ", ".join(words[20:45])), (3, "Subscribe to our news."), (4, ""), (5, None), (6, "café"), (None, " ".join(words[45:60])), (8, "..."), (9, "no such words anywhere here"),
             (1, " ".join(words[:30])), (10, "aa bb " * 8), (12, rows[7][1])]
    planted = ["x " + " ".join(words[3:17]).upper() + " y", "-".join(words[22:40]), " ".join(words[:60]), "aa bb " * 7, " ".join(words[44:56]), "CAFÉ cafés café", " ".join(words[0:9]) + ". " + words[9]]
    return rows + [(2000 + i, x, "en", "src0", 1) for i, x in enumerate(planted)], items


def brute_marks(text, items, window):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for name, item in items:
        own = WORD.findall(lower(item))
        size = min(window, len(own))
        wanted = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i:i + size]) in wanted:
                hit |= set(range(i, i + size))
                found |= {str(name)} if name is not None else set()
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("window, most", [(10, 1 << 20), (10, 200), (3, 400)])
def test_marks_against_brute_force(spark, window, most):
    rows, items = leaky()
    benchmark = spark.createDataFrame(items, ITEMS)
    got = decontamination.marked(frame(spark, rows), benchmark, window=window, most_bytes=most).select("doc_id", "text", "marks.*").collect()
    want = sorted((repr(r[0]), repr(r[1]), brute_marks(r[1], items, window)) for r in rows)
    assert sorted((repr(r.doc_id), repr(r.text), (r.n_words, r.n_hit, r["items"])) for r in got) == want
    assert sum(r.n_hit > 0 for r in got) > 5
    for r in got:
        data = (r.text or "").encode()
        cut = b"".join(data[a:b] for a, b in zip([0] + [s.end for s in r.spans], [s.begin for s in r.spans] + [len(data)]))
        assert r.rest == (None if r.text is None else cut.decode())
        hit = sum(len(WORD.findall(lower(data[s.begin:s.end].decode()))) for s in r.spans)
        assert hit == r.n_hit


def test_removal_keeps_columns_and_clean_texts(spark):
    rows, items = leaky()
    docs, benchmark = frame(spark, rows).selectExpr("*", "1 AS marks", "2 AS item_id"), spark.createDataFrame(items, ITEMS)
    clean = Counter((repr(r[0]), r[1]) for r in rows if not brute_marks(r[1], items, 10)[1])
    kept = decontamination.documents_removed(docs, benchmark)
    assert kept.schema == docs.schema and Counter((repr(r.doc_id), r.text) for r in kept.collect()) == clean
    cut = decontamination.spans_removed(docs, benchmark)
    assert cut.schema == docs.schema
    got = Counter((repr(r.doc_id), r.text) for r in cut.collect())
    assert sum(got.values()) == len(rows) and all(got[k] >= n for k, n in clean.items())
    with pytest.raises(ValueError):
        decontamination.marked(docs, benchmark)
    some = decontamination.documents_removed(docs, benchmark, least_share=0.5).count()
    assert sum(clean.values()) < some < len(rows)


def test_marks_of_empty_tables(spark):
    rows, items = leaky()
    benchmark = spark.createDataFrame(items, ITEMS)
    assert decontamination.marked(frame(spark, rows).limit(0), benchmark).count() == 0
    for none in (benchmark.limit(0), benchmark.filter("item_id in (4, 5, 8)")):
        assert decontamination.marked(frame(spark, rows), none).filter("marks.n_hit > 0 or size(marks.items) > 0").count() == 0


# -- clustering --------------------------------------------------------------------------
def brute_clusters(rows, count, rounds, size, scale=64, seed=1):
    kept = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:count]
    points = [p for _, p in start]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, p)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        points = [[sum(x[k] for (_, x), o in zip(kept, of) if o == c) // of.count(c) for k in range(size)] if c in of else p for c, p in enumerate(points)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return sorted((repr(i), c, d, inertia[c], sum(inertia.values()), points[c]) for i, c, d in found)


VECTORS = "vec_id bigint, embedding array<double>, cluster int, distance string"


@pytest.mark.parametrize("count, spread, many", [(16, 1.0, 90), (5, 0.05, 90), (200, 1.0, 90), (3, 1e5, 90), (3, 2e6, 6)])
def test_clusters_against_brute_force(spark, count, spread, many):
    rng = np.random.default_rng(int(count))
    size = 4
    centers = rng.normal(size=(6, size))
    rows = [(i, (spread * (centers[i % 6] + 0.2 * rng.normal(size=size))).tolist()) for i in range(many)]
    rows += [(i, [float(v) for v in rng.integers(-1, 2, size)]) for i in range(100, 100 + many // 2)]  # ties
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (500, None), (501, [1.0] * (size - 1)), (502, [1.0] * (size - 1) + [None]), (503, [float("nan")] * size), (504, [float("inf")] * size), (505, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(3)
    got = orchard.clustered(df, count=count, size=size).collect()
    assert sorted((repr(r.id), r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in got) == brute_clusters(rows, count, 3, size)
    assert orchard.clustered(df.limit(0), size=size).count() == orchard.clustered(df, size=99).count() == 0


def test_orchard_takes_fewer_distances_and_the_smallest_of_equal_ones():
    rng = np.random.default_rng(2)
    points = (100 * rng.normal(size=(64, 8))).astype(int)
    points[40] = points[7]
    found = orchard.Centroids(points.tolist())
    rows = (points[rng.integers(0, 64, 5000)] + rng.integers(-8, 9, (5000, 8))).astype(np.int64)
    best, far = found.nearest(rows)
    all_d = ((rows[:, None] - points[None]) ** 2).sum(axis=2)
    assert np.array_equal(best, all_d.argmin(axis=1)) and np.array_equal(far, all_d.min(axis=1))


# -- collocations ------------------------------------------------------------------------
def brute_phrases(rows, support, most, top, share=50):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = r[2] if r[2] is not None else "und"
        for piece in re.split("[.,;:!?\n-\r]", lower(r[1])):
            words = tuple(x for x in re.split("[ \t]+", piece) if x)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang][words[i:i + k]] += 1
    out = []
    for lang, own in f.items():
        good = {p: a for p, a in own.items() if len(p) > 1 and a >= support}
        longest = Counter()
        for p, a in good.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i:i + k]] = max(longest[p[i:i + k]], a)
        found = []
        for p, a in good.items():
            if 100 * longest[p] >= share * a:
                continue
            score, _, l, r = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def chatter(seed=8, n=150):
    rng = random.Random(seed)
    stock = ["new york", "new york city", "in the", "a b c d", "x", "y", "hot dog stand", "über été", "the the the", "City"]
    return documents() + [(i, "".join(rng.choice(stock) + rng.choice([" ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None, "und"]), "s", 1) for i in range(n)]


@pytest.mark.parametrize("support, most, top, shard", [(10, 3, 2000, 2_000_000), (10, 3, 5, 300), (4, 4, 2000, 900), (2, 2, 50, 50), (3, 3, 2000, 1)])
def test_phrases_against_brute_force(spark, support, most, top, shard):
    rows = chatter()
    got = collocations.collocations(frame(spark, rows), support=support, most_words=most, top=top, shard_words=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, support, most, top)


def test_phrases_when_the_filter_is_too_small(spark, monkeypatch):
    """A full filter lets everything through and changes nothing."""
    monkeypatch.setattr(key_filter, "built", lambda *a: key_filter.KeyFilter(np.full(key_filter.SEGMENT // 8, 255, np.uint8)))
    rows = chatter()
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), shard_words=500).collect())) == brute_phrases(rows, 10, 3, 2000)


def test_shards_use_proportional_support(spark):
    """With few shards a shard may stay below the support and emits less than it has."""
    docs = frame(spark, chatter()).repartition(2)
    coded = collocations.shards(docs, "text", "lang")
    filters = [key_filter.KeyFilter(np.full(key_filter.SEGMENT // 8, 255, np.uint8))]
    sizes = []
    for least in (1, 2):
        rows = collocations.local_frequent(coded.withColumn("least", collocations.F.lit(least)), filters, 2, 8).collect()
        assert all(int(h) >> 56 == r.segment for r in rows for h in np.frombuffer(r.hashes, "<u8"))
        sizes.append(sum(len(r.hashes) // 8 for r in rows))
    assert 0 < sizes[1] < sizes[0]


def test_exact_score_beyond_64_bits(spark):
    """1000000 * a * a passes 64 bits from a = 3.1 million."""
    rows = [("en", "a b", 2, 5_000_000), ("en", "a", 1, 7_000_003), ("en", "b", 1, 5_000_001)]
    known = spark.createDataFrame(rows, "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 99)], "lang string, n long")
    import unittest.mock as mock
    with mock.patch.object(collocations, "frequent_phrases", lambda *a, **b: (known, totals)):
        got = collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect()
    assert [(r.score, r.l, r.r) for r in got] == [(1_000_000 * 5_000_000**2 // (7_000_003 * 5_000_001), 7_000_003, 5_000_001)]


def test_phrases_of_empty_tables(spark):
    docs = frame(spark)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.filter("text is null or text = ''")).count() == 0


def test_filter_has_what_was_added(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 40_000, dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in keys.view(np.int64)], "h long").repartition(3)
    for most in (1 << 30, 1 << 19):
        got = key_filter.built(df, len(keys), most)
        assert got.has(keys).all() and got.has(rng.integers(0, 2**64, 40_000, dtype=np.uint64)).mean() < 0.05 + (most < 1 << 20)


def test_new_queries_have_sql():
    assert {"op11_decontamination", "op12_orchard", "op13_collocations"} <= set(queries.ORACLES)
