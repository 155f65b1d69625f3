"""Near copies at five-word similarity 0.8 and more, brute force beside it."""

import os
import random
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest  # noqa: E402
from cases import SCHEMA, Sets, documents, frame  # noqa: E402

from outlane.llm import shingle_dedup, simhash  # noqa: E402


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def near_copies(seed=1, bases=12, each=8):
    """Texts of 150 words with 0 to 7 of them changed."""
    rng, out = random.Random(seed), []
    for b in range(bases):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(each):
            words = list(base)
            for _ in range(rng.randrange(8)):
                words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            out.append((5000 + len(out), " ".join(words), "en", "src0", 1))
    return out


def brute(rows):
    own, sets = [shingles(r[1]) for r in rows], Sets()
    for i, x in enumerate(own):
        for j in range(i + 1):
            both = len(x & own[j])
            if x == own[j] or both and both / (len(x) + len(own[j]) - both) >= 0.8:
                sets.join(i, j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[sets.find(i)].append(r[0])
    return [(r[0], min(ids[sets.find(i)], default=None)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("piece", [2, 7, 2048])
def test_groups_of_the_stage(spark, piece, monkeypatch):
    monkeypatch.setattr(shingle_dedup, "PIECE", piece)
    rows = documents() + near_copies()
    got = [(r.id, r.component_id) for r in shingle_dedup.shingle_groups(frame(spark, rows)).collect()]
    order = lambda x: sorted(x, key=lambda r: tuple((v is None, v or 0) for v in r))
    assert order(got) == order(brute(rows))
    assert shingle_dedup.shingle_groups(frame(spark, rows).limit(0)).count() == 0


def test_stage_removes_copies_that_differ_in_many_bits(spark):
    import corpus_pipeline

    rows = near_copies()
    want = {i for i, first in brute(rows) if i == first}
    prints = {r[0]: simhash.fingerprint(r[1]) for r in rows}
    assert any(bin(prints[i] ^ prints[first]).count("1") > 3 for i, first in brute(rows))
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == want
