"""Packing with more sources than queues of their own."""

import os
import sys
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest  # noqa: E402
from cases import SCHEMA  # noqa: E402

from outlane.llm import packing  # noqa: E402
from outlane.llm.queries import BYTE_BPE  # noqa: E402


def rows(sources, docs, words=20):
    return [(1000 * s + d, "word " * words, "en", name, 1) for s, name in enumerate(sources) for d in range(docs)]


def shares(pieces, sources, upto):
    """Tokens of each source in the first ``upto`` sequences, and all of them."""
    first, every = Counter(), Counter()
    for p in pieces:
        n = len(p.ids) // 4
        every[sources[p.id // 1000]] += n
        if p.sequence_id < upto:
            first[sources[p.id // 1000]] += n
    return first, every


def whole(pieces, window):
    """Sequences are gapless and full but for the last; documents are whole."""
    at, of = defaultdict(list), defaultdict(list)
    for p in pieces:
        at[p.sequence_id].append((p.offset, len(p.ids) // 4))
        of[p.id].append((p.start, len(p.ids) // 4, p.doc_tokens))
    for found in at.values():
        end = 0
        for begin, n in sorted(found):
            assert begin == end
            end += n
    assert sorted(at) == list(range(len(at))) and all(sum(n for _, n in v) == window for k, v in at.items() if k < len(at) - 1)
    for parts in of.values():
        assert sum(n for _, n, _ in parts) == parts[0][2]


def test_targets_of_sources_without_a_queue(spark):
    """Eight sources, three queues: the fourth and later keep their own targets."""
    sources = [f"s{i}" for i in range(8)]
    targets = {"s0": 10.0, "s1": 1.0, "s2": 1.0, "s3": 1.0, "s4": 1.0, "s5": 2.0, "s6": 1.0}
    pieces = packing.packed(spark.createDataFrame(rows(sources, 60), SCHEMA), BYTE_BPE, window=128, targets=targets, queues=3).collect()
    whole(pieces, 128)
    first, every = shares(pieces, sources, 15)
    for name, weight in targets.items():
        assert first[name] / sum(first.values()) == pytest.approx(weight / 17, abs=0.03), name
    assert first["s7"] == 0 and len(set(every.values())) == 1


@pytest.mark.parametrize("targets", [None, "rising"])
def test_hundreds_of_sources(spark, targets):
    sources = [f"host{i}" for i in range(300)] + [packing.SHARED]
    given = None if targets is None else {name: 1.0 + i % 5 for i, name in enumerate(sources)}
    pieces = packing.packed(spark.createDataFrame(rows(sources, 6, 4), SCHEMA).repartition(3), BYTE_BPE, window=64, targets=given).collect()
    whole(pieces, 64)
    last = max(p.sequence_id for p in pieces)
    first, every = shares(pieces, sources, last // 4)
    assert set(every) == set(sources)
    by = Counter()
    for i, name in enumerate(sources):
        by[1 if given is None else given[name]] += first[name]
    tail = sum(first[x] for x in sources[255:])
    assert tail > 0
    if given is not None:  # 60 sources of each weight
        assert all(by[w] / sum(by.values()) == pytest.approx(w / 15, abs=0.03) for w in (1.0, 2.0, 3.0, 4.0, 5.0))


def test_empty_and_single_source(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA), BYTE_BPE, queues=2, targets={"a": 1.0}).count() == 0
    docs = spark.createDataFrame(rows(["only"], 3) + [(5, None, None, None, None)], SCHEMA)
    pieces = packing.packed(docs, BYTE_BPE, window=16, queues=1).collect()
    assert {p.id for p in pieces} == {0, 1, 2, 5}
