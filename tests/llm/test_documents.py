"""Operators on documents against brute-force versions, awkward cases included."""

import hashlib
import os
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import SCHEMA, Sets, documents, frame  # noqa: E402

from outlane.llm import bloom_dedup, language, line_dedup, packing, pair_bpe, simhash, token_files  # noqa: E402
from outlane.llm.queries import BYTE_BPE, WORD_BPE  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, (bool, int)) else (x is None, "", x) for x in r))


@pytest.fixture(scope="module")
def docs():
    return documents()


def library(path, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


# -- exact dedup ------------------------------------------------------------------
def test_exact_groups(spark, docs):
    got = bloom_dedup.exact_groups(frame(spark)).collect()
    groups = defaultdict(list)
    for r in docs:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).digest()) for i in ids]
    assert plain((r.id, r.keep_id, r.group_size, r.kept, bytes(r.sha)) for r in got) == plain(want)


def test_exact_groups_with_a_full_filter(spark):
    """A filter that is far too small changes nothing."""
    rows = [(i, f"text {i // 2 if i < 40 else i}", None, None, None) for i in range(4000)]
    got = bloom_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA), most_bits=1).collect()
    assert sum(r.group_size == 2 for r in got) == 40 and sum(r.kept for r in got) == 3980


def test_repeat_filter_lets_single_rows_through(spark):
    rows = bloom_dedup.hashed(spark.createDataFrame([(i, f"t{i % 1990}", None, None, None) for i in range(2000)], SCHEMA))
    bits = bloom_dedup.repeat_filter(rows, bloom_dedup.SEGMENT)
    assert 20 <= np.unpackbits(bits).sum() <= 60


# -- line dedup ---------------------------------------------------------------------
def test_line_dedup(spark, docs):
    got = line_dedup.site_line_dedup(frame(spark)).collect()
    pages, has = Counter(), defaultdict(Counter)
    for r in docs:
        site = r[3] or ""
        pages[site] += 1
        has[site].update(set((r[1] or "").split("\n")))
    want = []
    for r in docs:
        site, lines = r[3] or "", (r[1] or "").split("\n")
        kept = [x for x in lines if not x.strip(" ") or has[site][x] < line_dedup.LEAST_PAGES or has[site][x] <= line_dedup.RATIO * pages[site]]
        want.append((r[0], None if r[1] is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert plain((r.doc_id, r.text, r.lines_before, r.lines_dropped) for r in got) == plain(want)
    assert any(x[3] for x in want) and got[0].id == "x"


# -- simhash -----------------------------------------------------------------------------
def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    count = [0] * 64
    for h in (xxhash.xxh64_intdigest(s, seed=42) for s in shingles):
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def test_simhash_groups(spark, docs):
    got = simhash.simhash_groups(frame(spark)).collect()
    prints, sets = [brute_print(r[1]) for r in docs], Sets()
    for i in range(len(docs)):
        for j in range(i + 1):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                sets.join(i, j)
    least = defaultdict(list)
    for i, r in enumerate(docs):
        if r[0] is not None:
            least[sets.find(i)].append(r[0])
    want = [(r[0], np.uint64(prints[i]).astype(np.int64).item(), min(least[sets.find(i)], default=None)) for i, r in enumerate(docs)]
    assert plain((r.id, r.fp, r.component_id) for r in got) == plain(want)


def ball(seed, centres, each):
    """Fingerprints around a few centres: dense groups and chains."""
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 2**63, centres, dtype=np.uint64):
        x = c
        for _ in range(each):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            y = (c if rng.random() < 0.7 else x)
            for b in flips:
                y = y ^ np.uint64(1 << int(b))
            x = y
            out.append(y)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_linked_fingerprints(spark, bits, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)  # common buckets are split
    prints = ball(bits, 6, 150)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long").repartition(3)
    count, together = simhash.bit_products(df)
    parts = simhash.correlated_parts(count, together)
    assert sorted(b for p in parts for b in p) == list(range(64)) and {len(p) for p in parts} == {16}
    rows = simhash.bucket_rows(df, parts, simhash.part_counts(df, parts), bits)
    from outlane.llm.common import components
    edges = simhash.verified(rows, bits)
    assert edges.count() < 20 * len(prints)
    got = {int(np.int64(r.node).view(np.uint64)): int(np.int64(r.component).view(np.uint64)) for r in components(edges).collect()}
    sets = Sets()
    for i, x in enumerate(prints.tolist()):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= bits).tolist():
            sets.join(x, prints[j].item())
    mine = defaultdict(set)
    for x in prints.tolist():
        mine[got.get(x, x)].add(x)
    want = defaultdict(set)
    for x in prints.tolist():
        want[sets.find(x)].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_thresholds_spend_the_budget():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 16, (4, 500))
    counts = rng.integers(0, 50, (4, 1 << 16))
    counts[1, values[1]] = 10**6  # a common part is not probed
    picked = simhash.thresholds(values, simhash.within(counts, 3), 3)
    assert ((picked + 1).sum(axis=0) == 4).all() and (picked[1] == -1).all() and picked.min() == -1


# -- tokenizers ------------------------------------------------------------------------
def test_pair_bpe_and_decoding(spark, docs):
    tokenizer, want = library(WORD_BPE, [r[1] for r in docs])
    got = pair_bpe.coded(frame(spark), WORD_BPE).collect()
    expected = [(r[0], len(x), np.array(x, "<u4").tobytes(), tokenizer.decode(x, skip_special_tokens=False)) for r, x in zip(docs, want)]
    assert plain((r.id, r.n_tokens, bytes(r.ids), r.decoded) for r in got) == plain(expected)


def test_pair_bpe_of_strange_texts():
    rng = np.random.default_rng(1)
    letters = ["a", "b", "the", "A", " ", "  ", "\n", "'s", "'", "1", "\u00e9", "e\u0301", "\u4e2d", "\u00df", "\U0001f600", ".", "<|endoftext|>", "\u0130", "\x85", "\u2028", "-", "\x00", "aaaa"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 25))) for _ in range(3000)]
    import pyarrow as pa
    _, want = library(WORD_BPE, texts)
    ids, counts = pair_bpe.encoder(WORD_BPE)[1].encode(pa.array(texts))
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    from outlane.llm.tokens import library_table
    for path, kind in ((WORD_BPE, "word"), (BYTE_BPE, "byte")):
        _, want = library(path, texts)
        ids, counts = library_table(path, kind).encode(pa.array(texts))
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_token_files(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 700)
    _, want = library(WORD_BPE, [r[1] for r in docs])
    token_files.write_token_files(frame(spark), str(tmp_path / "t"), WORD_BPE, "word", 1)
    got = token_files.read_token_files(spark, str(tmp_path / "t")).collect()
    rows = sorted(((r[0] is not None, r[0] or 0, len(x), np.array([*x, 1], "<u4").tobytes()) for r, x in zip(docs, want)), key=lambda r: r)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])[:-1]]).tolist()
    ids = [r.id for r in ordered]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert sorted((r.id is not None, r.id or 0, r.n_tokens - 1, bytes(r.ids)) for r in ordered) == rows


def test_variable_length_coding():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 1001):
        values = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 33, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_files.pack(values)
        assert len(control) == -(-n // 4) and (token_files.unpack(control, data, n) == values).all()
    assert len(token_files.pack(np.arange(256))[1]) == 256


# -- packing ---------------------------------------------------------------------------
def check_pieces(pieces, want, window):
    """Every id once, in order; sequences full and gapless."""
    by_row = defaultdict(list)
    for p in pieces:
        by_row[(p.id, p.doc_tokens)].append(p)
    tokens = Counter()
    for doc_id, ids in want:
        tokens[(doc_id, len(ids))] += len(ids)
    assert {k: sum(len(p.ids) // 4 for p in v) for k, v in by_row.items()} == dict(tokens)
    seqs = defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append((p.offset, len(p.ids) // 4))
    assert sorted(seqs) == list(range(len(seqs)))
    for k, parts in seqs.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == window or (k == len(seqs) - 1 and at <= window)


@pytest.mark.parametrize("targets", [None, {"src0": 3, "src1": 1}])
def test_packing(spark, docs, targets):
    _, encoded = library(BYTE_BPE, [r[1] for r in docs])
    want = [(r[0], [*x, 0]) for r, x in zip(docs, encoded)]
    pieces = packing.packed(frame(spark), BYTE_BPE, window=128, targets=targets).collect()
    check_pieces(pieces, want, 128)
    unique = {d: ids for d, ids in want if d is not None and d != 5}
    for p in pieces:
        if p.id in unique:
            assert bytes(p.ids) == np.array(unique[p.id][p.start:p.start + len(p.ids) // 4], "<u4").tobytes()
    shared = packing.packed(frame(spark), BYTE_BPE, window=128, queues=2).collect()
    check_pieces(shared, want, 128)
    whole = packing.sequences(packing.packed(frame(spark), BYTE_BPE, window=128), 128).collect()
    assert sum(r.n_tokens for r in whole) == sum(len(x) for _, x in want)
    assert all(len(r.ids) == 512 or r.n_tokens & (r.n_tokens - 1) == 0 for r in whole)


def test_windows_hold_target_shares():
    totals = {"a": 70_000, "b": 25_000, "c": 4_990, "d": 10}
    plan = packing.schedule(totals, 100)
    names = plan.names
    queue = np.arange(4)
    run, start, length, sequence, offset = packing.place(plan, queue, np.zeros(4, np.int64), np.array([totals[n] for n in names]))
    share = np.zeros((sequence.max() + 1, 4))
    np.add.at(share, (sequence, run), length)
    assert (share.sum(axis=1) == 100).all()
    goal = 100 * np.array([totals[n] for n in names]) / 100_000
    assert np.abs(share - goal).max() <= 4
    assert np.abs(np.cumsum(share, axis=0) - np.arange(1, len(share) + 1)[:, None] * goal).max() <= 5  # deficits carry


def test_schedule_when_a_queue_runs_dry():
    plan = packing.schedule({"a": 10, "b": 1000, "z": 7}, 50, {"a": 1, "b": 1})
    assert plan.base[-1].tolist() == [10, 1000, 7] and len(plan.quanta) >= 3


# -- language --------------------------------------------------------------------------
def test_language_of_held_out_rows(spark):
    rows = documents(seed=8, n=400)
    df = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(df.filter("crc32(cast(doc_id as string)) % 4 <> 2"))
    got = language.identified(frame(spark, rows), model, to="found").select("doc_id", "text", "lang", "found.pred", "found.score").collect()
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang and r.doc_id < 400]
    assert len(held) > 50 and np.mean([r.pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert r.pred == "und" and r.score == 0
        else:
            assert r.pred in ("de", "en", "fr")


def test_kernel_is_the_stated_one():
    texts = [language.folded(x) for x in ("The thing", "a thin king", "xyz", "")]
    kernel = language.Kernel(texts[:2])
    grams = lambda x, n: {x[i:i + n] for i in range(len(x) - n + 1)}
    for row, x in enumerate(texts):
        for col, z in enumerate(texts[:2]):
            want = 0
            for n in language.ORDERS:
                known = grams(texts[0], n) | grams(texts[1], n)
                a, b = grams(x, n) & known, grams(z, n)
                want += len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1)) / len(language.ORDERS)
            assert abs(kernel.values(texts)[row, col] - want) < 1e-5


def test_long_texts_are_whole(monkeypatch):
    kernel = language.Kernel([b" abc def "])
    text = b" " + b"zz " * 3000 + b"abc "
    whole = kernel.values([text])
    monkeypatch.setattr(language, "_SLICE", 64)
    assert np.allclose(kernel.values([text]), whole) and whole[0, 0] > 0


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None, None, None)], SCHEMA)
    assert [tuple(r.language) for r in language.identified(df, language.fit(df)).collect()] == [("und", 0.0)]


# -- empty tables ------------------------------------------------------------------------
def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    token_files.write_token_files(none, str(tmp_path / "e"), WORD_BPE)
    model = language.fit(none)
    for df in (bloom_dedup.exact_groups(none), line_dedup.site_line_dedup(none), simhash.simhash_groups(none), simhash.near_duplicates_removed(none), pair_bpe.coded(none, WORD_BPE),
               packing.packed(none, BYTE_BPE), token_files.read_token_files(spark, str(tmp_path / "e")), language.identified(none, model)):
        assert df.count() == 0 and df.columns
