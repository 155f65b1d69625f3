"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 bits.  Bits that go together are put in one of ``m`` parts
of 16 bits.  If two fingerprints differ in at most ``t`` bits, then for any
thresholds with sum ``t - m + 1`` (each -1 or more, -1 meaning "not probed")
some part differs in at most its own threshold.  A dynamic programme picks for
every fingerprint the thresholds with the fewest estimated candidates, so parts
whose value is common are left out.  Candidates are verified on all 64 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlane.llm.common import components, free_name, remove, written

BITS = 64
PARTS = 4
WIDTH = BITS // PARTS
#: Members of a bucket that one task compares with its probes at a time.
CHUNK = 2048
_ONE = np.uint64(1)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of one text (A-Z lower-cased).

    Words are runs without ASCII white space; a text with fewer words than a
    shingle has one shingle, one without words has fingerprint 0.  A bit is set
    if it is set in more than half the shingle hashes, repeats included.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    begins = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    ends = (begins + sizes)[words - 1:]
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(BITS, np.int64), len(ends)
    for i in range(0, total, 65536):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins[i:i + 65536].tolist(), ends[i:i + 65536].tolist())], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > total).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): one row per input row, the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = np.array([fingerprint(x, words, seed) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, fp long")


# -- parts and thresholds ----------------------------------------------------
def bit_products(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each pair of bits is set together."""
    def run(batches):
        total, count = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            for i in range(0, len(bits), 1 << 20):
                total += (bits[i:i + (1 << 20)].T @ bits[i:i + (1 << 20)]).astype(np.int64)
            count += len(bits)
        if count:
            k = np.arange(BITS * BITS + 1)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.append(total.ravel(), count))], names=["k", "n"])

    rows = prints.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BITS * BITS + 1, np.int64)
    out[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def correlated_parts(count: int, together: np.ndarray) -> list[list[int]]:
    """Bits of each part: a part grows by the bit most correlated with it."""
    rate = together / max(count, 1)
    share = np.diag(rate)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    link = np.abs(rate - np.outer(share, share)) / np.outer(spread, spread)
    free, parts = set(range(BITS)), []
    while free:
        left = sorted(free)
        first = left[int(np.argmax([link[b, left].sum() for b in left]))]
        part = [first]
        free.remove(first)
        while len(part) < WIDTH:
            left = sorted(free)
            part.append(left[int(np.argmax(link[np.ix_(left, part)].sum(axis=1)))])
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def part_values(fp: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(parts), len(fp)), np.int64)
    for i, part in enumerate(parts):
        for k, bit in enumerate(part):
            out[i] |= ((fp >> np.uint64(bit)) & _ONE).astype(np.int64) << k
    return out


def part_counts(prints: DataFrame, parts: list[list[int]]) -> np.ndarray:
    """How many fingerprints have each value of each part (4 x 65,536 counts)."""
    def run(batches):
        total = np.zeros((PARTS, 1 << WIDTH), np.int64)
        for batch in batches:
            values = part_values(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), parts)
            for i in range(PARTS):
                total[i] += np.bincount(values[i], minlength=1 << WIDTH)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["k", "n"])

    rows = prints.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(PARTS << WIDTH, np.int64)
    out[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(PARTS, 1 << WIDTH)


def flips(most: int) -> list[np.ndarray]:
    """Masks of a part with exactly 0, 1, ... ``most`` bits set."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), k)], np.int64) for k in range(most + 1)]


def within(counts: np.ndarray, most: int) -> np.ndarray:
    """[threshold + 1, part, value]: fingerprints within that many bits."""
    masks, at = flips(most), np.arange(1 << WIDTH)
    out = np.zeros((most + 2, PARTS, 1 << WIDTH), np.int64)
    for k, group in enumerate(masks):
        out[k + 1] = out[k]
        for mask in group.tolist():
            out[k + 1] += counts[:, at ^ mask]
    return out


def thresholds(values: np.ndarray, near: np.ndarray, bits: int) -> np.ndarray:
    """[part, fingerprint] thresholds of least estimated candidates.

    Dynamic programme over parts; the state is the budget spent so far, where a
    part with threshold h spends h + 1 and all spend ``bits + 1``.  A probe of
    an empty bucket costs a little, so that many probes are not free.
    """
    n, budget = values.shape[1], bits + 1
    masks = np.cumsum([len(g) for g in flips(bits)])
    cost = np.full((budget + 1, n), np.inf)
    cost[0] = 0
    picks = []
    for i in range(PARTS):
        own = [np.zeros(n)] + [near[h + 1, i, values[i]] + 0.5 * masks[h] for h in range(bits + 1)]
        after, pick = np.full((budget + 1, n), np.inf), np.zeros((budget + 1, n), np.int8)
        for spent in range(budget + 1):
            for use in range(spent + 1):
                total = cost[spent - use] + own[use]
                better = total < after[spent]
                after[spent][better], pick[spent][better] = total[better], use
        cost = after
        picks.append(pick)
    out, left, row = np.zeros((PARTS, n), np.int64), np.full(n, budget), np.arange(n)
    for i in reversed(range(PARTS)):
        use = picks[i][left, row]
        out[i], left = use - 1, left - use
    return out


def bucket_rows(prints: DataFrame, parts, counts: np.ndarray, bits: int) -> DataFrame:
    """(bucket, piece, probe, fp): members of every part, and the probes.

    A bucket of more than ``CHUNK`` members is dealt over pieces by hash; its
    probes go to every piece, so no task holds a whole common bucket.
    """
    near, masks = within(counts, bits), flips(bits)
    pieces = np.maximum(1, -(-counts // CHUNK))

    def run(batches):
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(whole), 4096):
                fp = whole[at:at + 4096]
                values = part_values(fp, parts)
                limits = thresholds(values, near, bits)
                spread = ((fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
                bucket, piece, probe, own = [], [], [], []
                for i in range(PARTS):
                    bucket.append((i << WIDTH) + values[i])
                    piece.append(spread % pieces[i, values[i]])
                    probe.append(np.zeros(len(fp), bool))
                    own.append(fp)
                    for k, group in enumerate(masks):
                        who = np.flatnonzero(limits[i] >= k)
                        to = (values[i][who][:, None] ^ group[None, :]).ravel()
                        who = np.repeat(who, len(group))
                        some = counts[i, to] > 0
                        to, who = to[some], who[some]
                        copies = pieces[i, to]
                        bucket.append(np.repeat((i << WIDTH) + to, copies))
                        piece.append(np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies))
                        probe.append(np.ones(copies.sum(), bool))
                        own.append(fp[np.repeat(who, copies)])
                cols = [np.concatenate(x) for x in (bucket, piece, probe, own)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int32)), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3].view(np.int64))], names=["bucket", "piece", "probe", "fp"])

    return prints.select("fp").mapInArrow(run, "bucket int, piece int, probe boolean, fp long")


# -- verification --------------------------------------------------------------
def verified(rows: DataFrame, bits: int, width: int | None = None) -> DataFrame:
    """(a, b): edges that join what is linked inside each bucket.

    Rows of a bucket piece arrive together, members first.  Probes are compared
    with the members in blocks; of the pairs that pass only a spanning set of
    edges leaves, so a dense bucket of n rows gives about n rows and not n^2.
    """
    def run(batches):
        state = _Piece(bits)
        for batch in batches:
            bucket, piece, probe = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(piece) != 0)) + 1
            starts = np.concatenate([[0], cuts, [len(fp)]]).tolist()
            for s, e in zip(starts[:-1], starts[1:]):
                key = (int(bucket[s]), int(piece[s]))
                if key != state.key:
                    state.begin(key)
                first = s + int(np.searchsorted(probe[s:e], True))
                state.add(fp[s:first])
                state.compare(fp[first:e])
            yield from state.take(1 << 16)
        state.begin(None)
        yield from state.take(1)

    ordered = rows.repartition("bucket", "piece") if width is None else rows.repartition(width, "bucket", "piece")
    return ordered.sortWithinPartitions("bucket", "piece", "probe", "fp").mapInArrow(run, "a long, b long")


class _Piece:
    """Members of one bucket piece with the least fingerprint known to be linked."""

    def __init__(self, bits: int):
        self.bits, self.key, self.found, self.size = bits, None, [], 0
        self.members = self.labels = np.zeros(0, np.uint64)

    def begin(self, key) -> None:
        self._keep(self.members, self.labels)
        self.key = key
        self.members = self.labels = np.zeros(0, np.uint64)

    def add(self, fp: np.ndarray) -> None:
        if len(fp):
            self.members, self.labels = np.concatenate([self.members, fp]), np.concatenate([self.labels, fp])

    def compare(self, probes: np.ndarray) -> None:
        if not len(self.members) or not len(probes):
            return
        step = max(1, (1 << 20) // len(self.members))
        for i in range(0, len(probes), step):
            block = probes[i:i + step]
            near = np.bitwise_count(block[:, None] ^ self.members[None, :]) <= self.bits
            rows, cols = near.any(axis=1), near.any(axis=0)
            if near.sum() <= len(block) and np.array_equal(block[rows], self.members[near.argmax(axis=1)[rows]]):
                continue  # probes that met themselves only
            block, near, cols = block[rows], near[np.ix_(rows, cols)], np.flatnonzero(cols)
            before = own = self.labels[cols]
            top = np.uint64(0xFFFFFFFFFFFFFFFF)
            while True:
                of_probe = np.minimum(np.where(near, own[None, :], top).min(axis=1), block)
                of_member = np.minimum(own, np.where(near, of_probe[:, None], top).min(axis=0))
                if np.array_equal(of_member, own):
                    break
                own = of_member
            self._keep(block, of_probe)
            self._keep(before, own)
            self.labels[cols] = own

    def _keep(self, a: np.ndarray, b: np.ndarray) -> None:
        differ = a != b
        if differ.any():
            self.found.append(np.stack([a[differ], b[differ]]))
            self.size += int(differ.sum())

    def take(self, least: int):
        if self.size >= least and self.found:
            pair = np.unique(np.concatenate(self.found, axis=1), axis=1)
            self.found, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64))], names=["a", "b"])


# -- the operator ----------------------------------------------------------------
def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: id, fp (signed long), component_id.

    Rows are linked if their fingerprints differ in at most ``bits`` bits;
    component_id is the smallest id that links reach, the row's own included.
    A null or empty text (or one of white space) has fingerprint 0 and links
    like any other.  Rows with a null id keep their fingerprint, lend no id to
    a component, and have a null component_id only if every row of it has a
    null id.  Repeated ids are kept as rows.  An empty table gives no rows;
    other columns are not read.
    """
    if not 0 <= bits <= 3:
        raise ValueError("0 to 3 differing bits are supported")
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} must be an integer column")
    rows = written(fingerprints(docs, id_col, text_col, words, seed))
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("first")))
    count, together = bit_products(prints)
    parts = correlated_parts(count, together)
    edges = verified(bucket_rows(prints, parts, part_counts(prints, parts), bits), bits)
    roots = components(edges)
    named = written(prints.join(roots, prints["fp"] == roots["node"], "left")
                    .select("fp", "first", F.coalesce("component", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = written(named.join(least, "root").select("fp", "component_id"))
    remove(docs.sparkSession, prints, named)
    return rows.join(names, "fp").select("id", "fp", "component_id")


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows of a group that do not have its smallest id.

    Columns are unchanged.  Rows with a null id stay.  Rows that repeat an id
    stay or go together.
    """
    groups = simhash_groups(docs, id_col, text_col, **options)
    name = free_name(docs, "gone_id")
    gone = groups.filter("id <> component_id").select(F.col("id").alias(name)).distinct()
    return docs.join(written(gone), F.col(id_col) == F.col(name), "left_anti")
