"""Benchmark decontamination by windows of words.

The windows of all benchmark items are a hash set that every task has: the words
of the benchmark with a number each, and the sorted hashes of all windows of
numbers.  A text becomes the numbers of its words; windows without a foreign word
are looked up by hash, and a hit is verified number by number.  What is hit is
marked, and the marked spans or the documents can be taken out.

The index is broadcast, so its size is checked first: a benchmark of more than
``MOST_BYTES`` of text is dealt over several indexes, which are applied one after
another, each adding its marks.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from outlane.llm.common import written
from outlane.llm.words import blocks, cut, word_bytes

WINDOW = 10
#: Bytes of benchmark text that one index holds.
MOST_BYTES = 32 << 20
#: Words are runs of digits, letters a-z and all that is not ASCII.
_INSIDE = word_bytes(bytes(set(range(128)) - set(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")))
MARKS = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<begin:bigint,end:bigint>>,rest:string>"
_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


class Windows(NamedTuple):
    """Distinct windows of one size, sorted by hash."""
    size: int
    hashes: np.ndarray
    numbers: np.ndarray  #: [window, word]
    edge: np.ndarray  #: items of window i are ``items[edge[i]:edge[i + 1]]``
    items: np.ndarray
    again: int  #: most windows of equal hash


class Index(NamedTuple):
    words: pa.Array
    names: list  #: id of each item as a string, None without id
    windows: list


def _hash(numbers: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of word numbers."""
    out = np.zeros(len(numbers), np.uint64)
    for k in range(numbers.shape[1]):
        out = (out ^ (numbers[:, k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def index(ids: list, texts: list, window: int = WINDOW) -> Index:
    """The hash set of all windows of some items.

    An item of fewer words than a window is one window, one without words none.
    """
    got = cut(pa.array(texts, pa.string()), _INSIDE)
    coded = got.words.dictionary_encode()
    numbers, count = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(got.text, minlength=len(texts))
    first = np.cumsum(count) - count
    out = []
    for size in sorted(set(np.minimum(count[count > 0], window).tolist())):
        of = np.flatnonzero(np.minimum(count, window) == size)
        many = count[of] - size + 1
        at = np.repeat(first[of] - np.cumsum(many) + many, many) + np.arange(many.sum())
        rows = numbers[at[:, None] + np.arange(size)]
        distinct, which = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.repeat(of, many)]), axis=1)
        hashes = _hash(distinct)
        order = np.argsort(hashes, kind="stable")
        place = np.argsort(order)
        pairs[0] = place[pairs[0]]
        pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
        edge = np.searchsorted(pairs[0], np.arange(len(distinct) + 1))
        again = int(np.unique(hashes, return_counts=True)[1].max())
        out.append(Windows(size, hashes[order], distinct[order], edge, pairs[1], again))
    return Index(coded.dictionary, [None if x is None else str(x) for x in ids], out)


def hits(numbers: np.ndarray, text: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(place, window): every occurrence of a window inside one text."""
    none = np.zeros(0, np.int64)
    size = windows.size
    if len(numbers) < size:
        return none, none
    foreign = np.concatenate([[0], np.cumsum(numbers < 0)])
    at = np.flatnonzero((foreign[size:] == foreign[:-size]) & (text[size - 1:] == text[:len(text) - size + 1]))
    places, found = [none], [none]
    for i in range(0, len(at), 1 << 18):
        block = at[i:i + (1 << 18)]
        rows = numbers[block[:, None] + np.arange(size)]
        hashes = _hash(rows)
        near = np.searchsorted(windows.hashes, hashes)
        for k in range(windows.again):
            to = np.minimum(near + k, len(windows.hashes) - 1)
            maybe = np.flatnonzero(windows.hashes[to] == hashes)
            same = maybe[(windows.numbers[to[maybe]] == rows[maybe]).all(axis=1)]  # the hit is verified word by word
            if k:
                same = same[near[same] + k < len(windows.hashes)]
            places.append(block[same])
            found.append(to[same])
    return np.concatenate(places), np.concatenate(found)


def _marks(texts: pa.Array, known: Index, before: list | None) -> list:
    """One record of marks per text; ``before`` are the marks of other indexes."""
    got = cut(texts, _INSIDE)
    numbers = pc.fill_null(pc.index_in(got.words, value_set=known.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    total = len(texts)
    n_words = np.bincount(got.text, minlength=total).tolist()
    edges, pairs = np.zeros(len(numbers) + 1, np.int64), []
    for windows in known.windows:
        place, window = hits(numbers, got.text, windows)
        edges += np.bincount(place, minlength=len(edges)) - np.bincount(place + windows.size, minlength=len(edges))
        if len(place):
            own = np.unique(got.text[place] * len(windows.hashes) + window)
            of, window = own // len(windows.hashes), own % len(windows.hashes)
            many = windows.edge[window + 1] - windows.edge[window]
            at = np.repeat(windows.edge[window] - np.cumsum(many) + many, many) + np.arange(many.sum())
            pairs.append(np.stack([np.repeat(of, many), windows.items[at]]))
    names = [set() for _ in range(total)]
    for of, item in (np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist() if pairs else []):
        if known.names[item] is not None:
            names[of].add(known.names[item])
    covered = np.cumsum(edges)[:-1] > 0
    runs = [[] for _ in range(total)]
    inside = np.flatnonzero(covered)
    if len(inside):
        new = np.concatenate([[True], (np.diff(inside) != 1) | (np.diff(got.text[inside]) != 0)])
        begins, ends = inside[new], inside[np.concatenate([new[1:], [True]])]
        base = np.concatenate([[0], np.cumsum(np.bincount(got.text, minlength=total))])
        for of, a, b in zip(got.text[begins].tolist(), begins.tolist(), ends.tolist()):
            runs[of].append((a - int(base[of]), b - int(base[of]) + 1, int(got.starts[a] - got.origins[of]), int(got.ends[b] - got.origins[of])))
    out = []
    for of in range(total):
        if before is not None and (old := before[of])["spans"]:
            names[of] |= set(old["items"])
            runs[of] = _united(runs[of], [(x["from"], x["to"], x["begin"], x["end"]) for x in old["spans"]])
        out.append((n_words[of], sorted(names[of]), runs[of]))
    return out


def _united(left: list, right: list) -> list:
    """Union of two lists of runs (first word, word after, first byte, byte after)."""
    out = []
    for run in sorted(left + right):
        if out and run[0] <= out[-1][1]:
            if run[1] > out[-1][1]:
                out[-1] = (out[-1][0], run[1], out[-1][2], run[3])
        else:
            out.append(run)
    return out


def _rest(text: str | None, runs: list) -> str | None:
    if not runs:
        return text
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for _, _, begin, end in runs:
        out.append(data[at:begin])
        at = end
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


_WORK = "struct<n_words:bigint,items:array<string>,spans:array<struct<from:bigint,to:bigint,begin:bigint,end:bigint>>>"


def marked(docs: DataFrame, benchmark: DataFrame, into: str = "marks", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
           window: int = WINDOW, keep_text: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` with a column ``into`` of what is contaminated.

    It holds n_words, n_hit (words inside any occurrence of a window), items (ids
    of the items with occurring windows as strings, distinct, sorted), spans
    (bytes of the UTF-8 text from the first to the last hit word of each run) and
    rest (the text without the spans; null unless ``keep_text``).  Words are runs
    of digits, ASCII letters (lower-cased) and characters outside ASCII; a window
    is ``window`` words of an item in a row, or all words of a shorter item.

    A null text has no words and a null rest; an empty one no words.  Items that
    are null, empty or without words have no window; an item with a null id marks
    words and is not listed; rows that repeat an item id are one item.  Repeated
    documents are kept as rows, an empty table gives none, an empty benchmark
    hits nothing.  All other columns are kept as they are, whatever their names;
    only ``into`` must not be one of them.  Without ``keep_text`` the text column
    is dropped.
    """
    if into in docs.columns:
        raise ValueError(f"docs has a column {into}")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id_col).cast("string").alias("id"), F.coalesce(item_text_col, F.lit("")).alias("text"))
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most_bytes))
    at, names, now = docs.columns.index(text_col), docs.columns, docs
    for part in range(parts):
        some = items if parts == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        given = some.toPandas()  # at most about most_bytes
        shared = spark.sparkContext.broadcast(index([x if isinstance(x, str) else None for x in given["id"].tolist()], given["text"].tolist(), window))
        first, last = part == 0, part == parts - 1
        dropped = last and not keep_text

        def run(batches, shared=shared, first=first, last=last, dropped=dropped):
            for whole in batches:
                for batch in blocks(whole, at):
                    texts = batch.column(at)
                    found = _marks(texts, shared.value, None if first else batch.column(len(names)).to_pylist())
                    if last:
                        rest = [_rest(t, r) for t, (_, _, r) in zip(texts.to_pylist(), found)] if keep_text else [None] * len(found)
                        made = pa.array([{"n_words": n, "n_hit": sum(b - a for a, b, _, _ in r), "items": i, "spans": [{"begin": c, "end": d} for _, _, c, d in r], "rest": x}
                                         for (n, i, r), x in zip(found, rest)], pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN)), ("rest", pa.string())]))
                    else:
                        made = pa.array([{"n_words": n, "items": i, "spans": [{"from": a, "to": b, "begin": c, "end": d} for a, b, c, d in r]} for n, i, r in found],
                                        pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([(x, pa.int64()) for x in ("from", "to", "begin", "end")])))]))
                    carried = [c for k, c in enumerate(batch.columns[:len(names)]) if not (dropped and k == at)]
                    yield pa.RecordBatch.from_arrays([*carried, made], names=[*(x for k, x in enumerate(names) if not (dropped and k == at)), into])

        fields = [f for f in docs.schema.fields if not (dropped and f.name == text_col)]
        kind = spark.sql(f"SELECT CAST(NULL AS {MARKS if last else _WORK}) AS x").schema["x"].dataType
        now = now.mapInArrow(run, StructType([*fields, StructField(into, kind)]))
        if not last:
            now = written(now)
    return now


def _unused(docs: DataFrame) -> str:
    return f"marks_{uuid.uuid4().hex}"


def spans_removed(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the hit spans cut out of the texts; columns are unchanged."""
    into = _unused(docs)
    got = marked(docs, benchmark, into, text_col, **options)
    return got.withColumn(text_col, F.col(f"{into}.rest")).select(*docs.columns)


def documents_removed(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least_share: float = 0.0, **options) -> DataFrame:
    """``docs`` without those of whose words more than ``least_share`` are hit."""
    into = _unused(docs)
    got = marked(docs, benchmark, into, text_col, **options)
    return got.filter(F.col(f"{into}.n_hit") <= least_share * F.col(f"{into}.n_words")).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
h AS (SELECT doc_id, k, i, item_id FROM dw JOIN bw USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)"""
