"""Frequent phrases and their binding, by SON partitioning.

A shard is a block of whole documents, encoded once: per language its words with
counts, and the stream of word numbers.  Level by level, a shard is mined
completely at its proportionally lowered support ceil(support * n_i / n): a phrase
below it in every shard is below the support overall, as the shards' shortfalls
add up to less than the support.  Shards emit hash and count of what is frequent
in them, packed by segments of the hash space; the union keeps a phrase if its
counts plus what other shards may hide reach the support.  The kept hashes become a bit filter of bounded size, with which
every shard counts its candidates, and only those counts travel as strings and
are added up exactly.  The filter of a level prunes the next: a phrase is mined
only if both phrases of one word less are candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlane.llm import key_filter
from outlane.llm.common import remove, written
from outlane.llm.words import blocks, cut, word_bytes

SUPPORT = 10
WORDS = 3
TOP = 2000
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1_000_000
#: Words of the corpus for each segment in which shards' hashes meet.
SEGMENT_WORDS = 1_000_000
#: Pieces that a language's ranking is dealt over before they meet.
DEALT = 64
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_INSIDE = word_bytes(_BREAKS + b" \t")
_BREAK = ~word_bytes(_BREAKS)


# -- shards ------------------------------------------------------------------------
def shards(docs: DataFrame, text_col: str, lang_col: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, words, counts, stream, n): a row per shard and language.

    The stream has 32 bits a word: twice its number, plus one if the next word
    follows in the same piece.
    """
    def flush(waiting):
        words = pa.concat_arrays([x[0] for x in waiting])
        joined, names = np.concatenate([x[1] for x in waiting]), pa.concat_arrays([x[2] for x in waiting]).dictionary_encode()
        coded = words.dictionary_encode()
        number, lang = coded.indices.to_numpy(zero_copy_only=False), names.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(lang, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(lang[order])) + 1):
            if len(own):
                distinct, at, counts = np.unique(number[own], return_inverse=True, return_counts=True)
                stream = (2 * at + joined[own]).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([
                    names.dictionary.take(pa.array(lang[own[:1]])), _lists(coded.dictionary.take(pa.array(distinct)).cast(pa.large_string()).cast(pa.string())),
                    _lists(pa.array(counts.astype(np.int64))), pa.array([stream], pa.binary()), pa.array([len(own)], pa.int64())], names=["lang", "words", "counts", "stream", "n"])

    def run(batches):
        waiting, held = [], 0
        for whole in batches:
            for batch in blocks(whole, 0):
                got = cut(batch.column(0), _INSIDE)
                if not len(got.starts):
                    continue
                breaks = np.cumsum(_BREAK[got.data], dtype=np.int64)
                joined = np.zeros(len(got.starts), bool)
                joined[:-1] = (np.diff(got.text) == 0) & (breaks[got.starts[1:]] == breaks[got.starts[:-1]])
                waiting.append((got.words, joined, pc.fill_null(batch.column(1), "und").take(pa.array(got.text))))
                held += len(joined)
                if held >= shard_words:
                    yield from flush(waiting)
                    waiting, held = [], 0
        if waiting:
            yield from flush(waiting)

    schema = "lang string, words array<string>, counts array<bigint>, stream binary, n long"
    return docs.select(F.col(text_col), F.col(lang_col).cast("string")).mapInArrow(run, schema)


def _lists(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


# -- phrases of one shard ------------------------------------------------------------
def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    seed, digest = xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass")), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x, seed) for x in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    out = (left ^ (left >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + right
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def levels(lang: str, words: pa.Array, stream: bytes, filters: list, most: int):
    """For 1 to ``most`` words: (word numbers, counts, hashes) of the distinct phrases
    of one shard whose parts of one word less pass the filters of their level."""
    data = np.frombuffer(stream, "<i4")
    number, joined = data >> 1, (data & 1).astype(bool)
    single = word_hashes(lang, words)
    of, hashes, rows = number, single, np.arange(len(words))[:, None]  # of[i]: which distinct phrase begins at word i
    yield rows, np.bincount(number, minlength=len(words)), hashes
    for level in range(2, most + 1):
        good = filters[level - 2].has(hashes)[of] & (of >= 0)
        at = np.flatnonzero(good[:-1] & good[1:] & joined[:-1])
        code, which, count = np.unique(of[at].astype(np.int64) * len(words) + number[at + level - 1], return_inverse=True, return_counts=True)
        left, last = code // len(words), code % len(words)
        rows, hashes = np.concatenate([rows[left], last[:, None]], axis=1), joined_hash(hashes[left], single[last])
        yield rows, count, hashes
        of = np.full(len(number), -1, np.int32)
        of[at] = which
        if not len(code):
            return


# -- one level ------------------------------------------------------------------------
def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].view(kind)


def local_frequent(rows: DataFrame, filters: list, size: int, bits: int) -> DataFrame:
    """(segment, hashes, counts): what each shard finds frequent, in order of hash.

    A row holds all of a shard's hashes with the same first ``bits``; a count is
    less what the shard might have hidden (its support less one).
    """
    shared, shift = rows.sparkSession.sparkContext.broadcast(filters), np.uint64(64 - bits)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words, stream, least = batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(2)[i].as_buffer(), batch.column(3)[i].as_py()
                found = list(levels(lang, words, stream, shared.value, size))
                if len(found) < size:
                    continue
                _, count, hashes = found[-1]
                keep = np.flatnonzero(count >= least)
                keep = keep[np.argsort(hashes[keep])]
                hashes, count = hashes[keep], count[keep] - (least - 1)
                if len(keep):
                    segment = (hashes >> shift).astype(np.int64)
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(keep)]])
                    yield pa.RecordBatch.from_arrays([pa.array(segment[edges[:-1]]), _packed(hashes, edges), _packed(count.astype(np.int64), edges)], names=["segment", "hashes", "counts"])

    return rows.select("lang", "words", "stream", "least").mapInArrow(run, "segment long, hashes binary, counts binary")


def union(local: DataFrame, least: int, bits: int) -> DataFrame:
    """(h): hashes whose counts in all shards add up to ``least`` and more."""
    shift = np.uint64(64 - bits)

    def run(batches):
        h, c, last = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, c = np.concatenate([h, _unpacked(batch.column(1), "<u8")]), np.concatenate([c, _unpacked(batch.column(2), "<i8")])
            last = np.uint64(batch.column(0)[batch.num_rows - 1].as_py())
            whole = (h >> shift) != last  # the last segment may go on
            yield kept(h[whole], c[whole])
            h, c = h[~whole], c[~whole]
        yield kept(h, c)

    def kept(h, c):
        order = np.argsort(h)
        h, c = h[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        total = np.add.reduceat(c, first) if len(h) else c
        return pa.RecordBatch.from_arrays([pa.array(h[first[total >= least]].view(np.int64))], names=["h"])

    return local.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "h long")


def counted(rows: DataFrame, filters: list) -> DataFrame:
    """(lang, phrase, size, f): counts of each shard's candidates, all of them."""
    shared = rows.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words, stream = batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(2)[i].as_buffer()
                for level, (numbers, count, hashes) in enumerate(levels(lang, words, stream, shared.value, len(filters))):
                    keep = shared.value[level].has(hashes)
                    numbers, count = numbers[keep], count[keep]
                    text = pc.binary_join_element_wise(*[words.take(pa.array(numbers[:, k])) for k in range(level + 1)], " ")
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(count), np.int64))), text, pa.array(np.full(len(count), level + 1, np.int32)), pa.array(count.astype(np.int64))], names=["lang", "phrase", "size", "f"])

    return rows.select("lang", "words", "stream").mapInArrow(run, "lang string, phrase string, size int, f long")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, most_words: int = WORDS, shard_words: int = SHARD_WORDS,
                     most_bits: int = key_filter.MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to ``most_words`` words that occur
    ``support`` times or more in their language, and (lang, n) of all languages.

    Phrases lie within pieces; occurrences may overlap.  A null language is
    ``und``, a null text empty.
    """
    coded = written(shards(docs, text_col, lang_col, shard_words))
    totals = coded.groupBy("lang").agg(F.sum("n").alias("all"))
    shares = coded.select("lang", "n").join(totals, "lang").withColumn("least", F.expr(f"({support} * n + all - 1) div all"))
    stats = written(shares.groupBy("lang").agg(F.first("all").alias("all"), F.sum(F.col("least") - 1).alias("slack")))
    words, slack = stats.agg(F.sum("all"), F.max("slack")).first()
    rows = coded.join(stats, "lang").withColumn("least", F.expr(f"({support} * n + all - 1) div all"))
    bits = max(8, ((words or 0) // SEGMENT_WORDS).bit_length())
    filters = []
    for size in range(1, most_words + 1):
        kept = written(union(local_frequent(rows, filters, size, bits), support - (slack or 0), bits))
        filters.append(key_filter.built(kept, kept.count(), most_bits))
        remove(docs.sparkSession, kept)
    known = written(counted(rows, filters).groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).filter(F.col("f") >= support))
    remove(docs.sparkSession, coded)
    return known, stats.select("lang", F.col("all").alias("n"))


# -- binding and ranking -----------------------------------------------------------------
def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, most_words: int = WORDS, top: int = TOP, share: int = 50, scale: int = 1_000_000, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best bound phrases.

    A candidate has 2 words or more and a = f(phrase) >= ``support``.  Of its cuts
    into l = f(first part) and r = f(rest) the one with the least score
    floor(scale * a * a / (l * r)) counts, the first of equal ones.  Candidates that
    lie inside a longer one with 100 * f(longer) >= ``share`` * a are dropped.  The
    ``top`` of each language by score, a and phrase are returned.

    A null language is ``und``, a null or empty text has no words; repeated rows
    count as often as they occur; an empty table gives no rows.  Other columns
    are not read.  Products are decimals of 38 digits, enough for counts to 10^16.
    """
    known, totals = frequent_phrases(docs, text_col, lang_col, support, most_words, **options)
    found = known.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("w"))
    counts = known.select("lang", "phrase", "f")
    cuts = found.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.col("size") - k), " ").alias("right")))).alias("c")).select("lang", "phrase", "a", "c.*")
    left, right = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    scored = scored.withColumn("up", (wide("a") * wide("a") * F.lit(scale).cast("decimal(7,0)")).cast("decimal(38,0)")).withColumn("down", (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("up div down"))
    least = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.*").drop("k")
    inner = found.filter("size > 2").select("lang", F.col("a").alias("longer"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda b: F.array_join(F.slice("w", b, s), " "))))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = least.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = kept.withColumn("piece", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM (
  SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 4) AS t(k))),
f AS MATERIALIZED (SELECT lang, k AS size, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 10),
n AS MATERIALIZED (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
parts AS MATERIALIZED (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
cuts AS MATERIALIZED (SELECT parts.lang, parts.phrase, a, k, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM parts JOIN f AS l ON l.lang = parts.lang AND l.phrase = lp JOIN f AS r ON r.lang = parts.lang AND r.phrase = rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best AS b LEFT JOIN longer AS x ON x.lang = b.lang AND x.phrase = b.phrase WHERE x.f IS NULL OR 100 * x.f < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000"""
