"""URL filtering with cascades of Bloom filters.

A rule is a host and the beginning of a path; its key is both as one string.
The keys a url could match are its host's suffixes with as much of its path as
some rule has.  Over all urls these make the key universe.  The first filter of
a cascade holds the listed keys, the second the universe's keys that pass the
first in error, the third the listed keys that pass the second, and so on until
nothing is wrong: for every key of the universe the level that says no tells
exactly whether it is listed, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlane.llm.common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """From lines like ``block example.com/en/``."""
    out = []
    for line in lines:
        verdict, key = line.split()
        host, slash, path = key.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {line}")
        out.append(Rule(verdict, host.lower(), slash + path))
    if len({r.key for r in out}) < len(out):
        raise ValueError("two rules have the same key")
    return out


# -- filters ---------------------------------------------------------------------
class Bloom:
    """A filter over keys given as two 64-bit hashes."""

    def __init__(self, keys: np.ndarray, rate: float, salt: int):
        rate = min(max(rate, 1e-12), 0.5)
        self.hashes = max(1, round(-math.log2(rate)))
        self.size = max(64, math.ceil(1.45 * len(keys) * -math.log2(rate)))
        self.salt = salt
        self.bits = np.zeros(self.size, bool)
        self.bits[self._places(keys).ravel()] = True

    def _places(self, keys: np.ndarray) -> np.ndarray:
        step = np.arange(1, self.hashes + 1, dtype=np.uint64)[:, None] + np.uint64(self.salt * 101)
        mixed = keys[:, 0][None, :] + step * (keys[:, 1] | np.uint64(1))[None, :]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(20)) % np.uint64(self.size)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.bits[self._places(keys)].all(axis=0)


class Cascade:
    """Exact membership for the listed keys and all keys of the universe."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Listed are keys that the first level refusing them has in an odd place
        (the second, fourth, ...), or that all of an odd number of levels pass."""
        out = np.zeros(len(keys), bool)
        left = np.arange(len(keys))
        for depth, level in enumerate(self.levels):
            passed = level.has(keys[left])
            out[left[~passed]] = depth % 2 == 1
            left = left[passed]
        out[left] = len(self.levels) % 2 == 1
        return out


def _hash_columns(key):
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("cascade"), key).alias("b"))


def _pairs(a, b) -> np.ndarray:
    return np.stack([np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64)], axis=1)


def build_cascade(listed: np.ndarray, universe: DataFrame, others: int) -> Cascade:
    """``universe`` has the distinct hashed keys (a, b) of the corpus.

    The first level's rate makes about 0.7 errors per listed key expected over
    the universe, so what comes to the driver is bounded by the list.  The bound
    is checked: a first level with more errors is made again with another salt.
    """
    if not len(listed):
        return Cascade([])
    own = {tuple(x) for x in listed.tolist()}
    most = 4 * len(listed) + 64
    for salt in range(20):
        first = Bloom(listed, len(listed) / (math.sqrt(2) * max(others, len(listed))), salt)

        def run(batches, first=first):
            for batch in batches:
                keys = _pairs(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield batch.filter(pa.array(first.has(keys)))

        passed = universe.select("a", "b").mapInArrow(run, "a long, b long").limit(most + len(listed) + 1).collect()
        wrong = [x for x in map(tuple, _pairs([r[0] for r in passed], [r[1] for r in passed]).tolist()) if x not in own]
        if len(wrong) <= most:
            break
    else:
        raise RuntimeError("the first level of the cascade keeps failing")
    levels, held, against = [first], np.array(sorted(wrong), np.uint64).reshape(-1, 2), listed
    while len(held):
        if len(levels) > 60:
            raise RuntimeError("two keys have the same hashes")
        levels.append(Bloom(held, 0.5, len(levels) + 1))
        held, against = against[levels[-1].has(against)], held
    return Cascade(levels)


# -- urls ------------------------------------------------------------------------------
def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` (A-Z lower-cased) and ``path`` in front."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER)
    return pages.select(host.alias("__host"), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1).alias("__path"), "*")


def candidates(rules: list[Rule]):
    """Array column of the keys that a url could match, longest first."""
    labels = F.split("__host", r"\.", -1)
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    keys = [F.when((F.size(labels) >= n) & (F.char_length("__path") >= size) & (F.col("__host") != ""),
                   F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring("__path", 1, size))) for n, size in shapes]
    found = F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")
    return F.transform(F.reverse(F.array_sort(F.transform(found, lambda k: F.struct(F.char_length(k).alias("n"), k.alias("k"))))), lambda x: x["k"])


def filtered(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict for every row of ``pages``.

    Of the rules that fit, the one with the longest key decides; a url that no
    listed key fits is allowed.  A null url, or one without ``://``, has an
    empty host and path and fits no rule.  Rows repeat as given; an empty table
    gives no rows; other columns are not read.  The rules are the caller's list
    and their filters a few bytes per rule; they alone are sent to the tasks.
    """
    urls = with_parts(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")), "__url").select("__id", "__host", "__path", candidates(rules).alias("__keys"))
    universe = written(urls.select(F.explode("__keys").alias("key")).distinct().select(_hash_columns(F.col("key")).alias("h")).select("h.a", "h.b"))
    others, spark = universe.count(), pages.sparkSession
    cascades = {}
    for verdict in ("block", "allow"):
        keys = [(r.key,) for r in rules if r.verdict == verdict]
        hashed = spark.createDataFrame(keys, "key string").select(_hash_columns(F.col("key")).alias("h")).select("h.a", "h.b").collect() if keys else []
        cascades[verdict] = build_cascade(_pairs([r[0] for r in hashed], [r[1] for r in hashed]), universe, others)
    kind = urls.schema["__id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten()
            keys = _pairs(flat.field(1).to_numpy(), flat.field(2).to_numpy())
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            names = flat.field(0)
            block = cascades["block"].has(keys) if len(keys) else np.zeros(0, bool)
            hit = np.flatnonzero(block | (cascades["allow"].has(keys) if len(keys) else block))
            first = hit[np.unique(owner[hit], return_index=True)[1]] if len(hit) else hit
            at = np.full(len(lists), -1)
            at[owner[first]] = first
            rule = names.take(pa.array(at, mask=at < 0))
            verdict = np.where((at >= 0) & (block[at] if len(block) else False), "block", "allow")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), rule, pa.array(verdict.tolist(), pa.string())], names=["id", "host", "path", "rule", "verdict"])

    hashed = urls.withColumn("__keys", F.transform("__keys", lambda k: F.struct(k.alias("key"), F.xxhash64(k).alias("a"), F.xxhash64(F.lit("cascade"), k).alias("b"))))
    return hashed.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")


#: The rules of the registered query.
RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]

SQL = f"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
keys AS (SELECT DISTINCT host, path FROM u),
hits AS (SELECT k.host, k.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
         FROM keys k JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path) GROUP BY 1, 2)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN hits ON u.host = hits.host AND u.path = hits.path"""
