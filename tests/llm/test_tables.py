"""Vectors, urls and conversations against brute-force versions; the pipeline."""

import hashlib
import os
import sys
from collections import defaultdict

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import Sets  # noqa: E402

from outlane.llm import chat, common, near_vectors, queries, url_cascade  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


# -- components ------------------------------------------------------------------------
def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    assert got == {x: sets.find(x) for x in sets.up if sets.find(x) != x}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- vectors -----------------------------------------------------------------------------
def vectors(seed=0, n=600, width=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    near = np.repeat(base[:20], 8, axis=0) + rng.normal(size=(160, width)) * 0.12 * rng.random((160, 1))
    dense = base[50] + rng.normal(size=(150, width)) * 0.03
    rows = [*base, *near, *dense, *base[100:110], *(3 * base[110:115])]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.array(rows, np.float32))]
    k = len(rows)
    bad = [None, [], [0.0] * width, [float("nan")] + [1.0] * (width - 1), [float("inf")] * width, [None] + [1.0] * (width - 1), rows[3][1], rows[3][1] + [0.0], rows[4][1][:-1]]
    return rows + [(k + i, v) for i, v in enumerate(bad)] + [(None, rows[3][1])]


def brute(rows, least=0.95):
    width = max(len(v or []) for _, v in rows)
    ok = [(i, np.array(v + [0.0] * (width - len(v)))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    data = np.array([v / np.linalg.norm(v) for _, v in ok])
    links, sets = {i: (0, i) for i, _ in rows}, Sets()
    close = data @ data.T >= least
    for a in range(len(ok)):
        for b in np.flatnonzero(close[a]):
            sets.join(ok[a][0], ok[int(b)][0])
    for a in range(len(ok)):
        links[ok[a][0]] = (int(close[a].sum()) - 1, sets.find(ok[a][0]))
    return {i: (*x, i == x[1]) for i, x in links.items()}


@pytest.mark.parametrize("reach,recall", [(near_vectors.REACH, 0.97), (0.3163, 1.0)])
def test_near_vectors(spark, reach, recall, monkeypatch):
    monkeypatch.setattr(near_vectors, "GROUP_ROWS", 128)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS label", "'z' AS h", "2 AS v", "3 AS id").repartition(3)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df, reach=reach).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= recall * sum(w[0] for w in want.values())
    if recall == 1:
        assert got == want


def test_near_vectors_of_given_table(spark):
    """Recall against brute force on a whole given table."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()}
    want = brute(rows)
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())
    assert np.mean([got[i] == want[i] for i in want]) > 0.99


def test_vectors_without_any_valid_row(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in near_vectors.near_vectors(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_vectors.near_vectors(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [-1.0])], "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in near_vectors.near_vectors(one).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


# -- urls -------------------------------------------------------------------------------------
URLS = ["http://example.com/en/a", "HTTP://WWW.Example.COM/en/b?q=1", "https://a.example.com/en", "http://x.net/es/", "http://x.net/es", "http://net/fr/#x", "http://com/", "http://com", "http://a.b.c.d.example.com/en/x/y",
        None, "", "no scheme", "http://", "http:///en/", "http://.com/", "ftp://exampleXcom/en/", "http://my-example.com/en/", "x://y.net://z/es/", "http://h.org/" + "a" * 9000, "http://b.net/fr/x://www.example.com/en/", "http://a.com?x=/en/", "http://www.example.com/en/", "http://\u00c9.com/\u00e9"]


def brute_url(url):
    rules = [x.split() for x in url_cascade.RULES]
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[:min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(key), key, verdict) for verdict, key in rules if (host == key.split("/")[0] or host.endswith("." + key.split("/")[0])) and path.startswith("/" + key.split("/", 1)[1])]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(None, URLS[0]), (1, URLS[1])], "page_id bigint, url string").selectExpr("*", "'h' AS host", "'p' AS path", "1 AS id")
    got = url_cascade.filtered(df, url_cascade.parse_rules(url_cascade.RULES)).collect()
    key = lambda r: tuple((x is None, x or "") if not isinstance(x, int) else (False, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted([(i, *brute_url(u)) for i, u in [*enumerate(URLS), (None, URLS[0]), (1, URLS[1])]], key=key)
    assert url_cascade.filtered(df.limit(0), url_cascade.parse_rules(url_cascade.RULES)).count() == 0
    assert {r.verdict for r in url_cascade.filtered(df, []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(-2**62, 2**62, (20_000, 2)), axis=0)
    universe = spark.createDataFrame([(int(a), int(b)) for a, b in keys], "a long, b long")
    for n in (1, 50, 3000):
        listed = keys[rng.permutation(len(keys))[:n]].view(np.uint64)
        cascade = url_cascade.build_cascade(listed, universe, len(keys))
        found = {tuple(x) for x in keys.view(np.uint64)[cascade.has(keys.view(np.uint64))].tolist()}
        assert found == {tuple(x) for x in listed.tolist()}
    assert len(cascade.levels) > 2


def test_rules_must_be_rules():
    with pytest.raises(ValueError):
        url_cascade.parse_rules(["maybe com/"])
    with pytest.raises(ValueError):
        url_cascade.parse_rules(["allow com/", "block com/"])


# -- chat ---------------------------------------------------------------------------------------
def test_chat_round_trip_by_chance():
    rng = np.random.default_rng(4)
    pieces = ["[INST] ", " [/INST]", "</s>", "<s>", "<end>", "\\", "[SYS] ", " [/SYS]", "[ROLE x] ", " [/ROLE]", "a", " ", "]", "\n", "\u00e9", "["]
    roles = ["user", "assistant", "system", "tool", "", "a]b\\", "[INST] "]
    for _ in range(5000):
        turns = [(str(rng.choice(roles)), "".join(rng.choice(pieces, rng.integers(0, 6)))) for _ in range(rng.integers(0, 5))]
        text, spans = chat.format_turns(turns)
        assert chat.parse(text) == (turns, spans)


def test_clean_texts_are_not_escaped():
    assert chat.format_turns([("user", "hi [x]"), ("assistant", "yes")])[0] == "<s>[INST] hi [x] [/INST] yes</s><end>"


def test_chat_query(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "b"), (2, 1, None, "x</s>"), (2, None, "assistant", "[INST] "), (None, 1, "user", "n"), (3, 1, "assistant", "z" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS roles", "'q' AS formatted").repartition(3)
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert (back[1].roles, back[1].texts, back[1].loss_text) == (["user", "assistant", "assistant"], ["", "b", "b"], "bb")
    assert (back[2].roles, back[2].texts, back[2].loss_text) == (["assistant", ""], ["[INST] ", "x</s>"], "[INST] ")
    assert back[None].texts == ["n"] and len(back[3].loss_text) == 200_000
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_digests(spark):
    got = {r.conv_id: r for r in queries.QUERIES["op8_chat"](spark, FOLDER).collect()}
    given = defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").orderBy("conv_id", "turn").collect():
        given[r.conv_id].append((r.role, r.text or ""))
    given[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(given)
    for k, turns in given.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


# -- queries and pipeline --------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, FOLDER).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(theirs.columns)
    assert sorted(ours.columns) == cols
    rows = lambda df: sorted(tuple("null" if x is None or x != x else str(x) for x in r) for r in df[cols].astype(object).itertuples(index=False))
    assert rows(ours) == rows(theirs)


def test_pipeline_against_plain_python(spark):
    import corpus_pipeline
    from outlane.llm import language, line_dedup
    from test_near_dedup_stage import brute

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given = docs.collect()
    names, scores = language.fit(docs).predict([r.text for r in given])
    rows = [[r.doc_id, r.text, r.source] for r, n, s in zip(given, names, scores) if n != "und" and s >= corpus_pipeline.LEAST_SCORE]
    pages, has = defaultdict(int), defaultdict(int)
    for text, site in {(text, site) for _, text, site in rows}:  # copies of a page count once
        pages[site] += 1
        for line in set(text.split("\n")):
            has[site, line] += 1
    for r in rows:
        r[1] = "\n".join(x for x in r[1].split("\n") if not x.strip(" ") or has[r[2], x] < line_dedup.LEAST_PAGES or has[r[2], x] <= line_dedup.RATIO * pages[r[2]])
    component = dict(brute(rows))
    kept = {r[0]: r[1] for r in rows if component[r[0]] == r[0]}
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.BYTE_BPE)
    want = {k: np.array(tokenizer.encode(v, add_special_tokens=False).ids + [0], "<u4").tobytes() for k, v in kept.items()}
    got, where = defaultdict(list), defaultdict(int)
    for p in corpus_pipeline.run(spark, FOLDER).collect():
        got[p.doc_id].append((p.start, bytes(p.ids)))
        where[p.sequence_id] += len(p.ids) // 4
    assert {k: b"".join(x for _, x in sorted(v)) for k, v in got.items()} == want
    assert all(n == 1024 for k, n in where.items() if k < max(where))


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op") and x[2].isdigit()} and "pipeline" in names
