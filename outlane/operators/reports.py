"""Comparisons of result tables, consistency checks, logs and report tables."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlane.functions.order import with_position
from outlane.session import stage

ID = ["dataset", "idx"]


# ---- lane comparisons -------------------------------------------------------

def lane_metrics(lanes: DataFrame, truth: DataFrame, sizes_keys: list[str] = ["dataset"]) -> DataFrame:
    """tp/fp/fn per lane and for all lanes together (lane = 'combined')."""
    hits = lanes.join(truth.select("dataset", "idx", "y"), ID)
    per = hits.groupBy("dataset", "lane").agg(F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp"))
    # the combined lane is the sum of the lane rows: lanes are disjoint
    level = F.explode(F.array(F.col("lane"), F.lit("combined")))
    both = per.select("dataset", level.alias("lane"), "tp", "fp").groupBy("dataset", "lane").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    pos = truth.groupBy("dataset").agg(F.sum("y").alias("pos"))
    out = both.join(pos, "dataset").withColumn("fn", F.col("pos") - F.col("tp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("dataset", "lane", "tp", "fp", "fn", (tp / F.greatest(F.lit(1), tp + fp)).alias("precision"),
                      F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"))


def review_metrics(hard: DataFrame, review: DataFrame, truth: DataFrame) -> DataFrame:
    """Hard, review and combined hits per dataset, rescue and zero flags."""
    flag = lambda rows, name: rows.select(*ID).distinct().withColumn(name, F.lit(1))
    rows = truth.join(flag(hard, "h"), ID, "left").join(flag(review, "r"), ID, "left").fillna(0, ["h", "r"])
    y, h, r = F.col("y"), F.col("h"), F.col("r")
    got = rows.groupBy("dataset").agg(
        F.sum(h * y).alias("hard_tp"), F.sum(h * (1 - y)).alias("hard_fp"), F.sum(r * y).alias("review_tp"), F.sum(r * (1 - y)).alias("review_fp"),
        F.sum(F.greatest(h, r) * y).alias("combined_tp"), F.sum(F.greatest(h, r) * (1 - y)).alias("combined_fp"), F.sum(y).alias("pos"))
    tp, fp, fn = F.col("combined_tp"), F.col("combined_fp"), F.col("pos") - F.col("combined_tp")
    return got.withColumn("combined_f1", F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0)) \
              .withColumn("rescued", ((F.col("hard_tp") == 0) & (F.col("review_tp") > 0)).cast("int"))


def _sides(a: DataFrame, b: DataFrame, extra: str = "lane") -> DataFrame:
    left = a.select(*ID, F.col(extra).alias("a"))
    right = b.select(*ID, F.col(extra).alias("b"))
    return left.join(right, ID, "full_outer")


def lane_diff(a: DataFrame, b: DataFrame, lanes: list[str], names: DataFrame) -> DataFrame:
    """Exact match and Jaccard per lane and dataset; both empty counts as 1."""
    rows = _sides(a, b)
    in_a, in_b = F.coalesce(F.col("a") == F.col("lane"), F.lit(False)), F.coalesce(F.col("b") == F.col("lane"), F.lit(False))
    spread = rows.withColumn("lane", F.explode(F.array_distinct(F.array_compact(F.array("a", "b")))))
    got = spread.groupBy("dataset", "lane").agg(F.count_if(in_a & in_b).alias("both"), F.count_if(in_a | in_b).alias("either"))
    grid = names.select("dataset", F.explode(F.array(*[F.lit(x) for x in lanes])).alias("lane"))
    full = grid.join(got, ["dataset", "lane"], "left").fillna(0, ["both", "either"])
    jaccard = F.when(F.col("either") == 0, 1.0).otherwise(F.col("both") / F.col("either"))
    return full.select("dataset", "lane", (F.col("both") == F.col("either")).cast("int").alias("exact"), jaccard.alias("jaccard"))


def jaccard(a: DataFrame, b: DataFrame, names: DataFrame) -> DataFrame:
    flag = lambda rows, n: rows.select(*ID).distinct().withColumn(n, F.lit(1))
    got = flag(a, "a").join(flag(b, "b"), ID, "full_outer").groupBy("dataset").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count(F.lit(1)).alias("either"))
    value = F.when(F.col("either").isNull(), 1.0).otherwise(F.col("both") / F.col("either"))
    return names.join(got, "dataset", "left").select("dataset", value.alias("jaccard"))


def lane_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose lane changed, with 'no_alert' for absence."""
    a, b = F.coalesce("a", F.lit("no_alert")), F.coalesce("b", F.lit("no_alert"))
    return _sides(before, after).select(*ID, F.concat_ws("->", a, b).alias("transition")).filter(a != b)


def candidate_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.select(*ID).distinct(), after.select(*ID).distinct()
    return b.join(a, ID, "left_anti").withColumn("change", F.lit("added")).unionByName(
        a.join(b, ID, "left_anti").withColumn("change", F.lit("removed")))


def stage_diff(stages: list[tuple[str, DataFrame]], names: DataFrame) -> DataFrame:
    """How many datasets change between consecutive stages of a chain."""
    out = None
    for (_, a), (name, b) in zip(stages, stages[1:]):
        changed = candidate_diff(a, b).select("dataset").distinct().withColumn("c", F.lit(1))
        row = names.join(changed, "dataset", "left").agg(
            F.count(F.lit(1)).alias("datasets"), F.count("c").alias("changed")).select(F.lit(name).alias("stage"), "datasets", "changed")
        out = row if out is None else out.unionByName(row)
    return out


def rule_substitution(selections: DataFrame, first: str, second: str, names: DataFrame) -> DataFrame:
    """Exact match and Jaccard when one threshold rule replaces another."""
    a, b = (selections.filter(F.col("rule") == r) for r in (first, second))
    return jaccard(a, b, names).withColumn("exact", (F.col("jaccard") == 1.0).cast("int"))


def shared_comparison(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Match counts of two result tables on their shared datasets."""
    right = b.select("dataset", *[F.col(c).alias(f"r_{c}") for c in columns])
    both = a.join(right, "dataset")
    return both.agg(F.count(F.lit(1)).alias("shared"), *[
        F.count_if(F.col(c).eqNullSafe(F.col(f"r_{c}"))).alias(f"same_{c}") for c in columns])


TEXT_PART = 10_000


def lanes_as_text(lanes: DataFrame) -> DataFrame:
    """'3 7 9' per dataset and lane: the text form used at sinks.

    A long list continues in further parts, so no cell grows without bound.
    """
    placed = with_position(lanes.select("dataset", "lane", "idx").distinct(), ["dataset", "lane"], [("idx", "asc")], "p")
    part = F.floor((F.col("p") - 1) / TEXT_PART).alias("part")
    return placed.groupBy("dataset", "lane", part).agg(F.sort_array(F.collect_list("idx")).alias("ids")).select(
        "dataset", "lane", "part", F.concat_ws(" ", F.transform("ids", lambda v: v.cast("string"))).alias("text"))


def text_to_rows(text: DataFrame) -> DataFrame:
    ids = F.transform(F.filter(F.split("text", " "), lambda x: x != ""), lambda x: x.cast("bigint"))
    return text.select("dataset", "lane", F.explode(ids).alias("idx"))


def replay_check(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """Per dataset and lane, whether a replay gives the stored lists."""
    right = lanes_as_text(replayed).withColumnRenamed("text", "again")
    both = stored.join(right, ["dataset", "lane", "part"], "full_outer")
    same = F.coalesce(F.col("text"), F.lit("")) == F.coalesce(F.col("again"), F.lit(""))
    return both.groupBy("dataset", "lane").agg(F.min(same.cast("int")).alias("same"))


def consistency(lanes: DataFrame, sizes: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per broken rule: overlap, bounds, counts against rows."""
    rule = lambda df, name: df.select("dataset", F.lit(name).alias("rule")).distinct()
    overlap = lanes.groupBy(*ID).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    outside = lanes.join(sizes, "dataset").filter((F.col("idx") < 0) | (F.col("idx") >= F.col("n")))
    have = lanes.groupBy("dataset").agg(F.count(F.lit(1)).alias("have"))
    wrong = counts.join(have, "dataset", "left").filter(F.coalesce("have", F.lit(0)) != F.col("count"))
    return rule(overlap, "overlap").unionByName(rule(outside, "bounds")).unionByName(rule(wrong, "count"))


def reaggregate(detail: DataFrame, summary: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Recompute sums from detail and compare them with a summary."""
    again = detail.groupBy(*keys).agg(*[F.sum(c).alias(f"d_{c}") for c in columns])
    both = summary.join(again, keys, "full_outer")
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).eqNullSafe(F.col(f"d_{c}"))
    return both.select(*keys, ok.cast("int").alias("consistent"))


#: Positions of a block of the matching, and blocks that are composed at a time.
MATCH_BLOCK, COMPOSED = 4096, 64


def _nearest_free(lefts: list[int], rights: list[int], taken: list[int], tolerance: int) -> list[int | None]:
    """The right position that each left one takes, in order, None if there is none.

    Taken positions are skipped in both directions by paths that shorten.
    """
    below, above = list(range(len(rights) + 1)), list(range(len(rights) + 1))  # below[i]: greatest free j < i, plus one

    def end(up: list[int], i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def take(i: int) -> None:
        below[i + 1], above[i] = i, i + 1

    for v in taken:
        take(bisect_left(rights, v))
    out = []
    for x in lefts:
        at = bisect_left(rights, x)
        left, right = end(below, at) - 1, end(above, at)
        near = [(abs(rights[i] - x), rights[i], i) for i in (left, right) if 0 <= i < len(rights) and abs(rights[i] - x) <= tolerance]
        if near:
            take(min(near)[2])
        out.append(min(near)[1] if near else None)
    return out


def _match_blocks(left: DataFrame, right: DataFrame, tolerance: int, width: int) -> DataFrame:
    """(dataset, block, lefts, rights): the left positions of each block and all
    right ones that they reach."""
    at = lambda c: F.floor(c / width).cast("long")
    lefts = left.select(*ID).distinct().groupBy("dataset", at(F.col("idx")).alias("block")).agg(F.sort_array(F.collect_list("idx")).alias("lefts"))
    reached = F.explode(F.sequence(at(F.col("idx") - tolerance), at(F.col("idx") + tolerance))).alias("block")
    rights = right.select(*ID).distinct().select("dataset", "idx", reached).groupBy("dataset", "block").agg(F.sort_array(F.collect_list("idx")).alias("rights"))
    none = F.expr("CAST(array() AS array<bigint>)")
    return lefts.join(rights, ["dataset", "block"], "left").withColumn("rights", F.coalesce("rights", none))


def _evaluated(blocks: DataFrame, asked: DataFrame, tolerance: int, width: int) -> DataFrame:
    """(dataset, block, taken, matched, after): each block from each asked state."""
    def run(batches):
        for batch in batches:
            matched, after = [], []
            for block, lefts, rights, taken in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
                got = [v for v in _nearest_free(lefts, rights, taken, tolerance) if v is not None]
                matched.append(len(got))
                # the next block reaches back to its begin less the tolerance
                after.append(sorted(v for v in {*got, *taken} if v >= (block + 1) * width - tolerance))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(matched, pa.int64()), pa.array(after, pa.list_(pa.int64()))],
                                             names=["dataset", "block", "taken", "matched", "after"])

    rows = blocks.join(asked, ["dataset", "block"]).select("dataset", "block", "lefts", "rights", "taken")
    return rows.mapInArrow(run, "dataset string, block bigint, taken array<bigint>, matched bigint, after array<bigint>")


def _composed(part: pd.DataFrame) -> pd.DataFrame:
    """Up to ``COMPOSED`` neighbouring blocks as one map from state to state."""
    maps = {}
    for place, taken, matched, after in zip(part["place"], part["taken"], part["matched"], part["after"]):
        maps.setdefault(int(place), {})[tuple(taken)] = (int(matched), tuple(after))
    places, out = sorted(maps), []
    for begin in maps[places[0]]:
        state, total = begin, 0
        for place in places:
            matched, state = maps[place][state]
            total += matched
        out.append((list(begin), total, list(state)))
    first = part.iloc[0]
    return pd.DataFrame({"dataset": first["dataset"], "run": first["run"], "place": places[0] // COMPOSED, "taken": [x[0] for x in out], "matched": [x[1] for x in out], "after": [x[2] for x in out]})


def tolerance_match(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """Greedy nearest matching within +-t, left rows in ascending order; of equally
    near right positions the smaller is taken.

    The line is cut into blocks.  What blocks before can do to a block is to have
    taken some right positions near its begin, so a block is a map from such a
    state to its matches and the state it leaves.  Blocks are evaluated from the
    empty state and then from every state that the block before may leave, until
    none is new; then maps are composed in order, many at a time.  A dense line of
    any length is thus many tasks, and the counts are those of the sequential
    rule.  A dataset that is only on one side has no match.
    """
    width = max(MATCH_BLOCK, 2 * tolerance + 1)
    blocks = stage(_match_blocks(left, right, tolerance, width))
    known = stage(_evaluated(blocks, blocks.select("dataset", "block", F.expr("CAST(array() AS array<bigint>)").alias("taken")), tolerance, width))
    fresh, key = known, ["dataset", "block", "taken"]
    while True:
        asked = fresh.select("dataset", (F.col("block") + 1).alias("block"), F.col("after").alias("taken")).distinct().join(known.select(*key), key, "left_anti")
        fresh = stage(_evaluated(blocks, asked, tolerance, width))
        if fresh.isEmpty():
            break
        known = stage(known.unionByName(fresh))
    before = blocks.select("dataset", (F.col("block") + 1).alias("block"), F.lit(0).alias("cut"))
    order = blocks.select("dataset", "block").join(before, ["dataset", "block"], "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    runs = with_position(order, ["dataset"], [("block", "asc")], "p", {"run": F.col("cut")})
    starts = runs.groupBy("dataset", "run").agg(F.min("p").alias("start"))
    placed = runs.join(starts, ["dataset", "run"]).select("dataset", "block", "run", (F.col("p") - F.col("start")).alias("place"))
    maps = stage(known.join(placed, ["dataset", "block"]).select("dataset", "run", "place", "taken", "matched", "after"))
    schema = "dataset string, run bigint, place bigint, taken array<bigint>, matched bigint, after array<bigint>"
    while not maps.filter("place > 0").isEmpty():
        maps = stage(maps.groupBy("dataset", "run", F.floor(F.col("place") / COMPOSED).alias("group")).applyInPandas(_composed, schema))
    # the first block of a run starts from the empty state
    matched = maps.filter(F.size("taken") == 0).groupBy("dataset").agg(F.sum("matched").alias("matched"))
    side = lambda df, name: df.select(*ID).distinct().groupBy("dataset").agg(F.count(F.lit(1)).alias(name))
    sizes = side(left, "n_left").join(side(right, "n_right"), "dataset", "full").join(matched, "dataset", "left").na.fill(0)
    return sizes.select("dataset", "matched", (F.col("n_left") - F.col("matched")).alias("left_only"), (F.col("n_right") - F.col("matched")).alias("right_only"))


# ---- report tables ----------------------------------------------------------

def best_performers(detail: DataFrame, methods: list[str]) -> DataFrame:
    """Wide table of F1 per method with the maximum and who reaches it."""
    wide = detail.groupBy("dataset").pivot("source", methods).agg(F.first("f1")).fillna(0.0, methods)
    best = F.greatest(*[F.col(m) for m in methods])
    ties = F.array_compact(F.array(*[F.when(F.col(m) == best, F.lit(m)) for m in methods]))
    return wide.withColumn("best", best).withColumn("winners", F.concat_ws(" ", ties)).withColumn("n_winners", F.size(ties))


def win_counts(best: DataFrame) -> DataFrame:
    won = best.select(F.explode(F.split("winners", " ")).alias("source"), (F.col("n_winners") == 1).cast("int").alias("sole"))
    return won.groupBy("source").agg(F.count(F.lit(1)).alias("wins"), F.sum("sole").alias("sole_wins"))


def outcome_profile(detail: DataFrame, catalog: DataFrame) -> DataFrame:
    """Metadata of failed against successful datasets."""
    rows = detail.join(catalog, "dataset", "left").withColumn("failed", (F.col("f1") == 0).cast("int"))
    return rows.groupBy("failed").agg(
        F.count(F.lit(1)).alias("datasets"), F.avg("train_count").alias("mean_train"), F.avg("n_test").alias("mean_test"),
        F.min("train_count").alias("min_train"), F.max("train_count").alias("max_train"))


def rank_bucket(rank) -> Column:
    r = F.col(rank) if isinstance(rank, str) else rank
    return (F.when(r <= 1, "top1").when(r <= 3, "top3").when(r <= 10, "top10").when(r <= 20, "top20").otherwise("beyond20"))


def failure_classes(rows: DataFrame, rules: list[tuple[str, Column]], notes: list[Column]) -> DataFrame:
    """Class and notes of failed datasets (diagnostic).

    ``rules`` are (class, condition) in order of precedence, the last of which
    should hold for every row; ``notes`` are text columns, null where they say
    nothing.  Both are the caller's: what counts as a cause is policy.
    """
    named = F.coalesce(*[F.when(condition, F.lit(label)) for label, condition in rules])
    return rows.select("dataset", named.alias("primary"), F.concat_ws(";", *notes).alias("reasons"))


def operational_tier(f1: str, fp: str, exceed: str, precision: str, excluded: Column | None = None, default: Column | None = None) -> Column:
    """Rule on F1, false alerts, TRAIN exceed and alert precision; what is marked
    excluded or default comes first.

    Fixed values: the limits."""
    no = F.lit(False)
    marked = F.when(no if excluded is None else excluded, "excluded").when(no if default is None else default, "operational")
    a, b, e, p = (F.col(c) for c in (f1, fp, exceed, precision))
    return (marked.when(a.isNull(), "undecided")
            .when((a >= 0.5) & (b <= 2.0) & (e <= 0.01) & (p.isNull() | (p >= 0.5)), "operational")
            .when((a >= 0.5) & (b <= 2.5) & (e <= 0.015), "sensitive").when(a >= 0.5, "research").otherwise("hold"))


def strategy_summary(detail: DataFrame, keys: list[str], excluded: Column | None = None, default: Column | None = None) -> DataFrame:
    got = detail.groupBy(*keys).agg(
        F.avg("f1").alias("mean_f1"), F.count_if(F.col("f1") == 0).alias("zero_f1"), F.avg(F.col("tp") + F.col("fp")).alias("mean_predicted"),
        F.avg("tp").alias("mean_tp"), F.avg("fp").alias("mean_fp"), F.avg("fn").alias("mean_fn"), F.avg("exceed_rate").alias("mean_exceed"))
    got = got.withColumn("alert_precision", F.when(F.col("mean_tp") + F.col("mean_fp") > 0, F.col("mean_tp") / (F.col("mean_tp") + F.col("mean_fp"))))
    return got.withColumn("tier", operational_tier("mean_f1", "mean_fp", "mean_exceed", "alert_precision", excluded, default))


def family_trouble(detail: DataFrame, limit: int = 8) -> DataFrame:
    """Families with most false alerts (a top-k report)."""
    got = detail.groupBy("family").agg(
        F.countDistinct("dataset").alias("datasets"), F.avg("f1").alias("mean_f1"), F.count_if(F.col("f1") == 0).alias("zero_f1"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return got.orderBy(F.col("fp").desc(), F.col("zero_f1").desc(), F.col("fn").desc(), "mean_f1", "family").limit(limit)


def strategy_detail(detail: DataFrame, top: int = 10) -> DataFrame:
    """Per strategy the datasets with most false alerts (a top-k report).

    The limit is constant, so Spark prunes each map task to its best rows first.
    """
    window = Window.partitionBy("source").orderBy(F.col("fp").desc(), F.col("predicted").desc(), "dataset")
    rows = detail.withColumn("predicted", F.col("tp") + F.col("fp"))
    return rows.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= top)


def run_comparison(summary: DataFrame) -> DataFrame:
    """Gap of each run to the best run that is not excluded."""
    best = summary.filter("excluded = 0").agg(F.max("mean_f1").alias("best")).withColumn("k", F.lit(1))
    return summary.withColumn("k", F.lit(1)).join(best, "k").select("source", "mean_f1", (F.col("mean_f1") - F.col("best")).alias("delta"))


def catalog_snapshot(catalog: DataFrame, small: int = 20) -> DataFrame:
    """Totals and size percentiles over the catalog (one row per dataset)."""
    from outlane.functions.order import exact_quantiles
    rows = catalog.withColumn("k", F.lit(1))
    qs = exact_quantiles(rows, ["k"], "train_count", {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    main = rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("train_count").alias("train_rows"), F.sum("n_test").alias("test_rows"),
        F.min("train_count").alias("min_train"), F.max("train_count").alias("max_train"), F.count_if(F.col("train_count") < small).alias("small"))
    return main.join(qs, "k").drop("k")


# ---- logs -------------------------------------------------------------------

# Fixed patterns: the three progress formats, the error and the warning format.
CANONICAL = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\d+ \[INFO\] Progress: \[\s*(\d+)/(\d+)\] rows=(\d+)"
PLAIN = r"^(?i)Progress:\s*\[\s*(\d+)/(\d+)\]\s*rows=(\d+)"
COMPACT = r"(?i)\bprogress\s+(\d+)/(\d+)\b(?:\s+last=(\S+))?"
ERROR = r"Error evaluating (?:dataset )?([^:]+): (.*)$"
WARNING = r"([A-Za-z]+Warning):\s*(.*)$"


def progress_events(lines: DataFrame) -> DataFrame:
    """Progress lines of any of the three formats, typed."""
    source = F.when(F.col("line").rlike(CANONICAL), "canonical").when(F.col("line").rlike(PLAIN), "plain").when(F.col("line").rlike(COMPACT), "compact")
    rows = lines.withColumn("format", source).filter("format is not null")

    def pick(canonical: int, plain: int | None, compact: int | None) -> Column:
        get = lambda pattern, i: F.lit(None).cast("string") if i is None else F.regexp_extract("line", pattern, i)
        return F.when(F.col("format") == "canonical", get(CANONICAL, canonical)).when(F.col("format") == "plain", get(PLAIN, plain)).otherwise(get(COMPACT, compact))

    rest = [c for c in lines.columns if c != "line"]
    return rows.select(*rest, "format", F.try_to_timestamp(pick(1, None, None)).alias("at"), pick(2, 1, 1).cast("bigint").alias("done"),
                       pick(3, 2, 2).cast("bigint").alias("expected"), pick(4, 3, None).cast("bigint").alias("rows"))


def error_events(lines: DataFrame) -> DataFrame:
    message = F.trim(F.regexp_extract("line", ERROR, 2))
    low = F.lower(message)
    reason = (F.when(low.contains("inhomogeneous shape") | low.contains("setting an array element with a sequence"), "variable_length_inhomogeneous_shape")
              .when(low.contains("nan") | low.contains("inf"), "nan_or_inf").when(low.contains("memory"), "memory").otherwise("other_exception"))
    name = F.trim(F.regexp_extract("line", ERROR, 1))
    rest = [c for c in lines.columns if c != "line"]
    return lines.filter(F.col("line").rlike(ERROR)).select(
        *rest, name.alias("dataset"), F.regexp_replace(name, "_normal_[^_]*$", "").alias("family"), reason.alias("reason"), message.alias("message"))


def error_summary(errors: DataFrame) -> DataFrame:
    """Counts by reason and by family from one grouped pass."""
    level = F.explode(F.array(F.struct(F.lit("reason").alias("kind"), F.col("reason").alias("value")),
                              F.struct(F.lit("family").alias("kind"), F.col("family").alias("value"))))
    per = errors.groupBy("reason", "family", "dataset").agg(F.count(F.lit(1)).alias("c"))
    return per.select(level.alias("l"), "c", "dataset").groupBy(F.col("l.kind").alias("kind"), F.col("l.value").alias("value")).agg(
        F.sum("c").alias("errors"), F.countDistinct("dataset").alias("datasets"))


def warning_summary(lines: DataFrame, order: str = "seq") -> DataFrame:
    """Unique warnings with their count and last occurrence."""
    rows = lines.filter(F.col("line").rlike(WARNING)).select(
        F.regexp_extract("line", WARNING, 1).alias("category"), F.trim(F.regexp_extract("line", WARNING, 2)).alias("message"), order)
    return rows.groupBy("category", "message").agg(F.count(F.lit(1)).alias("times"), F.max(order).alias("last_seen"))


def coverage(done: DataFrame, errors: DataFrame, expected: int) -> DataFrame:
    d = done.select("dataset").distinct().agg(F.count(F.lit(1)).alias("done")).withColumn("k", F.lit(1))
    e = errors.select("dataset").distinct().agg(F.count(F.lit(1)).alias("errors")).withColumn("k", F.lit(1))
    return d.join(e, "k").select("done", "errors", F.lit(expected).alias("expected"),
                                 F.greatest(F.lit(0), F.lit(expected) - F.col("done") - F.col("errors")).alias("remaining"),
                                 (100.0 * F.col("done") / expected).alias("percent"))


def recent_unique(rows: DataFrame, order: str, limit: int = 12) -> DataFrame:
    """The last ``limit`` distinct datasets (a top-k report)."""
    return rows.groupBy("dataset").agg(F.max(order).alias(order)).orderBy(F.col(order).desc(), "dataset").limit(limit)


def eta(speed: Column, other: Column, remaining: Column) -> list[Column]:
    """Remaining seconds and what they rest on: the recent speed (per minute),
    else the mean one, else nothing yet."""
    left = F.greatest(F.lit(0), remaining)
    return [F.when(speed > 0, left / speed * 60).when(other > 0, left / other * 60).alias("eta_seconds"),
            F.when(speed > 0, "recent").when(other > 0, "average").otherwise("waiting").alias("eta_basis")]


def throughput(events: DataFrame, window: str = "1 minute") -> DataFrame:
    """Speed and remaining time per window of progress lines.

    Recent speed is between the last two lines of the window, mean speed from
    the first line of all to the last of the window; both per minute.
    """
    lines = events.filter("at is not null").select(F.window("at", window)["start"].alias("start"), F.unix_timestamp("at").alias("at"), "done", "expected")
    got = lines.groupBy("start").agg(F.min("done").alias("first"), F.max("done").alias("last"), F.max("expected").alias("expected"), F.count(F.lit(1)).alias("lines"))
    order = Window.partitionBy("start").orderBy(F.desc("at"), F.desc("done"))
    pick = lambda c, r: F.max(F.when(F.col("_r") == r, F.col(c)))
    last = lines.withColumn("_r", F.row_number().over(order)).filter("_r <= 2").groupBy("start").agg(*[pick(c, r).alias(f"{c}{r}") for c in ("at", "done") for r in (1, 2)])
    begin = lines.agg(F.min("at").alias("begin"))  # one row
    seconds, gain = F.col("at1") - F.col("at2"), F.col("done1") - F.col("done2")
    recent = F.when((seconds > 0) & (gain >= 0), gain / (seconds / 60))
    mean = F.when(F.col("at1") > F.col("begin"), F.col("done1") / ((F.col("at1") - F.col("begin")) / 60))
    return got.join(last, "start").crossJoin(begin).select(
        "start", "lines", "first", "last", (F.col("expected") - F.col("last")).alias("remaining"), recent.alias("recent_speed"), mean.alias("mean_speed"),
        *eta(recent, mean, F.col("expected") - F.col("done1")))
