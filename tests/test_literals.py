"""Known small inputs and their results."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from outlane.functions import columns as C
from outlane.operators import evaluate, fusion, models, prep, quality, reports, rerank, selection, thresholds

S = "dataset string, split string, idx bigint, source string, score double"


def scores(spark, train, test, source="a"):
    data = [("d", "TRAIN", i, source, float(v)) for i, v in enumerate(train)]
    return spark.createDataFrame(data + [("d", "TEST", i, source, float(v)) for i, v in enumerate(test)], S)


def picks(spark, pairs, name="dataset string, idx bigint"):
    return spark.createDataFrame(pairs, name)


def by_idx(df, col, split="TEST"):
    return [r[0] for r in df.filter(F.col("split") == split).orderBy("idx").select(col).collect()]


def test_conformal_p(spark):
    got = fusion.conformal_p(scores(spark, [0.1, 0.2, 0.3, 0.4], [0.35, 0.50]), ["dataset"])
    assert by_idx(got, "p") == [2 / 5, 1 / 5]


def test_conformal_p_does_not_change_when_rows_are_appended(spark):
    few = fusion.conformal_p(scores(spark, [0.1, 0.2, 0.3], [0.15, 0.35]), ["dataset"])
    more = fusion.conformal_p(scores(spark, [0.1, 0.2, 0.3], [0.15, 0.35, 9.0]), ["dataset"])
    assert by_idx(few, "p") == by_idx(more, "p")[:2]


def test_conformal_p_of_bad_scores_is_one(spark):
    got = fusion.conformal_p(scores(spark, [0.1, 0.2], [float("nan"), float("inf")]), ["dataset"])
    assert by_idx(got, "p") == [1.0, 1.0]


@pytest.mark.parametrize("n,folds,sizes", [(1, 0, []), (7, 7, [1] * 7), (23, 5, [4, 4, 5, 5, 5])])
def test_fold_plan(spark, n, folds, sizes):
    plan = models.fold_plan(picks(spark, [("d", i) for i in range(n)]))
    assert sorted(r["count"] for r in plan.groupBy("fold").count().collect()) == sizes
    assert plan.filter(F.col("folds") != folds).count() == 0


def test_p_agreement(spark):
    data = [("d", i, s, p) for s, ps in (("a", (.01, .20, .01)), ("b", (.02, .01, .20)), ("c", (.20, .20, .01))) for i, p in enumerate(ps)]
    got = selection.p_agreement(spark.createDataFrame(data, "dataset string, idx bigint, source string, p double"), 0.05)
    assert rows(got.select("idx", "support", "selected")) == [(0, 2, 1), (1, 1, 0), (2, 2, 1)]


def test_lanes_from_evidence(spark):
    p = lambda *i: picks(spark, [("d", x) for x in i])
    got = dict(rows(rerank.route_by_evidence(p(1, 2, 3, 4), p(1, 4), p(2, 4), p(*range(6))).select("idx", "lane")))
    assert got == {0: "none", 1: "hard", 2: "priority_review", 3: "standard_review", 4: "hard", 5: "none"}


def test_triage_precedence_and_bounds(spark):
    p = lambda *i: picks(spark, [("d", x) for x in i])
    size = lambda n: spark.createDataFrame([("d", n)], "dataset string, n bigint")
    got = dict(rows(rerank.route(p(1, 3), p(2, 3), p(2, 4), size(6)).select("idx", "lane")))
    assert got == {1: "hard", 2: "standard_review", 3: "hard", 4: "priority_review"}
    with pytest.raises(Exception, match="outside the TEST set"):
        rerank.route(p(5), p(), p(), size(5)).collect()


def test_train_reference_rank(spark):
    got = fusion.train_rank(scores(spark, [1, 3, 2], [.5, 2, 4]), ["dataset"])
    assert by_idx(got, "rank", "TRAIN") == [1 / 3, 1.0, 2 / 3]
    assert by_idx(got, "rank") == [0.0, 2 / 3, 1.0]


def test_count_cap(spark):
    got = thresholds.count_cap(scores(spark, [1, 2, 3, 4, 5], []), ["dataset"], 0.4).first()
    assert (got.threshold, got.q_effective, got.cap) == (3.0, 0.4, 2)


def test_reference_ensemble(spark):
    data = None
    for name in ("a", "b", "c"):
        part = scores(spark, [0, 1, 2, 3], [.5, 3.5], name)
        data = part if data is None else data.unionByName(part)
    got = fusion.weighted_ranks(fusion.train_rank(data, ["dataset", "source"]), {n: 1 / 3 for n in "abc"})
    assert by_idx(got, "score", "TRAIN") == pytest.approx([.25, .5, .75, 1])
    assert by_idx(got, "score") == pytest.approx([.25, 1])


def test_tail_gap(spark):
    test = scores(spark, [], [.01, .02, .03, .40, .41, .42, .90, .91])
    assert [r[0] for r in rows(selection.tail_gap(test).select("idx"))] == [6, 7]


def test_prior_strategies(spark):
    test = scores(spark, [], [i / 99 for i in range(100)])
    got = rows(selection.by_strategies(test, ["prior_q_02", "prior_q_02_min_k_3"]).select("strategy", "idx"))
    assert got == [("prior_q_02", 98), ("prior_q_02", 99)] + [("prior_q_02_min_k_3", i) for i in (97, 98, 99)]


def test_top_k_ties(spark):
    test = scores(spark, [], [1, 1, 1, 0])
    assert rows(selection.top_k(test, 1).select("idx")) == [(2,)]
    assert rows(selection.top_k(test, 1, later_first=False).select("idx")) == [(0,)]


def arrays(spark, *values):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(values)], "id int, values array<double>")


def test_min_zero(spark):
    got = arrays(spark, (-2, 1, 3), (5, 4, 7)).select(C.min_zero("values").alias("v")).collect()
    assert [r.v for r in got] == [[0, 3, 5], [1, 0, 3]]


def test_interpolation(spark):
    nan = float("nan")
    got = arrays(spark, (nan, 1, nan, 3, nan), (nan, nan), (1, 2), ()).select(prep.interpolate_missing("values").alias("v")).collect()
    assert [r.v for r in got] == [[1, 1, 2, 3, 3], [0, 0], [1, 2], []]


def test_z_norm_of_a_constant_series(spark):
    assert arrays(spark, (2, 2, 2)).select(C.z_norm("values").alias("v")).first().v == [0, 0, 0]


def test_resample_keeps_ends(spark):
    got = arrays(spark, (0, 10), (1,), ()).select(C.resample("values", 3).alias("v")).collect()
    assert [r.v for r in got] == [[0, 5, 10], [1, 1, 1], [0, 0, 0]]


def test_overlap_removal_and_balance(spark):
    series = lambda v: [float(v), float(v) / 2, 1.0]
    data = [("d", "TRAIN", i, i, 0, series(i)) for i in range(2)]
    normals = [0, 1] + list(range(2, 52)) + [2]
    data += [("d", "TEST", i, 100 + i, 0, series(v)) for i, v in enumerate(normals)]
    data += [("d", "TEST", 60 + i, 200 + i, 1, series(1000 + i)) for i in range(2)]
    frame = spark.createDataFrame(data, "dataset string, split string, idx bigint, id bigint, y int, values array<double>")
    clean = quality.clean_test(frame)
    summary = quality.manifest_summary(frame, clean).first()
    assert (summary.clean_normal_count, summary.clean_anomaly_count, summary.removed_overlap, summary.removed_copies) == (50, 2, 2, 1)
    balanced = quality.balanced_manifest(clean)
    assert dict(rows(balanced.groupBy("y").count())) == {0: 49, 1: 1}


def test_tolerance_match(spark):
    p = lambda *i: picks(spark, [("d", x) for x in i])
    got = reports.tolerance_match(p(10, 30), p(11, 31, 50), 1).first()
    assert (got.matched, got.left_only, got.right_only) == (2, 0, 1)


def test_tier_metrics(spark):
    truth = spark.createDataFrame([("d", i, y) for i, y in enumerate((0, 1, 0, 1))], "dataset string, idx bigint, y int")
    p = lambda *i: picks(spark, [("d", x) for x in i])
    got = evaluate.confusion(evaluate.index_flags(truth, p(1, 2))).first()
    assert (got.tp, got.fp, got.fn) == (1, 1, 1)
    both = reports.review_metrics(p(1, 2), p(3), truth).first()
    assert (both.review_tp, both.review_fp) == (1, 0)


def test_empty_truth_and_selection(spark):
    truth = spark.createDataFrame([("d", 0, 0)], "dataset string, idx bigint, y int")
    got = evaluate.confusion(evaluate.index_flags(truth, picks(spark, []))).first()
    assert (got.f1, got.precision, got.recall) == (0.0, 0.0, 0.0)
    scored = truth.withColumn("score", F.lit(1.0))
    assert evaluate.auc_roc(scored).first().auc_roc == 0.5


def test_operational_summary(spark):
    detail = spark.createDataFrame([("a", "s", 2, 1, 0, .5, .005), ("b", "s", 1, 0, 0, .5, .010)],
                                   "dataset string, source string, tp int, fp int, fn int, f1 double, exceed_rate double")
    got = reports.strategy_summary(detail, ["source"]).first()
    assert (got.mean_fp, got.mean_tp, got.alert_precision, got.mean_exceed) == pytest.approx((.5, 1.5, .75, .0075))


def test_coverage(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "dataset string")
    got = reports.coverage(names("a", "b"), names("c"), 5).first()
    assert (got.done, got.errors, got.remaining, got.percent) == (2, 1, 2, 40.0)
