"""Features of one series as array expressions on its row.

Nothing here shuffles: a series stays one row from values to feature vector.
Only feature selection and projection look across series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlane.functions.columns import (
    array_mean, array_std, array_sum, first_difference, fixed_width, let, moments, slope, sorted_percentile)
from outlane.functions.order import exact_quantiles
from outlane.operators.kernels import draw
from outlane.operators.prep import spectrum
from outlane.operators.scoring import feature_quantiles, row_chunks
from outlane.session import stage


# ---- intervals --------------------------------------------------------------

def random_intervals(length: int, count: int, seed: int = 27) -> list[tuple[int, int]]:
    """Hash-drawn [start, end) spans of at least max(4, length / 40) points."""
    low = max(4, length // 40)
    spans = []
    for i in range(count):
        width = low + int(draw(seed, length, i, "w") * (length - low + 1))
        start = int(draw(seed, length, i, "s") * max(1, length - width + 1))
        spans.append((start, min(length, start + width)))
    return spans


def even_intervals(length: int, count: int) -> list[tuple[int, int]]:
    """``count`` spans that begin at equal distances from the first to the last
    point and meet the next one or overlap it, then the whole series.

    A span has at least max(4, length / max(4, count)) points where the series
    has them; the last one ends with the series.
    """
    begin = np.arange(max(count, 1)) * (length - 1) // max(count - 1, 1)
    shortest = max(4, length // max(4, count))
    end = np.clip(np.append(np.maximum(begin[:-1] + shortest, begin[1:]), length), begin + 1, None)
    end = np.maximum(np.minimum(end, length), begin + 1)
    return [*zip(begin.tolist(), end.tolist()), (0, length)]


def span_moments(segment: Column) -> Column:
    """mean, std, min, max, median, IQR, slope, skew, excess kurtosis."""
    def body(s):
        m, q = s["m"], s["q"]
        return F.array(m["mean"], m["std"], F.get(q, 0), F.get(q, F.size(q) - 1), sorted_percentile(q, 0.5),
                       sorted_percentile(q, 0.75) - sorted_percentile(q, 0.25), slope(segment), m["skew"], m["kurt"])
    return let(F.struct(moments(segment).alias("m"), F.array_sort(segment).alias("q")), body)


def span_summary(segment: Column) -> Column:
    """mean, std, min, max, p5/25/50/75/95 and the slope on [-1, 1]."""
    def body(s):
        q, mean, n = s["q"], s["m"], F.size(segment)
        at = lambda i: F.when(n > 1, -1.0 + 2.0 * i / (n - 1)).otherwise(F.lit(-1.0))
        cross = F.aggregate(F.transform(segment, lambda x, i: (x - mean) * at(i)), F.lit(0.0), lambda a, x: a + x)
        norm = F.aggregate(F.transform(segment, lambda x, i: at(i) * at(i)), F.lit(0.0), lambda a, x: a + x)
        return F.array(mean, array_std(segment), F.get(q, 0), F.get(q, n - 1),
                       *[sorted_percentile(q, p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)], cross / (norm + 1e-9))
    return let(F.struct(F.array_sort(segment).alias("q"), array_mean(segment).alias("m")), body)


def over_spans(values, spans: list[tuple[int, int]], statistic) -> Column:
    """Concatenate a statistic over fixed spans of an array.

    The spans are a literal array walked by one expression, so the plan does not
    grow with their number.
    """
    table = F.array(*[F.struct(F.lit(a + 1).alias("a"), F.lit(b - a).alias("n")) for a, b in spans])
    v = F.col(values) if isinstance(values, str) else values
    # bind the array outside the walk: it may be an Arrow function's result
    return let(v, lambda bound: F.flatten(F.transform(table, lambda s: let(F.slice(bound, s["a"], s["n"]), statistic))))


def representations(rows: DataFrame) -> DataFrame:
    """raw, first and second differences, |rFFT| as named rows."""
    d1 = first_difference("values")
    wide = rows.withColumn("_d1", d1).withColumn("_f", spectrum("values"))
    rest = [c for c in rows.columns if c != "values"]
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("representation"), e.alias("values")) for n, e in (
        ("raw", F.col("values")), ("diff1", F.col("_d1")), ("diff2", first_difference("_d1")), ("fft", F.col("_f")))]))
    return wide.select(*rest, named.alias("r")).select(*rest, "r.representation", "r.values")


# ---- spectra ----------------------------------------------------------------

def log_spectrum(values) -> Column:
    """log(1 + |rFFT|) without the constant bin."""
    return F.transform(F.filter(spectrum(values), lambda m, i: i > 0), lambda m: F.log1p(m))


def band_edges(bins: int, bands: int) -> list[tuple[int, int]]:
    """Sizes as even as possible, the longer ones first."""
    size, extra = divmod(bins, bands)
    edges, at = [], 0
    for i in range(bands):
        width = size + (1 if i < extra else 0)
        edges.append((at, at + width))
        at += width
    return edges


def band_means(log_mag, bins: int, bands: int) -> Column:
    spans = [(a, b) for a, b in band_edges(bins, bands)]
    one = lambda seg: F.array(F.when(F.size(seg) > 0, array_mean(seg)).otherwise(0.0))
    return over_spans(log_mag, spans, one)


def _profile(values: Column) -> Column:
    """mean, std, median, p90 - p10, max |x|."""
    return let(F.array_sort(values), lambda q: F.array(
        array_mean(values), array_std(values), sorted_percentile(q, 0.5), sorted_percentile(q, 0.9) - sorted_percentile(q, 0.1),
        F.greatest(F.abs(F.get(q, 0)), F.abs(F.get(q, F.size(q) - 1)))))


def spectral_profile(rows: DataFrame, bins: int) -> DataFrame:
    """Stats of x, dx, ddx; eight energy shares; centroid, entropy, peak."""
    edges = [int(i * bins / 8) for i in range(9)]
    wide = rows.withColumn("_d1", first_difference("values")).withColumn("_f", spectrum("values"))
    clean = F.transform("_f", lambda m, i: F.when(i == 0, 0.0).otherwise(m))
    share = let(clean, lambda f: let(array_sum(f) + 1e-9, lambda total: F.transform(f, lambda m: m / total)))
    wide = wide.withColumn("_p", share)
    bands = over_spans("_p", [(a, max(b, a + 1)) for a, b in zip(edges, edges[1:])], lambda s: F.array(array_sum(s)))
    centroid = F.aggregate(F.transform("_p", lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x) / max(1, bins - 1)
    entropy = -array_sum(F.transform("_p", lambda p: p * F.log(p + 1e-12))) / math.log(max(2, bins))
    vec = F.concat(_profile(F.col("values")), _profile(F.col("_d1")), let(first_difference("_d1"), _profile), bands,
                   F.array(centroid, entropy, F.array_max("_p")))
    return wide.withColumn("vec", vec).drop("_d1", "_f", "_p")


# ---- wavelets ---------------------------------------------------------------

def haar(values, length: int, width: int) -> Column:
    """Detail coefficients level by level, then the last average."""
    root = math.sqrt(2.0)

    def levels(current: Column, size: int, have: int) -> Column:
        if size <= 1 or have >= width:
            return current
        half = (size + 1) // 2
        # an odd tail is paired with itself
        right = lambda c, i: F.coalesce(F.get(c, 2 * i + 1), F.get(c, 2 * i))
        grid = F.sequence(F.lit(0), F.lit(half - 1))
        detail = F.transform(grid, lambda i: (F.get(current, 2 * i) - right(current, i)) / root)
        average = F.transform(grid, lambda i: (F.get(current, 2 * i) + right(current, i)) / root)
        return F.concat(detail, let(average, lambda a: levels(a, half, have + half)))

    v = F.col(values) if isinstance(values, str) else values
    return let(v, lambda bound: fixed_width(levels(bound, length, 0), width))


# ---- shapelets --------------------------------------------------------------

def choose_shapelets(train: DataFrame, length: int, count: int, widths: list[int], seed: str = "shape") -> DataFrame:
    """(dataset, shapelets): sub-series of hash-chosen TRAIN rows, z-normed.

    Each TRAIN row is ranked once per shapelet by hash; the smallest wins, so a
    shapelet is a grouped minimum and not a gathered group.
    """
    from outlane.functions.columns import hash_key, z_norm
    widths = [w for w in widths if 4 <= w <= length] or [min(max(4, length // 4), length)]
    slots = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    keyed = train.select("dataset", "idx", "values", slots.alias("s"))
    key = F.struct(hash_key(seed, F.col("dataset"), F.col("s"), F.col("idx")).alias("h"), F.col("idx").alias("i"))
    picked = keyed.groupBy("dataset", "s").agg(F.min_by("values", key).alias("values"))
    width = F.element_at(F.array(*[F.lit(w) for w in widths]), F.col("s") % len(widths) + 1)
    from outlane.functions.columns import uniform
    start = F.floor(uniform(seed, F.col("dataset"), F.col("s"), "start") * (F.lit(length) - width + 1)).cast("int")
    piece = F.slice("values", start + 1, width)
    norm = lambda p: let(F.struct(array_mean(p).alias("m"), (array_std(p) + 1e-6).alias("d")),
                         lambda f: F.transform(p, lambda x: (x - f["m"]) / f["d"]))
    got = picked.select("dataset", "s", let(piece, norm).alias("shape"))
    return got.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("s", "shape"))).alias("p")).select(
        "dataset", F.col("p.shape").alias("shapelets"))


def _sliding(x: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """[series, shape] smallest RMSE of each shape to the z-normed windows of each
    series: all window products of a few series at once by FFT, window means and
    deviations from running sums; the best window is measured again directly."""
    n, length = x.shape
    width = shapes.shape[1]
    size = 1 << (length + width - 1).bit_length()
    x = x - x.mean(axis=1, keepdims=True)  # windows are normed anyway; small sums keep digits
    heard = np.conj(np.fft.rfft(shapes, size))
    sums = np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1)
    squares = np.cumsum(np.pad(x * x, ((0, 0), (1, 0))), axis=1)
    mean = (sums[:, width:] - sums[:, :-width]) / width
    deviation = np.sqrt(np.maximum((squares[:, width:] - squares[:, :-width]) / width - mean ** 2, 0)) + 1e-6
    out = np.empty((n, len(shapes)))
    step = max(1, 4_000_000 // (size * len(shapes)))
    for i in range(0, n, step):
        product = np.fft.irfft(np.fft.rfft(x[i:i + step], size)[:, None] * heard[None], size)[:, :, :length - width + 1] / width
        m, d = mean[i:i + step, None], deviation[i:i + step, None]
        alike = 2 * (product - m * shapes.mean(axis=1)[None, :, None]) / d - ((d - 1e-6) / d) ** 2
        best = alike.argmax(axis=2)
        for r in range(best.shape[0]):
            w = x[i + r][best[r][:, None] + np.arange(width)]
            w = (w - w.mean(axis=1, keepdims=True)) / (w.std(axis=1, keepdims=True) + 1e-6)
            out[i + r] = np.sqrt(((w - shapes) ** 2).mean(axis=1))
    return out


def shapelet_distances(rows: DataFrame, shapelets: DataFrame) -> DataFrame:
    """Smallest RMSE of each shapelet to any z-normed window of the series.

    Series of a batch that share their dataset and length are one matrix, shapelets
    of one width another; no matrix of windows is made."""
    @F.pandas_udf("array<double>")
    def run(names: pd.Series, values: pd.Series, shapes: pd.Series) -> pd.Series:
        out = [None] * len(values)
        alike = pd.DataFrame({"name": names.to_numpy(), "length": values.map(len).to_numpy()}).groupby(["name", "length"], dropna=False).indices
        for where in alike.values():
            x, group = np.stack(values.iloc[where].to_numpy()).astype(float), [np.asarray(s, dtype=float) for s in shapes.iloc[where[0]]]
            found = np.empty((len(where), len(group)))
            for width in {len(s) for s in group}:
                own = [k for k, s in enumerate(group) if len(s) == width]
                found[:, own] = _sliding(x, np.stack([group[k] for k in own]))
            for i, row in zip(where, found):
                out[i] = row
        return pd.Series(out)
    return rows.join(shapelets, "dataset").withColumn("vec", run("dataset", "values", "shapelets")).drop("shapelets")


def interval_frequency(rows: DataFrame, length: int, intervals: int = 12, bands: int = 24) -> DataFrame:
    """Span summaries of the series and its change, then log-spectrum bands."""
    spans = even_intervals(length, intervals)
    wide = rows.withColumn("_d1", first_difference("values")).withColumn("_f", log_spectrum("values"))
    vec = F.concat(over_spans("values", spans, span_summary), over_spans("_d1", spans, span_summary), band_means("_f", length // 2, bands))
    return wide.withColumn("vec", vec).drop("_d1", "_f")


# ---- selection and projection ----------------------------------------------

def keep_features(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Reduce vectors to the chosen (dataset, feature) rows, in feature order."""
    packed = chosen.groupBy("dataset").agg(F.sort_array(F.collect_list("feature")).alias("_keep"))
    return rows.join(packed, "dataset").withColumn("vec", F.transform("_keep", lambda i: F.get("vec", i))).drop("_keep")


def stable_tail(train: DataFrame, keep: int) -> DataFrame:
    """Features whose robust tail is calm: lowest p95/p75 ratio, and neither
    always nor never zero."""
    from pyspark.sql import Window
    q = feature_quantiles(train, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    long = train.select("dataset", F.posexplode("vec").alias("feature", "v")).join(q, ["dataset", "feature"])
    iqr = F.col("q75") - F.col("q25")
    long = long.withColumn("robust", F.abs((F.col("v") - F.col("q50")) / (iqr + 1e-6)))
    got = long.groupBy("dataset", "feature").agg(F.max(iqr > 1e-8).alias("usable"), F.avg((F.abs("v") > 1e-8).cast("int")).alias("nonzero")).join(
        exact_quantiles(long, ["dataset", "feature"], "robust", {"calm": 0.75, "tail": 0.95}), ["dataset", "feature"])
    score = F.round(F.col("tail") / (F.col("calm") + 1e-6) + 0.25 * F.abs(F.col("nonzero") - 0.5), 9)
    # unusable features fill the rest in order; a dataset has few features
    window = Window.partitionBy("dataset").orderBy(F.col("usable").desc(), F.when(F.col("usable"), score).otherwise(0.0), "feature")
    return got.withColumn("r", F.row_number().over(window)).filter(F.col("r") <= keep).select("dataset", "feature")


def widest_spread(train: DataFrame, keep: int) -> DataFrame:
    """Features with the largest (p90 - p10) / MAD on the reference."""
    from pyspark.sql import Window
    q = feature_quantiles(train, {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    long = train.select("dataset", F.posexplode("vec").alias("feature", "v")).join(q, ["dataset", "feature"])
    far = long.withColumn("far", F.abs(F.col("v") - F.col("q50")))
    got = q.select("dataset", "feature", (F.col("q90") - F.col("q10")).alias("spread")).join(exact_quantiles(far, ["dataset", "feature"], "far", {"mad": 0.5}), ["dataset", "feature"])
    ratio = F.round(F.col("spread") / (F.col("mad") + 1e-6), 9)
    window = Window.partitionBy("dataset").orderBy(ratio.desc(), F.col("feature").desc())
    return got.withColumn("r", F.row_number().over(window)).filter(F.col("r") <= keep).select("dataset", "feature", "r")


#: Widest vectors whose product matrix is added up whole.
WIDE = 512
#: More directions than components, rounds, and the change that ends them.
SPARE, SUBSPACE_ROUNDS, SUBSPACE_GAIN = 8, 60, 1e-12


def _gram(batches):
    """Per task and dataset: row count, sums and the d x d product matrix."""
    held, cells = {}, 0
    for pdf in batches:
        for name, part in pdf.groupby("dataset"):
            x = np.stack(part["vec"].to_numpy()).astype(float)
            sums = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
            cells += len(sums) if name not in held else 0
            held[name] = held[name] + sums if name in held else sums
        if cells > 8_000_000:
            yield pd.DataFrame({"dataset": list(held), "sums": list(held.values())})
            held, cells = {}, 0
    if held:
        yield pd.DataFrame({"dataset": list(held), "sums": list(held.values())})


def _signed(axes: np.ndarray) -> np.ndarray:
    """Rows turned so that their largest loading is positive."""
    return axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def _gram_axes(train: DataFrame, components: int, centred: bool) -> DataFrame:
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf.sort_values("at")["v"].to_numpy()
        d = int(round((-1 + math.sqrt(1 + 4 * (len(total) - 1))) / 2))
        n, mean, product = total[0], total[1:d + 1] / total[0], total[d + 1:].reshape(d, d)
        if centred:
            product = product - n * np.outer(mean, mean)
        else:
            mean = np.zeros(d)
        axes = np.linalg.eigh(product)[1].T[::-1][:min(components, int(n), d)]
        return pd.DataFrame({"dataset": [pdf["dataset"].iloc[0]], "mean": [mean], "axes": [list(_signed(axes))]})

    parts = train.select("dataset", "vec").mapInPandas(_gram, "dataset string, sums array<double>")
    total = parts.select("dataset", F.posexplode("sums").alias("at", "v")).groupBy("dataset", "at").agg(F.sum("v").alias("v"))
    return total.groupBy("dataset").applyInPandas(solve, "dataset string, mean array<double>, axes array<array<double>>")


def _subspace_axes(train: DataFrame, components: int, centred: bool) -> DataFrame:
    """First axes by subspace iteration: a round multiplies X'X with a few directions,
    X'(X Q), summed over blocks of rows, so nothing of size d x d is ever made.

    Directions start from fixed draws; a dataset ends when its leading values change
    no more.
    """
    rows = stage(row_chunks(train.select("dataset", "idx", "vec"), "vec", "idx").select("dataset", F.size("idx").alias("n"), "data"))
    state_schema = "dataset string, n double, mean array<double>, q array<double>, values array<double>, done boolean"

    def summed(state: DataFrame | None) -> DataFrame:
        first = state is None

        def run(batches):
            held = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    name, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    x = batch.column(2)[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
                    if first:
                        sums = np.concatenate([[n], x.sum(axis=0)])
                    else:
                        x = x - batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                        q = batch.column(4)[i].values.to_numpy(zero_copy_only=False).reshape(x.shape[1], -1)
                        sums = (x.T @ (x @ q)).ravel()
                    held[name] = held[name] + sums if name in held else sums
                if sum(map(len, held.values())) > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["dataset", "sums"])
                    held = {}
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["dataset", "sums"])

        given = rows.select("dataset", "n", "data") if first else rows.join(state.filter("NOT done").select("dataset", "mean", "q"), "dataset").select("dataset", "n", "data", "mean", "q")
        parts = given.mapInArrow(run, "dataset string, sums array<double>").select("dataset", F.posexplode("sums").alias("at", "v")).groupBy("dataset", "at").agg(F.sum("v").alias("v"))
        return parts.groupBy("dataset").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda z: z["v"]).alias("sums"))

    def begun(batches):
        for batch in batches:
            out = []
            for name, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, total = sums[0], np.array(sums[1:])
                wide = min(components + SPARE, len(total))
                q = np.linalg.qr(np.random.default_rng(90).normal(size=(len(total), wide)))[0]
                out.append((name, n, total / n if centred else 0 * total, q.ravel(), np.zeros(wide), False))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["dataset", "n", "mean", "q", "values", "done"]), preserve_index=False)

    def moved(batches):
        for batch in batches:
            out = []
            for name, n, mean, q, values, done, sums in zip(*(c.to_pylist() for c in batch.columns)):
                q = np.array(q).reshape(len(mean), -1)
                if sums is not None:
                    y = np.array(sums).reshape(q.shape)
                    found, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
                    top = found[::-1]
                    kept = min(components, len(top))
                    done = bool(np.abs(top[:kept] - np.array(values)[:kept]).max() <= SUBSPACE_GAIN * max(abs(top[0]), 1e-300))
                    # the directions in order of their values; one more product brings them closer
                    q, values = (q @ turn[:, ::-1]) if done else np.linalg.qr(y @ turn[:, ::-1])[0], top
                out.append((name, n, mean, q.ravel(), np.array(values), done))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["dataset", "n", "mean", "q", "values", "done"]), preserve_index=False)

    state = stage(summed(None).mapInArrow(begun, state_schema))
    for _ in range(SUBSPACE_ROUNDS):
        state = stage(state.join(summed(state), "dataset", "left").select("dataset", "n", "mean", "q", "values", "done", "sums").mapInArrow(moved, state_schema))
        if state.filter("NOT done").isEmpty():
            break

    def axes(batches):
        for batch in batches:
            for name, n, mean, q in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.array(q).reshape(len(mean), -1).T[:min(components, int(n))]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([mean], pa.list_(pa.float64())), pa.array([_signed(found).tolist()], pa.list_(pa.list_(pa.float64())))], names=["dataset", "mean", "axes"])

    return stage(state.select("dataset", "n", "mean", "q").mapInArrow(axes, "dataset string, mean array<double>, axes array<array<double>>"))


def factor(rows: DataFrame, components: int, centred: bool) -> DataFrame:
    """PCA (centred) or truncated SVD fitted on the TRAIN side of any size.

    Vectors up to ``WIDE``: TRAIN is read once into product matrices that are
    summed entry by entry; only the d x d total of a dataset meets the eigen
    solver.  Wider ones: subspace iteration.  The projection is an expression on
    every row.  The largest loading of an axis is positive.
    """
    train = rows.filter("split = 'TRAIN'")
    widest = train.agg(F.max(F.size("vec"))).first()[0] or 0
    model = (_gram_axes if widest <= WIDE else _subspace_axes)(train, components, centred)
    shifted = F.zip_with("vec", "mean", lambda x, m: x - m)
    project = let(shifted, lambda v: F.transform("axes", lambda a: array_sum(F.zip_with(a, v, lambda p, q: p * q))))
    return rows.join(model, "dataset").withColumn("vec", fixed_width(project, components)).drop("mean", "axes")


def random_projection(rows: DataFrame, width: int, components: int, sparse: bool = False, seed: int = 92) -> DataFrame:
    """Gaussian or sparse projection; the matrix is a hash-drawn literal."""
    density = 1 / math.sqrt(width)

    def weight(c: int, f: int) -> float:
        u, v = draw(seed, c, f, "u"), draw(seed, c, f, "v")
        if not sparse:
            return math.sqrt(-2 * math.log(1 - u)) * math.cos(2 * math.pi * v) / math.sqrt(components)
        return 0.0 if u >= density else (1 if v < 0.5 else -1) * math.sqrt(1 / density / components)

    matrix = np.array([[weight(c, f) for f in range(width)] for c in range(components)])

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(values.to_numpy()).astype(float) @ matrix.T))

    return rows.withColumn("vec", run("vec"))


def compressed(rows: DataFrame, method: str, width: int, components: int) -> DataFrame:
    """Compression by name, fitted on TRAIN only."""
    train = rows.filter("split = 'TRAIN'")
    if method == "none":
        return rows
    if method in ("pca", "svd"):
        return factor(rows, components, method == "pca")
    if method in ("gaussian_rp", "sparse_rp"):
        return random_projection(rows, width, components, method == "sparse_rp")
    if method == "stability_select":
        return keep_features(rows, widest_spread(train, components))
    raise ValueError(f"unknown compression {method}")
