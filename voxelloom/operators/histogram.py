"""Histograms, automatic thresholds, quantiles and display windows, per volume or per slice."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.numeric import clamp, dbl
from ..scale import attach, stage

BINS = 256
# Quantiles of the display windows and their overlap.
WINDOW_QUANTILES = (0.01, 0.20, 0.50, 0.80, 0.99)
WINDOW_OVERLAP = 0.05
MIN_WEIGHT = 1e-8


def histogram256(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """256 counts per volume between vmin and vmax, empty bins included; all zero for a flat volume. NaN has no bin."""
    ranged = volumes.select("volume_id", "vmin", "vmax")
    span = F.col("vmax") - F.col("vmin")
    cells = attach(voxels.select("volume_id", "v", *_spread(voxels)), ranged, ["volume_id"], _spread(voxels))
    found = (
        cells.where((span > 0) & ~F.isnan(dbl("v")))
        .withColumn("bin", clamp(F.floor((dbl("v") - F.col("vmin")) / span * F.lit(255.0)), 0, 255).cast("int"))
        .groupBy("volume_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    slots = volumes.select("volume_id", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    return slots.join(found, ["volume_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def _spread(df: DataFrame) -> list[str]:
    return [c for c in ("z", "y", "x", "idx", "u", "linear") if c in df.columns]


def histogram_display(hist: DataFrame, volumes: DataFrame, window_min, window_max) -> DataFrame:
    """Bar heights on a log scale and whether each bin's value lies in the display window."""
    logs = F.log(dbl("n") + F.lit(1.0))
    top = F.max(logs).over(W.partitionBy("volume_id"))  # 256 rows per volume
    at = attach(hist, volumes.select("volume_id", "vmin", "vmax"), ["volume_id"], ["bin"])
    value = F.col("vmin") + dbl("bin") / F.lit(255.0) * (F.col("vmax") - F.col("vmin"))
    return at.select(
        "volume_id", "bin", "n",
        F.when(top > 0, logs / top).otherwise(0.0).alias("height"),
        value.between(F.lit(float(window_min)), F.lit(float(window_max))).alias("in_window"))


def sample_systematic(cells: DataFrame, n: Column, cap: int, linear: str = "linear") -> DataFrame:
    """Keeps the cells at floor(i * (n - 1) / (cap - 1)), i = 0..cap-1, when there are more than ``cap``.

    Whether a cell is hit follows from its own linear index, so nothing is sorted, joined or shuffled.
    """
    step = (dbl(n) - F.lit(1.0)) / F.lit(float(max(1, cap - 1)))
    lin = dbl(linear)
    near = F.ceil(lin / step)
    hit = F.lit(False)
    for d in (-1, 0, 1):
        i = near + F.lit(d)
        hit = hit | (i.between(0, cap - 1) & (F.floor(dbl(i) * step) == F.col(linear)))
    return cells.where((n <= cap) | hit)


def binned(cells: DataFrame, keys: Sequence[str], value: str = "value", bins: int = BINS) -> DataFrame:
    """Counts per bin floor((v - min) * (bins - 1) / range) and group: (keys, lo, hi, b, n).

    The range of every group is staged first, so the cells are joined to a table of known size.
    """
    keys = list(keys)
    bins = max(16, int(bins))
    clean = cells.where(~F.isnan(dbl(value)))
    ranges = stage(clean.groupBy(*keys).agg(
        F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"),
    ).where(F.col("hi") > F.col("lo")))
    scale = F.lit(float(bins - 1)) / (F.col("hi") - F.col("lo"))
    at = attach(clean, ranges, keys, _spread(cells) or [value])
    b = clamp(F.floor((dbl(value) - F.col("lo")) * scale), 0, bins - 1).cast("int")
    return at.groupBy(*keys, "lo", "hi", b.alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _threshold(b: Column, bins: int) -> Column:
    return F.col("lo") + (dbl(b) + F.lit(1.0)) / F.lit(float(bins)) * (F.col("hi") - F.col("lo"))


def otsu_binary(hist: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """Threshold that best separates two classes; the first of equal scores wins.

    Windows hold at most ``bins`` rows. Only occupied bins need rows: an empty one repeats a score.
    """
    keys = list(keys)
    run = W.partitionBy(*keys).orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    weighted = F.col("b") * F.col("n")
    k = hist.select(
        *keys, "lo", "hi", "b",
        dbl(F.sum("n").over(run)).alias("w0"), dbl(F.sum(weighted).over(run)).alias("s0"),
        dbl(F.sum("n").over(whole)).alias("w"), dbl(F.sum(weighted).over(whole)).alias("s"),
    ).where(F.col("w0") < F.col("w"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    scored = k.withColumn("score", F.col("w0") * w1 * gap * gap)
    best = scored.groupBy(*keys, "lo", "hi").agg(F.max_by("b", F.struct(F.round("score", 6), -F.col("b"))).alias("bin"))
    return best.withColumn("threshold", _threshold(F.col("bin"), bins))


@F.pandas_udf(T.StructType([T.StructField("t1", T.IntegerType()), T.StructField("t2", T.IntegerType())]))
def _three_way_split(bins: pd.Series, counts: pd.Series) -> pd.DataFrame:
    """Best bin pair of each histogram (at most a few hundred bins), null where no pair is admissible."""
    rows = []
    for b, c in zip(bins, counts):
        b = np.asarray(b, dtype=np.int64)
        n = np.asarray(c, dtype=np.float64)
        w = np.cumsum(n) / n.sum()
        m = np.cumsum(n * b) / n.sum()
        w0, w1, w2 = w[:, None], w[None, :] - w[:, None], 1.0 - w[None, :]
        ok = (w0 > MIN_WEIGHT) & (w1 > MIN_WEIGHT) & (w2 > MIN_WEIGHT) & np.triu(np.ones((len(b),) * 2, bool), 1)
        if not ok.any():
            rows.append((None, None))
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = m[-1]
            score = (w0 * (m[:, None] / w0 - mean) ** 2
                     + w1 * ((m[None, :] - m[:, None]) / w1 - mean) ** 2
                     + w2 * ((mean - m[None, :]) / w2 - mean) ** 2)
        score = np.where(ok, np.round(score, 9), -np.inf)
        i, j = np.unravel_index(np.argmax(score), score.shape)
        rows.append((int(b[i]), int(b[j])))
    return pd.DataFrame(rows, columns=["t1", "t2"]).astype("Int32")


def _split(hist: DataFrame, keys: list[str]) -> DataFrame:
    packed = hist.groupBy(*keys, "lo", "hi").agg(
        F.array_sort(F.collect_list(F.struct("b", "n"))).alias("_h"), F.sum("n").alias("n_values"))
    return packed.withColumn("_t", _three_way_split(F.col("_h.b"), F.col("_h.n"))).select(
        *keys, "lo", "hi", "n_values", F.col("_t.t1").alias("t1"), F.col("_t.t2").alias("t2"))


def otsu_multi3(hist: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """Two thresholds for three classes; without an admissible pair, bins around the binary threshold."""
    keys = list(keys)
    pair = _split(hist, keys)
    single = otsu_binary(hist, keys, bins).select(*keys, "bin")
    both = pair.join(single, keys, "left")
    span = max(1, bins // 6)
    base = F.coalesce("bin", F.lit(0))
    t1 = F.coalesce("t1", F.greatest(F.lit(0), base - span))
    t2 = F.coalesce("t2", F.least(F.lit(bins - 1), base + span))
    both = both.select(*keys, "lo", "hi", t1.alias("t1"), t2.alias("t2"))
    both = both.withColumn("t2", F.when(F.col("t2") <= F.col("t1"), F.least(F.lit(bins - 1), F.col("t1") + 1))
                           .otherwise(F.col("t2")))
    a, b = _threshold(F.col("t1"), bins), _threshold(F.col("t2"), bins)
    return both.withColumns({"lower": F.least(a, b), "upper": F.greatest(a, b)})


def otsu_multi3_strict(hist: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """Like ``otsu_multi3`` but only groups with at least three values and an admissible pair have a row."""
    pair = _split(hist, list(keys)).where((F.col("n_values") >= 3) & (F.col("t2") > F.col("t1")))
    return pair.withColumns({"lower": _threshold(F.col("t1"), bins), "upper": _threshold(F.col("t2"), bins)}).where(
        F.col("upper") > F.col("lower"))


def exact_quantiles(cells: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    limit: int = 1 << 20) -> DataFrame:
    """Interpolated quantiles (keys, q, value), exact for groups of any size.

    Values are first counted per group. While a span that holds a wanted rank still has more than ``limit``
    distinct values, it is cut into equal-width parts and only the parts with wanted ranks are kept, so the
    closing window sorts at most ``limit`` rows. Infinities are parts of their own. The lowest and the highest finite
    value of a span always fall in different parts, so every round leaves fewer distinct values and the loop ends.
    """
    keys = list(keys)
    infinity = F.lit(float("inf"))
    finite = F.when(F.abs("val") < infinity, F.col("val"))
    counts = stage(cells.where(~F.isnan(dbl(value))).groupBy(*keys, dbl(value).alias("val")).agg(
        F.count(F.lit(1)).alias("n")))
    totals = stage(counts.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.min("val").alias("lo"), F.max("val").alias("hi"), F.count("val").alias("m"),
        F.min(finite).alias("flo"), F.max(finite).alias("fhi")))
    ranks = totals.select(*keys, "total", F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("q"))
    ranks = ranks.withColumn("_at", F.col("q") * dbl(F.col("total") - 1)).withColumns({
        "_r0": F.floor("_at"), "_r1": F.ceil("_at"), "_t": F.col("_at") - F.floor("_at")})
    targets = ranks.select(*keys, F.explode(F.array("_r0", "_r1")).alias("rank")).distinct()
    spans = totals.select(*keys, "lo", "hi", F.lit(0).cast("bigint").alias("before"), "m", "flo", "fhi")

    def inside(some: DataFrame) -> DataFrame:
        return attach(counts, some, keys, ["val"]).where(F.col("val").between(F.col("lo"), F.col("hi")))

    while (spans.agg(F.max("m")).first()[0] or 0) > limit:
        wide = spans.where(F.col("m") > limit)
        width, half = F.col("fhi") - F.col("flo"), F.lit(0.5)
        share = F.when(width < infinity, F.try_divide(F.col("val") - F.col("flo"), width)).otherwise(  # the width may overflow
            (F.col("val") * half - F.col("flo") * half) / (F.col("fhi") * half - F.col("flo") * half))
        part = F.when(F.col("val") == -infinity, -1).when(F.col("val") == infinity, 4096).otherwise(
            F.least(F.lit(4095), F.floor(share * 4096.0).cast("int")))
        parts = inside(wide).groupBy(*keys, "lo", "hi", "before", part.alias("part")).agg(
            F.sum("n").alias("n"), F.min("val").alias("plo"), F.max("val").alias("phi"), F.count("val").alias("pm"))
        run = W.partitionBy(*keys, "lo").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        parts = parts.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(run), F.lit(0)))
        kept = parts.join(targets, keys).where(
            (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("n")))
        narrow = kept.select(*keys, F.col("plo").alias("lo"), F.col("phi").alias("hi"),
                             F.col("start").alias("before"), F.col("pm").alias("m"),
                             F.col("plo").alias("flo"), F.col("phi").alias("fhi")).distinct()
        spans = stage(spans.where(F.col("m") <= limit).unionByName(narrow))

    run = W.partitionBy(*keys, "lo").orderBy("val").rowsBetween(W.unboundedPreceding, 0)
    ordered = inside(spans).withColumn("end", F.col("before") + F.sum("n").over(run))
    hit = ordered.join(targets, keys).where(
        (F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n")))
    hit = hit.select(*keys, "rank", "val").distinct()
    low = ranks.join(hit.withColumnsRenamed({"rank": "_r0", "val": "_v0"}), [*keys, "_r0"])
    both = low.join(hit.withColumnsRenamed({"rank": "_r1", "val": "_v1"}), [*keys, "_r1"])
    return both.select(
        *keys, "q", F.when(F.col("_t") == 0, F.col("_v0")).otherwise(
            F.col("_v0") * (F.lit(1.0) - F.col("_t")) + F.col("_v1") * F.col("_t")).alias("value"))


def pseudo_rgb_windows(cells: DataFrame, keys: Sequence[str], value: str = "value",
                       fallback: DataFrame | None = None) -> DataFrame:
    """Three display windows per slice (lo_0, hi_0, ... hi_2).

    From the strict three-class thresholds with an overlap of 5 % of the range, else from quantiles.
    ``fallback`` (keys, fmin, fmax) replaces the slice's own range.
    """
    keys = list(keys)
    cells = cells.select(*keys, value, *[c for c in _spread(cells) if c not in keys])
    own = cells.groupBy(*keys).agg(F.min(value).cast("double").alias("omin"), F.max(value).cast("double").alias("omax"))
    split = otsu_multi3_strict(binned(cells, keys, value), keys).select(*keys, "lower", "upper")
    quant = exact_quantiles(cells, keys, value, WINDOW_QUANTILES)
    quant = quant.groupBy(*keys).agg(*[
        F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"p{round(q * 100):02d}") for q in WINDOW_QUANTILES])
    at = own.join(quant, keys, "left").join(split, keys, "left")
    if fallback is None:
        at = at.withColumns({"fmin": F.col("omin"), "fmax": F.col("omax")})
    else:
        at = at.join(fallback.select(*keys, "fmin", "fmax"), keys, "left")
        usable = F.col("fmax") > F.col("fmin")
        at = at.withColumns({
            "_a": F.when(usable, F.col("fmin")).otherwise(F.col("omin")),
            "_b": F.when(usable, F.col("fmax")).otherwise(F.col("omax"))})
        at = at.withColumns({"fmin": F.col("_a"), "fmax": F.col("_b")})
    flat = ~(F.col("fmax") > F.col("fmin"))
    at = at.withColumns({"_lo": F.when(flat, 0.0).otherwise(F.col("fmin")), "_hi": F.when(flat, 1.0).otherwise(F.col("fmax"))})
    over = F.lit(WINDOW_OVERLAP) * F.greatest(F.lit(1e-6), F.col("_hi") - F.col("_lo"))
    found = F.col("lower").isNotNull()
    wanted = [
        (F.when(found, F.col("_lo")).otherwise(F.col("p01")), F.when(found, F.col("lower") + over).otherwise(F.col("p80"))),
        (F.when(found, F.col("lower") - over).otherwise(F.col("p20")), F.when(found, F.col("upper") + over).otherwise(F.col("p80"))),
        (F.when(found, F.col("upper") - over).otherwise(F.col("p50")), F.when(found, F.col("_hi")).otherwise(F.col("p99"))),
    ]
    out = []
    for k, (lo, hi) in enumerate(wanted):
        good = hi > lo
        out += [F.when(good, lo).otherwise(F.col("_lo")).alias(f"lo_{k}"),
                F.when(good, hi).otherwise(F.col("_hi")).alias(f"hi_{k}")]
    return at.select(*keys, found.alias("from_thresholds"), *out)
