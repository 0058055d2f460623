"""Label metrics: confusion counts, agreement, per-rule and per-language scores, fold statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def severity_label(degree: Column, days_lost: Column) -> Column:
    """Serious outcome: a fatality, time away from work, or any days lost."""
    low = F.lower(F.coalesce(degree, F.lit("")))
    days = F.trim(F.coalesce(days_lost, F.lit("")))
    return low.contains("fatality") | low.contains("away from work") | ~days.isin("", "0", "0.0")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def confusion(df: DataFrame, truth: Column, predicted: Column, groups: list[str] | None = None) -> DataFrame:
    """Counts per group. A row that is neither positive pair is a true negative, an unknown prediction included."""
    t, p = F.coalesce(truth, F.lit(False)), predicted
    tp, fp = t & F.coalesce(p, F.lit(False)), ~t & F.coalesce(p, F.lit(False))
    fn = t & F.coalesce(~p, F.lit(False))
    counts = [F.count_if(tp).alias("tp"), F.count_if(fp).alias("fp"), F.count_if(fn).alias("fn"),
              F.count_if(~tp & ~fp & ~fn).alias("tn")]
    return df.groupBy(*groups).agg(*counts) if groups else df.agg(*counts)


def with_scores(counts: DataFrame, digits: int = 3) -> DataFrame:
    """Precision, recall, F1, F2 and accuracy with zero guards."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    cols = {"_p": p, "_r": r}
    f1 = F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(F.lit(0.0))
    f2 = F.when(4 * F.col("_p") + F.col("_r") > 0, 5 * F.col("_p") * F.col("_r") / (4 * F.col("_p") + F.col("_r"))).otherwise(F.lit(0.0))
    out = {"precision": F.round("_p", digits), "recall": F.round("_r", digits), "f1": F.round(f1, digits), "f2": F.round(f2, digits)}
    if "tn" in counts.columns:
        out["accuracy"] = F.round(_ratio(tp + F.col("tn"), tp + fp + fn + F.col("tn")), digits)
    return counts.withColumns(cols).withColumns(out).drop("_p", "_r")


def rule_metrics(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """Per-rule scores from (case_id, rule) pairs on both sides; one shuffle-joined full outer join."""
    e = expected.select("case_id", "rule").distinct().withColumn("_e", F.lit(True))
    d = detected.select("case_id", "rule").distinct().withColumn("_d", F.lit(True))
    pairs = e.join(d, ["case_id", "rule"], "full")
    counts = pairs.groupBy("rule").agg(
        F.count_if("_e").alias("support"), F.count_if(F.col("_e") & F.col("_d")).alias("tp"),
        F.count_if(F.col("_d") & F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_e") & F.col("_d").isNull()).alias("fn"))
    return with_scores(counts)


def fold_statistics(folds: DataFrame, metric: str, digits: int = 3) -> DataFrame:
    """Mean, population deviation, range and 95 % interval over folds."""
    stats = folds.agg(F.avg(metric).alias("m"), F.stddev_pop(metric).alias("s"), F.min(metric).alias("lo"), F.max(metric).alias("hi"), F.count(F.lit(1)).alias("k"))
    half = F.lit(1.96) * F.col("s") / F.sqrt(F.col("k"))
    shown = {"mean": F.col("m"), "std": F.col("s"), "min": F.col("lo"), "max": F.col("hi"), "ci95_low": F.col("m") - half, "ci95_high": F.col("m") + half}
    return stats.select(*[F.round(c, digits).alias(n) for n, c in shown.items()])


def threshold_sweep(scored: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """Scores at each threshold; rows are widened by the few thresholds inside the row, then aggregated map-side."""
    levels = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    rows = scored.select((F.col(truth) == 1).alias("_t"), F.col(score).alias("_s"), levels)
    return with_scores(confusion(rows, F.col("_t"), F.col("_s") >= F.col("threshold"), ["threshold"]))
