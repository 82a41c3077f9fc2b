"""ROC curves, precision and recall, thresholds and areas.

Rows are calls: score (null or not finite if none), tp (weighted baseline matches), fp, tp_raw
(matched calls).  A subset's curve is one label; a row may have several.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1000


def label_subsets(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """One row per row and label whose predicate holds."""
    labels = F.array_compact(F.array(*(F.when(p, F.lit(name)) for name, p in predicates.items())))
    return df.withColumn("subset", F.explode(labels))


def curve(df: DataFrame, by: tuple[str, ...] = (), descending: bool = True) -> DataFrame:
    """Cumulative tp, fp and tp_raw at every score, merged at three decimals; calls without a score come last, as null.

    Scores are grouped first, so that only distinct ones are put in order.
    """
    finite = F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")) & (F.abs(F.col("score").cast("double")) < float("inf"))
    step = F.when(finite, F.floor(F.col("score").cast("double") * SCALE + 0.5).cast("long"))
    points = df.groupBy(*by, step.alias("step_")).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tp_raw")))
    order = F.desc_nulls_last("step_") if descending else F.asc_nulls_last("step_")
    running = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return points.select(*by, (F.col("step_") / SCALE).alias("score"), *(F.sum(c).over(running).alias(c) for c in ("tp", "fp", "tp_raw")))


def metrics(points: DataFrame, total: Column | int) -> DataFrame:
    """Precision over the calls, sensitivity over the baseline (``total`` of it), F-measure and false negatives."""
    total = F.lit(total) if isinstance(total, int) else total
    p = F.when(F.col("tp_raw") + F.col("fp") > 0, F.col("tp_raw") / (F.col("tp_raw") + F.col("fp"))).otherwise(F.lit(0.0))
    r = F.when(total > 0, F.col("tp") / total).otherwise(F.lit(0.0))
    out = points.withColumns({"precision": p, "sensitivity": r, "fn": total - F.col("tp")})
    s = F.col("precision") + F.col("sensitivity")
    return out.withColumn("f_measure", F.when(s > 0, 2 * F.col("precision") * F.col("sensitivity") / s).otherwise(F.lit(0.0)))


def rescale(points: DataFrame, totals: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A subset's tp scaled by its baseline matches over its call matches (``totals``: by, baseline_tp, call_tp)."""
    scaled = points.join(totals, list(by), "left")
    k = F.when(F.col("call_tp") > 0, F.col("baseline_tp") / F.col("call_tp")).otherwise(F.lit(1.0))
    return scaled.withColumn("tp", F.col("tp_raw") * k).drop("baseline_tp", "call_tp")


def best_f_measure(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The point of the largest F-measure; of equal ones the later on the curve (with more calls)."""
    pick = F.max_by(F.struct(*points.columns), F.struct("f_measure", "tp_raw", "fp"))
    return _pick(points.where("score is not null"), pick, by)


def at_precision(points: DataFrame, least: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The last point on the curve with this precision at least."""
    pick = F.max_by(F.struct(*points.columns), F.struct("tp_raw", "fp"))
    return _pick(points.where(F.col("precision") >= least).where("score is not null"), pick, by)


def at_sensitivity(points: DataFrame, least: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The first point on the curve with this sensitivity at least."""
    pick = F.min_by(F.struct(*points.columns), F.struct("tp_raw", "fp"))
    return _pick(points.where(F.col("sensitivity") >= least).where("score is not null"), pick, by)


def _pick(points: DataFrame, pick: Column, by: tuple[str, ...]) -> DataFrame:
    return (points.groupBy(*by) if by else points).agg(pick.alias("p_")).select("p_.*").where("tp is not null")


def precision_recall_area(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the precision-recall curve in percent of percent, by trapezoids between neighbouring points."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("tp_raw", "fp")
    x, y = F.col("sensitivity") * 100, F.col("precision") * 100
    parts = points.withColumn("a_", (x - F.lag(x).over(w)) * (y + F.lag(y).over(w)) / 2)
    return (parts.groupBy(*by) if by else parts).agg(F.coalesce(F.sum("a_"), F.lit(0.0)).alias("area"))


def interpolate(points: DataFrame, step: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Extra points on straight lines wherever tp grows by more than ``step``."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("tp", "fp")
    moved = points.withColumns({"tp0": F.coalesce(F.lag("tp").over(w), F.lit(0)), "fp0": F.coalesce(F.lag("fp").over(w), F.lit(0))})
    n = F.greatest(F.lit(1), F.ceil((F.col("tp") - F.col("tp0")) / step)).cast("int")
    each = moved.withColumn("n_", n).withColumn("i_", F.explode(F.sequence(F.lit(1), F.col("n_"))))
    share = F.col("i_") / F.col("n_")
    return each.select(*by, "score", (F.col("tp0") + (F.col("tp") - F.col("tp0")) * share).alias("tp"), (F.col("fp0") + (F.col("fp") - F.col("fp0")) * share).alias("fp"))


def hull_slope(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Slope of tp over fp along the curve's upper hull, per score.

    The hull is a monotone stack over the points in order and so sequential; a curve has at
    most one point per distinct score, and curves are dealt out by subset.
    """
    keys = list(by)
    ordered = points.select(*keys, "score", F.col("tp").cast("double").alias("tp"), F.col("fp").cast("double").alias("fp"))
    ordered = (ordered.repartition(*keys) if keys else ordered.coalesce(1)).sortWithinPartitions(*keys, F.desc_nulls_last("score"))

    def close(key, stack):
        rows = [(*key, s, (t1 - t0) / max(f1 - f0, 1e-9)) for (t0, f0, t1, f1, scores) in stack for s in scores]
        return pd.DataFrame(rows, columns=[*keys, "score", "slope"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, stack, last = None, [], (0.0, 0.0)
        for batch in batches:
            for row in batch.itertuples(index=False):
                key = tuple(row[: len(keys)])
                if key != here:
                    if stack:
                        yield close(here, stack)
                    here, stack, last = key, [], (0.0, 0.0)
                score, tp, fp = row[len(keys) :]
                part = (*last, tp, fp, [score])
                slope = lambda p: (p[2] - p[0]) / max(p[3] - p[1], 1e-9)
                while stack and slope(part) >= slope(stack[-1]):
                    prev = stack.pop()
                    part = (prev[0], prev[1], part[2], part[3], prev[4] + part[4])
                stack.append(part)
                last = (tp, fp)
        if stack:
            yield close(here, stack)

    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    return ordered.mapInPandas(run, f"{kinds + ', ' if kinds else ''}score double, slope double")


def score_column(field: str) -> Column:
    """Score by name: QUAL, INFO.x, FORMAT.x (or x) of the first sample."""
    if field == "QUAL":
        return F.col("qual")
    level, _, name = field.rpartition(".")
    if level == "INFO":
        return F.try_element_at("info", F.lit(name)).try_cast("double")
    return F.try_element_at(F.get("samples", F.lit(0)), F.lit(name)).try_cast("double")


def standard_subsets(ref: Column, alts: Column, gt: Column) -> dict[str, Column]:
    """The usual subsets of calls: all, by zygosity, and by type of the genotype."""
    from ..functions import alleles as A

    kind = A.genotype_type(ref, alts, gt)
    return {
        "ALL": F.lit(True), "HOM": A.is_hom(gt), "HET": A.is_het(gt), "SNP": kind == "SNP", "NON_SNP": kind != "SNP", "MNP": kind == "MNP",
        "INDEL": kind.isin(*A.INDEL_TYPES),
    }


def format_curve(points: DataFrame, total: int, field: str = "QUAL") -> DataFrame:
    """A curve as the lines of a table (``place``, ``value``), with totals and column names before it."""
    head = points.sparkSession.createDataFrame([(-2, f"#total baseline variants: {total}"), (-1, f"#score field: {field}"), (0, "#score\ttrue_positives_baseline\tfalse_positives\ttrue_positives_call")], "place long, value string")
    rows = points.select((F.col("tp_raw") + F.col("fp") + 1).cast("long").alias("place"), F.concat_ws("\t", F.coalesce(F.format_string("%.3f", "score"), F.lit("None")), F.format_string("%.2f", F.col("tp").cast("double")), F.col("fp").cast("string"), F.col("tp_raw").cast("string")).alias("value"))
    return head.unionByName(rows).orderBy("place")


def summary(points: DataFrame) -> DataFrame:
    """Two rows: the point of the best F-measure, and all calls (threshold null)."""
    every = points.agg(F.max_by(F.struct(*points.columns), F.struct("tp_raw", "fp")).alias("p_")).select("p_.*").withColumn("score", F.lit(None).cast("double"))
    columns = points.columns
    return best_f_measure(points).select(*columns).unionByName(every.select(*columns))
