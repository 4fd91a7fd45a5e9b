"""Tie-safe ranking curves: ROC, precision-recall, risk-coverage.

Every curve starts from totals per distinct score, so a tie is one point, and the
running totals are cut into score buckets (see ``ranking.running_totals``), so a run of
any size is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.ranking import running_totals


def detection_metrics(df: DataFrame, keys: Sequence[str], confidence: str = "confidence", positive: str = "is_ood",
                      target: float = 0.95) -> DataFrame:
    """AUROC (ties half), step-wise AUPRC and FPR at the target TPR; low confidence means unknown.

    With one class only, all three are NULL.
    """
    keys = list(keys)
    is_pos = F.col(positive).cast("long")
    points = running_totals(df, keys, confidence, {"p": F.sum(is_pos), "n": F.sum(1 - is_pos)})
    positives, negatives = F.col("p__all"), F.col("n__all")
    tp, fp, p, n = F.col("p__cum"), F.col("n__cum"), F.col("p"), F.col("n")
    both = F.max((positives > 0) & (negatives > 0))
    when_both = lambda value: F.when(both, value)
    return points.groupBy(*keys).agg(
        F.max(positives).alias("n_ood"), F.max(negatives).alias("n_known"),
        when_both(F.sum(F.try_divide(n * (tp - p + 0.5 * p), positives * negatives))).alias("auroc"),
        when_both(F.sum(F.try_divide(p, positives) * tp / (tp + fp))).alias("auprc"),
        when_both(F.min(F.when(tp >= F.lit(target) * positives, F.try_divide(fp, negatives)))).alias("fpr_at_tpr"),
    )


def risk_coverage(df: DataFrame, keys: Sequence[str], confidence: str = "confidence", correct: str = "correct",
                  weight: str = "weight") -> DataFrame:
    """Coverage and risk at each distinct confidence, highest first, with the (0, 0) start implied."""
    keys = list(keys)
    w = F.col(weight)
    points = running_totals(
        df, keys, confidence, {"w": F.sum(w), "e": F.sum(F.when(F.col(correct), 0.0).otherwise(w))}, descending=True
    )
    return points.select(
        *keys, confidence, (F.col("w__cum") / F.col("w__all")).alias("coverage"),
        (F.col("e__cum") / F.col("w__cum")).alias("risk"), (F.col("w") / F.col("w__all")).alias("step"),
    )


def area_under_risk(df: DataFrame, keys: Sequence[str], confidence: str = "confidence", correct: str = "correct",
                    weight: str = "weight") -> DataFrame:
    """Trapezoid area of the risk-coverage curve.

    The previous point's risk follows from the running totals (cumulative minus own),
    so no lag over a whole run is needed.
    """
    keys = list(keys)
    w = F.col(weight)
    points = running_totals(
        df, keys, confidence, {"w": F.sum(w), "e": F.sum(F.when(F.col(correct), 0.0).otherwise(w)),
                               "c": F.count("*")}, descending=True
    )
    first = F.col("c__cum") == F.col("c")
    before_w, before_e = F.col("w__cum") - F.col("w"), F.col("e__cum") - F.col("e")
    previous = F.when(first, 0.0).otherwise(before_e / before_w)
    risk = F.col("e__cum") / F.col("w__cum")
    return points.groupBy(*keys).agg(
        F.sum((risk + previous) / 2 * F.col("w") / F.col("w__all")).alias("aurc")
    )
