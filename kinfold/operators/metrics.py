"""Classification metrics, computed for every run at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import arrays as ar
from kinfold.operators.ranking import _null_safe_join, add_group_size, hash_rank, running_totals
from kinfold.operators.weights import evaluation_weights


def confusion(df: DataFrame, keys: Sequence[str], truth: str = "label", predicted: str = "predicted",
              weight: Column | None = None, out: str = "n") -> DataFrame:
    """(Weighted) count per true and predicted label."""
    amount = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(*keys, F.col(truth).alias("true_label"), F.col(predicted).alias("predicted_label")).agg(
        amount.alias(out)
    )


def label_totals(counts: DataFrame, keys: Sequence[str], amounts: Sequence[str] = ("n",)) -> DataFrame:
    """Per label: true mass, predicted mass and hits, for each amount column."""
    side = lambda label, t, p: F.struct(
        F.col(label).alias("label"), F.lit(t).alias("is_true"), F.lit(p).alias("is_pred")
    )
    both = counts.select(
        *keys, *amounts, (F.col("true_label") == F.col("predicted_label")).alias("hit"),
        F.explode(F.array(side("true_label", 1, 0), side("predicted_label", 0, 1))).alias("s"),
    )
    pick = lambda rule, a: F.sum(F.when(rule, F.col(a)).otherwise(0))
    return both.groupBy(*keys, F.col("s.label").alias("label")).agg(
        *[
            metric
            for a in amounts
            for metric in (
                pick(F.col("s.is_true") == 1, a).alias(f"t_{a}"),
                pick(F.col("s.is_pred") == 1, a).alias(f"p_{a}"),
                pick((F.col("s.is_true") == 1) & F.col("hit"), a).alias(f"h_{a}"),
            )
        ]
    )


def f1_columns(amount: str = "n", suffix: str = "") -> list[Column]:
    t, p, h = F.col(f"t_{amount}"), F.col(f"p_{amount}"), F.col(f"h_{amount}")
    f1 = F.when(t + p > 0, 2.0 * h / (t + p)).otherwise(0.0)
    return [
        F.avg(F.when(t + p > 0, f1)).alias(f"macro_f1{suffix}"),
        F.avg(F.when(t > 0, f1)).alias(f"macro_f1_true_labels{suffix}"),
        F.avg(F.when(t > 0, h / t)).alias(f"balanced_accuracy{suffix}"),
        F.try_divide(F.sum(h), F.sum(t)).alias(f"accuracy{suffix}"),
    ]


def scores_from_confusion(counts: DataFrame, keys: Sequence[str], amounts: Sequence[str] = ("n",)) -> DataFrame:
    """macro-F1 (label scope: union, and true labels only), balanced accuracy and accuracy."""
    totals = label_totals(counts, keys, amounts)
    suffix = lambda a: "" if len(amounts) == 1 else f"_{a}"
    return totals.groupBy(*keys).agg(*[c for a in amounts for c in f1_columns(a, suffix(a))])


def confusion_scores(counts: DataFrame, keys: Sequence[str], n_labels: int) -> DataFrame:
    """Macro-F1 over a fixed number of labels: a label without any support counts as zero."""
    totals = label_totals(counts, keys)
    t, p, h = F.col("t_n"), F.col("p_n"), F.col("h_n")
    return totals.groupBy(*keys).agg(
        (F.sum(F.when(t + p > 0, 2.0 * h / (t + p)).otherwise(0.0)) / F.lit(n_labels)).alias("macro_f1"),
        F.try_divide(F.sum(h), F.sum(t)).alias("accuracy"),
    )


def classification_scores(df: DataFrame, keys: Sequence[str], truth: str = "label", predicted: str = "predicted",
                          weight: Column | None = None) -> DataFrame:
    return scores_from_confusion(confusion(df, keys, truth, predicted, weight), keys)


def enrich_rows(df: DataFrame, classes: list[str], probability: str = "probability") -> DataFrame:
    """Row-level outcomes: hit, true-class probability, Brier term, top-3 hit, confidence."""
    p, names = F.col(probability), ar.class_array(classes)
    known = F.col("role") == "test_known" if "role" in df.columns else F.lit(True)
    return df.select(
        "*",
        F.coalesce(known & (F.col("predicted") == F.col("label")), F.lit(False)).alias("correct"),
        F.when(known, ar.value_at_label(p, names, F.col("label"))).alias("true_probability"),
        F.when(known, ar.brier(p, names, F.col("label"))).alias("brier_row"),
        (known & F.array_contains(ar.top_labels(p, names, 3), F.col("label"))).alias("top3_correct"),
    )


def weighted_means(df: DataFrame, keys: Sequence[str], values: dict[str, Column], weight: str = "weight") -> DataFrame:
    w = F.col(weight)
    return df.groupBy(*keys).agg(*[(F.sum(v * w) / F.sum(w)).alias(n) for n, v in values.items()])


def log_loss_term(p: Column, epsilon: float = 1e-12) -> Column:
    return -F.ln(F.least(F.greatest(p, F.lit(epsilon)), F.lit(1.0)))


def calibration_error(df: DataFrame, keys: Sequence[str], confidence: str = "confidence", correct: str = "correct",
                      weight: str = "weight", bins: int = 15, tie: str = "row_id") -> DataFrame:
    """Equal-frequency calibration error.

    The rank of a row is the number of rows with a lower score plus its hash rank among
    equal scores. Both parts are cut for hot groups, so one run may hold any share of
    the table. The first ``n mod bins`` bins hold one row more, as in an even split.
    """
    keys = list(keys)
    totals = running_totals(df, keys, confidence, {"__c": F.count("*")}).select(
        *keys, confidence, (F.col("__c__cum") - F.col("__c")).alias("__below"), F.col("__c__all").alias("__n")
    )
    tied = hash_rank(df, [*keys, confidence], F.sha2(F.col(tie).cast("string"), 256), [tie], "__r")
    ranked = _null_safe_join(tied, totals, [*keys, confidence])
    k = F.least(F.lit(bins), F.col("__n"))
    at, small = F.col("__below") + F.col("__r") - 1, F.floor(F.col("__n") / k)
    extra = F.col("__n") % k
    bin_no = F.when(at < extra * (small + 1), F.floor(at / (small + 1))).otherwise(
        extra + F.floor((at - extra * (small + 1)) / small)
    )
    w = F.col(weight)
    per_bin = ranked.withColumn("__bin", bin_no).groupBy(*keys, "__bin").agg(
        F.sum(w).alias("w"), F.sum(w * F.col(correct).cast("double")).alias("c"),
        F.sum(w * F.col(confidence)).alias("s"),
    )
    return per_bin.groupBy(*keys).agg((F.sum(F.abs(F.col("c") - F.col("s"))) / F.sum("w")).alias("ece"))


def run_scores(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metric row per run from enriched rows: F1, balanced accuracy, top-3, log loss, Brier, ECE."""
    weighted = evaluation_weights(rows, keys)
    loss = weighted_means(
        weighted, keys, {"log_loss": log_loss_term(F.col("true_probability")), "brier": F.col("brier_row")}
    )
    plain = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.avg(F.col("top3_correct").cast("double")).alias("top3_accuracy")
    )
    result = classification_scores(rows, keys).drop("macro_f1_true_labels", "accuracy")
    for part in (plain, loss, calibration_error(weighted, keys)):
        result = _null_safe_join(result, part, list(keys))
    return result


def seed_scores(known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Out-of-fold rows pooled over folds: one metric row per (design, model, seed)."""
    weighted = evaluation_weights(known, keys)
    means = weighted_means(
        weighted, keys,
        {
            "top3_accuracy": F.col("top3_correct").cast("double"),
            "log_loss": log_loss_term(F.col("true_probability")),
            "brier": F.col("brier_row"),
            "known_acceptance": F.col("accepted").cast("double"),
        },
    )
    counts = known.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.countDistinct("cluster_id").alias("n_clusters"),
        F.countDistinct("label").alias("n_labels"),
    )
    result = classification_scores(known, keys).drop("macro_f1_true_labels", "accuracy")
    for part in (counts, means):
        result = _null_safe_join(result, part, list(keys))
    return result


def cluster_mean_predictions(df: DataFrame, keys: Sequence[str], classes: list[str],
                             probability: str = "probability") -> DataFrame:
    """One prediction per cluster from its mean probability vector."""
    means = mean_vectors(df, [*keys, "cluster_id", "label"], probability, len(classes))
    return means.withColumn("predicted", ar.argmax_label(F.col(probability), ar.class_array(classes))).withColumn(
        "confidence", F.array_max(probability)
    )


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str, size: int | None = None) -> DataFrame:
    """Element-wise mean of equally long arrays, in double precision, and how many rows it has (``n_rows``, with a ``size``).

    With their ``size`` (a class list) given, elements are columns of one aggregate and no row is multiplied. Else element
    sums combine map-side; only one (position, mean) entry per element is
    collected back, so the array built here is bounded by the vector length.
    """
    if size is not None:
        means = [F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(size)]
        found = df.groupBy(*keys).agg(F.array(*means).alias(vector), F.count("*").alias("n_rows"), F.count(vector).alias("__k"))
        return found.filter("__k > 0").drop("__k")
    long = df.select(*keys, F.posexplode(vector).alias("__pos", "__x"))
    means = long.groupBy(*keys, "__pos").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__pos", "__m"))).alias("__v"))
    return packed.select(*keys, F.transform("__v", lambda e: e["__m"]).alias(vector))


def leakage_metrics(known: DataFrame, keys: Sequence[str], classes: list[str] | None = None,
                    cluster_predictions: DataFrame | None = None) -> DataFrame:
    """Three estimands per run: pooled rows, equal cluster weight, cluster-mean probability."""
    keys = list(keys)
    sized = add_group_size(known, [*keys, "cluster_id"], "__rows").withColumn("__w", F.lit(1.0) / F.col("__rows"))
    counts = sized.groupBy(*keys, F.col("label").alias("true_label"), F.col("predicted").alias("predicted_label")).agg(
        F.count("*").alias("n"), F.sum("__w").alias("w")
    )
    both = scores_from_confusion(counts, keys, ["n", "w"]).select(
        *keys, F.col("macro_f1_n").alias("pooled_row_macro_f1"), F.col("macro_f1_w").alias("equal_cluster_macro_f1")
    )
    clusters = cluster_predictions if cluster_predictions is not None else cluster_mean_predictions(known, keys, classes)
    mean = classification_scores(clusters, keys).select(
        *keys, F.col("macro_f1").alias("cluster_mean_macro_f1"),
        F.col("balanced_accuracy").alias("cluster_mean_balanced_accuracy"),
    )
    size = known.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.countDistinct("cluster_id").alias("n_clusters"),
        F.countDistinct("label").alias("n_labels"),
    )
    return _null_safe_join(_null_safe_join(size, both, keys), mean, keys)


ESTIMANDS = ("pooled_row_macro_f1", "equal_cluster_macro_f1", "cluster_mean_macro_f1")


def design_deltas(metrics: DataFrame, keys: Sequence[str], values: Sequence[str] = ESTIMANDS) -> DataFrame:
    """Row-random minus cluster-grouped value of each metric, one row per (keys, metric)."""
    long = metrics.select(*keys, "design", *values).unpivot([*keys, "design"], list(values), "metric", "value")
    wide = long.groupBy(*keys, "metric").pivot("design", ["row_random", "cluster_grouped"]).agg(F.first("value"))
    return wide.withColumn("delta", F.col("row_random") - F.col("cluster_grouped"))


def delta_summary(deltas: DataFrame, keys: Sequence[str]) -> DataFrame:
    return deltas.groupBy(*keys, "metric").agg(
        F.count("*").alias("n_seeds"), F.avg("row_random").alias("row_random_mean"),
        F.avg("cluster_grouped").alias("cluster_grouped_mean"), F.avg("delta").alias("delta_mean"),
        F.stddev_samp("delta").alias("delta_sd"), F.min("delta").alias("delta_min"), F.max("delta").alias("delta_max"),
    )


def endpoint_suite(df: DataFrame, keys: Sequence[str], classes: list[str] | None = None,
                   scores: str = "scores") -> DataFrame:
    """Row, equal-cluster and cluster-aggregate endpoints; F1 is over the true labels only."""
    keys = list(keys)
    sized = add_group_size(df, [*keys, "cluster_id"], "__rows").withColumn("__w", F.lit(1.0) / F.col("__rows"))
    counts = sized.groupBy(*keys, F.col("label").alias("true_label"), F.col("predicted").alias("predicted_label")).agg(
        F.count("*").alias("n"), F.sum("__w").alias("w")
    )
    base = scores_from_confusion(counts, keys, ["n", "w"]).select(
        *keys, F.col("accuracy_n").alias("row_accuracy"), F.col("macro_f1_true_labels_n").alias("row_macro_f1"),
        F.col("balanced_accuracy_n").alias("row_balanced_accuracy"),
        F.col("accuracy_w").alias("equal_cluster_accuracy"),
        F.col("macro_f1_true_labels_w").alias("equal_cluster_macro_f1"),
    )
    hit = (F.col("label") == F.col("predicted")).cast("double")
    extra = [F.avg(F.array_contains(ar.top_labels(F.col(scores), ar.class_array(classes), 3), F.col("label"))
                   .cast("double")).alias("row_top3_accuracy")] if classes else []
    size = df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.countDistinct("cluster_id").alias("n_clusters"),
        F.countDistinct("label").alias("n_labels"), F.sum(F.col("accepted").cast("long")).alias("accepted_count"),
        F.avg(F.col("accepted").cast("double")).alias("accepted_rate"),
        F.avg(F.when(F.col("accepted"), hit)).alias("accepted_accuracy"), *extra,
    )
    result = _null_safe_join(size, base, keys)
    if classes:
        means = mean_vectors(df, [*keys, "cluster_id", "label"], scores, len(classes)).withColumn(
            "predicted", ar.argmax_label(F.col(scores), ar.class_array(classes))
        )
        aggregate = classification_scores(means, keys).select(
            *keys, F.col("accuracy").alias("cluster_aggregate_accuracy"),
            F.col("macro_f1_true_labels").alias("cluster_aggregate_macro_f1"),
        )
        result = _null_safe_join(result, aggregate, keys)
    return result


def false_acceptance(ood: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unknown rows accepted, overall and by distance, with distances renamed for reporting."""
    renamed = F.when(F.col("ood_distance") == "near", "same-parent").when(
        F.col("ood_distance") == "far", "different-parent").otherwise(F.col("ood_distance"))
    both = ood.filter(F.col("role") == "test_ood").withColumn(
        "population", F.explode(F.array(F.lit("all"), renamed))
    )
    group = [*keys, "population"]
    # summed by cluster and by label first, so that counting them needs no copy of the rows
    clusters = both.groupBy(*group, "cluster_id").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("accepted").cast("long")).alias("a"), F.count("accepted").alias("k")
    )
    labels = both.groupBy(*group, "label").agg(F.count("*").alias("n")).groupBy(*group).agg(F.count("label").alias("n_labels"))
    totals = clusters.groupBy(*group).agg(
        F.sum("n_rows").alias("n_rows"), F.count("cluster_id").alias("n_clusters"), F.sum("a").alias("false_accepts"), F.sum("k").alias("k")
    )
    return _null_safe_join(totals, labels, group).select(
        *group, "n_rows", "n_clusters", "n_labels", "false_accepts", F.try_divide("false_accepts", "k").alias("false_accept_rate")
    )
