"""Controlled leakage experiments: cohorts, rotations, paired injections, dose response.

Seeds, rotations, levels and arms are columns, so the whole experiment grid is one
DataFrame per step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.formats import level_token
from kinfold.functions.hashing import hash_key, stable_token
from kinfold.operators.metrics import classification_scores
from kinfold.operators.bootstrap import paired_f1, paired_scores
from kinfold.operators.ranking import _null_safe_join, hash_fraction, hash_rank, rank_in_group

ROTATIONS = 5  # fixed value
CELL = ("experiment", "seed", "rotation")


@dataclass(frozen=True)
class Experiment:
    name: str
    min_rows: int
    cap: int
    levels: tuple[float, ...]
    min_clusters: int = 5


# fixed values: the two experiments
PREVALENCE = Experiment("prevalence", 2, 2, (0.0, 0.25, 0.5, 0.75, 1.0))
INTENSITY = Experiment("intensity", 5, 5, (0.0, 1.0, 2.0, 4.0))


def condition_grid(spark: SparkSession, experiment: Experiment) -> DataFrame:
    """Levels x arms; level zero has a single baseline arm."""
    arms = [
        (experiment.name, float(level), arm)
        for level in experiment.levels
        for arm in (("baseline",) if level == 0 else ("leakage", "matched_control"))
    ]
    grid = spark.createDataFrame(arms, "experiment string, level double, arm string")
    return grid.withColumn("level_token", level_token(F.col("experiment"), F.col("level")))


def fits_per_cell(experiment: Experiment) -> int:
    return sum(1 if level == 0 else 2 for level in experiment.levels)


def build_cohort(rows: DataFrame, experiment: Experiment) -> tuple[DataFrame, DataFrame]:
    """Eligible clusters and their first ``cap`` rows in hash order.

    Returns (row cohort with ``selected_rank`` from 0, cluster inventory).
    """
    sizes = rows.groupBy("label", "cluster_id").agg(F.count("*").alias("available_rows"))
    eligible = sizes.filter(F.col("available_rows") >= experiment.min_rows)
    labels = eligible.groupBy("label").agg(F.count("*").alias("eligible_clusters")).filter(
        F.col("eligible_clusters") >= experiment.min_clusters
    )
    inventory = eligible.join(labels, "label").withColumn("q", F.floor(F.col("eligible_clusters") / ROTATIONS))
    candidates = rows.join(inventory.select("label", "cluster_id", "available_rows"), ["label", "cluster_id"])
    token = stable_token("spectrum", experiment.name, F.col("cluster_id"), F.col("row_id"))
    ranked = hash_rank(candidates, ["cluster_id"], token, ["row_id"], "__r").withColumn("selected_rank", F.col("__r") - 1)
    return ranked.filter(F.col("selected_rank") < experiment.cap).drop("__r"), inventory


def cluster_roles(inventory: DataFrame, experiment: Experiment, seeds: Sequence[int]) -> DataFrame:
    """Role of every cluster for every seed and rotation.

    Clusters of a label are cut into five blocks of q in hash order; rotation r evaluates
    block r and keeps block r + 1 as donors. The rest trains. ``pair_rank`` lines up
    evaluation and donor clusters.
    """
    seeded = inventory.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    token = stable_token("strain", experiment.name, F.col("seed"), F.col("label"), F.col("cluster_id"))
    ranked = hash_rank(seeded, ["seed", "label"], token, ["cluster_id"], "__r")
    ranked = ranked.withColumn("cluster_rank", F.col("__r") - 1).drop("__r").withColumn(
        "block", F.when(F.col("cluster_rank") < ROTATIONS * F.col("q"), F.floor(F.col("cluster_rank") / F.col("q"))).otherwise(-1)
    )
    rotated = ranked.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(ROTATIONS - 1))))
    role = F.when(F.col("block") == F.col("rotation"), "evaluation").when(
        F.col("block") == (F.col("rotation") + 1) % ROTATIONS, "donor").otherwise("baseline_train")
    return rotated.select(
        F.lit(experiment.name).alias("experiment"), "seed", "rotation", "label", "cluster_id", "available_rows",
        "eligible_clusters", "q", "cluster_rank", F.col("block").cast("int").alias("block"), role.alias("cluster_role"),
        F.when(role != "baseline_train", F.col("cluster_rank") % F.col("q")).alias("pair_rank"),
    )


def build_pairs(roles: DataFrame) -> DataFrame:
    """Evaluation cluster and donor cluster of equal rank within a label: an equi-join on the rank."""
    at = [*CELL, "label", "pair_rank"]
    side = lambda role, name: roles.filter(F.col("cluster_role") == role).select(*at, F.col("cluster_id").alias(name))
    pairs = side("evaluation", "evaluation_cluster").join(side("donor", "donor_cluster"), at)
    return pairs.select(
        "*",
        F.substring(stable_token("pair", *[F.col(c) for c in CELL], F.col("label"), F.col("evaluation_cluster"),
                                 F.col("donor_cluster")), 1, 20).alias("pair_id"),
        stable_token("exposure", *[F.col(c) for c in CELL], F.col("evaluation_cluster")).alias("exposure_hash"),
    )


def assign_rows(cohort: DataFrame, roles: DataFrame, pairs: DataFrame, experiment: Experiment) -> DataFrame:
    """Role of every cohort row in every cell."""
    both = pairs.select(
        *CELL, "pair_id", F.explode(F.array("evaluation_cluster", "donor_cluster")).alias("cluster_id")
    )
    joined = cohort.select("row_id", "cluster_id", "label", "selected_rank").join(roles, ["label", "cluster_id"])
    joined = joined.join(both, [*CELL, "cluster_id"], "left")
    rank = F.col("selected_rank")
    row_role = (
        F.when(F.col("cluster_role") == "evaluation",
               F.when(rank == 0, "evaluation_query").otherwise("same_cluster_candidate"))
        .when(F.col("cluster_role") == "donor",
              F.when(rank < experiment.cap - 1, "donor_candidate").otherwise("donor_unused"))
        .otherwise("baseline_train")
    )
    return joined.withColumn("row_role", row_role)


def assignment_violations(assignments: DataFrame, pairs: DataFrame, experiment: Experiment) -> DataFrame:
    """Breaches of the assignment rules, ``(experiment, seed, rotation, item, rule)``."""
    cell = list(CELL)
    out = lambda df, item, rule: df.select(*cell, item.cast("string").alias("item"), F.lit(rule).alias("rule"))
    of = lambda role: F.sum((F.col("row_role") == role).cast("int"))
    per = assignments.groupBy(*cell, "cluster_id").agg(
        F.countDistinct("cluster_role").alias("roles"), F.countDistinct("label").alias("labels"), F.count("*").alias("n"),
        F.min("cluster_role").alias("role"), F.min("label").alias("label"), of("evaluation_query").alias("queries"),
        of("same_cluster_candidate").alias("same"), of("donor_candidate").alias("donors"),
    )
    want = experiment.cap - 1
    repeated = assignments.groupBy(*cell, "row_id").count().filter("count > 1")
    paired = pairs.select(*cell, "pair_id", F.col("evaluation_cluster").alias("e"), F.col("donor_cluster").alias("d"))
    role_of = lambda name, label: per.select(*cell, F.col("cluster_id").alias(name), F.col("role").alias(f"{name}_role"),
                                             F.col("label").alias(label))
    checked = paired.join(role_of("e", "el"), [*cell, "e"], "left").join(role_of("d", "dl"), [*cell, "d"], "left")
    unpaired = per.filter("role IN ('evaluation', 'donor')").join(
        paired.select(*cell, F.explode(F.array("e", "d")).alias("cluster_id")), [*cell, "cluster_id"], "left_anti"
    )
    cluster = F.col("cluster_id")
    parts = [
        out(repeated, F.col("row_id"), "repeated row"),
        out(per.filter("roles > 1"), cluster, "cluster in several roles"),
        out(per.filter("labels > 1"), cluster, "cluster with several labels"),
        out(per.filter(F.col("n") != experiment.cap), cluster, "row cap differs"),
        out(per.filter("role = 'evaluation' AND queries != 1"), cluster, "not exactly one query"),
        out(per.filter((F.col("role") == "evaluation") & (F.col("same") != want)), cluster, "candidate count"),
        out(per.filter((F.col("role") == "donor") & (F.col("donors") != want)), cluster, "donor count"),
        out(unpaired, cluster, "cluster without a pair"),
        out(checked.filter("e = d"), F.col("pair_id"), "cluster paired with itself"),
        out(checked.filter("NOT (el <=> dl)"), F.col("pair_id"), "pair across labels"),
        out(checked.filter("NOT (e_role <=> 'evaluation')"), F.col("pair_id"), "evaluation side has another role"),
        out(checked.filter("NOT (d_role <=> 'donor')"), F.col("pair_id"), "donor side has another role"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def exposure_order(pairs: DataFrame) -> DataFrame:
    """Add ``pair_order`` (from 0, by exposure hash) and ``n_pairs`` per cell."""
    position = hash_fraction(F.col("exposure_hash"))
    ranked = rank_in_group(pairs, CELL, ["exposure_hash", "pair_id"], position, "__r", "n_pairs")
    return ranked.withColumn("pair_order", F.col("__r") - 1).drop("__r")


def prevalence_violations(pairs: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Cells where a prevalence is not a whole number of pairs."""
    sizes = pairs.groupBy(*CELL).agg(F.count("*").alias("n_pairs"))
    exact = F.col("level") * F.col("n_pairs")
    return sizes.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).filter(
        F.abs(exact - F.round(exact)) > 1e-10
    )


def exposed_pairs(pairs: DataFrame, experiment: Experiment, exact: bool = True) -> DataFrame:
    """``(cell, level, pair..., rows_per_pair)``: the pairs that receive injections at each level.

    Prevalence takes a growing prefix of the exposure order; intensity takes every pair
    and varies the rows per pair. ``exact=False`` floors a fractional prefix.
    """
    positive = [float(x) for x in experiment.levels if x > 0]
    if experiment.name == "prevalence" and exact:
        from kinfold.schema import assert_empty

        assert_empty(prevalence_violations(pairs, positive), "prevalence is not a whole number of pairs")
    ordered = exposure_order(pairs).withColumn("level", F.explode(F.array(*[F.lit(x) for x in positive])))
    if experiment.name == "prevalence":
        limit = F.floor(F.col("level") * F.col("n_pairs") + F.lit(1e-9))
        return ordered.filter(F.col("pair_order") < limit).withColumn("rows_per_pair", F.lit(1))
    return ordered.withColumn("rows_per_pair", F.col("level").cast("int"))


def injections(assignments: DataFrame, exposed: DataFrame) -> DataFrame:
    """Rows injected into training per cell, level and arm.

    Leakage takes the evaluation cluster's own rows after its query (rank offset 1); the
    matched control takes the donor's rows from rank 0. Lower levels are subsets of higher ones.
    """
    pairs = exposed.select(
        *CELL, "level", "pair_id", "pair_order", "rows_per_pair",
        F.explode(F.array(
            F.struct(F.lit("leakage").alias("arm"), F.col("evaluation_cluster").alias("cluster_id"), F.lit(1).alias("offset")),
            F.struct(F.lit("matched_control").alias("arm"), F.col("donor_cluster").alias("cluster_id"), F.lit(0).alias("offset")),
        )).alias("a"),
    ).select(*CELL, "level", "pair_id", "pair_order", "rows_per_pair", "a.*")
    candidates = assignments.filter(F.col("row_role").isin("same_cluster_candidate", "donor_candidate")).select(
        *CELL, "pair_id", "cluster_id", "row_id", "label", "selected_rank"
    )
    joined = candidates.join(pairs, [*CELL, "pair_id", "cluster_id"]).withColumn(
        "candidate_rank", F.col("selected_rank") - F.col("offset")
    )
    return joined.filter(F.col("candidate_rank") < F.col("rows_per_pair")).select(
        *CELL, "level", "arm", "pair_id", "pair_order", "candidate_rank", "row_id", "cluster_id", "label"
    )


def condition_violations(injected: DataFrame, assignments: DataFrame) -> DataFrame:
    """Unequal arms, unequal label composition, injected queries, unquarantined donors."""
    cell = [*CELL, "level"]
    arm = lambda name: F.sum((F.col("arm") == name).cast("int"))
    out = lambda df, item, rule: df.select(*cell, item.cast("string").alias("item"), F.lit(rule).alias("rule"))
    size = injected.groupBy(*cell).agg(arm("leakage").alias("a"), arm("matched_control").alias("b")).filter("a != b")
    mix = injected.groupBy(*cell, "label").agg(arm("leakage").alias("a"), arm("matched_control").alias("b")).filter("a != b")
    queries = assignments.filter(F.col("row_role") == "evaluation_query").select(*CELL, "row_id")
    queried = injected.join(queries, [*CELL, "row_id"], "left_semi")
    roles = assignments.groupBy(*CELL, "cluster_id").agg(F.countDistinct("cluster_role").alias("n")).filter("n > 1")
    loose = injected.filter("arm = 'matched_control'").join(roles, [*CELL, "cluster_id"], "left_semi")
    return (
        out(size, F.lit(""), "arms differ in size")
        .unionByName(out(mix, F.col("label"), "arms differ in composition"))
        .unionByName(out(queried, F.col("row_id"), "query injected"))
        .unionByName(out(loose, F.col("cluster_id"), "donor not quarantined"))
    )


def training_rows(assignments: DataFrame, injected: DataFrame, conditions: DataFrame) -> DataFrame:
    """Baseline rows plus injections for every condition: ``(cell, level, arm, row_id, cluster_id, label)``.

    ``conditions`` has one row per (experiment, level, arm), a dozen at most.
    """
    columns = [*CELL, "level", "arm", "row_id", "cluster_id", "label"]
    baseline = assignments.filter(F.col("row_role") == "baseline_train").join(
        F.broadcast(conditions.select("experiment", "level", "arm")), "experiment"
    )
    return baseline.select(*columns).unionByName(injected.select(*columns))


def training_violations(training: DataFrame) -> DataFrame:
    return training.groupBy(*CELL, "level", "arm", "row_id").count().filter("count > 1")


def pair_predictions(predictions: DataFrame) -> DataFrame:
    """Leakage and matched-control predictions of the same query side by side.

    One conditional aggregation over the nine identifying columns instead of a self-join.
    """
    keys = [*CELL, "level", "level_token", "pair_id", "row_id", "cluster_id", "label"]
    pick = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("predicted")))
    return predictions.filter(F.col("arm").isin("leakage", "matched_control")).groupBy(*keys).agg(
        pick("leakage").alias("predicted_leakage"), pick("matched_control").alias("predicted_control")
    ).filter("predicted_leakage IS NOT NULL AND predicted_control IS NOT NULL")


ARMS = {"leakage": "predicted_leakage", "control": "predicted_control"}


def cell_contrasts(paired: DataFrame) -> DataFrame:
    """macro-F1 and accuracy of both arms and their difference, per cell and level."""
    keys = [*CELL, "level", "level_token"]
    counts = paired.groupBy(*keys).agg(F.count("*").alias("n_pairs"))
    return _null_safe_join(counts, paired_scores(paired, keys, ARMS), keys)


def cluster_bootstrap(paired: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Label-stratified paired cluster bootstrap per (experiment, level)."""
    return paired_f1(paired, ARMS, replicates, seed, ["experiment", "level", "level_token"])


def plan_counts(inventory: DataFrame, experiment: Experiment, n_seeds: int) -> DataFrame:
    """Planned workload: eligible clusters, evaluation and donor clusters, fits."""
    return inventory.agg(
        F.count("*").alias("eligible_clusters"), F.countDistinct("label").alias("eligible_labels"),
        F.sum(F.col("available_rows")).alias("available_rows"),
    ).join(
        F.broadcast(inventory.groupBy("label").agg(F.first("q").alias("q")).agg(F.sum("q").alias("evaluation_clusters"))),
        F.lit(True),
    ).select(
        F.lit(experiment.name).alias("experiment"), "eligible_labels", "eligible_clusters", "available_rows",
        "evaluation_clusters", F.col("evaluation_clusters").alias("donor_clusters"),
        F.lit(n_seeds * ROTATIONS).alias("cells"), F.lit(n_seeds * ROTATIONS * fits_per_cell(experiment)).alias("fits"),
    )


def dose_plan(test_rows: DataFrame, doses: Sequence[float], keys: Sequence[str] = ("seed", "fold")) -> tuple[DataFrame, DataFrame]:
    """Dose response: per test cluster the first row in hash order evaluates, ceil(dose x rest) are injected.

    Returns (evaluation rows, injections with ``dose``); clusters with one row are left out.
    """
    keys = list(keys)
    token = hash_key(*[F.col(k) for k in keys], F.col("row_id"))
    sized = hash_rank(test_rows, [*keys, "cluster_id"], token, ["row_id"], "__r", "__n").filter(F.col("__n") >= 2)
    evaluation = sized.filter(F.col("__r") == 1).drop("__r", "__n")
    dosed = sized.filter(F.col("__r") > 1).withColumn("dose", F.explode(F.array(*[F.lit(float(d)) for d in doses])))
    injected = dosed.filter((F.col("dose") > 0) & (F.col("__r") - 1 <= F.ceil((F.col("__n") - 1) * F.col("dose"))))
    return evaluation, injected.drop("__r", "__n")


def condition_scores(predictions: DataFrame) -> DataFrame:
    """Metric row per condition."""
    return classification_scores(predictions, [*CELL, "level", "arm"])
