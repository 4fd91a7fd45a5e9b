"""Records to an audited manifest: label and cluster resolution, QC, duplicates, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as tx
from kinfold.functions.hashing import hash_key, stable_id
from kinfold.operators.ranking import hash_fraction, rank_in_group
from kinfold.schema import require_columns

# fixed values: flag, reason and membership names
ZERO_PEAKS = "zero-peaks"
CONFLICT_FLAG = "cmt-identity-conflict"
UNRESOLVED = "unresolved-taxonomy"
DUPLICATE = "exact_raw_duplicate"


def attach_metadata(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """One-to-one left join on ``source_key``; ``metadata_found`` tells whether a row was covered."""
    require_columns(records, ["source_key"], "records")
    require_columns(metadata, ["source_key"], "metadata")
    return records.join(metadata.withColumn("metadata_found", F.lit(True)), "source_key", "left").withColumn(
        "metadata_found", F.coalesce("metadata_found", F.lit(False))
    )


def metadata_violations(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """Keys that would break the one-to-one join: repeated on a side, or without metadata."""
    repeated = lambda df, name: df.groupBy("source_key").count().filter("count > 1").select(
        "source_key", F.lit(name).alias("problem")
    )
    uncovered = records.select("source_key").distinct().join(metadata, "source_key", "left_anti").select(
        "source_key", F.lit("no metadata").alias("problem")
    )
    return repeated(records, "repeated record").unionByName(repeated(metadata, "repeated metadata")).unionByName(uncovered)


def resolve_alias(df: DataFrame, aliases: DataFrame, column: str, out: str) -> DataFrame:
    """Canonical name where an alias exists, the name itself otherwise."""
    lookup = aliases.select(F.col("alias").alias("__alias"), F.col("canonical").alias("__canonical"))
    return (
        df.join(lookup, F.col(column) == F.col("__alias"), "left")
        .withColumn(out, F.coalesce("__canonical", F.col(column)))
        .drop("__alias", "__canonical")
    )


def match_longest_prefix(names: DataFrame, labels: DataFrame, name: str, label: str, out: str = "matched") -> DataFrame:
    """Longest label that equals the name or is followed in it by a blank, ignoring case.

    Every word-boundary prefix of a name is a lookup key, so this is an equi-join on
    text with as many probes as the name has blanks, whatever the number of labels.
    """
    words = F.split(F.lower(F.col(name)), " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    distinct = names.select(name).distinct()
    probes = distinct.select(name, F.explode(prefixes).alias("__key"))
    keyed = labels.select(F.lower(F.col(label)).alias("__key"), F.col(label).alias("__label")).distinct()
    best = probes.join(keyed, "__key").groupBy(name).agg(
        F.min(F.struct(-F.length("__label"), F.col("__label"))).getField("__label").alias(out)
    )
    return names.join(best, name, "left")


def match_longest_substring(paths: DataFrame, names: DataFrame, path: str, name: str, out: str = "matched") -> DataFrame:
    """Longest name contained in the normalised path, ignoring case.

    Names are grouped by length; a path is probed with its own substrings of exactly
    those lengths, again as an equi-join on text. Probes per path are bounded by
    path length x number of distinct name lengths.
    """
    wanted = names.select(tx.fold_case(F.col(name)).alias("__key"), F.col(name).alias("__name")).distinct()
    lengths = wanted.agg(F.collect_set(F.length("__key")).alias("__lengths"))
    haystack = tx.fold_label(F.col(path))
    texts = paths.select(path).distinct().withColumn("__text", haystack)
    probes = (
        texts.join(F.broadcast(lengths), F.lit(True))
        .select(path, "__text", F.explode("__lengths").alias("__len"))
        .filter((F.col("__len") > 0) & (F.col("__len") <= F.length("__text")))
        .select(
            path,
            F.explode(
                F.array_distinct(
                    F.transform(
                        F.sequence(F.lit(1), F.length("__text") - F.col("__len") + 1),
                        lambda i: F.substring(F.col("__text"), i, F.col("__len")),
                    )
                )
            ).alias("__key"),
        )
    )
    best = probes.join(wanted, "__key").groupBy(path).agg(
        F.min(F.struct(-F.length("__name"), F.col("__name"))).getField("__name").alias(out)
    )
    return paths.join(best, path, "left")


def resolve_clusters(records: DataFrame, names: DataFrame) -> DataFrame:
    """Cluster name by three tries: directory + strain text, genus + epithet + strain text, path.

    ``records``: source_path, genus, epithet, strain, directory_label (normalised text).
    ``names``: name. Adds ``cluster_name``.
    """
    catalogue = names.select(tx.fold_label(F.col("name")).alias("__key"), F.col("name")).groupBy(
        "__key").agg(F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("__name"))
    parts = lambda *columns: tx.fold_label(F.concat_ws(" ", *[F.when(F.length(c) > 0, F.col(c)) for c in columns]))
    first = catalogue.select(F.col("__key").alias("__k1"), F.col("__name").alias("__n1"))
    second = catalogue.select(F.col("__key").alias("__k2"), F.col("__name").alias("__n2"))
    keyed = records.withColumn("__k1", parts("directory_label", "strain")).withColumn(
        "__k2", parts("genus", "epithet", "strain")
    )
    tried = keyed.join(first, "__k1", "left").join(second, "__k2", "left")
    tried = match_longest_substring(tried, names, "source_path", "name", "__n3")
    return tried.withColumn("cluster_name", F.coalesce("__n1", "__n2", "__n3")).drop(
        "__k1", "__k2", "__n1", "__n2", "__n3"
    )


def ordinal_in_group(df: DataFrame, group: str, ordinal: str, out: str, **limits) -> DataFrame:
    """1-based position within the group in file order (``ordinal`` is a unique number).

    A hot group is cut on the ordinal's place in the group's own range.
    """
    return rank_in_group(df, [group], [ordinal], ordinal, out, **limits)


def pair_by_position(left: DataFrame, right: DataFrame, group: str, left_order: str, right_order: str,
                     value: str, out: str) -> DataFrame:
    """The i-th left row of a group gets the i-th right value of that group; surplus rows get NULL."""
    ranked_left = ordinal_in_group(left, group, left_order, "__i")
    ranked_right = ordinal_in_group(right, group, right_order, "__i").select(group, "__i", F.col(value).alias(out))
    return ranked_left.join(ranked_right, [group, "__i"], "left").drop("__i")


def identity_conflicts(records: DataFrame) -> DataFrame:
    """Flag every row of a cluster that carries more than one identity."""
    conflicts = (
        records.filter(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id").agg(F.countDistinct("identity").alias("__n")).filter("__n > 1")
        .select("cluster_id", F.lit(True).alias("identity_conflict"))
    )
    return records.join(conflicts, "cluster_id", "left").withColumn(
        "identity_conflict", F.coalesce("identity_conflict", F.lit(False))
    )


def qc_flags(peak_count: Column, conflict: Column) -> Column:
    return F.concat_ws(
        ";",
        F.when(F.coalesce(peak_count, F.lit(0)) == 0, F.lit(ZERO_PEAKS)),
        F.when(F.coalesce(conflict, F.lit(False)), F.lit(CONFLICT_FLAG)),
    )


def mark_duplicates(records: DataFrame, digest: str = "digest", out: str = "duplicate") -> DataFrame:
    """All but the smallest ``row_id`` of each digest; every record counts, kept or not.

    The survivor of a digest is a minimum, so a digest shared by a third of the table
    needs no window: it is one partial aggregate per task.
    """
    first = records.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.min("row_id").alias("__first"))
    return records.join(first, digest, "left").withColumn(
        out, F.col(digest).isNotNull() & (F.col("row_id") != F.col("__first"))
    ).drop("__first")


def apply_inclusion(records: DataFrame, digest_required: bool = True) -> DataFrame:
    """Add ``included`` and ``exclusion_reason``; a later reason overrides an earlier one.

    A row dropped only because its digest is missing keeps an empty reason.
    """
    require_columns(records, ["row_id", "cluster_id", "taxonomy_status", "peak_count", "digest"], "records")
    marked = mark_duplicates(records)
    no_peaks = F.coalesce(F.col("peak_count"), F.lit(0)) == 0
    digest_ok = F.col("digest").isNotNull() if digest_required else F.lit(True)
    return marked.withColumn(
        "included", (F.col("taxonomy_status") == "matched") & ~no_peaks & digest_ok & ~F.col("duplicate")
    ).withColumn(
        "exclusion_reason",
        F.when(F.col("duplicate"), DUPLICATE)
        .when(no_peaks, ZERO_PEAKS)
        .when(F.col("taxonomy_status") == "unresolved", UNRESOLVED)
        .otherwise(""),
    ).drop("duplicate")


def assign_sets(manifest: DataFrame, known_min: int = 5, sensitivity_min: int = 3) -> DataFrame:
    """Known / out-of-distribution membership from the number of clusters per label.

    The primary and the sensitivity scheme overlap on purpose, hence two booleans.
    A parent is "near" when some known label belongs to it.
    """
    require_columns(manifest, ["cluster_id", "label", "parent"], "manifest")
    counts = manifest.filter(F.col("label").isNotNull()).groupBy("label").agg(
        F.countDistinct("cluster_id").cast("int").alias("label_cluster_count")
    )
    sized = manifest.join(counts, "label", "left").withColumn(
        "label_cluster_count", F.coalesce("label_cluster_count", F.lit(0))
    )
    known_parents = (
        sized.filter((F.col("label_cluster_count") >= known_min) & F.col("parent").isNotNull())
        .groupBy("parent").agg(F.lit(True).alias("__near"))
    )
    known = F.col("label_cluster_count") >= known_min
    return (
        sized.join(known_parents, "parent", "left")
        .withColumn("primary_known", known)
        .withColumn("primary_ood", ~known)
        .withColumn("sensitivity_known", F.col("label_cluster_count") >= sensitivity_min)
        .withColumn("analysis_set", F.when(known, "primary_known").otherwise("ood"))
        .withColumn("ood_distance", F.when(~known, F.when(F.col("__near"), "near").otherwise("far")))
        .withColumn("ood_singleton", ~known & (F.col("label_cluster_count") == 1))
        .drop("__near")
    )


def finish_manifest(records: DataFrame, known_min: int = 5, sensitivity_min: int = 3) -> DataFrame:
    """Membership for included rows, neutral values for the rest."""
    included = assign_sets(records.filter("included"), known_min, sensitivity_min)
    excluded = records.filter("NOT included").select(
        "*",
        F.lit(0).alias("label_cluster_count"), F.lit("excluded").alias("analysis_set"),
        *[F.lit(False).alias(c) for c in ("primary_known", "primary_ood", "sensitivity_known", "ood_singleton")],
        F.lit(None).cast("string").alias("ood_distance"),
    )
    return included.unionByName(excluded, allowMissingColumns=True)


def label_counts(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """Observed clusters and rows for every declared label, zero where none was seen."""
    seen = rows.groupBy("label").agg(
        F.countDistinct("cluster_id").alias("observed_clusters"), F.count("row_id").alias("observed_rows")
    )
    return labels.join(seen, "label", "left").fillna(0, ["observed_clusters", "observed_rows"])


def dataset_summary(manifest: DataFrame) -> DataFrame:
    """One row of counts over the whole manifest."""
    distinct_if = lambda rule, column: F.countDistinct(F.when(rule, F.col(column)))
    known = F.col("analysis_set") == "primary_known"
    return manifest.agg(
        F.count("*").alias("rows"),
        F.countDistinct("cluster_id").alias("clusters"),
        F.countDistinct("label").alias("labels"),
        F.countDistinct("parent").alias("parents"),
        F.sum(F.when(F.col("label").isNull(), 1).otherwise(0)).alias("unresolved_rows"),
        distinct_if(known, "label").alias("known_labels"),
        distinct_if(known, "cluster_id").alias("known_clusters"),
        distinct_if(F.col("sensitivity_known"), "label").alias("sensitivity_known_labels"),
        distinct_if(F.col("analysis_set") == "ood", "label").alias("ood_labels"),
        distinct_if(F.col("ood_singleton"), "label").alias("singleton_ood_labels"),
    )


def fold_distance(rows: DataFrame, train: DataFrame, keys: list[str], out: str = "ood_distance") -> DataFrame:
    """near / far decided against the parents this very fold was trained on."""
    fitted = train.filter(F.col("parent").isNotNull()).select(*keys, "parent").distinct().withColumn("__fit", F.lit(True))
    return rows.join(fitted, [*keys, "parent"], "left").withColumn(
        out, F.when(F.col("__fit"), "near").otherwise("far")
    ).drop("__fit")


def keep_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def exclude_clusters(df: DataFrame, excluded: DataFrame) -> DataFrame:
    return df.join(excluded.select("cluster_id").distinct(), "cluster_id", "left_anti")


def cluster_ids(paths: Column) -> Column:
    return stable_id(paths, prefix="strain_")


def hash_sample(df: DataFrame, keys: list[str], n: int, *parts: Column, tie: list[str]) -> DataFrame:
    """The first ``n`` rows of each group in hash order (the sampling operator)."""
    tokened = df.withColumn("__token", hash_key(*parts))
    ranked = rank_in_group(tokened, keys, ["__token", *tie], hash_fraction(F.col("__token")), "sample_rank")
    return ranked.filter(F.col("sample_rank") <= n).drop("__token")
