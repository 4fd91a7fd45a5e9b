"""Raw tables to a manifest, a taxonomy summary and a feature bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.config import Study
from kinfold.functions import text as tx
from kinfold.operators import features as ft
from kinfold.operators import manifest as mf
from kinfold.schema import assert_empty, require_columns
from kinfold.sources.writers import write_bundle


def taxonomy_tables(listing: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``listing``: ordinal, name (one line per row). ``labels``: label, declared_clusters.

    Returns (rows with label, parent, cluster and replicate ordinal; label counts).
    """
    named = listing.withColumn("cluster_name", tx.normalize_label(F.col("name"))).filter(F.length("cluster_name") > 0)
    matched = mf.match_longest_prefix(named, labels, "cluster_name", "label", "label")
    rows = matched.select(
        "ordinal", F.format_string("row_%06d", "ordinal").alias("row_id"), "cluster_name",
        mf.cluster_ids(F.col("cluster_name")).alias("cluster_id"), "label", tx.first_token(F.col("label")).alias("parent"),
        F.when(F.col("label").isNotNull(), "matched").otherwise("unresolved").alias("taxonomy_status"),
    )
    rows = mf.ordinal_in_group(rows, "cluster_name", "ordinal", "replicate_ordinal")
    return rows, mf.label_counts(labels, rows)


def taxonomy_summary(listing: DataFrame, labels: DataFrame, study: Study) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership, label counts and the one-row summary, from names alone."""
    rows, counts = taxonomy_tables(listing, labels)
    manifest = mf.assign_sets(rows, study.known_min_clusters, study.sensitivity_min_clusters)
    return manifest, counts, mf.dataset_summary(manifest)


def build_manifest(records: DataFrame, metadata: DataFrame, aliases: DataFrame, labels: DataFrame, digests: DataFrame,
                   study: Study, check: bool = True) -> DataFrame:
    """Join records with their metadata, resolve labels and clusters, audit, dedupe, assign sets.

    ``records``: row_id, source_path, peak_count. ``metadata``: source_key,
    archive_spectrum_dir, folder_species, folder_measurement, gen, spe, str, uie, uid.
    ``digests``: source_path, digest.
    """
    require_columns(records, ["row_id", "source_path", "peak_count"], "records")
    keyed = records.withColumn("source_key", tx.forward_slashes(F.col("source_path")))
    if check:
        assert_empty(mf.metadata_violations(keyed, metadata), "metadata does not cover the records one to one")
    joined = mf.attach_metadata(keyed, metadata).join(digests, "source_path", "left")
    joined = joined.withColumn("directory_label", tx.normalize_label(F.col("folder_species")))
    named = mf.resolve_alias(joined, aliases, "directory_label", "label")
    known = labels.select("label").distinct().withColumn("__known", F.lit(True))
    ready = named.join(known, "label", "left").select(
        "row_id", "source_path", "peak_count", "digest", "label", tx.first_token(F.col("label")).alias("parent"),
        mf.cluster_ids(tx.group_path(F.col("archive_spectrum_dir"), F.col("folder_measurement"))).alias("cluster_id"),
        F.when(F.col("__known"), "matched").otherwise("unresolved").alias("taxonomy_status"),
        tx.identity_string(*[tx.normalize_label(F.col(c)) for c in ("gen", "spe", "str")]).alias("identity"),
        tx.taxonomy_number(F.col("uie"), F.col("uid")).alias("taxid"),
    )
    flagged = mf.identity_conflicts(ready).withColumn("qc_flags", mf.qc_flags(F.col("peak_count"), F.col("identity_conflict")))
    return mf.finish_manifest(mf.apply_inclusion(flagged), study.known_min_clusters, study.sensitivity_min_clusters)


def prepare_features(peaks: DataFrame, manifest: DataFrame, study: Study, path: str) -> None:
    """Bin and normalise the included rows, check the row sums of what was written, store the bundle."""
    rows = manifest.filter("included") if "included" in manifest.columns else manifest
    features = ft.bin_peaks(peaks, mass_min=study.mass_min, mass_max=study.mass_max, bin_width=study.bin_width, rows=rows)
    settings = {"mass_min": study.mass_min, "mass_max": study.mass_max, "bin_width": study.bin_width}
    write_bundle(features, rows, path, study.bins, settings)
    stored = features.sparkSession.read.parquet(f"{path}/features")
    assert_empty(ft.row_sum_violations(stored), "feature rows do not sum to one")
