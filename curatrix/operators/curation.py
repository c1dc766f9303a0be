"""End-to-end gates: curation, preflight of a training manifest, augmentation, external sets and cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import is_blank, is_lower_hex, is_safe_relative_path, is_sha256, normalized_label
from curatrix.operators import dedup, sets, split
from curatrix.operators.classify import exclusion_reason, reference_class, split_excluded
from curatrix.operators.expectations import ExpectationFailed, check, condition, enforce, report, row_checks, single_value_check, unique_check
from curatrix.operators.provenance import manifest_digest


def validate_config(config: Mapping[str, Any]) -> Mapping[str, Any]:
    """A curation document with dataset, columns, label mapping and integrity parts; raises on the first fault."""

    def part(name: str, keys: Sequence[str]) -> Mapping[str, Any]:
        value = config.get(name)
        if not isinstance(value, Mapping):
            raise ExpectationFailed(f"{name} must be a mapping")
        missing = [k for k in keys if value.get(k) in (None, "")]
        if missing:
            raise ExpectationFailed(f"{name} lacks {missing}")
        return value

    if config.get("schema_version") != 1:
        raise ExpectationFailed("schema_version must be 1")
    dataset = part("dataset", ("id", "version", "source_url", "license", "license_url", "attribution"))
    if "expected_images" in dataset and (not isinstance(dataset["expected_images"], int) or dataset["expected_images"] <= 0):
        raise ExpectationFailed("dataset.expected_images must be positive")
    part("columns", ("image", "group"))
    labels = part("label_mapping", ("version", "task", "source_column", "values"))
    values = labels["values"]
    if not isinstance(values, Mapping) or {v.get("target") for v in values.values() if isinstance(v, Mapping)} != {0, 1} or not all(isinstance(v, Mapping) and v.get("label") for v in values.values()):
        raise ExpectationFailed("label_mapping.values must map labels to both targets and a label")
    if len({str(k).strip().lower() for k in values}) != len(values):
        raise ExpectationFailed("label_mapping.values collide when normalised")
    integrity = part("integrity", ("perceptual_hash", "near_duplicate_hamming_threshold") if config.get("integrity", {}).get("near_duplicate_hamming_threshold") else ("perceptual_hash",))
    size = integrity["perceptual_hash"].get("hash_size")
    if not isinstance(size, int) or size < 2 or not 0 <= int(integrity.get("near_duplicate_hamming_threshold", 0)) < size * size:
        raise ExpectationFailed("the near-duplicate threshold must fit the hash width")
    return config


def curate(metadata: DataFrame, files: DataFrame, labels: DataFrame, *, name: str = "image_name", group: str = "group_id", raw_label: str = "source_label", official: DataFrame | None = None, duplicates: str = "exclude_within_group_and_label") -> tuple[DataFrame, DataFrame]:
    """(manifest, exclusions): metadata joined to files (``image_name, sha256, valid``) and labels, with the first reason of each drop.

    Exact duplicates are excluded within group and label; a digest across groups or labels is an error; with 'block' any is.
    """
    from curatrix.operators.classify import map_labels

    rows = map_labels(metadata, raw_label, labels).withColumn(raw_label, normalized_label(F.col(raw_label).cast("string"))).join(files.withColumn("_found", F.lit(True)), name, "left")
    if official is not None:
        enforce(dedup.official_pair_checks(official, metadata, name, group, raw_label))
        rows = rows.join(dedup.official_pair_exclusions(official, name).select(name, F.regexp_extract("reason", ":(.*)", 1).alias("_kept")), name, "left")
    else:
        rows = rows.withColumn("_kept", F.lit(None).cast("string"))
    reason = exclusion_reason(name=F.col(name), found=F.coalesce("_found", F.lit(False)), duplicate_of=F.col("_kept"), group=F.col(group), label=F.col(raw_label), mapped=F.col("target").isNotNull(), valid=F.coalesce("valid", F.lit(False)))
    kept, dropped = split_excluded(rows.withColumn("reason", reason).drop("_found", "_kept"))
    if duplicates == "block":
        enforce(check(dedup.exact_duplicates(kept), "no exact duplicates", F.lit(False), F.col(name)))
        return kept, dropped.select(name, "reason")
    enforce(check(dedup.conflicting_duplicates(kept, (group, raw_label)), "exact duplicates agree in group and label", F.lit(False), F.col("sha256")))
    repeats = dedup.exact_duplicate_exclusions(kept, (group, raw_label), name)
    return kept.join(repeats.select(name), name, "left_anti"), dropped.select(name, "reason").union(repeats.select(name, "reason"))


def split_preconditions(manifest: DataFrame, *, hash_digits: int = 16, folds: int = 2) -> DataFrame:
    """Check rows that a manifest must pass before it is split."""
    name = F.col("image_name")
    groups = manifest.groupBy("target").agg(F.count_distinct("group_id").alias("g"))
    return report(
        [
            unique_check(manifest, "image_name_unique", "image_name"),
            check(manifest, "image_path_safe", is_safe_relative_path("image_path"), name),
            check(manifest, "group_not_blank", ~is_blank("group_id"), name),
            check(manifest, "target_binary", F.col("target").isin(0, 1), name),
            check(manifest, "sha256_valid", is_sha256("sha256"), name),
            check(manifest, "hash_valid", is_lower_hex("perceptual_hash", hash_digits), name),
            check(dedup.exact_duplicates(manifest), "no_exact_duplicates", F.lit(False), name),
            check(groups, "groups_per_target", F.col("g") >= folds, F.col("target").cast("string")),
        ]
    )


def preflight(manifest: DataFrame, links: DataFrame, *, splits: Sequence[str] = ("train", "validation", "test"), hash_digits: int = 16, constants: Sequence[str] = (), files: DataFrame | None = None, digest: str | None = None, declared: Mapping[str, int] | None = None) -> DataFrame:
    """Check rows of a split manifest: keys, formats, splits, targets, leakage, near-duplicate evidence and, with files, contents.

    ``links`` are those of ``near_duplicate_links`` by split, or their totals: pairs are counted, not listed. ``digest`` is the manifest's recorded digest, and
    ``declared`` has the counts that its report states: of images, groups, and of each split by name.
    """
    name = F.col("image_name")
    crossing = links.agg(F.coalesce(F.sum("split_differ"), F.lit(0)).cast("long").alias("n"))
    checks = [
        condition(manifest.agg(F.count("*").alias("n")), "not_empty", F.col("n") > 0),
        unique_check(manifest, "image_name_unique", "image_name"),
        row_checks(
            manifest,
            {
                "image_path_safe": is_safe_relative_path("image_path"),
                "sha256_valid": is_sha256("sha256"),
                "hash_valid": is_lower_hex("perceptual_hash", hash_digits),
                "target_binary": F.col("target").isin(0, 1),
                "split_known": F.col("split").isin(*splits),
                "group_not_blank": ~is_blank("group_id"),
            },
            name,
        ),
        check(split.leaking_groups(manifest, "group_id"), "group_in_one_split", F.lit(False), F.col("group_id")),
        check(split.split_target_counts(manifest, list(splits)), "both_targets_in_split", F.col("n_targets") == 2, F.col("split")),
        check(dedup.exact_duplicates(manifest), "no_exact_duplicates", F.lit(False), name),
        condition(crossing, "no_near_duplicates_across_splits", F.col("n") == 0, F.col("n")),
        *(single_value_check(manifest, f"single_{c}", c) for c in constants),
    ]
    if files is not None:
        found = manifest.select("image_name", F.col("sha256").alias("_want")).join(files.select("image_name", F.col("sha256").alias("_have")), "image_name", "left")
        checks.append(check(found, "content_matches", F.col("_want") == F.col("_have"), name))
    if digest is not None:
        one = manifest.sparkSession.range(1)
        checks.append(condition(one, "digest_matches", F.lit(manifest_digest(manifest) == digest)))
    if declared is not None:
        count_of = {"images": F.count("*"), "groups": F.count_distinct("group_id")}
        seen = expected_counts(manifest, declared, {n: count_of.get(n, F.count_if(F.col("split") == n)) for n in declared})
        checks.append(check(seen, "report_agrees", F.col("ok"), F.col("name")))
    return report(checks)


def augmentation_gate(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Check rows before extra training rows join a manifest: nothing shared, blank patients declared, equal settings."""
    shared = lambda c: sets.overlap(base, extra, c)
    settings = ("perceptual_hash_algorithm", "perceptual_hash_bits", "near_duplicate_hamming_threshold")
    both = base.select(*settings).union(extra.select(*settings))
    return report(
        [
            *(check(shared(c), f"{c}_disjoint", F.lit(False), F.col("key")) for c in ("image_name", "group_id", "patient_id", "sha256")),
            check(extra, "blank_patient_declared", ~is_blank("patient_id") | (F.col("patient_identifier_status") == "unavailable"), F.col("image_name")),
            *(single_value_check(both, f"single_{c}", c) for c in settings),
        ]
    )


def external_card_gate(card: Mapping[str, Any], manifest: DataFrame) -> DataFrame:
    """Check rows of an external set: purpose, training forbidden, and counts as the card says."""
    one = manifest.agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("g"))
    return report(
        [
            condition(one, "purpose_is_evaluation", F.lit(card.get("purpose") == "external_evaluation_only")),
            condition(one, "training_forbidden", F.lit(card.get("training_authorized") is False)),
            condition(one, "records_as_declared", F.col("n") == int(card.get("records", -1))),
            condition(one, "groups_as_declared", F.col("g") == int(card.get("groups", -1))),
        ]
    )


def build_cohort(rows: DataFrame, receipts: DataFrame, excluded: DataFrame, *, fields: Sequence[str], seed: int, fraction: float) -> DataFrame:
    """``image_name, patient_id, lesion_group, class_name, image_sha256, split``: one image for each patient's lesion."""
    classed = rows.withColumn("class_name", reference_class(F.col("diagnosis_confirm_type"), [F.col(f) for f in fields])).where(F.col("class_name").isNotNull())
    enforce(check(classed, "eligible rows have image and patient", ~is_blank("image_name") & ~is_blank("patient_id"), F.col("image_name")))
    left = classed.join(excluded.select("image_name").distinct(), "image_name", "left_anti")
    lesion = F.when(is_blank("lesion_id"), F.col("image_name")).otherwise(F.col("lesion_id"))
    grouped = left.withColumn("lesion_group", lesion).groupBy("patient_id", "lesion_group").agg(F.count_distinct("class_name").alias("_classes"), F.min("class_name").alias("class_name"), F.min("image_name").alias("image_name"))
    enforce(check(grouped, "one class a lesion", F.col("_classes") == 1, F.col("lesion_group")))
    cohort = grouped.join(receipts.select("image_name", F.lower("sha256").alias("image_sha256")), "image_name", "left")
    enforce(check(cohort, "image receipts", is_sha256("image_sha256"), F.col("image_name")))
    return cohort.withColumn("split", split.hash_partition("patient_id", seed, fraction)).drop("_classes")


def collect_oof(plan: DataFrame, predictions: DataFrame, key: str = "record_id") -> DataFrame:
    """Predictions of all folds as one table; raises unless each record of the plan is predicted once, by its own fold's run."""
    enforce(report([unique_check(predictions, "one prediction a record", key), check(plan.join(predictions.select(key), key, "left_anti"), "every record is predicted", F.lit(False), F.col(key).cast("string"))]))
    joined = predictions.join(plan.select(key, F.col("oof_fold").alias("_own")), key, "left")
    enforce(check(joined, "predicted by its own fold", F.col("fold_id") == F.col("_own"), F.col(key).cast("string")))
    return joined.drop("_own")


def license_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def expected_counts(df: DataFrame, expected: Mapping[str, int], columns: Mapping[str, Column]) -> DataFrame:
    """``name, expected, observed, ok`` of named aggregates."""
    seen = df.agg(*(columns[n].cast("long").alias(n) for n in expected))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(int(v)).cast("long").alias("expected"), F.col(n).alias("observed")) for n, v in expected.items()))
    return seen.select(F.inline(rows)).withColumn("ok", F.col("expected") == F.col("observed"))


#: Fixed value: the target that an error type speaks of.
ERROR_TARGETS = {"hard_false_positive": 0, "hard_false_negative": 1}


def priority_checks(priority: DataFrame, training: DataFrame, *, key: str = "image_name", fields: Sequence[str] = ("sha256", "group_id", "collection_id", "target")) -> DataFrame:
    """Check rows for priority records: unique, in the training split, equal to the manifest field by field, and of the target their
    error type says."""
    known = training.select(key, *(F.col(f).cast("string").alias(f"_{f}") for f in fields), F.lit(True).alias("_in"))
    joined = priority.join(known, key, "left")
    wanted = F.element_at(F.create_map(*(F.lit(x) for kv in ERROR_TARGETS.items() for x in kv)), F.col("error_type"))
    name = F.col(key).cast("string")
    return report(
        [
            unique_check(priority, "priority_unique", key),
            unique_check(training, "training_unique", key),
            check(joined, "priority_in_training", F.col("_in").isNotNull(), name),
            *(check(joined.where("_in"), f"{f}_matches", F.col(f).cast("string").eqNullSafe(F.col(f"_{f}")), name) for f in fields),
            check(priority, "error_type_matches_target", F.col("target") == wanted, name),
        ]
    )
