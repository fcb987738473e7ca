"""Queue filter, candidate selection, and the category derivation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.fixed_values import (
    AOSP_NAMESPACES,
    AOSP_TEST_KEY_MARKER,
    EMULATOR_MARKERS,
    GENERATED_OVERLAY_MARKER,
    OEM_ISSUER_ORGS,
    OEM_NAME_TOKENS,
    RETRYABLE_STATUSES,
    UNKNOWN,
    VERDICTS,
)
from corpus_spark.functions.canonical import description_digest


def is_emulator(device_key: Column) -> Column:
    """Whether the device half of a `<driver>:<device>` key names an emulator image."""
    tail = F.when(
        F.contains(device_key, F.lit(":")),
        F.substring(device_key, F.instr(device_key, ":") + 1, F.length(device_key)),
    ).otherwise("")
    device = F.lower(F.coalesce(F.nullif(tail, F.lit("")), device_key))
    hits = [F.contains(device, F.lit(m)) for m in EMULATOR_MARKERS]
    found = hits[0]
    for hit in hits[1:]:
        found = found | hit
    return found


def filter_verdicts(corpus: DataFrame, reference: DataFrame) -> DataFrame:
    """(package, filter_verdict, queued, listed): the first rule that fires. `corpus` has `emulators_only` (see
    `devices.device_profiles`), or the array `devices` where rows were merged already."""
    listed = reference.select("package").distinct().withColumn("listed", F.lit(True))
    profiled = "emulators_only" in corpus.columns
    emulated = F.col("emulators_only") if profiled else (F.size("devices") > 0) & F.forall("devices", is_emulator)
    verdict = (
        F.when(F.col("listed"), "already_upstream")
        .when(F.contains(F.col("package"), F.lit(GENERATED_OVERLAY_MARKER)), "auto_generated_rro")
        .when(emulated, "emulator_only")
        .otherwise("queued")
    )
    return (
        corpus.select("package", "emulators_only" if profiled else "devices")
        .join(listed, "package", "left")
        .select("package", verdict.alias("filter_verdict"))
        .withColumn("listed", F.col("filter_verdict") == "already_upstream")
        .withColumn("queued", F.col("filter_verdict") == "queued")
    )


def survival(verdicts: DataFrame) -> DataFrame:
    """Package count per verdict, zeros and the total included; one partial aggregate."""
    counted = verdicts.agg(
        F.array(
            *[
                F.struct(F.lit(v).alias("verdict"), F.count_if(F.col("filter_verdict") == v).alias("packages"))
                for v in VERDICTS
            ],
            F.struct(F.lit("total").alias("verdict"), F.count(F.lit(1)).alias("packages")),
        ).alias("rows")
    )
    return counted.select(F.inline("rows"))


def not_listed(corpus: DataFrame, reference: DataFrame) -> DataFrame:
    return corpus.join(reference.select("package"), "package", "left_anti")


def derive_category(package: Column, cert_issuer: Column, partitions: Column) -> Column:
    """struct(category, rule, detail); category NULL means no rule decides."""
    segments = F.split(F.lower(package), r"\.")
    tokens = F.array(*[F.lit(t) for t in OEM_NAME_TOKENS])
    matched = F.sort_array(F.array_intersect(segments, tokens))
    issuer = F.lower(F.coalesce(cert_issuer, F.lit("")))
    orgs = F.filter(F.array(*[F.lit(o) for o in OEM_ISSUER_ORGS]), lambda o: F.contains(issuer, o))
    in_namespace = package.startswith(AOSP_NAMESPACES[0]) | package.startswith(AOSP_NAMESPACES[1])
    shipped = F.array_join(F.sort_array(F.coalesce(partitions, F.array().cast("array<string>"))), ", ")

    def outcome(category: Column, rule: str, detail: Column) -> Column:
        return F.struct(category.alias("category"), F.lit(rule).alias("rule"), detail.alias("detail"))

    return (
        F.when(
            F.size(matched) > 0,
            outcome(
                F.lit("Oem"),
                "rule:oem_name_token",
                F.concat(F.lit("package name carries the vendor segment(s) "), F.array_join(matched, ", ")),
            ),
        )
        .when(
            F.size(orgs) > 0,
            outcome(
                F.lit("Oem"),
                "rule:oem_cert_issuer",
                F.concat(F.lit("signing organization names the vendor ("), orgs[0], F.lit(")")),
            ),
        )
        .when(
            F.contains(issuer, F.lit(AOSP_TEST_KEY_MARKER)) & in_namespace,
            outcome(
                F.lit("Aosp"),
                "rule:aosp_platform_key",
                F.lit("signed with the AOSP test key and in the AOSP namespace"),
            ),
        )
        .otherwise(
            outcome(
                F.lit(None).cast("string"),
                "llm:list",
                F.concat(
                    F.lit("no deterministic rule decided this package (partitions: "),
                    F.coalesce(F.nullif(shipped, F.lit("")), F.lit("none")),
                    F.lit(")"),
                ),
            )
        )
    )


def proposal_candidates(
    bundles: DataFrame,
    analysis: DataFrame,
    stored: DataFrame,
    packages: DataFrame | None = None,
    reclassify: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """(package, bundle_sha256) to ask about now: queued or explicitly named, not yet answered for
    this very bundle. A limit takes a name-ordered prefix."""
    if packages is not None:
        wanted = packages.select("package").distinct()
    else:
        wanted = analysis.filter("queued IS TRUE").select("package")
    rows = bundles.select("package", "bundle_sha256").join(wanted, "package", "left_semi")
    if not reclassify:
        answered = stored.select("package", F.col("bundle_sha256").alias("stored_sha256"))
        rows = (
            rows.join(answered, "package", "left")
            .filter(~F.col("bundle_sha256").eqNullSafe(F.col("stored_sha256")))
            .drop("stored_sha256")
        )
    return rows.orderBy("package").limit(limit) if limit is not None else rows


def live_proposals(classification: DataFrame) -> DataFrame:
    """Accepted proposals that make a claim: not parked, described, and not `unknown`."""
    return classification.filter(
        ~F.col("parked") & F.col("description").isNotNull() & (F.col("description") != UNKNOWN)
    ).select("package", "description")


def corroboration_candidates(
    classification: DataFrame,
    verdicts: DataFrame,
    packages: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Live proposals without a verdict, with one for another description, or with a failure."""
    proposals = live_proposals(classification)
    if packages is not None:
        proposals = proposals.join(packages.select("package").distinct(), "package", "left_semi")
    current = description_digest(F.col("package"), F.col("description"))
    known = verdicts.select("package", F.col("description_sha256").alias("judged_sha256"), "status")
    rows = (
        proposals.withColumn("description_sha256", current)
        .join(known, "package", "left")
        .filter(
            F.col("status").isNull()
            | (F.col("judged_sha256") != F.col("description_sha256"))
            | F.col("status").isin(*RETRYABLE_STATUSES)
        )
        .select("package", "description", "description_sha256")
    )
    return rows.orderBy("package").limit(limit) if limit is not None else rows


def fresh_sources(results: DataFrame, cutoff: datetime | str) -> DataFrame:
    """All search rows of packages whose newest row is not older than the cutoff."""
    newest = results.groupBy("package").agg(F.max("fetched_at").alias("newest"))
    fresh = newest.filter(F.col("newest") >= F.lit(cutoff).cast("timestamp_ntz")).select("package")
    return results.join(fresh, "package", "left_semi")
