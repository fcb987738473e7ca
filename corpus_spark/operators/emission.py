"""Approved work grouped into per-vendor batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.fixed_values import SHARED_VENDOR
from corpus_spark.functions.text import device_key_parts
from corpus_spark.operators.validation import emission_fault


def approved_details(names: DataFrame, classification: DataFrame, analysis: DataFrame, facts: DataFrame) -> DataFrame:
    """Approved packages with everything an entry needs."""
    return (
        classification.join(names.select("package"), "package", "left_semi")
        .select("package", "description", "target_list", "removal", "bundle_sha256", "model", "parked")
        .join(analysis.select("package", "floor", "dependencies", "needed_by"), "package", "left")
        .join(facts.select("package", "devices"), "package", "left")
    )


def shipping_refusal() -> Column:
    """Why an approved row cannot ship, first reason first, or NULL."""
    return (
        F.when(F.col("parked"), "parked")
        .when(F.col("description").isNull(), "no description")
        .when(F.col("target_list").isNull(), "no list")
        .when(F.col("removal").isNull(), "no removal")
        .when(F.col("floor").isNull(), "no floor")
    )


def vendor_of(devices: Column) -> Column:
    """The one driver of all device keys, `shared` for several, NULL when there is no device or a
    malformed key (the batch is refused)."""
    parts = F.transform(devices, device_key_parts)
    drivers = F.array_distinct(F.transform(parts, lambda p: p["driver"]))
    sound = (F.size(devices) > 0) & ~F.exists(parts, lambda p: p.isNull())
    return F.when(sound, F.when(F.size(drivers) == 1, drivers[0]).otherwise(SHARED_VENDOR))


def duplicates(batch: DataFrame) -> DataFrame:
    """Packages that stand in one batch more than once; the batch is refused when there are any."""
    return batch.groupBy("package").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def carried_split(batch: DataFrame, destination: DataFrame) -> DataFrame:
    """The batch with `carried`: whether the destination already has the package."""
    known = destination.select("package").distinct().withColumn("_known", F.lit(True))
    return batch.join(known, "package", "left").withColumn("carried", F.col("_known").isNotNull()).drop("_known")


def emission_batch(
    names: DataFrame,
    classification: DataFrame,
    analysis: DataFrame,
    facts: DataFrame,
    destination: DataFrame,
) -> DataFrame:
    """Every approved package with its vendor and the one thing that keeps it back, if any:
    `refusal` is a reason, `carried` marks what the destination has; the rest ships."""
    empty = F.array().cast("array<string>")
    rows = (
        approved_details(names, classification, analysis, facts)
        .withColumns({c: F.coalesce(c, empty) for c in ("dependencies", "needed_by", "devices")})
        .withColumns({"labels": empty, "vendor": vendor_of(F.col("devices"))})
    )
    refusal = F.coalesce(
        F.when(F.col("vendor").isNull(), "no vendor"), shipping_refusal(), emission_fault()
    )
    return carried_split(rows.withColumn("refusal", refusal), destination)


def shippable(batch: DataFrame) -> DataFrame:
    return batch.filter("refusal IS NULL AND NOT carried")


def entry_json() -> Column:
    """One entry in its fixed key order, raw UTF-8, nulls kept."""
    entry = F.struct(
        F.col("target_list").alias("list"),
        "description",
        "dependencies",
        F.col("needed_by").alias("neededBy"),
        "labels",
        "removal",
    )
    return F.to_json(entry, {"ignoreNullFields": "false"})


def write_vendor_batches(batch: DataFrame, path: str) -> None:
    """One folder per vendor, lines in package order. The range partitioning splits a vendor that
    holds a third of the rows over several files."""
    lines = batch.select(
        "vendor", "package", F.concat(F.lit('{"package":'), F.to_json(F.array("package")).substr(F.lit(2), F.length(F.to_json(F.array("package"))) - 2), F.lit(',"entry":'), entry_json(), F.lit("}")).alias("value")
    )
    (
        lines.repartitionByRange("vendor", "package")
        .sortWithinPartitions("vendor", "package")
        .select("vendor", "value")
        .write.partitionBy("vendor")
        .text(path)
    )


def markdown_code(value: Column) -> Column:
    return F.concat(F.lit("`"), F.regexp_replace(value, r"[\r\n\x0b\x0c\x85  ]+", " "), F.lit("`"))


def disclosure_lines(batch: DataFrame) -> DataFrame:
    """(vendor, package, line): one table row per package. Lines stay rows: a vendor's report is
    read in package order, not gathered into one cell."""
    columns = (markdown_code(F.col("package")), F.col("target_list"), F.col("removal"), markdown_code(F.col("bundle_sha256")))
    return batch.select("vendor", "package", F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |")).alias("line"))


def disclosure_summary(batch: DataFrame) -> DataFrame:
    """(vendor, packages, models): counts and the distinct models of each vendor's batch."""
    per_model = batch.groupBy("vendor", "model").agg(F.count(F.lit(1)).alias("n"))
    return per_model.groupBy("vendor").agg(
        F.sum("n").alias("packages"), F.array_join(F.sort_array(F.collect_list("model")), ", ").alias("models")
    )
