"""Build catalogues, partition images and artifact paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.fixed_values import ARTIFACT_GLOBS, CATALOGUE_PATTERNS, PARSE_FAILURE_RATIO
from corpus_spark.functions.text import build_date
from corpus_spark.operators.ordered import numbered


def invalid_reference() -> Column:
    """The first field of a catalogue row that is not what it must be, or NULL."""
    checks = []
    for field, pattern in CATALOGUE_PATTERNS.items():
        # `$` would let a last line feed pass.
        fits = F.col(field).rlike(pattern.removesuffix("$") + r"\z")
        if field in ("sha256", "md5"):
            fits = F.col(field).isNull() | fits
        checks.append(F.when(~F.coalesce(fits, F.lit(False)), field))
    checks.append(F.when(F.col("size") <= 0, "size"))
    checks.append(F.when(F.char_length("marketing_name") > 128, "marketing_name"))
    return F.coalesce(*checks)


def ingest(raw: DataFrame) -> DataFrame:
    """Catalogue rows with `rejected` naming the field a row is dropped for."""
    return raw.withColumn("rejected", invalid_reference())


def rejected_counts(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("driver", F.coalesce("rejected", F.lit("valid")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def factory_rows(html: DataFrame) -> DataFrame:
    """Index rows written as HTML table rows; a row without a factory link is no build."""
    row = F.col("row")
    link = r'href="(https://dl\.google\.com/dl/android/aosp/([A-Za-z0-9_]+)-([A-Za-z0-9._]+)-factory-[0-9a-f]+\.zip)"'

    def found(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.trim(F.regexp_extract(row, pattern, group)), F.lit(""))

    return html.select(
        "file_position",
        F.lit("pixel").alias("driver"),
        found(link, 2).alias("device"),
        F.upper(found(link, 3)).alias("build"),
        found(link, 1).alias("url"),
        F.lower(found(r"(?i)<td>\s*([0-9a-f]{64})\s*</td>")).alias("sha256"),
        found(r"<td>\s*(\d[\w.]*)\s*\(").alias("android_version"),
        found(r'data-label="[^"]*? for ([^"]*?)\s*\[[^\[\]"]*\]"').alias("marketing_name"),
    ).filter("url IS NOT NULL")


def chronology(catalogue: DataFrame) -> DataFrame:
    """Adds `position`: rows of a source oldest first by its own date, ties by region, build and
    place in the file."""
    return numbered(catalogue, ["driver"], ["published_at", "region", "build", "file_position"], "position")


def newest_builds(catalogue: DataFrame) -> DataFrame:
    """The newest build per device: a dated id beats an undated one, then the date, then the place
    in the index."""
    date = build_date(F.col("build"))
    key = F.struct(date.isNotNull().alias("dated"), date.alias("date"), F.col("position"))
    return catalogue.groupBy("driver", "device").agg(F.max_by("build", key).alias("newest_build"))


def named_build(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first row whose build matches the wanted (driver, device, build), case ignored."""
    keyed = catalogue.withColumn("build_key", F.upper("build"))
    asked = wanted.select("driver", "device", F.upper("build").alias("build_key")).distinct()
    return (
        keyed.join(asked, ["driver", "device", "build_key"], "left_semi")
        .groupBy("driver", "device", "build_key")
        .agg(F.min_by(F.struct("build", "url", "position"), "position").alias("hit"))
        .select("driver", "device", "hit.*")
    )


def device_options(catalogue: DataFrame) -> DataFrame:
    """Per device: how many builds, the newest, and the first marketing name in index order."""
    date = build_date(F.col("build"))
    key = F.struct(date.isNotNull().alias("dated"), date.alias("date"), F.col("position"))
    named = F.when(F.length("marketing_name") > 0, F.col("position"))
    return catalogue.groupBy("driver", "device").agg(
        F.count(F.lit(1)).alias("build_count"),
        F.max_by("build", key).alias("newest_build"),
        F.coalesce(F.min_by("marketing_name", named), F.lit("")).alias("marketing_name"),
    )


def source_completeness(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(host, rows, state) of every expected host, zeros included, and of foreign and unattributed
    rows. An expected host without a valid row makes the catalogue unusable."""
    host = F.lower(F.coalesce(F.try_parse_url("source_url", F.lit("HOST")), F.lit("")))
    counted = rows.withColumn("host", host).groupBy("host").agg(
        F.count(F.lit(1)).alias("all_rows"), F.count_if(F.col("rejected").isNull()).alias("valid_rows")
    )
    known = expected.select("host", F.lit(True).alias("expected"))
    joined = counted.join(F.broadcast(known), "host", "full_outer")
    state = (
        F.when(F.col("expected") & (F.coalesce("valid_rows", F.lit(0)) == 0), "missing")
        .when(F.col("expected"), "present")
        .when(F.col("host") == "", "unattributed")
        .otherwise("foreign")
    )
    amount = F.when(F.col("expected"), F.coalesce("valid_rows", F.lit(0))).otherwise(F.col("all_rows"))
    return joined.select("host", amount.alias("rows"), state.alias("state"))


def glob_pattern(glob: str) -> str:
    """A shell glob as a regular expression; `*` also crosses directories."""
    return "^(?s)" + ".*".join(re.escape(part) for part in glob.split("*")) + r"\z"


def is_artifact(path: Column) -> Column:
    rooted = F.concat(F.lit("/"), path)
    return rooted.rlike("|".join(f"(?:{glob_pattern(g)})" for g in ARTIFACT_GLOBS))


def volume_sets(files: DataFrame) -> DataFrame:
    """(owner, stem, volumes, complete): chunk files by stem; complete means exactly 1..n."""
    pattern = r"^(.+)-image-logical\.7z\.(\d{3})$"
    numbered_files = files.select(
        "owner", F.regexp_extract("file", pattern, 1).alias("stem"), F.regexp_extract("file", pattern, 2).cast("int").alias("index")
    ).filter("stem <> ''")
    # A repeated index makes the run wrong too, so rows are counted beside distinct indexes.
    per_index = numbered_files.groupBy("owner", "stem", "index").agg(F.count(F.lit(1)).alias("copies"))
    return per_index.groupBy("owner", "stem").agg(
        F.sum("copies").alias("volumes"),
        ((F.sum("copies") == F.max("index")) & (F.min("index") == 1) & (F.count(F.lit(1)) == F.max("index"))).alias("complete"),
    )


def parse_budget(scans: DataFrame, ratio: float = PARSE_FAILURE_RATIO) -> DataFrame:
    """Adds `accepted`: the share of unreadable packages is within the budget."""
    share = F.col("failed") / F.col("total")
    return scans.withColumn("accepted", (F.col("failed") == 0) | (F.coalesce(share, F.lit(1.0)) <= ratio))


def partition_identity(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)_[ab]$", "")


def resolve_slots(images: DataFrame) -> DataFrame:
    """(device, name, identity, collides): slot B goes where slot A of the same partition is there;
    what still shares an identity collides and is reported."""
    present = images.select("device", F.col("name").alias("sibling")).distinct()
    stem = F.when(F.col("name").endswith("_b"), F.expr("substring(name, 1, length(name) - 2)"))
    kept = images.withColumn("sibling", F.concat(stem, F.lit("_a"))).join(present, ["device", "sibling"], "left_anti")
    identified = kept.withColumn("identity", partition_identity(F.col("name"))).drop("sibling")
    claims = identified.groupBy("device", "identity").agg(F.count(F.lit(1)).alias("claims"))
    return identified.join(claims, ["device", "identity"]).withColumn("collides", F.col("claims") > 1).drop("claims")
