"""Search results and the verdict rows made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpus_spark.fixed_values import NO_RESULT_REASONING, RULE_PROVENANCE, SOURCE_PROVENANCE


def merge_results(items: DataFrame, display: DataFrame, limit: int) -> DataFrame:
    """Two result blocks and a display order as one ranked list per package.

    `items` is (package, block, block_index, url, ...), `display` is (package, position, block,
    item) where a NULL item means the whole block. What the display order leaves out follows in
    block order; of equal urls the first stays; positions are numbered again.
    """
    single = display.filter("item IS NOT NULL").groupBy("package", "block", F.col("item").alias("block_index")).agg(
        F.min("position").alias("item_position")
    )
    whole = display.filter("item IS NULL").groupBy("package", "block").agg(F.min("position").alias("block_position"))
    placed = items.join(single, ["package", "block", "block_index"], "left").join(whole, ["package", "block"], "left")
    shown = F.least("item_position", "block_position")
    order = F.struct(
        shown.isNull().alias("unlisted"),
        shown.alias("shown"),
        (F.col("block") != "web").alias("block_order"),
        F.col("block_index").alias("index"),
    )
    payload = [c for c in items.columns if c not in ("package", "url")]
    first = placed.groupBy("package", "url").agg(
        F.min(order).alias("order"), F.min_by(F.struct(*payload), order).alias("hit")
    )
    ranked = W.partitionBy("package").orderBy("order")
    return (
        first.withColumn("position", F.row_number().over(ranked))
        .filter(F.col("position") <= limit)
        .select("package", "position", "url", *[F.col("hit")[c].alias(c) for c in payload])
    )


def verdict_rows(candidates: DataFrame, searches: DataFrame, judged: DataFrame) -> DataFrame:
    """One typed row per candidate.

    `candidates` (package, description_sha256), `searches` (package, failure, sources), `judged`
    (package, model, status, sources array, reasoning, rejected struct, attempts). A failed search,
    no source at all, a rejected judge and a verdict each fill their own columns and no others.
    """
    rows = (
        candidates.join(searches.select("package", "failure", F.col("sources").alias("source_count")), "package", "left")
        .join(judged, "package", "left")
    )
    searched = F.col("failure").isNull()
    empty = F.coalesce("source_count", F.lit(0)) == 0
    accepted = searched & ~empty & F.col("status").isNotNull() & F.col("rejected").isNull()
    status = (
        F.when(~searched, "search_failed").when(empty, "uncorroborated").when(accepted, F.col("status")).otherwise("judge_failed")
    )
    asked = searched & ~empty
    owner = F.when(accepted, F.concat(F.lit("llm:"), "model")).otherwise(RULE_PROVENANCE)
    none = F.array().cast("array<string>")
    return rows.select(
        "package",
        "description_sha256",
        status.alias("row_status"),
        F.when(asked, F.col("model")).alias("model"),
        F.when(accepted, F.coalesce("sources", none)).otherwise(none).alias("sources"),
        F.when(searched & empty, NO_RESULT_REASONING).when(accepted, F.nullif("reasoning", F.lit(""))).alias("reasoning"),
        F.when(~searched, F.col("failure"))
        .when(asked & ~accepted, F.coalesce(F.concat_ws(": ", "rejected.field", "rejected.reason"), F.lit("")))
        .alias("failure_reason"),
        F.create_map(
            F.lit("status"), owner, F.lit("reasoning"), owner, F.lit("sources"), F.lit(SOURCE_PROVENANCE)
        ).alias("provenance"),
        F.when(asked, F.coalesce("attempts", F.lit(0))).otherwise(0).alias("attempts"),
    ).withColumnRenamed("row_status", "status")


def family_rate(verdicts: DataFrame) -> DataFrame:
    """Supported among judged, per leading namespace."""
    return (
        verdicts.filter(F.col("status").isin("corroborated", "uncorroborated"))
        .groupBy(F.substring_index("package", ".", 2).alias("family"))
        .agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col("status") == "corroborated").alias("supported"))
    )
