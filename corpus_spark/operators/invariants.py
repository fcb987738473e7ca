"""Table constraints as a report: one row per rule with its number of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.fixed_values import RETRYABLE_STATUSES
from corpus_spark.functions.text import strip
from corpus_spark.operators.merge import ORDER_COLUMNS


def _count(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    counted = df.agg(
        F.array(*[F.struct(F.lit(n).alias("rule"), F.count_if(c).alias("violations")) for n, c in rules.items()]).alias("r")
    )
    return counted.select(F.inline("r"))


def verdict_row_fault() -> Column:
    """A failure never carries sources or reasoning, a verdict never a failure reason."""
    failed = F.col("status").isin(*RETRYABLE_STATUSES)
    return (failed & ((F.size("sources") > 0) | F.col("reasoning").isNotNull())) | (
        ~failed & F.col("failure_reason").isNotNull()
    )


def violations(
    observations: DataFrame, decisions: DataFrame, emissions: DataFrame, corroboration: DataFrame
) -> DataFrame:
    repeated = observations.groupBy(*ORDER_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    parts = (
        _count(observations, {"icon_pair": F.col("icon_bytes").isNull() != F.col("icon_mime").isNull()}),
        _count(decisions, {"reject_reason": (F.col("action") == "reject") & (strip(F.coalesce("reason", F.lit(""))) == "")}),
        _count(
            emissions,
            {
                "commit_pair": F.col("commit_oid").isNull() != F.col("committed_at").isNull(),
                "reconciled_commit": F.col("reconciled") & F.col("commit_oid").isNull(),
            },
        ),
        _count(repeated, {"observation_key": F.col("n") > 1}),
        _count(corroboration, {"verdict_row": verdict_row_fault()}),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
