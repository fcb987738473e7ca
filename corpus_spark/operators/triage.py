"""Review state read from append-only logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.fixed_values import VIEWS


def latest(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The newest row per key. A max_by with map-side combine: a hot key costs one row per task."""
    newest = F.max_by(F.struct(*[F.col(c) for c in columns]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    return latest(decisions, "package", ("decided_at", "id"), ("bundle_sha256", "action", "reason", "decided_at"))


def shipped_branches(emission_packages: DataFrame, emissions: DataFrame) -> DataFrame:
    """The newest committed emission of each package; an uncommitted one has not shipped."""
    committed = emissions.filter("commit_oid IS NOT NULL").select("emission_id", "branch")
    shipped = emission_packages.select("emission_id", "package").join(committed, "emission_id")
    return latest(shipped, "package", ("emission_id",), ("branch",)).withColumnRenamed("branch", "shipped_branch")


def decision_history(decisions: DataFrame, classification: DataFrame) -> DataFrame:
    """Every decision with whether it was made about the evidence on the row now."""
    now = classification.select("package", F.col("bundle_sha256").alias("row_sha256"))
    return decisions.join(now, "package").withColumn(
        "is_current", F.col("bundle_sha256") == F.col("row_sha256")
    ).drop("row_sha256")


def triage_rows(
    classification: DataFrame,
    facts: DataFrame,
    analysis: DataFrame,
    corroboration: DataFrame,
    decisions: DataFrame,
    emission_packages: DataFrame,
    emissions: DataFrame,
) -> DataFrame:
    """One row per answered package with everything the board shows. Only the newest decision can
    count, and only while it is about the row's present bundle."""
    newest = latest_decisions(decisions).select("package", F.col("bundle_sha256").alias("decided_sha256"), "action")
    return (
        classification.select(
            "package", "bundle_sha256", "removal", "confidence", "parked",
            (F.size("unknown_fields") > 0).alias("unknown"),
        )
        .join(facts.select("package", "device_count", "has_conflict", F.col("icon_mime").isNotNull().alias("has_icon")), "package", "left")
        .join(analysis.select("package", "floor"), "package", "left")
        .join(corroboration.select("package", F.col("status").alias("corroboration")), "package", "left")
        .join(newest, "package", "left")
        .join(shipped_branches(emission_packages, emissions), "package", "left")
        .withColumn("current_action", F.when(F.col("decided_sha256") == F.col("bundle_sha256"), F.col("action")))
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_conflict", "has_icon")})
        .drop("decided_sha256", "action")
    )


def view_flags() -> dict[str, Column]:
    """Membership of a triage row in each view."""
    action = F.coalesce(F.col("current_action"), F.lit(""))
    shipped = (action == "approve") & F.col("shipped_branch").isNotNull()
    live = ~F.col("parked")
    flags = {
        "queue": live & action.isin("", "edit", "reopen"),
        "deferred": live & (action == "defer"),
        "decided": live & action.isin("approve", "reject") & ~shipped,
        "shipped": live & shipped,
        "parked": F.col("parked"),
    }
    return {v: flags[v] for v in VIEWS}


def with_views(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"in_{v}": flag for v, flag in view_flags().items()})


def in_view(rows: DataFrame, view: str) -> DataFrame:
    if view not in VIEWS:
        raise ValueError(f"{view!r} is not a view; views are {', '.join(VIEWS)}")
    return rows.filter(view_flags()[view])


def view_counts(rows: DataFrame) -> DataFrame:
    """Rows per view, all views in one partial aggregate."""
    counts = rows.agg(
        F.array(
            *[F.struct(F.lit(v).alias("view"), F.count_if(flag).alias("packages")) for v, flag in view_flags().items()]
        ).alias("views")
    )
    return counts.select(F.inline("views"))


def approved_names(rows: DataFrame) -> DataFrame:
    return rows.filter("current_action = 'approve'").select("package")


def cited_titles(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """(response_id, position, url, title): cited order, titles from the search rows only."""
    titled = sources.select("package", "url", "title").groupBy("package", "url").agg(F.max("title").alias("title"))
    return citations.join(titled, ["package", "url"], "left").withColumn("title", F.coalesce("title", F.lit("")))


def truncated(values: Column, limit: int = 8) -> Column:
    """The first values joined, the rest as a count; a dash for none."""
    text = values.cast("array<string>")
    rest = F.size(text) - limit
    return (
        F.when(F.coalesce(F.size(text), F.lit(0)) <= 0, "-")
        .when(
            rest > 0,
            F.concat(F.array_join(F.slice(text, 1, limit), ", "), F.lit(" (+"), rest.cast("string"), F.lit(" more)")),
        )
        .otherwise(F.array_join(text, ", "))
    )


def missing_evidence() -> Column:
    """What a card is decided without, in order. Needs fact_package, floor, corroboration,
    anchor_count, unknown_fields and model on the row."""
    unknown = F.concat(F.col("model"), F.lit("'s answer ("), F.array_join("unknown_fields", ", "), F.lit(")"))
    return F.array_compact(
        F.array(
            F.when(F.col("fact_package").isNull(), "firmware facts"),
            F.when(F.col("floor").isNull(), "minimum rating"),
            F.when(~F.col("corroboration").eqNullSafe(F.lit("corroborated")), "sources"),
            F.when(F.coalesce(F.col("anchor_count"), F.lit(0)) == 0, "upstream neighbours"),
            F.when(F.size("unknown_fields") > 0, unknown),
        )
    )
