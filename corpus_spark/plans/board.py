"""Board, card and emission jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.operators import emission, triage
from corpus_spark.operators.anchors import nearest_entries
from corpus_spark.operators.browse import ranked
from corpus_spark.session import materialize


def triage_board(
    classification: DataFrame,
    facts: DataFrame,
    analysis: DataFrame,
    corroboration: DataFrame,
    decisions: DataFrame,
    emission_packages: DataFrame,
    emissions: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(rows with view flags, counts per view), both off one written copy of the rows, so counts
    and rows always describe the same moment."""
    rows = materialize(
        triage.with_views(
            triage.triage_rows(
                classification, facts, analysis, corroboration, decisions, emission_packages, emissions
            )
        ),
        "board",
    )
    return rows, triage.view_counts(rows)


def ranked_view(rows: DataFrame, view: str) -> DataFrame:
    return ranked(triage.in_view(rows, view))


def emission_batch(
    board: DataFrame, classification: DataFrame, analysis: DataFrame, facts: DataFrame, destination: DataFrame
) -> DataFrame:
    """Approved packages with vendor, refusal and carried mark."""
    return emission.emission_batch(
        triage.approved_names(board), classification, analysis, facts, destination
    )


def triage_cards(
    classification: DataFrame,
    facts: DataFrame,
    analysis: DataFrame,
    corroboration: DataFrame,
    decisions: DataFrame,
    emission_packages: DataFrame,
    emissions: DataFrame,
    reference: DataFrame,
) -> DataFrame:
    """One row per card: proposal, standing, evidence gaps, rendered lists and anchors. Filter the
    inputs on a package to read one card; the filter is pushed into every scan. The history of a
    card is `triage.decision_history`, as rows."""
    rows = triage.triage_rows(
        classification, facts, analysis, corroboration, decisions, emission_packages, emissions
    )
    nearest = (
        nearest_entries(classification.select("package"), reference)
        .groupBy("package")
        .agg(
            F.count(F.lit(1)).alias("anchor_count"),
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "anchor"))), lambda x: x["anchor"]).alias("anchors"),
        )
    )
    history = decisions.groupBy("package").agg(F.count(F.lit(1)).alias("decisions"))
    answered = classification.select("package", "description", "target_list", "model", "unknown_fields", "parked_reason")
    shipped = facts.select("package", F.col("package").alias("fact_package"), "devices", "partitions")
    return (
        rows.join(answered, "package")
        .join(shipped, "package", "left")
        .join(analysis.select("package", "dependencies", "needed_by"), "package", "left")
        .join(nearest, "package", "left")
        .join(history, "package", "left")
        .withColumns(
            {
                "missing": triage.missing_evidence(),
                "devices_text": triage.truncated(F.col("devices")),
                "partitions_text": triage.truncated(F.col("partitions")),
                "decisions": F.coalesce("decisions", F.lit(0)),
                "device_count": F.coalesce("device_count", F.lit(0)),
            }
        )
        .drop("fact_package")
    )
