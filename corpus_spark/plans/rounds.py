"""Classification and corroboration rounds. The calls to a model or a search service happen outside;
their answers come in as tables, and everything before and after them is here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.operators import queueing, searching
from corpus_spark.operators.rewrite import rewrite_accepted, rewrite_parked
from corpus_spark.operators.triage import latest
from corpus_spark.operators.validation import (
    cited_sources,
    parse_verdicts,
    proposal_provenance,
    validate_proposals,
    validate_verdicts,
)
from corpus_spark.session import materialize


def accepted_rows(validated: DataFrame) -> DataFrame:
    return validated.filter("rejected IS NULL").select(
        "package",
        "bundle_sha256",
        "model",
        F.col("p_description").alias("description"),
        F.col("p_list").alias("target_list"),
        F.col("p_removal").alias("removal"),
        F.col("p_confidence").alias("confidence"),
        F.coalesce("p_reasoning_brief", F.lit("")).alias("reasoning_brief"),
        F.sort_array("p_unknown_fields").alias("unknown_fields"),
        proposal_provenance(F.col("model"), F.col("rule"), F.col("category")).alias("provenance"),
        "attempts",
    )


def parked_rows(validated: DataFrame) -> DataFrame:
    return validated.filter("rejected IS NOT NULL").select(
        "package", "bundle_sha256", "model", "attempts",
        F.concat_ws(": ", "rejected.field", "rejected.reason").alias("reason"),
    )


def classification_round(
    bundles: DataFrame,
    analysis: DataFrame,
    categories: DataFrame,
    stored: DataFrame,
    responses: DataFrame,
    **selection,
) -> DataFrame:
    """New classification rows of every candidate that was answered, refused writes marked.

    `categories` is (package, category, rule); `responses` is (package, model, attempts, response).
    """
    candidates = queueing.proposal_candidates(bundles, analysis, stored, **selection)
    asked = (
        candidates.join(responses, "package")
        .join(analysis.select("package", "floor"), "package", "left")
        .join(categories.select("package", "category", "rule"), "package", "left")
    )
    validated = materialize(validate_proposals(asked), "validated")
    return rewrite_accepted(stored, accepted_rows(validated), analysis).unionByName(
        rewrite_parked(stored, parked_rows(validated), analysis)
    )


def corroboration_round(
    classification: DataFrame,
    verdicts: DataFrame,
    results: DataFrame,
    display: DataFrame,
    failures: DataFrame,
    responses: DataFrame,
    cutoff: str,
    top: int = 10,
) -> DataFrame:
    """One corroboration row per candidate.

    `results` are search rows; those of a package whose newest row is older than the cutoff do not
    count. `failures` is (package, failure), `responses` the judge's answers as they came
    (response_id, package, model, response JSON text, attempts); a package's newest one counts.
    """
    candidates = queueing.corroboration_candidates(classification, verdicts)
    fresh = queueing.fresh_sources(results, cutoff).join(candidates.select("package"), "package", "left_semi")
    handed = materialize(searching.merge_results(fresh, display, top), "handed-sources")
    found = handed.groupBy("package").agg(F.count(F.lit(1)).alias("sources"))
    searches = candidates.select("package").join(found, "package", "left").join(failures, "package", "left").select(
        "package", "failure", F.coalesce("sources", F.lit(0)).alias("sources")
    )
    newest = latest(responses, "package", ("response_id",), ("response_id", "model", "response", "attempts"))
    final = materialize(parse_verdicts(newest), "judge-verdicts")
    citations = cited_sources(final)
    validated = validate_verdicts(final.drop("sources"), citations, handed)
    # A judge may cite any number of handed sources, which are at most `top`.
    first_cited = citations.groupBy("response_id", "url").agg(F.min("position").alias("position"))
    cited = first_cited.groupBy("response_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "url"))), lambda c: c["url"]).alias("sources")
    )
    judged = validated.join(cited, "response_id", "left").select(
        "package", "model", "status", "sources", "reasoning", "rejected", "attempts"
    )
    return searching.verdict_rows(candidates, searches, judged)
