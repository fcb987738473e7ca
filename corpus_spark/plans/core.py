"""The deterministic core: merged facts to graph, filter verdict and removal floor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.operators import configs, graph
from corpus_spark.operators.bundle import build_bundles, require_floors
from corpus_spark.operators.ladder import compute_floors
from corpus_spark.operators.merge import merge_columns, merge_observations
from corpus_spark.operators.queueing import filter_verdicts
from corpus_spark.session import materialize
from corpus_spark.sources.corpus import load_corpus


def analyse(
    corpus: DataFrame, config: DataFrame, reference: DataFrame, edge_rows: DataFrame
) -> DataFrame:
    """One analysis row per package: neighbours, evidence, verdict, floor."""
    empty = F.array().cast("array<string>")
    platform = configs.platform_libraries(config)
    floors = compute_floors(corpus, configs.privapp_permissions(config), configs.static_roles(config))
    verdicts = filter_verdicts(corpus, reference)
    return (
        corpus.select("package")
        .join(graph.neighbours(edge_rows), "package", "left")
        .join(graph.evidence(corpus, platform), "package", "left")
        .join(verdicts, "package", "left")
        .join(floors, "package", "left")
        .select(
            "package",
            *[F.coalesce(c, empty).alias(c) for c in ("dependencies", "needed_by", *graph.EVIDENCE_LISTS)],
            "overlay_target_absent",
            F.col("listed").alias("reference_present"),
            "queued",
            "filter_verdict",
            "floor",
            "floor_rule",
            "floor_reasons",
            "privapp_allowlisted",
            "privapp_permission_count",
        )
    )


def deterministic_core(
    observations: DataFrame, config: DataFrame, reference: DataFrame, columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, edges, analysis), each written once: they are the stage tables later jobs read. Facts are whole unless later jobs need
    some `columns` only; `corpus.BUNDLE_FACTS` is what the analysis and bundles read."""
    merged = merge_observations(observations) if columns is None else merge_columns(observations, columns)
    facts = materialize(merged, "facts")
    corpus = load_corpus(facts)
    edge_rows = materialize(graph.edges(corpus), "edges")
    analysis = materialize(analyse(corpus, config, reference, edge_rows), "analysis")
    return facts, edge_rows, analysis


def bundles(
    facts: DataFrame, edge_rows: DataFrame, analysis: DataFrame, reference: DataFrame
) -> DataFrame:
    """Evidence bundle of every analysed package; a package without a floor is an error."""
    require_floors(facts, analysis)
    return build_bundles(facts, edge_rows, analysis, reference)
