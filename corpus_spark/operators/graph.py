"""Dependency edges, and the evidence that is recorded but never an edge.

Long frames come first (one row per relation); arrays are built only at the end, from distinct
rows. Questions of the kind "does any other package provide this" are answered from a per-name
count with the lowest and highest owner, so no pairs inside a group are formed to answer them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE_COLUMNS = ("kind", "dependent", "provider", "detail")
EVIDENCE_LISTS = (
    "queries_packages_in_corpus",
    "queries_packages_absent",
    "required_libraries_from_platform",
    "required_libraries_unresolved",
    "shared_provider_authorities",
    "content_uri_authorities_in_corpus",
    "content_uri_authorities_absent",
)


def provided_libraries(corpus: DataFrame) -> DataFrame:
    """(package, library): every shared-library name a package declares, static or not."""
    return corpus.select(
        "package", F.explode(F.array_union("libraries", "static_libraries")).alias("library")
    )


def required_libraries(corpus: DataFrame) -> DataFrame:
    return corpus.select(
        "package", F.explode(F.array_distinct("uses_libraries_required")).alias("library")
    )


def owners(pairs: DataFrame, name: str) -> DataFrame:
    """Per name: how many packages own it, and the lowest and highest of them."""
    return pairs.groupBy(name).agg(
        F.count(F.lit(1)).alias("owner_count"),
        F.min("package").alias("first_owner"),
        F.max("package").alias("last_owner"),
    )


def other_owner_exists() -> Column:
    """Whether somebody other than `package` owns the name (after a left join with `owners`)."""
    return F.coalesce(
        (F.col("first_owner") != F.col("package")) | (F.col("last_owner") != F.col("package")),
        F.lit(False),
    )


def overlay_links(corpus: DataFrame) -> DataFrame:
    """(package, overlay_target, resolved): a target outside the corpus, or the package itself,
    does not resolve."""
    targets = corpus.select(F.col("package").alias("overlay_target"), F.lit(True).alias("known"))
    return (
        corpus.select("package", "overlay_target")
        .filter(F.col("overlay_target").isNotNull() & (F.col("overlay_target") != ""))
        .join(targets, "overlay_target", "left")
        .select(
            "package",
            "overlay_target",
            (F.col("known").isNotNull() & (F.col("overlay_target") != F.col("package"))).alias("resolved"),
        )
    )


def overlay_edges(links: DataFrame) -> DataFrame:
    return links.filter("resolved").select(
        F.lit("overlay").alias("kind"),
        F.col("package").alias("dependent"),
        F.col("overlay_target").alias("provider"),
        F.col("overlay_target").alias("detail"),
    )


def library_edges(corpus: DataFrame) -> DataFrame:
    """One edge per (consumer, other provider, library). The pairs are the result itself."""
    consumers = required_libraries(corpus).select(F.col("package").alias("dependent"), "library")
    providers = provided_libraries(corpus).select(F.col("package").alias("provider"), "library")
    return (
        consumers.join(providers, "library")
        .filter(F.col("dependent") != F.col("provider"))
        .select(
            F.lit("library").alias("kind"), "dependent", "provider", F.col("library").alias("detail")
        )
    )


def edges(corpus: DataFrame) -> DataFrame:
    """Every edge once. Both parts are distinct already, and the kinds are disjoint."""
    return overlay_edges(overlay_links(corpus)).unionByName(library_edges(corpus))


def library_evidence(corpus: DataFrame, platform: DataFrame) -> DataFrame:
    """(package, bucket, value) of required libraries that no other package provides."""
    unmet = (
        required_libraries(corpus)
        .join(owners(provided_libraries(corpus), "library"), "library", "left")
        .filter(~other_owner_exists())
    )
    known = platform.select("library").distinct().withColumn("on_platform", F.lit(True))
    return unmet.join(known, "library", "left").select(
        "package",
        F.when(F.col("on_platform"), "required_libraries_from_platform")
        .otherwise("required_libraries_unresolved")
        .alias("bucket"),
        F.col("library").alias("value"),
    )


def query_evidence(corpus: DataFrame) -> DataFrame:
    names = corpus.select(F.col("package").alias("value"), F.lit(True).alias("known"))
    return (
        corpus.select("package", F.explode("queries_packages").alias("value"))
        .join(names, "value", "left")
        .select(
            "package",
            F.when(F.col("known"), "queries_packages_in_corpus")
            .otherwise("queries_packages_absent")
            .alias("bucket"),
            "value",
        )
    )


def authority_owners(corpus: DataFrame) -> DataFrame:
    pairs = corpus.select(
        "package", F.explode(F.array_distinct("provider_authorities")).alias("authority")
    )
    return owners(pairs, "authority")


def shared_authorities(corpus: DataFrame) -> DataFrame:
    """Declared authorities that another package declares as well."""
    declared = corpus.select("package", F.explode("provider_authorities").alias("authority"))
    return (
        declared.join(authority_owners(corpus).filter("owner_count > 1"), "authority")
        .select("package", F.lit("shared_provider_authorities").alias("bucket"), F.col("authority").alias("value"))
    )


def content_uri_evidence(corpus: DataFrame) -> DataFrame:
    """Referenced authorities: another owner, no owner at all, or (dropped) only the package."""
    referenced = corpus.select("package", F.explode("content_uri_authorities").alias("authority"))
    return (
        referenced.join(authority_owners(corpus), "authority", "left")
        .select(
            "package",
            F.when(other_owner_exists(), "content_uri_authorities_in_corpus")
            .when(F.col("owner_count").isNull(), "content_uri_authorities_absent")
            .alias("bucket"),
            F.col("authority").alias("value"),
        )
        .filter("bucket IS NOT NULL")
    )


def evidence_rows(corpus: DataFrame, platform: DataFrame) -> DataFrame:
    """All evidence in long form."""
    absent_targets = (
        overlay_links(corpus)
        .filter("NOT resolved")
        .select("package", F.lit("overlay_target_absent").alias("bucket"), F.col("overlay_target").alias("value"))
    )
    parts = (
        library_evidence(corpus, platform),
        query_evidence(corpus),
        shared_authorities(corpus),
        content_uri_evidence(corpus),
    )
    rows = absent_targets
    for part in parts:
        rows = rows.unionByName(part)
    return rows


def evidence(corpus: DataFrame, platform: DataFrame) -> DataFrame:
    """One row per package that has evidence, one array per bucket."""
    def bucket(name: str) -> Column:
        return F.when(F.col("bucket") == name, F.col("value"))

    return (
        evidence_rows(corpus, platform)
        .groupBy("package")
        .agg(
            *[F.sort_array(F.collect_list(bucket(b))).alias(b) for b in EVIDENCE_LISTS],
            F.max(bucket("overlay_target_absent")).alias("overlay_target_absent"),
        )
    )


def neighbours(edge_rows: DataFrame) -> DataFrame:
    """(package, dependencies, needed_by): distinct and sorted, from one grouped pass."""
    outgoing = F.struct(F.col("dependent").alias("package"), F.lit("dependencies").alias("side"), F.col("provider").alias("other"))
    incoming = F.struct(F.col("provider").alias("package"), F.lit("needed_by").alias("side"), F.col("dependent").alias("other"))
    return (
        edge_rows.select(F.inline(F.array(outgoing, incoming)))
        .distinct()
        .groupBy("package")
        .agg(
            *[
                F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("other")))).alias(s)
                for s in ("dependencies", "needed_by")
            ]
        )
    )


def incidence(edge_rows: DataFrame) -> DataFrame:
    """(package, edges): every edge a package takes part in, on either side, in edge order. What is moved is the side the package is on
    and the other package; the package itself, and a detail that only repeats the provider, are put back afterwards."""
    detail = F.nullif("detail", F.col("provider")).alias("detail")

    def seen_from(package: str, other: str) -> Column:
        end = F.struct("kind", F.lit(package == "provider").alias("provides"), F.col(other).alias("other"), detail)
        return F.struct(F.col(package).alias("package"), end.alias("end"))

    def edge(end: Column) -> Column:
        dependent = F.when(end["provides"], end["other"]).otherwise(F.col("package"))
        provider = F.when(end["provides"], F.col("package")).otherwise(end["other"])
        values = (end["kind"], dependent, provider, F.coalesce(end["detail"], provider))
        return F.struct(*[value.alias(c) for c, value in zip(EDGE_COLUMNS, values, strict=True)])

    return (
        edge_rows.select(F.inline(F.array(seen_from("dependent", "provider"), seen_from("provider", "dependent"))))
        .groupBy("package")
        .agg(F.collect_list("end").alias("ends"))
        .select("package", F.sort_array(F.transform("ends", edge)).alias("edges"))
    )


def counts_by_kind(corpus: DataFrame) -> DataFrame:
    """Edge count per kind, zero included. Library edges are counted without forming them: per library
    its consumers times its providers, less the packages that are both."""
    needs = required_libraries(corpus).select("library", "package", F.lit(1).alias("needs"), F.lit(0).alias("gives"))
    gives = provided_libraries(corpus).select("library", "package", F.lit(0).alias("needs"), F.lit(1).alias("gives"))
    roles = needs.unionByName(gives).groupBy("library", "package").agg(F.max("needs").alias("needs"), F.max("gives").alias("gives"))
    pairs = roles.groupBy("library").agg(
        (F.sum("needs") * F.sum("gives") - F.sum(F.col("needs") * F.col("gives"))).alias("pairs")
    )
    library = pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("edges"))
    overlay = overlay_links(corpus).agg(F.count_if("resolved").alias("edges"))
    return overlay.select(F.lit("overlay").alias("kind"), "edges").unionByName(
        library.select(F.lit("library").alias("kind"), "edges")
    )


def with_neighbours(corpus: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Every corpus package with its neighbour arrays; a package without edges gets empty ones."""
    empty = F.array().cast("array<string>")
    return (
        corpus.select("package")
        .join(neighbours(edge_rows), "package", "left")
        .select(
            "package",
            F.coalesce("dependencies", empty).alias("dependencies"),
            F.coalesce("needed_by", empty).alias("needed_by"),
        )
    )
