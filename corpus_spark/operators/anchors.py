"""Nearest reference entries by shared dotted prefix, without comparing every pair.

An entry that shares exactly L leading segments with a package sits under the package's L-segment
prefix but not under its next segment. So each prefix only has to remember its lowest-named entries
per next segment: with k anchors wanted, k per branch and 2k per prefix are enough, because leaving
out the one branch that continues the package's own name leaves k or more of the lowest others.
Both cuts are row_number filters, which Spark also applies before the shuffle, so a prefix that
covers a third of all entries reaches its task as at most 2k rows per input task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpus_spark.fixed_values import ANCHOR_COUNT, ANCHOR_MIN_SEGMENTS


def _levels(name: Column, minimum: int) -> Column:
    """One struct(shared, prefix, branch) per prefix of at least `minimum` segments."""
    parts = F.split(name, r"\.")
    lengths = F.when(F.size(parts) >= minimum, F.sequence(F.lit(minimum), F.size(parts)))
    return F.transform(
        lengths,
        lambda n: F.struct(
            n.alias("shared"),
            F.array_join(F.slice(parts, F.lit(1), n), ".").alias("prefix"),
            # NULL-free: the name that ends here is a branch of its own.
            F.coalesce(F.get(parts, n), F.lit("")).alias("branch"),
            (n == F.size(parts)).alias("ends"),
        ),
    )


def prefix_digests(reference: DataFrame, k: int, minimum: int) -> DataFrame:
    """(prefix, entries): the lowest-named described entries under each prefix, 2k at most."""
    described = reference.filter(F.length(F.trim("description")) > 0)
    nodes = described.select(
        F.col("package").alias("anchor"),
        F.explode(_levels(F.col("package"), minimum)).alias("at"),
    ).select("anchor", "at.prefix", "at.branch", "at.ends")
    per_branch = W.partitionBy("prefix", "branch", "ends").orderBy("anchor")
    per_prefix = W.partitionBy("prefix").orderBy("anchor")
    kept = (
        nodes.withColumn("rank", F.row_number().over(per_branch))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(per_prefix))
        .filter(F.col("rank") <= 2 * k)
    )
    return kept.groupBy("prefix").agg(F.collect_list(F.struct("anchor", "branch", "ends")).alias("entries"))


def nearest_entries(
    packages: DataFrame,
    reference: DataFrame,
    k: int = ANCHOR_COUNT,
    minimum: int = ANCHOR_MIN_SEGMENTS,
) -> DataFrame:
    """(package, rank, shared, anchor): the k nearest entries, longest shared prefix first, then by
    name. The package's own entry and entries without a description do not count."""
    levels = packages.select("package", F.explode(_levels(F.col("package"), minimum)).alias("at"))
    candidates = (
        levels.select("package", "at.*")
        .withColumnsRenamed({"branch": "own_branch", "ends": "own_ends"})
        .join(prefix_digests(reference, k, minimum), "prefix")
        .select("package", "shared", "own_branch", "own_ends", F.inline("entries"))
        .filter(~((F.col("branch") == F.col("own_branch")) & (F.col("ends") == F.col("own_ends"))))
    )
    nearest = W.partitionBy("package").orderBy(F.col("shared").desc(), "anchor")
    return (
        candidates.withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= k)
        .select("package", "rank", "shared", "anchor")
    )


def anchor_lists(
    packages: DataFrame, reference: DataFrame, k: int = ANCHOR_COUNT, minimum: int = ANCHOR_MIN_SEGMENTS
) -> DataFrame:
    """(package, anchors): the nearest entries with their fields, nearest first; k at most."""
    entries = reference.select(F.col("package").alias("anchor"), "description", "list", "removal")
    entry = F.struct(
        "rank", "description", "list", F.col("anchor").alias("package"), "removal"
    )
    return (
        nearest_entries(packages, reference, k, minimum)
        .join(entries, "anchor")
        .groupBy("package")
        .agg(F.sort_array(F.collect_list(entry)).alias("ranked"))
        .select(
            "package",
            F.transform(
                "ranked",
                lambda e: F.struct(e["description"], e["list"], e["package"], e["removal"]),
            ).alias("anchors"),
        )
    )
