"""Rewriting stored proposals: what a human owns survives, what the floor forbids does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.fixed_values import (
    HUMAN_PREFIX,
    HUMAN_TRIAGE,
    SUPERSEDED_BY,
    SUPERSEDED_SUFFIX,
    UNKNOWN,
)
from corpus_spark.functions.tiers import is_below_floor, is_tier

# column -> provenance field
HUMAN_COLUMNS = {
    "description": "description",
    "target_list": "list",
    "removal": "removal",
    "confidence": "confidence",
    "reasoning_brief": "reasoning_brief",
}
EDITABLE = {"description": "description", "list": "target_list", "removal": "removal", "confidence": "confidence"}


def is_human(owner: Column) -> Column:
    return F.coalesce(owner.startswith(HUMAN_PREFIX), F.lit(False))


def floor_refusal(removal: Column, floor: Column, owner: Column) -> Column:
    """Why a removal may not be stored, or NULL. Without a floor a model's value passes (it was
    checked against a live one) and a human's does not."""
    return (
        F.when(removal.isNull(), None)
        .when(floor.isNull(), F.when(is_human(owner), "no floor to check a human rating against"))
        .when(~is_tier(floor), "unreadable floor")
        .when(is_below_floor(removal, floor), "below the floor")
    )


def preserved(old: str = "o", floor: str = "floor") -> dict[str, Column]:
    """Per column: whether the stored value survives a rewrite; `superseded` for a human removal
    that the floor now refuses. Needs `<old>.<column>`, `<old>.provenance` and the floor."""
    keeps = {}
    for column, field in HUMAN_COLUMNS.items():
        owner = F.col(f"{old}.provenance")[field]
        human = is_human(owner)
        if column == "removal":
            refused = floor_refusal(F.col(f"{old}.removal"), F.col(floor), owner).isNotNull()
            keeps["superseded"] = human & refused
            human = human & ~refused
        keeps[column] = F.coalesce(human, F.lit(False))
    return keeps


def _carried_provenance(old: str, keeps: dict[str, Column]) -> Column:
    stored = F.coalesce(F.col(f"{old}.provenance"), F.create_map().cast("map<string,string>"))
    return F.map_filter(
        stored,
        lambda field, owner: is_human(owner) & ~((field == "removal") & F.coalesce(keeps["superseded"], F.lit(False))),
    )


def _marks(old: str, keeps: dict[str, Column]) -> Column:
    mark = F.concat(F.lit(SUPERSEDED_BY + " "), F.col(f"{old}.provenance")["removal"], F.lit(" "), F.col(f"{old}.removal"))
    return F.when(
        F.coalesce(keeps["superseded"], F.lit(False)), F.create_map(F.lit("removal" + SUPERSEDED_SUFFIX), mark)
    ).otherwise(F.create_map().cast("map<string,string>"))


def _merge_maps(*maps: Column) -> Column:
    """Later maps win."""
    entries = [F.map_entries(m) for m in maps]
    out = entries[0]
    for later in entries[1:]:
        out = F.concat(_without(out, later), later)
    return F.map_from_entries(out)


def _without(entries: Column, later: Column) -> Column:
    taken = F.transform(later, lambda e: e["key"])
    return F.filter(entries, lambda e: ~F.array_contains(taken, e["key"]))


def _unknown_fields(description_kept: Column, old: str, fresh: Column) -> Column:
    others = F.filter(
        F.coalesce(F.col(f"{old}.unknown_fields"), F.array().cast("array<string>")), lambda f: f != "description"
    )
    declared = F.when(F.col(f"{old}.description") == UNKNOWN, F.array(F.lit("description"))).otherwise(
        F.array().cast("array<string>")
    )
    return F.when(description_kept, F.sort_array(F.concat(others, declared))).otherwise(fresh)


def rewrite_accepted(stored: DataFrame, accepted: DataFrame, floors: DataFrame) -> DataFrame:
    """Accepted proposals as new rows. A kept human field brings its provenance along; a human
    removal below the present floor is dropped and marked. `refusal` is set where the row that
    results may not be written."""
    rows = accepted.alias("n").join(stored.alias("o"), "package", "left").join(
        floors.select("package", "floor"), "package", "left"
    )
    keeps = preserved()
    chosen = {c: F.when(keeps[c], F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) for c in HUMAN_COLUMNS}
    provenance = _merge_maps(F.col("n.provenance"), _carried_provenance("o", keeps), _marks("o", keeps))
    written = rows.select(
        "package",
        F.col("n.bundle_sha256").alias("bundle_sha256"),
        F.col("n.model").alias("model"),
        *[chosen[c].alias(c) for c in HUMAN_COLUMNS],
        _unknown_fields(keeps["description"], "o", F.col("n.unknown_fields")).alias("unknown_fields"),
        provenance.alias("provenance"),
        F.col("n.attempts").alias("attempts"),
        F.lit(False).alias("parked"),
        F.lit(None).cast("string").alias("parked_reason"),
        "floor",
    )
    return written.withColumn(
        "refusal", floor_refusal(F.col("removal"), F.col("floor"), F.col("provenance")["removal"])
    )


def rewrite_parked(stored: DataFrame, parked: DataFrame, floors: DataFrame) -> DataFrame:
    """Park rows (package, bundle_sha256, model, attempts, reason). A park about the stored bundle
    keeps its proposal; about another bundle it clears what no human owns."""
    rows = parked.alias("n").join(stored.alias("o"), "package", "left").join(
        floors.select("package", "floor"), "package", "left"
    )
    keeps = preserved()
    same = F.coalesce(F.col("o.bundle_sha256") == F.col("n.bundle_sha256"), F.lit(False))
    chosen = {c: F.when(same | keeps[c], F.col(f"o.{c}")) for c in HUMAN_COLUMNS}
    none = F.array().cast("array<string>")
    cleared = _merge_maps(_carried_provenance("o", keeps), _marks("o", keeps))
    return rows.select(
        "package",
        F.col("n.bundle_sha256").alias("bundle_sha256"),
        F.col("n.model").alias("model"),
        *[chosen[c].alias(c) for c in HUMAN_COLUMNS],
        F.when(same, F.col("o.unknown_fields")).otherwise(_unknown_fields(keeps["description"], "o", none)).alias("unknown_fields"),
        F.when(same, F.col("o.provenance")).otherwise(cleared).alias("provenance"),
        F.col("n.attempts").alias("attempts"),
        F.lit(True).alias("parked"),
        F.col("n.reason").alias("parked_reason"),
        "floor",
    ).withColumn("refusal", F.lit(None).cast("string"))


def edit_diff(edits: DataFrame, stored: DataFrame) -> DataFrame:
    """(package, field, from, to) of edits (package, field, value) that change something."""
    long = stored.select(
        "package",
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("from")) for f, c in EDITABLE.items()])
        ).alias("s"),
    ).select("package", "s.*")
    return (
        edits.join(long, ["package", "field"])
        .filter(~F.col("from").eqNullSafe(F.col("value")))
        .select("package", "field", "from", F.col("value").alias("to"))
    )


def apply_edits(stored: DataFrame, diff: DataFrame) -> DataFrame:
    """Rows with their edits in place. Edited fields become the reviewer's and lose an older
    superseded mark; a written description takes its unknown declaration off, the sentinel puts it
    on. A package has four editable fields, so the gathered map is bounded."""
    changes = diff.groupBy("package").agg(F.map_from_entries(F.collect_list(F.struct("field", "to"))).alias("edits"))
    rows = stored.join(changes, "package")
    fields = F.map_keys("edits")
    owners = F.transform(fields, lambda f: F.struct(f.alias("key"), F.lit(HUMAN_TRIAGE).alias("value")))
    marks = F.transform(fields, lambda f: F.concat(f, F.lit(SUPERSEDED_SUFFIX)))
    kept = F.filter(
        F.map_entries("provenance"),
        lambda e: ~F.array_contains(fields, e["key"]) & ~F.array_contains(marks, e["key"]),
    )
    others = F.filter("unknown_fields", lambda f: f != "description")
    declared = F.col("edits")["description"] == UNKNOWN
    return rows.select(
        *[c for c in stored.columns if c not in (*EDITABLE.values(), "provenance", "unknown_fields")],
        *[
            F.when(F.array_contains(fields, f), F.col("edits")[f]).otherwise(F.col(c)).alias(c)
            for f, c in EDITABLE.items()
        ],
        F.map_from_entries(F.concat(kept, owners)).alias("provenance"),
        F.when(~F.array_contains(fields, "description"), F.col("unknown_fields"))
        .when(declared, F.array_sort(F.array_distinct(F.array_append(others, F.lit("description")))))
        .otherwise(others)
        .alias("unknown_fields"),
    )

