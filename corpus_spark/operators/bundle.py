"""Content-addressed evidence bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.fixed_values import ANCHOR_COUNT, BUNDLE_SCHEMA_VERSION
from corpus_spark.functions.canonical import canonical_json, sha256_hex, sorted_struct
from corpus_spark.operators.anchors import anchor_lists
from corpus_spark.operators.graph import EDGE_COLUMNS, EVIDENCE_LISTS, incidence
from corpus_spark.sources.corpus import IDENTITY, load_corpus


class MissingFloorError(RuntimeError):
    """A package reached the bundle stage without a floor."""


def require_floors(corpus: DataFrame, floors: DataFrame) -> None:
    missing = corpus.select("package").join(
        floors.filter("floor IS NOT NULL").select("package"), "package", "left_anti"
    )
    if not missing.limit(1).isEmpty():
        raise MissingFloorError("a package has no computed floor: run the rule ladder first")


def _facts(empty: Column) -> Column:
    def listed(name: str) -> Column:
        return F.sort_array(F.coalesce(F.col(name), empty))

    return sorted_struct(
        {
            "label": F.coalesce(F.col("label"), F.lit("unknown")),
            "label_unresolved": F.col("label_unresolved"),
            "version_code": F.col("version_code"),
            "cert_issuer": F.col("cert_issuer"),
            "partitions": listed("partitions"),
            "priv_app": F.col("priv_app"),
            "core_app": F.col("core_app"),
            "persistent": F.col("persistent"),
            "shared_user_id": F.col("shared_user_id"),
            "overlay_target": F.col("overlay_target"),
            "declares_libraries": F.sort_array(F.array_union("libraries", "static_libraries")),
            "uses_libraries_required": listed("uses_libraries_required"),
            "uses_libraries_optional": listed("uses_libraries_optional"),
            "provider_authorities": listed("provider_authorities"),
            "handles_home": F.col("handles_home"),
            "handles_dialer": F.col("handles_dialer"),
            "handles_sms_deliver": F.col("handles_sms_deliver"),
            "is_input_method": F.col("is_input_method"),
            "has_conflict": F.col("has_conflict"),
        }
    )


def _evidence_json(empty: Column) -> Column:
    """The evidence object; `overlay_target_absent` is present only when there is one."""
    lists = {b: F.coalesce(F.col(b), empty) for b in EVIDENCE_LISTS}
    without = canonical_json(sorted_struct(lists))
    target = F.col("overlay_target_absent")
    with_target = canonical_json(sorted_struct({**lists, "overlay_target_absent": target}))
    return F.when(target.isNull(), without).otherwise(with_target)


def build_bundles(
    facts: DataFrame,
    edge_rows: DataFrame,
    analysis: DataFrame,
    reference: DataFrame | None = None,
    anchor_count: int = ANCHOR_COUNT,
) -> DataFrame:
    """(package, bundle_json, bundle_sha256) of every package with a floor.

    The corpus view and the identity columns come out of one select over the facts, and neighbours,
    evidence and floor out of the analysis row, so what is joined by package is three frames.
    """
    empty = F.array().cast("array<string>")
    edge_type = "array<struct<" + ",".join(f"{c}:string" for c in EDGE_COLUMNS) + ">>"
    corpus = load_corpus(facts, IDENTITY)
    rows = corpus.join(analysis, "package").join(incidence(edge_rows), "package", "left")
    anchor_type = "array<struct<description:string,list:string,package:string,removal:string>>"
    if reference is not None and anchor_count > 0:
        rows = rows.join(anchor_lists(facts.select("package"), reference, anchor_count), "package", "left")
    else:
        rows = rows.withColumn("anchors", F.lit(None).cast(anchor_type))

    edge_objects = F.transform(
        F.coalesce(F.col("edges"), F.array().cast(edge_type)),
        lambda e: sorted_struct({c: e[c] for c in EDGE_COLUMNS}),
    )
    fired = F.transform(
        "floor_reasons", lambda r: sorted_struct({c: r[c] for c in ("rule", "floor", "detail")})
    )
    floor_object = sorted_struct(
        {
            "package": F.col("package"),
            "floor": F.col("floor"),
            "rule": F.col("floor_rule"),
            "fired": fired,
            "privapp_allowlisted": F.col("privapp_allowlisted"),
            "privapp_permission_count": F.col("privapp_permission_count"),
        }
    )
    # The evidence object has an optional key, which a struct cannot express, so the payload text
    # is put together from the canonical texts of its parts, keys in sorted order.
    payload = F.concat(
        F.lit('{"anchors":'),
        canonical_json(F.coalesce(F.col("anchors"), F.array().cast(anchor_type))),
        F.lit(',"facts":'),
        canonical_json(_facts(empty)),
        F.lit(',"floor":'),
        canonical_json(floor_object),
        F.lit(',"graph":{"dependencies":'),
        canonical_json(F.coalesce(F.col("dependencies"), empty)),
        F.lit(',"edges":'),
        canonical_json(edge_objects),
        F.lit(',"evidence":'),
        _evidence_json(empty),
        F.lit(',"needed_by":'),
        canonical_json(F.coalesce(F.col("needed_by"), empty)),
        F.lit('},"package":'),
        canonical_json(F.array("package")).substr(F.lit(2), F.length(canonical_json(F.array("package"))) - 2),
        F.lit(',"provenance":'),
        canonical_json(
            sorted_struct({"devices": F.sort_array("devices"), "device_count": F.col("device_count")})
        ),
        F.lit(f',"schema":{BUNDLE_SCHEMA_VERSION}}}'),
    )
    return rows.select("package", payload.alias("bundle_json")).withColumn(
        "bundle_sha256", sha256_hex(F.col("bundle_json"))
    )
