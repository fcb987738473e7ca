"""Merge family: A1-A12, S1, S2, S10-S12."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_spark.fixed_values import CONFLICT_COLUMNS, STICKY_COLUMNS, UNION_COLUMNS
from corpus_spark.operators import configs, merge
from corpus_spark.session import fresh_path
from corpus_spark.sources import tables
from corpus_spark.sources.bucketed import KeyedTable
from corpus_spark.sources.corpus import load_corpus
from corpus_spark.testbed.oracle import cte
from corpus_spark.testbed.registry import Bed, joined, query, stamp

LIBS = "list_transform({c}, lambda x: x.name || ':' || coalesce(CAST(x.version AS VARCHAR), '-'))"


def lib_text(column: str):
    return joined(F.transform(column, lambda x: F.concat(x["name"], F.lit(":"), F.coalesce(x["version"].cast("string"), F.lit("-")))))


def filter_text(column: str):
    return joined(
        F.transform(
            column,
            lambda x: F.concat_ws("/", x["component"], F.array_join(x["actions"], "+"), F.array_join(x["categories"], "+"), x["priority"].cast("string")),
        )
    )


STRING_LISTS = tuple(c for c in UNION_COLUMNS if c not in ("libraries", "static_libraries", "intent_filters"))

cte("obs_ranked", "SELECT *, row_number() OVER (PARTITION BY package ORDER BY device_key, build, device_path) AS rn FROM observations")
cte(
    "fact_scalars",
    "SELECT package, count(DISTINCT device_key) AS device_count, list_sort(list(DISTINCT device_key)) AS devices, "
    "min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at, list_sort(list(DISTINCT partition)) AS partitions, "
    "CASE WHEN count(*) FILTER (WHERE label IS NOT NULL AND label <> 'unknown') > 0 "
    "THEN arg_min(label, rn) FILTER (WHERE label IS NOT NULL AND label <> 'unknown') ELSE max(label) FILTER (WHERE rn = 1) END AS label, "
    "CASE WHEN count(*) FILTER (WHERE label IS NOT NULL AND label <> 'unknown') > 0 "
    "THEN arg_min(label_unresolved, rn) FILTER (WHERE label IS NOT NULL AND label <> 'unknown') ELSE bool_or(label_unresolved) FILTER (WHERE rn = 1) END AS label_unresolved, "
    "max(version_code) AS version_code, "
    + ", ".join(f"max({c}) FILTER (WHERE rn = 1) AS {c}" for c in merge.FIRST_COLUMNS)
    + ", "
    + ", ".join(f"bool_or(coalesce({c}, false)) AS {c}" for c in STICKY_COLUMNS)
    + " FROM obs_ranked GROUP BY package",
)
_libs_sorted = (
    "list_sort(list_distinct(flatten(list(list_transform({c}, lambda x: x.name || ':' || coalesce(CAST(x.version AS VARCHAR), '~'))))))"
)
cte(
    "fact_lists",
    "SELECT package, "
    + ", ".join(f"list_sort(list_distinct(flatten(list({c})))) AS {c}" for c in STRING_LISTS)
    + ", "
    + ", ".join(f"{_libs_sorted.format(c=c)} AS {c}" for c in ("libraries", "static_libraries"))
    + ", list_sort(list_distinct(flatten(list(list_transform(intent_filters, lambda x: x.component || '/' || array_to_string(x.actions, '+') || '/' || array_to_string(x.categories, '+') || '/' || CAST(x.priority AS VARCHAR)))))) AS intent_filters"
    + " FROM observations GROUP BY package",
)
cte(
    "conflict_long",
    " UNION ALL ".join(
        f"SELECT package, {i} AS position, '{c}' AS field, CAST({c} AS VARCHAR) AS value, device_key FROM observations WHERE {c} IS NOT NULL"
        for i, c in enumerate(CONFLICT_COLUMNS)
    ),
)
cte(
    "conflict_values",
    "SELECT package, position, field, value, array_to_string(list_sort(list(DISTINCT device_key)), ';') AS devices FROM conflict_long GROUP BY ALL",
)
cte(
    "conflict_rows",
    "SELECT package, string_agg(field || '=' || vals, '|' ORDER BY position) AS conflicts FROM (SELECT package, position, field, "
    "string_agg(value || '[' || devices || ']', ' ' ORDER BY value) AS vals, count(*) AS n FROM conflict_values GROUP BY ALL) WHERE n >= 2 GROUP BY package",
)
cte(
    "facts",
    "SELECT s.*, l.* EXCLUDE (package), c.conflicts IS NOT NULL AS has_conflict, coalesce(c.conflicts, '') AS conflicts "
    "FROM fact_scalars s JOIN fact_lists l USING (package) LEFT JOIN conflict_rows c USING (package)",
)


def conflict_text(column: str = "conflicts"):
    return joined(
        F.transform(
            column,
            lambda f: F.concat(
                f["field"],
                F.lit("="),
                F.array_join(
                    F.transform(f["values"], lambda v: F.concat(v["value"], F.lit("["), F.array_join(v["devices"], ";"), F.lit("]"))), " "
                ),
            ),
        ),
        "|",
    )


@query("a1_sticky_true_merge", f"SELECT package, {', '.join(STICKY_COLUMNS)} FROM fact_scalars")
def _(b: Bed):
    return b.observations.groupBy("package").agg(*merge.sticky_true())


@query(
    "a2_union_merge",
    "SELECT package, " + ", ".join(f"array_to_string({c}, ',') AS {c}" for c in (*STRING_LISTS, "intent_filters"))
    + ", " + ", ".join(f"replace(array_to_string({c}, ','), '~', '-') AS {c}" for c in ("libraries", "static_libraries"))
    + " FROM fact_lists WHERE len(libraries) + len(static_libraries) + len(intent_filters) + " + " + ".join(f"len({c})" for c in STRING_LISTS) + " > 0",
)
def _(b: Bed):
    merged = merge.union_merge(b.observations)
    return merged.select(
        "package",
        *[joined(c).alias(c) for c in STRING_LISTS],
        filter_text("intent_filters").alias("intent_filters"),
        *[lib_text(c).alias(c) for c in ("libraries", "static_libraries")],
    )


@query("a3_first_wins_merge", "SELECT package, cert_issuer, cert_subject, shared_user_id, overlay_target FROM fact_scalars")
def _(b: Bed):
    return b.observations.groupBy("package").agg(merge.first_wins().alias("f")).select("package", "f.*")


@query("a4_first_label_merge", "SELECT package, label, label_unresolved FROM fact_scalars")
def _(b: Bed):
    return b.observations.groupBy("package").agg(merge.first_label().alias("f")).select("package", "f.*")


@query(
    "a5_first_icon_merge",
    "SELECT package, decode(arg_min(icon_bytes, rn) FILTER (WHERE icon_bytes IS NOT NULL)) AS icon, arg_min(icon_mime, rn) FILTER (WHERE icon_bytes IS NOT NULL) AS icon_mime "
    "FROM obs_ranked GROUP BY package",
)
def _(b: Bed):
    merged = b.observations.groupBy("package").agg(merge.first_icon().alias("i"))
    return merged.select("package", F.decode("i.icon_bytes", "UTF-8").alias("icon"), "i.icon_mime")


@query("a6_max_version", "SELECT package, max(version_code) AS version_code FROM observations GROUP BY package")
def _(b: Bed):
    return b.observations.groupBy("package").agg(F.max("version_code").alias("version_code"))


@query(
    "a7_seen_span",
    "SELECT package, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S') AS first_seen_at, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S') AS last_seen_at FROM observations GROUP BY package",
)
def _(b: Bed):
    seen = b.observations.groupBy("package").agg(F.min("observed_at").alias("f"), F.max("observed_at").alias("l"))
    return seen.select("package", stamp("f").alias("first_seen_at"), stamp("l").alias("last_seen_at"))


@query(
    "a8_devices_and_partitions",
    "SELECT package, device_count, array_to_string(devices, ',') AS devices, array_to_string(partitions, ',') AS partitions FROM fact_scalars",
)
def _(b: Bed):
    # Distinct pairs first: a hot package is deduplicated over all tasks before its list is built.
    obs = b.observations
    pairs = obs.select("package", F.lit("d").alias("side"), F.col("device_key").alias("v")).unionByName(
        obs.select("package", F.lit("p").alias("side"), F.col("partition").alias("v"))
    ).distinct()
    lists = pairs.groupBy("package").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("v")))).alias(n) for s, n in (("d", "devices"), ("p", "partitions"))]
    )
    return lists.select("package", F.size("devices").cast("long").alias("device_count"), joined("devices").alias("devices"), joined("partitions").alias("partitions"))


@query("a9_conflict_detection", "SELECT package, conflicts FROM conflict_rows")
def _(b: Bed):
    return merge.conflicts(b.observations).select("package", conflict_text().alias("conflicts"))


FACT_SQL = (
    "SELECT package, device_count, array_to_string(devices, ',') AS devices, strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at, "
    "strftime(last_seen_at, '%Y-%m-%d %H:%M:%S') AS last_seen_at, label, label_unresolved, version_code, cert_issuer, cert_subject, shared_user_id, overlay_target, "
    + ", ".join(STICKY_COLUMNS)
    + ", array_to_string(partitions, ',') AS partitions, has_conflict, conflicts, "
    + ", ".join(f"array_to_string({c}, ',') AS {c}" for c in (*STRING_LISTS, "intent_filters"))
    + ", " + ", ".join(f"replace(array_to_string({c}, ','), '~', '-') AS {c}" for c in ("libraries", "static_libraries"))
    + " FROM facts"
)


def fact_text(facts):
    return facts.select(
        "package",
        F.col("device_count").cast("long").alias("device_count"),
        joined("devices").alias("devices"),
        stamp("first_seen_at").alias("first_seen_at"),
        stamp("last_seen_at").alias("last_seen_at"),
        "label", "label_unresolved", "version_code", *merge.FIRST_COLUMNS, *STICKY_COLUMNS,
        joined("partitions").alias("partitions"),
        "has_conflict",
        conflict_text().alias("conflicts"),
        *[joined(c).alias(c) for c in STRING_LISTS],
        filter_text("intent_filters").alias("intent_filters"),
        *[lib_text(c).alias(c) for c in ("libraries", "static_libraries")],
    )


@query("a10_merged_facts", FACT_SQL)
def _(b: Bed):
    return fact_text(merge.merge_observations(b.stored_observations))


@query("a11_incremental_remerge", FACT_SQL)
def _(b: Bed):
    # Rows of later orders arrive as a second batch, and with them a tenth of the keys moves to the package it belongs to from one
    # that ends there; the result must equal one merge of everything.
    obs, moves = b.stored_observations, F.abs(F.hash(*merge.ORDER_COLUMNS)) % 10 == 0
    late = F.substring("build", 2, 20).cast("long") % 10 == 0
    stored = obs.filter(~late).withColumn("package", F.when(moves, F.concat("package", F.lit(".old"))).otherwise(F.col("package")))
    incoming = obs.filter(late | moves)
    _, facts = merge.remerge_touched(merge.merge_observations(stored), stored, incoming)
    return fact_text(facts)


@query(
    "a12_config_union",
    "SELECT kind, key, CAST(array_to_string(list_sort(list(DISTINCT value)), ',') AS VARCHAR) AS vals FROM config_rows WHERE kind IN ('privapp', 'role') GROUP BY kind, key "
    "UNION ALL SELECT DISTINCT kind, key, '' FROM config_rows WHERE kind IN ('library', 'failed') "
    "UNION ALL SELECT 'read', 'files', CAST(count(*) AS VARCHAR) FROM config_rows WHERE kind = 'read'",
)
def _(b: Bed):
    return configs.config_union(b.config).select("kind", "key", joined("values").alias("vals"))


cte(
    "corpus",
    "SELECT package, devices, partitions, device_count, priv_app, core_app, persistent, shared_user_id, overlay_target, uses_libraries_required, uses_libraries_optional, "
    "queries_packages, provider_authorities, content_uri_authorities, is_input_method, "
    "list_distinct(list_transform(libraries, lambda x: split_part(x, ':', 1))) AS libraries, "
    "list_distinct(list_transform(static_libraries, lambda x: split_part(x, ':', 1))) AS static_libraries, "
    "len(list_filter(intent_filters, lambda x: contains(x, 'android.intent.action.MAIN') AND contains(x, 'android.intent.category.HOME'))) > 0 AS handles_home, "
    "len(list_filter(intent_filters, lambda x: contains(x, 'android.intent.action.DIAL'))) > 0 AS handles_dialer, "
    "len(list_filter(intent_filters, lambda x: contains(x, 'android.provider.Telephony.SMS_DELIVER'))) > 0 AS handles_sms_deliver FROM facts",
)


@query(
    "s1_load_corpus",
    "SELECT package, device_count, priv_app, core_app, persistent, shared_user_id, overlay_target, array_to_string(list_sort(libraries), ',') AS libraries, "
    "array_to_string(list_sort(static_libraries), ',') AS static_libraries, is_input_method, handles_home, handles_dialer, handles_sms_deliver FROM corpus",
)
def _(b: Bed):
    corpus = load_corpus(merge.merge_observations(b.stored_observations))
    return corpus.select(
        "package", F.col("device_count").cast("long").alias("device_count"), "priv_app", "core_app", "persistent", "shared_user_id", "overlay_target",
        joined(F.sort_array("libraries")).alias("libraries"), joined(F.sort_array("static_libraries")).alias("static_libraries"),
        "is_input_method", "handles_home", "handles_dialer", "handles_sms_deliver",
    )


@query("s2_require_rows", "SELECT count(*) AS n, count(DISTINCT package) AS packages FROM observations")
def _(b: Bed):
    obs = tables.require_rows(b.observations, "package observations")
    return obs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("package").alias("packages"))


@query(
    "s10_column_upsert",
    "WITH stored AS (SELECT package, min(observed_at) AS created_at, max(version_code) AS version_code, 'kept' AS note FROM observations WHERE ascii(right(device_key, 1)) % 2 = 0 GROUP BY package), "
    "incoming AS (SELECT package, max(observed_at) AS created_at, min(version_code) AS version_code FROM observations WHERE ascii(right(device_key, 1)) % 2 = 1 GROUP BY package) "
    "SELECT coalesce(s.package, i.package) AS package, strftime(CASE WHEN s.package IS NULL THEN i.created_at ELSE s.created_at END, '%Y-%m-%d') AS created, "
    "CASE WHEN i.package IS NULL THEN s.version_code ELSE i.version_code END AS version_code, s.note FROM stored s FULL JOIN incoming i ON s.package = i.package",
)
def _(b: Bed):
    obs = b.observations
    stored = obs.filter("ascii(right(device_key, 1)) % 2 = 0").groupBy("package").agg(
        F.min("observed_at").alias("created_at"), F.max("version_code").alias("version_code"), F.first(F.lit("kept")).alias("note"))
    incoming = obs.filter("ascii(right(device_key, 1)) % 2 = 1").groupBy("package").agg(
        F.max("observed_at").alias("created_at"), F.min("version_code").alias("version_code"))
    table = KeyedTable(b.spark, fresh_path(b.spark, "upserted"), stored.schema, ["package"])
    table.upsert(stored)
    table.upsert(incoming, insert_only=["created_at"])
    return table.read().select("package", F.date_format("created_at", "yyyy-MM-dd").alias("created"), "version_code", "note")


@query(
    "s11_replace_by_key",
    "SELECT package, result_id, url FROM search_results WHERE package NOT IN (SELECT package FROM search_results WHERE block = 'discussions') "
    "UNION ALL SELECT package, result_id + 1000000, url FROM search_results WHERE block = 'discussions'",
)
def _(b: Bed):
    rows = b.table("search_results").select("package", "result_id", "url", "block")
    incoming = rows.filter("block = 'discussions'").withColumn("result_id", F.col("result_id") + 1000000)
    table = KeyedTable(b.spark, fresh_path(b.spark, "replaced"), rows.schema, ["package"])
    table.replace(rows)
    table.replace(incoming)
    return table.read().select("package", "result_id", "url")


@query("s12_append_log", "SELECT id, package, action, strftime(decided_at, '%Y-%m-%d') AS day FROM decisions")
def _(b: Bed):
    log = b.table("decisions").select("id", "package", "action", F.date_format("decided_at", "yyyy-MM-dd").alias("day"))
    path = fresh_path(b.spark, "decision-log")
    tables.append_log(log.filter("action = 'approve'"), path)
    tables.append_log(log.filter("action <> 'approve'"), path)
    return b.spark.read.schema(log.schema).parquet(path)
