"""Source, document, catalogue and scalar queries: S3-S9, P15, P16, W6-W8, A30, A31, A33, A34, F6-F9, F20-F22, F26, F27."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_spark.fixed_values import ARTIFACT_GLOBS
from corpus_spark.functions import text as tx
from corpus_spark.functions.urls import url_check
from corpus_spark.operators import catalogue as cat
from corpus_spark.operators import queueing, searching
from corpus_spark.session import fresh_path
from corpus_spark.sources import documents, reference_list

from corpus_spark.testbed.adapters import DUCK, SPARK, fill_names, name
from corpus_spark.testbed.oracle import cte
from corpus_spark.testbed.registry import Bed, joined, query


def both(cte_name: str, sql: str, *tables: str):
    """One text for both engines: a checking expression, and a function giving the Spark frame."""
    cte(cte_name, fill_names(sql, DUCK).format(**{t: t for t in tables}))

    def frame(b: Bed):
        return b.spark.sql(fill_names(sql, SPARK), **{t: b.raw(t) for t in tables})

    return frame


# --- reference list -------------------------------------------------------------------------
entry_rows = both(
    "entry_rows",
    "SELECT "
    + name("p_partkey")
    + " AS package, CASE WHEN p_partkey % 17 = 3 THEN '[1]' WHEN p_partkey % 19 = 4 THEN '\"text\"' ELSE '{{\"list\": ' || CASE WHEN p_partkey % 5 = 0 THEN '7' ELSE '\"Oem\"' END || "
    "', \"removal\": ' || CASE WHEN p_partkey % 7 = 0 THEN 'null' ELSE '\"Expert\"' END || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE ', \"description\": \"' || p_name || '\"' END || '}}' END AS value, p_partkey AS k, p_name FROM {part}",
    "part",
)


@query(
    "s3_reference_entries",
    "SELECT package, CASE WHEN k % 17 = 3 OR k % 19 = 4 OR k % 5 = 0 THEN NULL ELSE 'Oem' END AS list, CASE WHEN k % 17 = 3 OR k % 19 = 4 OR k % 7 = 0 THEN NULL ELSE 'Expert' END AS removal, "
    "CASE WHEN k % 17 = 3 OR k % 19 = 4 THEN NULL WHEN k % 6 = 0 THEN '' ELSE p_name END AS description FROM entry_rows",
)
def _(b: Bed):
    return reference_list.entries(entry_rows(b).select("package", "value"))


@query("s4_list_provenance", "SELECT package, filter_verdict, CAST(25 AS BIGINT) AS entry_count, CAST(64 AS BIGINT) AS digest_length FROM (SELECT f.package, CASE WHEN f.package IN (SELECT 'nation.' || n_name FROM nation) THEN 'already_upstream' "
       "WHEN contains(f.package, 'auto_generated_rro_') THEN 'auto_generated_rro' WHEN v.filter_verdict = 'already_upstream' THEN 'queued' ELSE v.filter_verdict END AS filter_verdict FROM facts f JOIN verdicts_unlisted v USING (package))")
def _(b: Bed):
    # The list file holds one object built from the nations, 25 entries by definition.
    objects = b.raw("nation").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("nation."), "n_name"), F.struct(F.lit("Misc").alias("list")))))).alias("value"))
    path = fresh_path(b.spark, "reference-list")
    objects.coalesce(1).write.text(path)
    listed, provenance = reference_list.load_reference_list(b.spark, f"{path}/*.txt")
    shipped = b.observations.groupBy("package").agg(F.collect_set("device_key").alias("devices"))
    rows = reference_list.with_provenance(queueing.filter_verdicts(shipped, listed), provenance)
    return rows.select("package", "filter_verdict", F.col("list_provenance.entry_count").cast("long").alias("entry_count"), F.length("list_provenance.sha256").cast("long").alias("digest_length"))


cte("verdicts_unlisted", "SELECT package, CASE WHEN len(devices) > 0 AND len(list_filter(devices, lambda d: contains(lower(d), 'emulator') OR contains(lower(d), 'sdk_gphone'))) = len(devices) THEN 'emulator_only' ELSE 'queued' END AS filter_verdict FROM facts")

# --- config documents -----------------------------------------------------------------------
config_docs = both(
    "config_docs",
    "SELECT c_custkey AS k, 'oem' || CAST(c_custkey % 6 AS STRING) || ':dev' || CAST(c_custkey AS STRING) AS device_key, 'etc/doc' || CAST(c_custkey AS STRING) || '.xml' AS path, "
    "CASE WHEN c_custkey % 17 = 0 THEN '<!doctype x []><permissions/>' WHEN c_custkey % 23 = 1 THEN '<permissions><broken>' ELSE "
    "'<?xml version=\"1.0\"?><permissions><group><privapp-permissions package=\"pkg.' || CAST(c_custkey AS STRING) || '\"><permission name=\"perm.A\"/><permission name=\"perm.' || CAST(c_custkey % 7 AS STRING) || '\"/><deny-permission name=\"no\"/></privapp-permissions></group>"
    "<library name=\"lib' || CAST(c_custkey % 3 AS STRING) || '\"/><role name=\"role.' || CAST(c_custkey % 5 AS STRING) || '\" ' || CASE WHEN c_custkey % 2 = 0 THEN 'static=\"true\" ' ELSE '' END || 'defaultHolders=\"h' || CAST(c_custkey AS STRING) || ' ; h0;\"/></permissions>' END AS content FROM {customer}",
    "customer",
)


@query(
    "s5_config_harvest",
    "SELECT device_key, 'failed' AS kind, path AS key, CAST(NULL AS VARCHAR) AS value FROM config_docs WHERE k % 17 = 0 OR k % 23 = 1 "
    "UNION ALL SELECT device_key, 'read', path, NULL FROM config_docs WHERE NOT (k % 17 = 0 OR k % 23 = 1) "
    "UNION ALL SELECT device_key, 'privapp', 'pkg.' || k, unnest([NULL, 'perm.A', 'perm.' || (k % 7)]) FROM config_docs WHERE NOT (k % 17 = 0 OR k % 23 = 1) "
    "UNION ALL SELECT device_key, 'library', 'lib' || (k % 3), NULL FROM config_docs WHERE NOT (k % 17 = 0 OR k % 23 = 1) "
    "UNION ALL SELECT device_key, 'role', 'role.' || (k % 5), unnest(['h' || k, 'h0']) FROM config_docs WHERE NOT (k % 17 = 0 OR k % 23 = 1) AND k % 2 = 0",
)
def _(b: Bed):
    docs = config_docs(b).select("device_key", "path", F.col("content").cast("binary").alias("content"))
    return documents.harvest_configs(docs)


manifest_docs = both(
    "manifest_docs",
    "SELECT p_partkey AS k, CAST(p_partkey AS STRING) AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN '/system/priv-app/p.apk' ELSE '/product/app/p.apk' END AS device_path, "
    "CASE WHEN p_partkey % 29 = 0 THEN '<manifest' ELSE '<manifest xmlns:android=\"http://schemas.android.com/apk/res/android\"' || CASE WHEN p_partkey % 31 = 1 THEN '' ELSE ' package=\"pkg.' || CAST(p_partkey AS STRING) || '\"' END || "
    "CASE WHEN p_partkey % 4 = 0 THEN ' coreApp=\"true\"' ELSE ' android:coreApp=\"true\"' END || ' android:versionCode=\"' || CASE WHEN p_partkey % 5 = 0 THEN '0x1F' WHEN p_partkey % 5 = 1 THEN '@7f01' ELSE CAST(p_partkey AS STRING) END || '\">"
    "<queries><package android:name=\"q.a\"/><package android:name=\"q.a\"/></queries><protected-broadcast android:name=\"b.' || CAST(p_partkey % 3 AS STRING) || '\"/>"
    "<application android:hasCode=\"' || CASE WHEN p_partkey % 6 = 0 THEN 'false' ELSE 'true' END || '\"><uses-library android:name=\"lib.a\"/><uses-library android:name=\"lib.b\" android:required=\"false\"/>' || "
    "CASE WHEN p_partkey % 2 = 0 THEN '<uses-static-library android:name=\"lib.b\" android:version=\"2\"/>' ELSE '' END || '<library android:name=\"prov\"/><static-library android:name=\"sprov\" android:version=\"7\"/>"
    "<provider android:name=\"P\" android:authorities=\"a.' || CAST(p_partkey AS STRING) || '; b ;a.' || CAST(p_partkey AS STRING) || '\"/>' || "
    "CASE WHEN p_partkey % 7 = 0 THEN '<service android:name=\"S\"><intent-filter android:priority=\"5\"><action android:name=\"android.view.InputMethod\"/></intent-filter></service>' ELSE '' END || '</application></manifest>' END AS manifest FROM {part}",
    "part",
)


@query(
    "s6_manifest_facts",
    "SELECT doc_id, NOT (k % 29 = 0 OR k % 31 = 1) AS ok, CASE WHEN k % 29 = 0 OR k % 31 = 1 THEN NULL ELSE 'pkg.' || k END AS package, CASE WHEN k % 29 = 0 OR k % 5 = 1 THEN NULL WHEN k % 5 = 0 THEN 31 ELSE k END AS version_code, "
    "k % 3 = 0 AS priv_app, k % 29 > 0 AND k % 4 = 0 AS core_app, k % 29 = 0 OR k % 6 > 0 AS has_code, CASE WHEN k % 29 = 0 THEN '' WHEN k % 2 = 0 THEN 'lib.a,lib.b' ELSE 'lib.a' END AS required, "
    "CASE WHEN k % 29 = 0 OR k % 2 = 0 THEN '' ELSE 'lib.b' END AS optional, CASE WHEN k % 29 = 0 THEN '' ELSE 'a.' || k || ',b' END AS authorities, CASE WHEN k % 29 = 0 THEN '' ELSE 'q.a' END AS queries, "
    "CASE WHEN k % 29 = 0 THEN '' ELSE 'sprov:7' END AS static_libraries, k % 29 > 0 AND k % 7 = 0 AS is_input_method FROM manifest_docs",
)
def _(b: Bed):
    f = documents.manifest_facts(manifest_docs(b))
    static = F.transform("static_libraries", lambda x: F.concat_ws(":", x["name"], x["version"].cast("string")))

    def listed(c):
        return F.coalesce(joined(c), F.lit(""))

    return f.select(
        "doc_id", "ok", "package", "version_code", "priv_app", "core_app", "has_code", listed("uses_libraries_required").alias("required"), listed("uses_libraries_optional").alias("optional"),
        listed("provider_authorities").alias("authorities"), listed("queries_packages").alias("queries"), listed(static).alias("static_libraries"), F.coalesce("is_input_method", F.lit(False)).alias("is_input_method"),
    )


uri_texts = both(
    "uri_texts",
    "SELECT doc_id, 'x CONTENT://auth.' || CAST(doc_id % 10 AS STRING) || '/p content:///lead' || CAST(doc_id % 3 AS STRING) || '/x content://é' || '/y content:////z ' || text AS body FROM {documents}",
    "documents",
)


@query("s7_content_authorities", "SELECT doc_id, 'auth.' || (doc_id % 10) || ',lead' || (doc_id % 3) AS authorities FROM uri_texts")
def _(b: Bed):
    return uri_texts(b).select("doc_id", joined(tx.content_authorities(F.col("body"))).alias("authorities"))


# --- catalogue ------------------------------------------------------------------------------
REJECT = (
    "CASE WHEN NOT regexp_full_match(device, '[A-Za-z0-9_-]{{1,64}}') THEN 'device' WHEN NOT regexp_full_match(build, '[A-Za-z0-9._-]{{1,64}}') THEN 'build' WHEN NOT starts_with(url, 'https://') THEN 'url' WHEN size <= 0 THEN 'size' END"
).replace("{{", "{").replace("}}", "}")
cte("catalogue", f"SELECT *, {REJECT} AS rejected FROM catalogue_raw")
cte("catalogue_valid", "SELECT * FROM catalogue WHERE rejected IS NULL")
cte("chronology", "SELECT *, row_number() OVER (PARTITION BY driver ORDER BY published_at, region, build, file_position) AS position FROM catalogue_valid")
_digits = "regexp_extract(build, '\\.(\\d{6})\\.', 1)"
_date = f"CAST(try_strptime(nullif({_digits}, ''), '%y%m%d') AS DATE)"


def valid(b: Bed):
    return cat.ingest(b.table("catalogue_raw")).filter("rejected IS NULL")


@query("s8_catalogue_ingest", "SELECT driver, coalesce(rejected, 'valid') AS outcome, count(*) AS rows FROM catalogue GROUP BY ALL")
def _(b: Bed):
    return cat.rejected_counts(cat.ingest(b.table("catalogue_raw")))


factory_html = both(
    "factory_html",
    "SELECT o_orderkey AS file_position, '<tr id=\"x\"><td data-label=\"d for ' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Phone ' || CAST(o_custkey AS STRING) END || ' [CP1A.1]\">17.0 (CP1A, Jul)</td><td>' || CASE WHEN o_orderkey % 4 = 0 THEN 'nolink' ELSE "
    "'<a href=\"https://dl.google.com/dl/android/aosp/dev' || CAST(o_custkey % 9 AS STRING) || '-cp1a.' || CAST(o_orderkey AS STRING) || '-factory-ab12.zip\">x</a>' END || '</td><td>' || md5(CAST(o_orderkey AS STRING)) || md5(CAST(o_custkey AS STRING)) || '</td></tr>' AS row, o_custkey AS c FROM {orders}",
    "orders",
)


@query(
    "s8_factory_index_rows",
    "SELECT file_position, 'pixel' AS driver, 'dev' || (c % 9) AS device, 'CP1A.' || file_position AS build, 'https://dl.google.com/dl/android/aosp/dev' || (c % 9) || '-cp1a.' || file_position || '-factory-ab12.zip' AS url, "
    "md5(CAST(file_position AS VARCHAR)) || md5(CAST(c AS VARCHAR)) AS sha256, CASE WHEN file_position % 3 = 0 THEN NULL ELSE 'Phone ' || c END AS marketing_name FROM factory_html WHERE file_position % 4 <> 0",
)
def _(b: Bed):
    return cat.factory_rows(factory_html(b)).select("file_position", "driver", "device", "build", "url", "sha256", "marketing_name")


artifact_paths = both(
    "artifact_paths",
    "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'app/a' || CAST(event_id AS STRING) || '.apk' WHEN 1 THEN 'system/etc/permissions/x.xml' WHEN 2 THEN 'etc/sysconfig/any' WHEN 3 THEN 'etc/permissions/x.txt' WHEN 4 THEN 'x/privapp-permissions-vendor.xml' "
    "WHEN 5 THEN 'deep/er/roles.xml' WHEN 6 THEN 'lib/libx.so' WHEN 7 THEN 'a.apk/readme' ELSE 'etc/default-permissions/d.xml' END AS path FROM {events}",
    "events",
)


@query("s9_artifact_paths", "SELECT event_id, " + " OR ".join(f"('/' || path) GLOB '{g}'" for g in ARTIFACT_GLOBS) + " AS artifact FROM artifact_paths")
def _(b: Bed):
    return artifact_paths(b).select("event_id", cat.is_artifact(F.col("path")).alias("artifact"))


@query("w8_catalogue_chronology", "SELECT driver, file_position, position FROM chronology")
def _(b: Bed):
    return cat.chronology(valid(b)).select("driver", "file_position", F.col("position").cast("long").alias("position"))


_newest = f"SELECT driver, device, build AS newest_build FROM chronology QUALIFY row_number() OVER (PARTITION BY driver, device ORDER BY {_date} IS NOT NULL DESC, {_date} DESC NULLS LAST, position DESC) = 1"
cte("newest_build_rows", _newest)


@query("w6_newest_build", "SELECT driver, device, newest_build FROM newest_build_rows")
def _(b: Bed):
    return cat.newest_builds(cat.chronology(valid(b)))


@query(
    "w6_named_build",
    "SELECT driver, device, build, position FROM chronology WHERE (driver, device, upper(build)) IN (SELECT driver, device, upper(build) FROM catalogue_valid WHERE file_position % 10 = 0) QUALIFY row_number() OVER (PARTITION BY driver, device, upper(build) ORDER BY position) = 1",
)
def _(b: Bed):
    wanted = valid(b).filter("file_position % 10 = 0").select("driver", "device", F.lower("build").alias("build"))
    return cat.named_build(cat.chronology(valid(b)), wanted).select("driver", "device", "build", F.col("position").cast("long").alias("position"))


@query(
    "a30_device_options",
    "SELECT c.driver, c.device, count(*) AS build_count, max(n.newest_build) AS newest_build, coalesce(arg_min(c.marketing_name, c.position) FILTER (WHERE length(c.marketing_name) > 0), '') AS marketing_name FROM chronology c JOIN newest_build_rows n USING (driver, device) GROUP BY c.driver, c.device",
)
def _(b: Bed):
    return cat.device_options(cat.chronology(valid(b)))


@query(
    "a31_source_completeness",
    "WITH h AS (SELECT coalesce(nullif(regexp_extract(source_url, '^https://([^/]+)/', 1), ''), '') AS host, rejected FROM catalogue), e AS (SELECT unnest(['gate0.example', 'gate1.example', 'gate2.example', 'gate9.example']) AS host) "
    "SELECT e.host, count(h.host) FILTER (WHERE h.rejected IS NULL) AS rows, CASE WHEN count(h.host) FILTER (WHERE h.rejected IS NULL) = 0 THEN 'missing' ELSE 'present' END AS state FROM e LEFT JOIN h USING (host) GROUP BY e.host "
    "UNION ALL SELECT host, count(*), CASE WHEN host = '' THEN 'unattributed' ELSE 'foreign' END FROM h WHERE host NOT IN (SELECT host FROM e) GROUP BY host",
)
def _(b: Bed):
    expected = b.spark.createDataFrame([(f"gate{i}.example",) for i in (0, 1, 2, 9)], "host string")
    return cat.source_completeness(cat.ingest(b.table("catalogue_raw")), expected)


volume_files = both(
    "volume_files",
    "SELECT l_orderkey AS owner, 'set' || CAST(l_orderkey % 3 AS STRING) || '-image-logical.7z.00' || CAST(l_linenumber AS STRING) AS file FROM {lineitem}",
    "lineitem",
)


@query(
    "a34_volume_sets",
    "SELECT owner, stem, count(*) AS volumes, list_sort(list(i)) = range(1, count(*) + 1) AS complete FROM (SELECT owner, regexp_extract(file, '^(.+)-image-logical', 1) AS stem, CAST(right(file, 3) AS BIGINT) AS i FROM volume_files) GROUP BY owner, stem",
)
def _(b: Bed):
    return cat.volume_sets(volume_files(b))


scans = both("scans", "SELECT 'oem' || CAST(l_suppkey % 6 AS STRING) || ':dev' || CAST(l_suppkey AS STRING) AS device_key, count(*) AS total, sum(CASE WHEN l_quantity < 4 THEN 1 ELSE 0 END) AS failed FROM {lineitem} GROUP BY l_suppkey", "lineitem")


@query("p15_parse_budget", "SELECT device_key, total, CAST(failed AS BIGINT) AS failed, failed / total <= 0.05 AS accepted FROM scans")
def _(b: Bed):
    return cat.parse_budget(scans(b)).select("device_key", "total", "failed", "accepted")


images = both(
    "images",
    "SELECT o_orderkey AS image_id, 'dev' || CAST(o_custkey AS STRING) AS device, CASE o_orderkey % 7 WHEN 0 THEN 'system_a' WHEN 1 THEN 'system_b' WHEN 2 THEN 'vendor_b' WHEN 3 THEN 'product' WHEN 4 THEN 'boot_a' WHEN 5 THEN '_b' ELSE 'system' END AS name FROM {orders}",
    "orders",
)


@query(
    "p16_slot_resolution",
    "WITH kept AS (SELECT *, CASE WHEN length(name) > 2 AND (name LIKE '%\\_a' ESCAPE '\\' OR name LIKE '%\\_b' ESCAPE '\\') THEN substr(name, 1, length(name) - 2) ELSE name END AS identity FROM images i WHERE NOT (name LIKE '%\\_b' ESCAPE '\\' "
    "AND EXISTS (SELECT 1 FROM images s WHERE s.device = i.device AND s.name = substr(i.name, 1, length(i.name) - 2) || '_a'))) SELECT image_id, device, name, identity, count(*) OVER (PARTITION BY device, identity) > 1 AS collides FROM kept",
)
def _(b: Bed):
    return cat.resolve_slots(images(b)).select("image_id", "device", "name", "identity", "collides")


# --- text and pages -------------------------------------------------------------------------
_ws = "[\\x{0009}-\\x{000d}\\x{001c}-\\x{0020}\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def clean(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, chr(0), ''), '{_ws}', ' ', 'g'))"


@query("f6_clean_text", f"SELECT doc_id, {clean('text')} AS clean FROM documents")
def _(b: Bed):
    return b.raw("documents").select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


_stripped = "regexp_replace(regexp_replace(html, '(?s)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_unescaped = f"replace(replace(replace(replace(regexp_replace({_stripped}, '(?s)<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


@query("f7_page_text", f"SELECT page_id, {clean(_unescaped)} AS page_text FROM pages")
def _(b: Bed):
    return b.raw("pages").select("page_id", documents.page_text(F.col("html")).alias("page_text"))


@query(
    "f8_judged_text",
    "SELECT result_id, CASE WHEN length(coalesce(page_text, '')) > length(coalesce(snippet, '')) THEN 'page_text' ELSE 'search_snippet' END AS kind, "
    "CASE WHEN length(coalesce(page_text, '')) > length(coalesce(snippet, '')) THEN page_text WHEN coalesce(snippet, '') <> '' THEN snippet ELSE coalesce(page_text, '') END AS judged FROM search_results",
)
def _(b: Bed):
    pair = (F.col("page_text"), F.col("snippet"))
    return b.table("search_results").select("result_id", tx.evidence_kind(*pair).alias("kind"), tx.judged_text(*pair).alias("judged"))


urls = both(
    "urls",
    "SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'http://127.0.0.1/x' WHEN 1 THEN 'https://10.1.2.' || CAST(event_id % 250 AS STRING) || '/' WHEN 2 THEN 'http://[::1]:80/' WHEN 3 THEN 'http://[::ffff:169.254.1.1]/' WHEN 4 THEN 'ftp://host/x' WHEN 5 THEN 'javascript:alert(1)' "
    "WHEN 6 THEN 'http://[2002:808:808::]/' WHEN 7 THEN 'http://[2001:0:1::]/' WHEN 8 THEN 'https://site' || CAST(event_id AS STRING) || '.example.org/p?q=1' WHEN 9 THEN 'http://0.0.0.0/' WHEN 10 THEN 'http://224.0.0.1/' ELSE 'http://240.0.0.1/' END AS url FROM {events}",
    "events",
)


@query(
    "f9_url_check",
    "SELECT event_id, event_id % 12 NOT IN (4, 5) AS fetchable, CASE event_id % 12 WHEN 0 THEN 'loopback' WHEN 1 THEN 'private' WHEN 2 THEN 'loopback' WHEN 3 THEN 'link-local' WHEN 6 THEN '6to4' WHEN 7 THEN 'teredo' WHEN 9 THEN 'unspecified' WHEN 10 THEN 'multicast' WHEN 11 THEN 'private' END AS blocked FROM urls",
)
def _(b: Bed):
    return urls(b).select("event_id", url_check(F.col("url")).alias("c")).select("event_id", "c.fetchable", "c.blocked")


@query(
    "f20_canonical_device_path",
    "SELECT DISTINCT partition, path, CASE WHEN split_part(path, '/', 1) = partition THEN '/' || path ELSE '/' || partition || '/' || path END AS device_path FROM image_paths",
)
def _(b: Bed):
    return image_paths(b).distinct().withColumn("device_path", tx.canonical_device_path(F.col("partition"), F.col("path")))


image_paths = both(
    "image_paths",
    "SELECT CASE l_returnflag WHEN 'A' THEN 'system' ELSE 'product' END AS partition, CASE WHEN l_linestatus = 'F' THEN 'system/app/p' ELSE 'app/p' END || CAST(l_partkey AS STRING) || '.apk' AS path FROM {lineitem}",
    "lineitem",
)


@query("f21_build_date", f"SELECT file_position, strftime({_date}, '%Y-%m-%d') AS build_date FROM catalogue_raw")
def _(b: Bed):
    return b.table("catalogue_raw").select("file_position", F.date_format(tx.build_date(F.col("build")), "yyyy-MM-dd").alias("build_date"))


@query(
    "f22_usage_counters",
    "SELECT package, CAST(json_extract_string(usage, '$.prompt_cache_hit_tokens') AS BIGINT) AS cache_hit_tokens, coalesce(TRY_CAST(json_extract_string(usage, '$.completion_tokens_details.reasoning_tokens') AS BIGINT), 0) AS reasoning_tokens FROM classification",
)
def _(b: Bed):
    return b.table("classification").select("package", tx.usage_counters(F.col("usage")).alias("u")).select("package", "u.*")


versions = both("versions", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'A/B/C' WHEN 1 THEN 'A/B/' WHEN 2 THEN 'A/B/C/D' ELSE 'A' || CAST(o_custkey AS STRING) || '/B' END AS version FROM {orders}", "orders")


@query("f27_version_normalisation", "SELECT k, CASE k % 4 WHEN 0 THEN 'A/B/C/A' WHEN 1 THEN 'A/B/A/A' ELSE version END AS normal FROM versions")
def _(b: Bed):
    return versions(b).select("k", tx.normalize_version(F.col("version")).alias("normal"))


# --- search results and verdict rows --------------------------------------------------------
cte("display_rows", "SELECT DISTINCT package, CAST(result_id % 4 AS BIGINT) AS position, block, CASE WHEN display_rank = 2 THEN NULL ELSE block_index END AS item FROM search_results WHERE display_rank IS NOT NULL")
cte(
    "merged_results",
    "WITH placed AS (SELECT s.*, (SELECT min(d.position) FROM display_rows d WHERE d.package = s.package AND d.block = s.block AND (d.item IS NULL OR d.item = s.block_index)) AS shown FROM search_results s), "
    "firsts AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY package, url ORDER BY shown IS NULL, shown, block <> 'web', block_index) = 1) "
    "SELECT package, CAST(row_number() OVER (PARTITION BY package ORDER BY shown IS NULL, shown, block <> 'web', block_index) AS BIGINT) AS position, url, result_id FROM firsts QUALIFY row_number() OVER (PARTITION BY package ORDER BY shown IS NULL, shown, block <> 'web', block_index) <= 3",
)


def display(b: Bed):
    r = b.table("search_results").filter("display_rank IS NOT NULL")
    return r.select("package", (F.col("result_id") % 4).alias("position"), "block", F.when(F.col("display_rank") != 2, F.col("block_index")).alias("item")).distinct()


@query("w7_search_merge", "SELECT package, position, url, result_id FROM merged_results")
def _(b: Bed):
    items = b.table("search_results").select("package", "block", "block_index", "url", "title", "result_id")
    return searching.merge_results(items, display(b), 3).select("package", F.col("position").cast("long").alias("position"), "url", "result_id")


@query("a33_family_rate", "SELECT split_part(package, '.', 1) || '.' || split_part(package, '.', 2) AS family, count(*) AS judged, count(*) FILTER (WHERE status = 'corroborated') AS supported FROM corroboration WHERE status IN ('corroborated', 'uncorroborated') GROUP BY 1")
def _(b: Bed):
    return searching.family_rate(b.table("corroboration"))
