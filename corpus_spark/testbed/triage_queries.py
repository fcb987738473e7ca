"""Triage and emission queries: J9-J12, J16, W1-W3, P6, P7, P12, A25-A29, O1-O4, F12, F19, F23-F25, S13, C5, C6, C8."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_spark.fixed_values import CATEGORIES, TIERS, VIEWS
from corpus_spark.operators import browse, devices, emission, invariants, triage
from corpus_spark.operators.validation import emission_fault
from corpus_spark.plans import board
from corpus_spark.functions.text import device_key_parts
from corpus_spark.session import fresh_path
from corpus_spark.testbed.core_queries import RANK
from corpus_spark.testbed.oracle import cte
from corpus_spark.testbed.registry import Bed, joined, query

cte(
    "stored_facts",
    "SELECT package, count(DISTINCT device_key) AS device_count, list_sort(list(DISTINCT device_key)) AS devices, list_sort(list(DISTINCT partition)) AS partitions, max(icon_mime) AS icon_mime, "
    "count(DISTINCT cert_subject) > 1 AS has_conflict FROM observations GROUP BY package",
)
cte("latest_decision", "SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY package ORDER BY decided_at DESC, id DESC) = 1")
cte("shipped", "SELECT p.package, e.branch AS shipped_branch FROM emission_packages p JOIN emissions e USING (emission_id) WHERE e.commit_oid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p.package ORDER BY e.emission_id DESC) = 1")
cte(
    "board",
    "SELECT c.package, c.bundle_sha256, c.removal, c.confidence, c.parked, len(c.unknown_fields) > 0 AS unknown, f.device_count, coalesce(f.has_conflict, false) AS has_conflict, f.icon_mime IS NOT NULL AS has_icon, a.floor, "
    "r.status AS corroboration, s.shipped_branch, CASE WHEN d.bundle_sha256 = c.bundle_sha256 THEN d.action END AS current_action "
    "FROM classification c LEFT JOIN stored_facts f USING (package) LEFT JOIN stored_analysis a USING (package) LEFT JOIN corroboration r USING (package) LEFT JOIN latest_decision d USING (package) LEFT JOIN shipped s USING (package)",
)
_shipped = "coalesce(current_action, '') = 'approve' AND shipped_branch IS NOT NULL"
cte(
    "board_views",
    "SELECT *, NOT parked AND coalesce(current_action, '') IN ('', 'edit', 'reopen') AS in_queue, NOT parked AND coalesce(current_action, '') = 'defer' AS in_deferred, "
    f"NOT parked AND coalesce(current_action, '') IN ('approve', 'reject') AND NOT ({_shipped}) AS in_decided, NOT parked AND {_shipped} AS in_shipped, parked AS in_parked FROM board",
)


def stored_facts(b: Bed):
    grouped = b.observations.groupBy("package").agg(
        F.sort_array(F.collect_set("device_key")).alias("devices"),
        F.sort_array(F.collect_set("partition")).alias("partitions"),
        F.max("icon_mime").alias("icon_mime"),
        (F.min("cert_subject") != F.max("cert_subject")).alias("has_conflict"),
    )
    return grouped.withColumn("device_count", F.size("devices").cast("long"))


def inputs(b: Bed):
    return (
        b.table("classification"), stored_facts(b), b.table("stored_analysis"), b.table("corroboration"),
        b.table("decisions"), b.table("emission_packages"), b.table("emissions"),
    )


def rows(b: Bed):
    return triage.triage_rows(*inputs(b))


BOARD = ["package", "removal", "confidence", "parked", "unknown", "device_count", "has_conflict", "has_icon", "floor", "corroboration", "shipped_branch", "current_action"]


@query("j9_triage_join", f"SELECT {', '.join(BOARD)} FROM board")
def _(b: Bed):
    return rows(b).select(*BOARD)


@query("w1_latest_decision", "SELECT package, bundle_sha256, action, reason, strftime(decided_at, '%Y-%m-%d') AS day FROM latest_decision")
def _(b: Bed):
    return triage.latest_decisions(b.table("decisions")).select("package", "bundle_sha256", "action", "reason", F.date_format("decided_at", "yyyy-MM-dd").alias("day"))


@query("w2_latest_shipped_branch", "SELECT package, shipped_branch FROM shipped")
def _(b: Bed):
    return triage.shipped_branches(b.table("emission_packages"), b.table("emissions"))


@query("j10_shipped_join", "SELECT p.package, e.branch, count(*) AS n FROM emission_packages p JOIN emissions e USING (emission_id) WHERE e.commit_oid IS NOT NULL GROUP BY ALL")
def _(b: Bed):
    committed = b.table("emissions").filter("commit_oid IS NOT NULL")
    return b.table("emission_packages").join(committed, "emission_id").groupBy("package", "branch").agg(F.count(F.lit(1)).alias("n"))


@query("w3_decision_history", "SELECT d.package, d.id, d.action, d.bundle_sha256 = c.bundle_sha256 AS is_current FROM decisions d JOIN classification c USING (package)")
def _(b: Bed):
    return triage.decision_history(b.table("decisions"), b.table("classification")).select("package", "id", "action", "is_current")


@query("p7_current_decision", "SELECT package, current_action FROM board WHERE current_action IS NOT NULL")
def _(b: Bed):
    return rows(b).filter("current_action IS NOT NULL").select("package", "current_action")


@query("p6_view_membership", "SELECT package, " + ", ".join(f"in_{v}" for v in VIEWS) + " FROM board_views")
def _(b: Bed):
    return triage.with_views(rows(b)).select("package", *[f"in_{v}" for v in VIEWS])


COUNTS = " UNION ALL ".join(f"SELECT '{v}' AS view, count(*) FILTER (WHERE in_{v}) AS packages FROM board_views" for v in VIEWS)


@query("a25_view_counts", COUNTS)
def _(b: Bed):
    return triage.view_counts(rows(b))


@query("a26_approved_names", "SELECT package FROM board WHERE current_action = 'approve'")
def _(b: Bed):
    return triage.approved_names(rows(b))


@query("o1_triage_ranking", "SELECT package, device_count FROM board_views WHERE in_queue")
def _(b: Bed):
    return browse.ranked(triage.in_view(rows(b), "queue")).select("package", "device_count")


@query("o2_tier_sort", "SELECT package, floor FROM board")
def _(b: Bed):
    r = rows(b)
    return r.orderBy(*browse.screen_order(r, "floor")).select("package", "floor")


@query("o3_offset_paging", "SELECT package, device_count FROM stored_facts ORDER BY device_count DESC, package LIMIT 50 OFFSET 100")
def _(b: Bed):
    facts = stored_facts(b)
    return browse.page(facts, 3, facts.count()).select("package", "device_count")


@query("o4_newest_log", "SELECT emission_id, branch, (SELECT count(*) FROM emissions) AS total FROM emissions ORDER BY created_at DESC, emission_id DESC LIMIT 20")
def _(b: Bed):
    return browse.newest(b.table("emissions"), "created_at", "emission_id", 20).select("emission_id", "branch", "total")


@query(
    "c5_triage_board",
    "SELECT 'row' AS kind, package, CAST(device_count AS BIGINT) AS n, current_action AS detail FROM board_views WHERE in_queue UNION ALL SELECT 'count', view, packages, NULL FROM (" + COUNTS + ")",
)
def _(b: Bed):
    r, counts = board.triage_board(*inputs(b))
    shown = board.ranked_view(r, "queue").select(F.lit("row").alias("kind"), "package", F.col("device_count").alias("n"), F.col("current_action").alias("detail"))
    return shown.unionByName(counts.select(F.lit("count").alias("kind"), F.col("view").alias("package"), F.col("packages").alias("n"), F.lit(None).cast("string").alias("detail")))


# --- emission -------------------------------------------------------------------------------
cte(
    "details",
    "SELECT c.package, c.description, c.target_list, c.removal, c.bundle_sha256, c.model, c.parked, a.floor, coalesce(a.dependencies, []) AS dependencies, coalesce(a.needed_by, []) AS needed_by, coalesce(f.devices, []) AS devices "
    "FROM classification c JOIN board b USING (package) LEFT JOIN stored_analysis a USING (package) LEFT JOIN stored_facts f USING (package) WHERE b.current_action = 'approve'",
)
REFUSE = "CASE WHEN parked THEN 'parked' WHEN description IS NULL THEN 'no description' WHEN target_list IS NULL THEN 'no list' WHEN removal IS NULL THEN 'no removal' WHEN floor IS NULL THEN 'no floor' END"
_drivers = "list_distinct(list_transform(devices, lambda d: split_part(d, ':', 1)))"
VENDOR = f"CASE WHEN len(devices) = 0 THEN NULL WHEN len({_drivers}) = 1 THEN ({_drivers})[1] ELSE 'shared' END"
_tiers = "('" + "','".join(TIERS) + "')"


def _name_fault(x: str) -> str:
    return f"CASE WHEN trim({x}) = '' THEN 'blank' WHEN {x} <> trim({x}) THEN 'padded' WHEN length({x}) > 255 THEN 'too long' WHEN NOT regexp_full_match({x}, '[A-Za-z0-9._-]+') THEN 'not a package name' END"


def _list_fault(field: str, column: str) -> str:
    return f"CASE WHEN len({column}) > 64 THEN '{field}: too many names' WHEN len(list_filter({column}, lambda x: {_name_fault('x')} IS NOT NULL)) > 0 THEN '{field}: ' || list_transform({column}, lambda x: {_name_fault('x')})[1] END"


FAULT = (
    f"coalesce('package: ' || {_name_fault('package')}, CASE WHEN coalesce(target_list NOT IN ('" + "','".join(CATEGORIES) + "'), true) THEN 'list: not a category' END, "
    f"CASE WHEN coalesce(removal NOT IN {_tiers}, true) THEN 'removal: not a tier' END, CASE WHEN description IS NULL OR trim(description) = '' THEN 'description: blank' WHEN regexp_matches(description, '​') THEN 'description: hidden character' END, "
    "CASE WHEN contains(description, ' ' || chr(10)) OR contains(description, chr(10) || ' ') THEN 'description: whitespace next to a newline' END, "
    f"CASE WHEN coalesce(floor NOT IN {_tiers}, true) THEN 'floor: not a tier' END, CASE WHEN {RANK.format(x='removal')} < {RANK.format(x='floor')} THEN 'removal: below the floor' END, "
    + _list_fault("dependencies", "dependencies") + ", " + _list_fault("neededBy", "needed_by") + ")"
)
cte("batch", f"SELECT *, {VENDOR} AS vendor, CASE WHEN {VENDOR} IS NULL THEN 'no vendor' ELSE coalesce({REFUSE}, {FAULT}) END AS refusal, package IN (SELECT package FROM reference_list) AS carried FROM details")


def details(b: Bed):
    classification, facts, analysis, *_ = inputs(b)
    return emission.approved_details(triage.approved_names(rows(b)), classification, analysis, facts)


def batch(b: Bed):
    classification, facts, analysis, *_ = inputs(b)
    return board.emission_batch(rows(b), classification, analysis, facts, b.table("reference_list"))


@query("j11_approved_details", "SELECT package, description, target_list, removal, floor, array_to_string(dependencies, ',') AS dependencies, len(devices) AS n FROM details")
def _(b: Bed):
    d = details(b)
    return d.select("package", "description", "target_list", "removal", "floor", F.coalesce(joined("dependencies"), F.lit("")).alias("dependencies"), F.coalesce(F.size("devices"), F.lit(0)).cast("long").alias("n"))


@query("p12_shipping_refusal", f"SELECT package, {REFUSE} AS refusal FROM details")
def _(b: Bed):
    return details(b).select("package", emission.shipping_refusal().alias("refusal"))


@query("a27_vendor_grouping", f"SELECT package, {VENDOR} AS vendor FROM stored_facts")
def _(b: Bed):
    return stored_facts(b).select("package", emission.vendor_of(F.col("devices")).alias("vendor"))


@query("a27_vendor_profiles", f"SELECT package, {VENDOR} AS vendor FROM facts")
def _(b: Bed):
    return devices.device_profiles(b.observations).select("package", devices.vendor().alias("vendor"))


@query("a28_duplicate_guard", "SELECT package, count(*) AS copies FROM emission_packages GROUP BY package HAVING count(*) > 1")
def _(b: Bed):
    return emission.duplicates(b.table("emission_packages"))


@query("j12_carried_split", "SELECT package, package IN (SELECT package FROM reference_list) AS carried FROM classification")
def _(b: Bed):
    return emission.carried_split(b.table("classification").select("package"), b.table("reference_list"))


@query(
    "f12_emission_validation",
    f"SELECT package, {FAULT} AS fault FROM (SELECT c.*, a.floor, coalesce(a.dependencies, []) AS dependencies, coalesce(a.needed_by, []) AS needed_by FROM classification c LEFT JOIN stored_analysis a USING (package))",
)
def _(b: Bed):
    empty = F.array().cast("array<string>")
    r = b.table("classification").join(b.table("stored_analysis"), "package", "left").withColumns(
        {"dependencies": F.coalesce("dependencies", empty), "needed_by": F.coalesce("needed_by", empty), "labels": empty})
    return r.select("package", emission_fault().alias("fault"))


@query(
    "f19_device_key_parts",
    "SELECT DISTINCT device_key, CASE WHEN strpos(device_key, ':') > 1 THEN split_part(device_key, ':', 1) END AS driver, substr(device_key, strpos(device_key, ':') + 1) AS device FROM observations",
)
def _(b: Bed):
    keys = b.observations.select("device_key").distinct()
    return keys.select("device_key", device_key_parts(F.col("device_key")).alias("p")).select("device_key", "p.*")


cte("shipping", "SELECT * FROM batch WHERE refusal IS NULL AND NOT carried")


@query("c6_emission_batch", "SELECT package, vendor, refusal, carried FROM batch")
def _(b: Bed):
    return batch(b).select("package", "vendor", "refusal", "carried")


@query(
    "s13_vendor_batch_files",
    "SELECT vendor, '{\"package\":\"' || package || '\",\"entry\":{\"list\":\"' || target_list || '\",\"description\":' || CAST(to_json(description) AS VARCHAR) || ',\"dependencies\":' || CAST(to_json(dependencies) AS VARCHAR) || ',\"neededBy\":' || CAST(to_json(needed_by) AS VARCHAR) || ',\"labels\":[],\"removal\":\"' || removal || '\"}}' AS value FROM shipping",
)
def _(b: Bed):
    path = fresh_path(b.spark, "vendor-batches")
    emission.write_vendor_batches(emission.shippable(batch(b)), path)
    return b.spark.read.schema("value string, vendor string").text(path).select("vendor", "value")


@query(
    "a29_disclosure_report",
    "SELECT vendor, '0' AS package, CAST(count(*) AS VARCHAR) || ' ' || string_agg(DISTINCT model, ', ' ORDER BY model) AS line FROM shipping GROUP BY vendor "
    "UNION ALL SELECT vendor, package, '| `' || package || '` | ' || target_list || ' | ' || removal || ' | `' || bundle_sha256 || '` |' FROM shipping",
)
def _(b: Bed):
    ready = emission.shippable(batch(b))
    heads = emission.disclosure_summary(ready).select("vendor", F.lit("0").alias("package"), F.concat_ws(" ", F.col("packages").cast("string"), "models").alias("line"))
    return heads.unionByName(emission.disclosure_lines(ready))


# --- card -----------------------------------------------------------------------------------
def _cut(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR len({x}) = 0 THEN '-' WHEN len({x}) > 8 THEN array_to_string({x}[1:8], ', ') || ' (+' || (len({x}) - 8) || ' more)' ELSE array_to_string({x}, ', ') END"


_missing = (
    "array_to_string(list_filter([CASE WHEN f.package IS NULL THEN 'firmware facts' END, CASE WHEN b.floor IS NULL THEN 'minimum rating' END, CASE WHEN b.corroboration IS DISTINCT FROM 'corroborated' THEN 'sources' END, "
    "CASE WHEN n.anchors IS NULL THEN 'upstream neighbours' END, CASE WHEN len(c.unknown_fields) > 0 THEN c.model || '''s answer (' || array_to_string(c.unknown_fields, ', ') || ')' END], lambda x: x IS NOT NULL), '|')"
)
cte(
    "card_pairs",
    "SELECT c.package, r.package AS anchor, list_aggregate(list_transform(range(1, least(len(string_split(c.package, '.')), len(string_split(r.package, '.'))) + 1), "
    "lambda i: CASE WHEN string_split(c.package, '.')[1:i] = string_split(r.package, '.')[1:i] THEN 1 ELSE 0 END), 'sum') AS shared "
    "FROM classification c JOIN reference_list r ON split_part(c.package, '.', 1) = split_part(r.package, '.', 1) AND split_part(c.package, '.', 2) = split_part(r.package, '.', 2) "
    "WHERE r.package <> c.package AND trim(r.description) <> ''",
)
cte("card_anchors", "SELECT package, string_agg(anchor, ',' ORDER BY shared DESC, anchor) AS anchors FROM (SELECT * FROM card_pairs QUALIFY row_number() OVER (PARTITION BY package ORDER BY shared DESC, anchor) <= 4) GROUP BY package")
cte(
    "cards",
    f"SELECT b.package, b.current_action, b.shipped_branch, c.description, {_missing} AS missing, {_cut('f.devices')} AS devices_text, {_cut('f.partitions')} AS partitions_text, coalesce(n.anchors, '') AS anchors, "
    "(SELECT count(*) FROM decisions d WHERE d.package = b.package) AS decisions FROM board b JOIN classification c USING (package) LEFT JOIN stored_facts f USING (package) LEFT JOIN card_anchors n USING (package)",
)


def cards(b: Bed):
    return board.triage_cards(*inputs(b), b.table("reference_list"))


@query("c8_triage_card", "SELECT * FROM cards")
def _(b: Bed):
    return cards(b).select("package", "current_action", "shipped_branch", "description", joined("missing", "|").alias("missing"), "devices_text", "partitions_text", F.coalesce(joined("anchors"), F.lit("")).alias("anchors"), "decisions")


@query("f23_missing_evidence", "SELECT package, missing FROM cards")
def _(b: Bed):
    return cards(b).select("package", joined("missing", "|").alias("missing"))


@query("f25_truncated_lists", f"SELECT package, {_cut('devices')} AS devices_text FROM stored_facts")
def _(b: Bed):
    return stored_facts(b).select("package", triage.truncated(F.col("devices")).alias("devices_text"))


@query(
    "f24_invariant_violations",
    "SELECT 'icon_pair' AS rule, count(*) FILTER (WHERE (icon_bytes IS NULL) <> (icon_mime IS NULL)) AS violations FROM observations "
    "UNION ALL SELECT 'reject_reason', count(*) FILTER (WHERE action = 'reject' AND trim(coalesce(reason, '')) = '') FROM decisions "
    "UNION ALL SELECT 'commit_pair', count(*) FILTER (WHERE (commit_oid IS NULL) <> (committed_at IS NULL)) FROM emissions "
    "UNION ALL SELECT 'reconciled_commit', count(*) FILTER (WHERE reconciled AND commit_oid IS NULL) FROM emissions "
    "UNION ALL SELECT 'observation_key', count(*) FROM (SELECT device_key, build, device_path FROM observations GROUP BY ALL HAVING count(*) > 1) "
    "UNION ALL SELECT 'verdict_row', count(*) FILTER (WHERE (status IN ('search_failed', 'judge_failed') AND (len(sources) > 0 OR reasoning IS NOT NULL)) OR (status NOT IN ('search_failed', 'judge_failed') AND failure_reason IS NOT NULL)) FROM corroboration",
)
def _(b: Bed):
    return invariants.violations(b.observations, b.table("decisions"), b.table("emissions"), b.table("corroboration"))


@query(
    "j16_cited_titles",
    "SELECT c.response_id, c.position, c.url, coalesce(s.title, '') AS title FROM citations c JOIN verdict_responses v USING (response_id) LEFT JOIN (SELECT package, url, max(title) AS title FROM search_results GROUP BY ALL) s ON s.package = v.package AND s.url = c.url",
)
def _(b: Bed):
    cited = b.table("citations").join(b.table("verdict_responses").select("response_id", "package"), "response_id")
    return triage.cited_titles(cited, b.table("search_results")).select("response_id", "position", "url", "title")
