"""Validation and rewrite queries: F10, F11, F14-F18, F26, J14, U2, C3, C4."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_spark.fixed_values import CATEGORIES, OEM_NAME_TOKENS, TIERS
from corpus_spark.operators import queueing, rewrite, searching, validation
from corpus_spark.plans import core, rounds
from corpus_spark.testbed.core_queries import RANK, core_of, derived, verdict_rows
from corpus_spark.testbed.document_queries import display
from corpus_spark.testbed.oracle import cte
from corpus_spark.testbed.registry import Bed, joined, query

_tok = "['" + "','".join(OEM_NAME_TOKENS) + "']"
_t = "('" + "','".join(TIERS) + "')"
cte(
    "name_categories",
    f"SELECT package, CASE WHEN len(list_filter(string_split(lower(package), '.'), lambda t: list_contains({_tok}, t))) > 0 THEN 'Oem' END AS category, "
    f"CASE WHEN len(list_filter(string_split(lower(package), '.'), lambda t: list_contains({_tok}, t))) > 0 THEN 'rule:oem_name_token' ELSE 'llm:list' END AS rule FROM responses",
)


def _g(key: str) -> str:
    return f"json_extract_string(j, '$.{key}')"


def validated_sql(source: str) -> str:
    """Rows of `source` (package, model, attempts, response, floor, category, rule) with a verdict."""
    known = "['description','list','removal','confidence','unknown_fields','reasoning_brief']"
    unknown = "list_contains(coalesce(CAST(json_extract(j, '$.unknown_fields') AS VARCHAR[]), []), 'description')"
    return (
        f"SELECT *, {_g('description')} AS p_description, {_g('list')} AS p_list, {_g('removal')} AS p_removal, {_g('confidence')} AS p_confidence, {_g('reasoning_brief')} AS p_reasoning, {unknown} AS declared, CASE "
        "WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'response: not a JSON object' WHEN list_contains(json_keys(j), 'labels') THEN 'labels: never model output' "
        f"WHEN json_type(j, '$.list') <> 'VARCHAR' OR {_g('list')} NOT IN ('" + "','".join(CATEGORIES) + "') THEN 'list: not a category' "
        f"WHEN {_g('removal')} NOT IN {_t} THEN 'removal: not a tier' WHEN len(list_filter(json_keys(j), lambda k: NOT list_contains({known}, k))) > 0 THEN list_filter(json_keys(j), lambda k: NOT list_contains({known}, k))[1] || ': extra field' "
        "WHEN len(list_filter(coalesce(CAST(json_extract(j, '$.unknown_fields') AS VARCHAR[]), []), lambda u: u <> 'description')) > 0 THEN 'unknown_fields: field cannot be unknown' "
        f"WHEN {unknown} AND {_g('description')} <> 'unknown' THEN 'description: declared unknown but described' "
        f"WHEN NOT {unknown} AND {_g('description')} <> trim({_g('description')}) THEN 'description: leading or trailing whitespace' "
        f"WHEN NOT {unknown} AND length({_g('description')}) < 20 THEN 'description: too short' WHEN NOT {unknown} AND length({_g('description')}) > 600 THEN 'description: too long' "
        f"WHEN NOT {unknown} AND contains({_g('description')}, ' ' || chr(10)) THEN 'description: space next to a newline' "
        f"WHEN {RANK.format(x=_g('removal'))} < coalesce({RANK.format(x='floor')}, -1) THEN 'removal: below the floor' WHEN category IS NOT NULL AND {_g('list')} <> category THEN 'list: contradicts the decided category' "
        f"WHEN length({_g('reasoning_brief')}) > 400 THEN 'reasoning_brief: too long' END AS rejected FROM (SELECT *, CASE WHEN json_valid(response) THEN CAST(response AS JSON) END AS j FROM {source})"
    )


cte("asked", "SELECT r.*, a.floor, n.category, n.rule, md5(r.package) || md5(r.package || 'x') AS bundle_sha256 FROM responses r LEFT JOIN stored_analysis a USING (package) LEFT JOIN name_categories n USING (package)")
cte("validated", validated_sql("asked"))


def validated(b: Bed):
    none = F.lit(None).cast("string")
    rows = b.table("responses").join(b.table("stored_analysis").select("package", "floor"), "package", "left")
    rows = rows.withColumns({
        "d": queueing.derive_category(F.col("package"), none, F.lit(None).cast("array<string>")),
        "bundle_sha256": F.concat(F.md5("package"), F.md5(F.concat("package", F.lit("x")))),
    })
    return validation.validate_proposals(rows.select("*", "d.category", "d.rule").drop("d"))


def stored(b: Bed):
    pairs = {"description": "description_owner", "removal": "removal_owner"}
    owner = F.create_map(*[x for f, c in pairs.items() for x in (F.lit(f), F.col(c))])
    return b.table("classification").withColumn("provenance", owner)


def fault():
    return F.when(F.col("rejected").isNotNull(), F.concat_ws(": ", "rejected.field", "rejected.reason")).alias("rejected")


@query("f10_proposal_validation", "SELECT package, rejected FROM validated")
def _(b: Bed):
    return validated(b).select("package", fault())


@query(
    "f18_provenance_map",
    "SELECT package, 'confidence=llm:' || model || ',dependencies=graph:corpus,description=llm:' || model || ',floor=rule:ladder,list=' || CASE WHEN category IS NOT NULL THEN rule ELSE 'llm:' || model END || ',neededBy=graph:corpus,reasoning_brief=llm:' || model || ',removal=llm:' || model AS provenance FROM asked",
)
def _(b: Bed):
    provenance = validation.proposal_provenance(F.col("model"), F.col("rule"), F.col("category"))
    return validated(b).select("package", map_text(provenance).alias("provenance"))


def map_text(column):
    return joined(F.transform(F.sort_array(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


# Whether a stored human removal is refused by the floor, and what a rewrite keeps.
_human_refused = f"(c.removal IS NOT NULL AND (v.floor IS NULL OR v.floor NOT IN {_t} OR {RANK.format(x='c.removal')} < {RANK.format(x='v.floor')}))"
_keep_d = "coalesce(c.description_owner LIKE 'human:%', false)"
_own_r = "coalesce(c.removal_owner LIKE 'human:%', false)"


def rewritten_sql(source: str) -> str:
    prov = (
        "'confidence=llm:' || v.model || ',dependencies=graph:corpus,description=' || CASE WHEN keep_d THEN 'human:triage' ELSE 'llm:' || v.model END || ',floor=rule:ladder,list=' || CASE WHEN v.category IS NOT NULL THEN v.rule ELSE 'llm:' || v.model END || "
        "',neededBy=graph:corpus,reasoning_brief=llm:' || v.model || ',removal=' || CASE WHEN keep_r THEN 'human:triage' ELSE 'llm:' || v.model END || CASE WHEN superseded THEN ',removal_superseded=rule:floor superseded human:triage ' || c_removal ELSE '' END"
    )
    base = (
        f"SELECT v.*, c.package IS NOT NULL AS had, c.bundle_sha256 AS c_hash, c.description AS c_description, c.removal AS c_removal, c.target_list AS c_list, c.unknown_fields AS c_unknown, c.description_owner, c.removal_owner, {_keep_d} AS keep_d, "
        f"{_own_r} AND NOT {_human_refused} AS keep_r, {_own_r} AND {_human_refused} AS superseded FROM {source} v LEFT JOIN classification c USING (package)"
    )
    new_removal = "CASE WHEN keep_r THEN c_removal ELSE p_removal END"
    accepted = (
        f"SELECT package, false AS parked, CASE WHEN keep_d THEN c_description ELSE p_description END AS description, {new_removal} AS removal, p_list AS target_list, "
        "CASE WHEN keep_d THEN CASE WHEN c_description = 'unknown' THEN 'description' ELSE '' END ELSE CASE WHEN declared THEN 'description' ELSE '' END END AS unknown_fields, "
        f"{prov} AS provenance, CASE WHEN {new_removal} IS NULL THEN NULL WHEN floor IS NULL THEN CASE WHEN keep_r THEN 'no floor to check a human rating against' END WHEN floor NOT IN {_t} THEN 'unreadable floor' "
        f"WHEN {RANK.format(x=new_removal)} < {RANK.format(x='floor')} THEN 'below the floor' END AS refusal, CAST(NULL AS VARCHAR) AS reason FROM ({base}) v WHERE rejected IS NULL"
    )
    same = "coalesce(c_hash = bundle_sha256, false)"
    parked = (
        f"SELECT package, true, CASE WHEN {same} OR keep_d THEN c_description END, CASE WHEN {same} OR keep_r THEN c_removal END, CASE WHEN {same} THEN c_list END, "
        f"CASE WHEN {same} THEN array_to_string(c_unknown, ',') WHEN keep_d AND c_description = 'unknown' THEN 'description' ELSE '' END, "
        f"CASE WHEN {same} THEN 'description=' || description_owner || ',removal=' || removal_owner ELSE array_to_string(list_filter([CASE WHEN keep_d THEN 'description=human:triage' END, CASE WHEN keep_r THEN 'removal=human:triage' END, "
        f"CASE WHEN superseded THEN 'removal_superseded=rule:floor superseded human:triage ' || c_removal END], lambda x: x IS NOT NULL), ',') END, CAST(NULL AS VARCHAR), rejected FROM ({base}) v WHERE rejected IS NOT NULL"
    )
    return f"{accepted} UNION ALL {parked}"


cte("rewritten", rewritten_sql("validated"))
OUT = ["package", "description", "removal", "target_list", "unknown_fields", "provenance", "refusal"]


def shown(rows, *more):
    text = {"unknown_fields": joined("unknown_fields"), "provenance": map_text("provenance")}
    return rows.withColumns(text).select(*OUT, *more)


@query("f14_human_field_preservation", f"SELECT {', '.join(OUT)} FROM rewritten WHERE NOT parked")
def _(b: Bed):
    accepted = rounds.accepted_rows(validated(b))
    return shown(rewrite.rewrite_accepted(stored(b), accepted, b.table("stored_analysis")))


@query("f15_park_rewrite", f"SELECT {', '.join(OUT)}, reason AS parked_reason FROM parked_rewritten WHERE parked")
def _(b: Bed):
    # Half of the parks answer the bundle already on the row.
    current = b.table("classification").select("package", F.col("bundle_sha256").alias("now"))
    rows = validated(b).join(current, "package", "left")
    rows = rows.withColumn("bundle_sha256", F.when(F.length("package") % 2 == 0, F.coalesce("now", "bundle_sha256")).otherwise(F.col("bundle_sha256")))
    return shown(rewrite.rewrite_parked(stored(b), rounds.parked_rows(rows), b.table("stored_analysis")), "parked_reason")


cte("validated_same", "SELECT v.* REPLACE (CASE WHEN length(v.package) % 2 = 0 THEN coalesce(c.bundle_sha256, v.bundle_sha256) ELSE v.bundle_sha256 END AS bundle_sha256) FROM validated v LEFT JOIN classification c USING (package)")
cte("parked_rewritten", rewritten_sql("validated_same"))


@query(
    "f17_floor_gate",
    f"SELECT c.package, CASE WHEN c.removal IS NULL THEN NULL WHEN v.floor IS NULL THEN CASE WHEN {_own_r} THEN 'no floor to check a human rating against' END WHEN v.floor NOT IN {_t} THEN 'unreadable floor' "
    f"WHEN {RANK.format(x='c.removal')} < {RANK.format(x='v.floor')} THEN 'below the floor' END AS refusal FROM classification c LEFT JOIN stored_analysis v USING (package)",
)
def _(b: Bed):
    rows = b.table("classification").join(b.table("stored_analysis").select("package", "floor"), "package", "left")
    return rows.select("package", rewrite.floor_refusal(F.col("removal"), F.col("floor"), F.col("removal_owner")).alias("refusal"))


cte(
    "edits",
    "SELECT package, 'removal' AS field, CASE WHEN part_key % 2 = 0 THEN 'Unsafe' ELSE 'Expert' END AS value FROM classification WHERE part_key % 4 < 3 "
    "UNION ALL SELECT package, 'description', CASE WHEN part_key % 6 = 0 THEN 'unknown' ELSE 'Edited words of a reviewer' END FROM classification WHERE part_key % 3 = 0 "
    "UNION ALL SELECT package, 'confidence', 'high' FROM classification WHERE part_key % 5 = 0",
)
cte("diffs", "SELECT e.package, e.field, CASE e.field WHEN 'removal' THEN c.removal WHEN 'description' THEN c.description ELSE c.confidence END AS \"from\", e.value AS \"to\" FROM edits e JOIN classification c USING (package) "
    "WHERE e.value IS DISTINCT FROM CASE e.field WHEN 'removal' THEN c.removal WHEN 'description' THEN c.description ELSE c.confidence END")


def edits(b: Bed):
    c, k = b.table("classification"), F.col("part_key")
    removal = c.filter(k % 4 < 3).select("package", F.lit("removal").alias("field"), F.when(k % 2 == 0, "Unsafe").otherwise("Expert").alias("value"))
    described = c.filter(k % 3 == 0).select("package", F.lit("description").alias("field"), F.when(k % 6 == 0, "unknown").otherwise("Edited words of a reviewer").alias("value"))
    confident = c.filter(k % 5 == 0).select("package", F.lit("confidence").alias("field"), F.lit("high").alias("value"))
    return removal.unionByName(described).unionByName(confident)


@query("f16_edit_diff", 'SELECT package, field, "from" AS old_value, "to" AS new_value FROM diffs')
def _(b: Bed):
    return rewrite.edit_diff(edits(b), stored(b)).select("package", "field", F.col("from").alias("old_value"), F.col("to").alias("new_value"))


@query(
    "f16_applied_edits",
    "SELECT c.package, coalesce(max(d.\"to\") FILTER (WHERE field = 'removal'), c.removal) AS removal, CASE WHEN count(*) FILTER (WHERE field = 'description') > 0 THEN max(d.\"to\") FILTER (WHERE field = 'description') ELSE c.description END AS description, "
    "CASE WHEN count(*) FILTER (WHERE field = 'description') = 0 THEN array_to_string(c.unknown_fields, ',') WHEN max(d.\"to\") FILTER (WHERE field = 'description') = 'unknown' THEN 'description' ELSE '' END AS unknown_fields, "
    "array_to_string(list_sort(list_filter([CASE WHEN count(*) FILTER (WHERE field = 'confidence') > 0 THEN 'confidence=human:triage' END, 'description=' || CASE WHEN count(*) FILTER (WHERE field = 'description') > 0 THEN 'human:triage' ELSE c.description_owner END, "
    "'removal=' || CASE WHEN count(*) FILTER (WHERE field = 'removal') > 0 THEN 'human:triage' ELSE c.removal_owner END], lambda x: x IS NOT NULL)), ',') AS provenance FROM classification c JOIN diffs d USING (package) GROUP BY c.package, c.removal, c.description, c.unknown_fields, c.description_owner, c.removal_owner",
)
def _(b: Bed):
    rows = stored(b)
    applied = rewrite.apply_edits(rows, rewrite.edit_diff(edits(b), rows))
    return applied.select("package", "removal", "description", joined("unknown_fields").alias("unknown_fields"), map_text("provenance").alias("provenance"))


# --- verdicts -------------------------------------------------------------------------------
_judged = "CASE WHEN length(coalesce(page_text, '')) > length(coalesce(snippet, '')) THEN page_text WHEN coalesce(snippet, '') <> '' THEN snippet ELSE coalesce(page_text, '') END"


cte("verdict_json", "SELECT *, CASE WHEN json_type(try_cast(response AS JSON)) = 'OBJECT' THEN try_cast(response AS JSON) END AS j FROM verdict_responses")
cte(
    "verdict_fields",
    "SELECT response_id, package, json_extract_string(j, '$.status') AS status, coalesce(length(json_extract_string(j, '$.reasoning')), 0) AS reasoning_chars, "
    "CASE WHEN j IS NULL THEN 'response: not a JSON object' WHEN json_type(j, '$.status') IS NULL THEN 'status: missing' WHEN json_type(j, '$.status') <> 'VARCHAR' THEN 'status: not text' "
    "WHEN json_type(j, '$.sources') <> 'ARRAY' OR len(list_filter(json_extract(j, '$.sources[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'sources: not a list of urls' "
    "WHEN json_type(j, '$.reasoning') <> 'VARCHAR' THEN 'reasoning: not text' WHEN list_contains(json_keys(j), 'confidence') THEN 'confidence: extra field' END AS shape FROM verdict_json",
)
cte("verdict_urls", "SELECT response_id, unnest(range(1, len(urls) + 1)) AS position, unnest(urls) AS url FROM (SELECT response_id, json_extract_string(j, '$.sources[*]') AS urls FROM verdict_json WHERE j IS NOT NULL)")


def cited_sql(responses: str, sources: str, citations: str = "citations") -> str:
    return (
        f"SELECT r.response_id, count(DISTINCT c.url) AS cited, coalesce(bool_or(c.url IS NOT NULL AND s.url IS NULL), false) AS fabricated, coalesce(bool_or(s.empty), false) AS unread FROM {responses} r JOIN {citations} c USING (response_id) "
        f"LEFT JOIN (SELECT package, url, bool_and({_judged} = '') AS empty FROM {sources} GROUP BY ALL) s ON s.package = r.package AND s.url = c.url GROUP BY r.response_id"
    )


VERDICT_RULES = (
    "CASE WHEN shape IS NOT NULL THEN shape WHEN status NOT IN ('corroborated', 'uncorroborated', 'search_failed', 'judge_failed') THEN 'status: not a status' WHEN status NOT IN ('corroborated', 'uncorroborated') THEN 'status: a pipeline fact, not a judgement' "
    "WHEN coalesce(fabricated, false) THEN 'sources: fabricated citation' WHEN coalesce(unread, false) THEN 'sources: cites a source without text' WHEN status = 'corroborated' AND coalesce(cited, 0) = 0 THEN 'sources: corroborated without a source' "
    "WHEN status = 'uncorroborated' AND coalesce(cited, 0) > 0 THEN 'sources: uncorroborated with sources' WHEN reasoning_chars > 400 THEN 'reasoning: too long' END"
)
cte("cited_rows", cited_sql("verdict_responses", "search_results"))
cte("cited_urls", cited_sql("verdict_fields", "search_results", "verdict_urls"))


@query("j14_citation_gate", "SELECT response_id, cited, fabricated, unread FROM cited_rows")
def _(b: Bed):
    cited = b.table("citations").join(b.table("verdict_responses").select("response_id", "package"), "response_id")
    return validation.check_citations(cited, b.table("search_results"))


@query("f11_verdict_validation", f"SELECT r.response_id, {VERDICT_RULES} AS rejected FROM verdict_fields r LEFT JOIN cited_urls c USING (response_id)")
def _(b: Bed):
    verdicts = validation.parse_verdicts(b.table("verdict_responses"))
    return validation.validate_verdicts(verdicts, validation.cited_sources(verdicts), b.table("search_results")).select("response_id", fault())


@query("u2_set_operations", "SELECT 'both' AS side, package FROM (SELECT package FROM classification INTERSECT SELECT package FROM reference_list) UNION ALL SELECT 'left', package FROM (SELECT package FROM classification EXCEPT SELECT package FROM reference_list)")
def _(b: Bed):
    left, right = b.table("classification").select("package"), b.table("reference_list").select("package")
    both = left.join(right, "package", "left_semi").select(F.lit("both").alias("side"), "package")
    return both.unionByName(left.join(right, "package", "left_anti").select(F.lit("left").alias("side"), "package"))


# --- rounds ---------------------------------------------------------------------------------
cte(
    "asked_round",
    "SELECT r.*, f.floor, d.category, d.rule, b.bundle_sha256 FROM responses r JOIN verdicts v USING (package) JOIN bundles b USING (package) JOIN floors f USING (package) JOIN derived d USING (package) WHERE v.filter_verdict = 'queued'",
)
cte("validated_round", validated_sql("asked_round"))
cte("round_rows", rewritten_sql("validated_round"))


@query("c3_classification_round", f"SELECT {', '.join(OUT)}, parked, reason AS parked_reason FROM round_rows")
def _(b: Bed):
    facts, edge_rows, analysis = core_of(b)
    built = core.bundles(facts, edge_rows, analysis, b.table("reference_list"))
    rows = rounds.classification_round(built, analysis, derived(facts), stored(b), b.table("responses"))
    return shown(rows, "parked", "parked_reason")


CUTOFF = "2024-01-03 12:00:00"
cte("wanted", "SELECT k.package, sha256('{\"description\": ' || CAST(to_json(k.description) AS VARCHAR) || ', \"package\": ' || CAST(to_json(k.package) AS VARCHAR) || '}') AS description_sha256 FROM classification k LEFT JOIN verdict_rows v USING (package) "
    "WHERE NOT k.parked AND k.description IS NOT NULL AND k.description <> 'unknown' AND (v.status IS NULL OR v.description_sha256 <> sha256('{\"description\": ' || CAST(to_json(k.description) AS VARCHAR) || ', \"package\": ' || CAST(to_json(k.package) AS VARCHAR) || '}') OR v.status IN ('search_failed', 'judge_failed'))")
cte("handed", f"SELECT s.* FROM merged_results m JOIN search_results s ON s.package = m.package AND s.result_id = m.result_id WHERE m.package IN (SELECT package FROM search_results GROUP BY package HAVING max(fetched_at) >= TIMESTAMP '{CUTOFF}') AND m.package IN (SELECT package FROM wanted)")
cte("final_responses", "SELECT * FROM verdict_fields QUALIFY row_number() OVER (PARTITION BY package ORDER BY response_id DESC) = 1")
cte("final_cited", cited_sql("final_responses", "handed", "verdict_urls"))
cte("judged_rows", f"SELECT r.package, r.status, {VERDICT_RULES} AS rejected, (SELECT string_agg(url, ',' ORDER BY p) FROM (SELECT url, min(position) AS p FROM verdict_urls x WHERE x.response_id = r.response_id GROUP BY url)) AS sources FROM final_responses r LEFT JOIN final_cited c USING (response_id)")
cte(
    "verdict_out",
    "SELECT w.package, w.description_sha256, failed.package IS NULL AS searched, (SELECT count(*) FROM handed h WHERE h.package = w.package) AS n, j.status, j.rejected, j.sources, j.package IS NOT NULL AS answered FROM wanted w "
    "LEFT JOIN (SELECT package FROM corroboration WHERE status = 'search_failed' AND stale) failed USING (package) LEFT JOIN judged_rows j USING (package)",
)
ROUND_SQL = (
    "SELECT package, description_sha256, CASE WHEN NOT searched THEN 'search_failed' WHEN n = 0 THEN 'uncorroborated' WHEN answered AND rejected IS NULL THEN status ELSE 'judge_failed' END AS status, "
    "CASE WHEN searched AND n > 0 AND answered THEN 'judge-1' END AS model, CASE WHEN searched AND n > 0 AND answered AND rejected IS NULL THEN coalesce(sources, '') ELSE '' END AS sources, "
    "CASE WHEN searched AND n = 0 THEN 'the search returned no result to judge' WHEN searched AND answered AND rejected IS NULL THEN 'it fits' END AS reasoning, "
    "CASE WHEN NOT searched THEN 'timeout' WHEN n > 0 AND NOT (answered AND rejected IS NULL) THEN coalesce(rejected, '') END AS failure_reason FROM verdict_out"
)


def judged_round(b: Bed):
    failures = b.table("corroboration").filter("status = 'search_failed' AND stale").select("package", F.lit("timeout").alias("failure"))
    responses = b.table("verdict_responses").withColumns({"model": F.lit("judge-1"), "attempts": F.lit(1)})
    results = b.table("search_results").select("package", "block", "block_index", "url", "title", "snippet", "page_text", "fetched_at")
    rows = rounds.corroboration_round(
        b.table("classification"), verdict_rows(b), results, display(b), failures, responses, CUTOFF, top=3)
    return rows.select("package", "description_sha256", "status", "model", joined("sources").alias("sources"), "reasoning", "failure_reason")


@query("c4_corroboration_round", ROUND_SQL)
def _(b: Bed):
    return judged_round(b)


cte("outcomes", "SELECT package, status, CASE WHEN status = 'search_failed' THEN 'timeout' END AS failure, CASE WHEN status = 'uncorroborated' THEN 0 ELSE 2 END AS n FROM corroboration")


@query(
    "f26_verdict_row_rules",
    "SELECT package, status, CASE WHEN status IN ('judge_failed', 'corroborated') THEN 'judge-1' END AS model, CASE WHEN status = 'corroborated' THEN 'http://a' ELSE '' END AS sources, "
    "CASE status WHEN 'uncorroborated' THEN 'the search returned no result to judge' WHEN 'corroborated' THEN 'fits' END AS reasoning, CASE status WHEN 'search_failed' THEN 'timeout' WHEN 'judge_failed' THEN 'sources: fabricated citation' END AS failure_reason, "
    "CASE WHEN status = 'corroborated' THEN 'llm:judge-1' ELSE 'rule:corroborate' END AS owner FROM outcomes",
)
def _(b: Bed):
    c = b.table("corroboration").select("package", "status")
    failed = F.struct(F.lit("sources").alias("field"), F.lit("fabricated citation").alias("reason"))
    searches = c.select("package", F.when(F.col("status") == "search_failed", "timeout").alias("failure"), F.when(F.col("status") == "uncorroborated", 0).otherwise(2).alias("sources"))
    judged = c.select("package", F.lit("judge-1").alias("model"), F.lit("corroborated").alias("status"), F.array(F.lit("http://a")).alias("sources"), F.lit("fits").alias("reasoning"),
                      F.when(F.col("status") == "judge_failed", failed).alias("rejected"), F.lit(2).alias("attempts"))
    rows = searching.verdict_rows(c.select("package", F.lit("x").alias("description_sha256")), searches, judged)
    return rows.select("package", "status", "model", joined("sources").alias("sources"), "reasoning", "failure_reason", rows["provenance"]["status"].alias("owner"))
