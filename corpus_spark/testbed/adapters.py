"""Domain tables derived from the star-schema tables, as one SQL text per table.

Each table is a function of a dialect, so Spark and the checking engine read the same rule; only
list and struct literals differ between the two. All rules are row-local expressions over one
table (no join, no shuffle), so a derived table costs one scan whatever its size.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpus_spark.sources.tables import read_table


class SparkDialect:
    def arr(self, *items: str) -> str:
        return f"array_compact(array({', '.join(items)}))"

    def lit(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def no_strings(self) -> str:
        return "CAST(array() AS array<string>)"

    def strings(self, *items: str) -> str:
        """A list of texts; an item may be `CASE WHEN test THEN text END`. Rows for which no test
        holds get the empty list without building one."""
        cases = [re.match(r"^CASE WHEN (.*?) THEN (.*) END$", i, re.S) for i in items]
        if items == ("cast(null as string)",):
            return self.no_strings()
        if not all(cases):
            return self.lit(*items)
        tests = " OR ".join(f"({c[1]})" for c in cases)
        made = self.lit(cases[0][2]) if len(cases) == 1 else self.arr(*items)
        return f"CASE WHEN {tests} THEN {made} ELSE {self.no_strings()} END"

    def lib(self, name: str, version: str) -> str:
        return f"named_struct('name', {name}, 'version', CAST({version} AS INT))"

    def filt(self, component: str, actions: str, categories: str, priority: str) -> str:
        return (
            f"named_struct('component', {component}, 'component_class', 'Main', 'actions', {actions}, "
            f"'categories', {categories}, 'priority', CAST({priority} AS INT))"
        )

    def pick(self, items: str, position: str) -> str:
        return f"element_at(array({items}), CAST({position} AS INT))"

    def no_libs(self) -> str:
        return "CAST(array() AS array<struct<name:string,version:int>>)"

    def no_filters(self) -> str:
        return (
            "CAST(array() AS array<struct<component:string,component_class:string,"
            "actions:array<string>,categories:array<string>,priority:int>>)"
        )

    def binary(self, text: str) -> str:
        return f"CAST({text} AS BINARY)"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def plus_minutes(self, ts: str, n: str) -> str:
        return f"timestampadd(MINUTE, CAST({n} AS INT), {ts})"

    def json_get(self, text: str, key: str) -> str:
        return f"CAST(get_json_object({text}, '$.{key}') AS BIGINT)"


class DuckDialect(SparkDialect):
    def arr(self, *items: str) -> str:
        return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"

    def lit(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def no_strings(self) -> str:
        return "CAST([] AS VARCHAR[])"

    def lib(self, name: str, version: str) -> str:
        return f"struct_pack(name := {name}, version := CAST({version} AS INT))"

    def filt(self, component: str, actions: str, categories: str, priority: str) -> str:
        return (
            f"struct_pack(component := {component}, component_class := 'Main', actions := {actions}, "
            f"categories := {categories}, priority := CAST({priority} AS INT))"
        )

    def pick(self, items: str, position: str) -> str:
        return f"list_extract([{items}], CAST({position} AS INT))"

    def no_libs(self) -> str:
        return "CAST([] AS STRUCT(name VARCHAR, version INT)[])"

    def no_filters(self) -> str:
        return (
            "CAST([] AS STRUCT(component VARCHAR, component_class VARCHAR, actions VARCHAR[], "
            "categories VARCHAR[], priority INT)[])"
        )

    def binary(self, text: str) -> str:
        return f"encode({text})"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def plus_minutes(self, ts: str, n: str) -> str:
        return f"({ts} + to_minutes(CAST({n} AS BIGINT)))"

    def json_get(self, text: str, key: str) -> str:
        return f"CAST(json_extract_string({text}, '$.{key}') AS BIGINT)"


SPARK = SparkDialect()
DUCK = DuckDialect()


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


# Namespaces a package name is drawn from: every name rule, its lookalikes, and plain vendors.
NAMESPACES = (
    "com.android.cellbroadcastreceiver", "com.vendor.amber", "com.weather.wearable",
    "com.vendor.sarcontrol", "hu.android.mobilvasarlas", "com.EMERGENCY.info",
    "com.samsung.core", "com.samsung.media", "com.android.core", "com.android.media",
    "com.maker.auto_generated_rro_vendor__", "com.vendor.wea.alerts", "android.ext.core",
    *(f"com.b{n}.{kind}" for n in range(8) for kind in ("core", "media", "tools", "ui")),
)


def name(k: str) -> str:
    """A package name as a function of a part key."""
    return f"(pick_namespace[[{k}]] || '.p' || {text(k)})"


def fill_names(sql: str, d: SparkDialect) -> str:
    listed = ", ".join(f"'{n}'" for n in NAMESPACES)
    return re.sub(
        r"pick_namespace\[\[(.*?)\]\]", lambda m: d.pick(listed, f"({m[1]}) % {len(NAMESPACES)} + 1"), sql
    )


def tier(k: str) -> str:
    return (
        f"CASE {k} % 4 WHEN 0 THEN 'Recommended' WHEN 1 THEN 'Advanced' WHEN 2 THEN 'Expert' "
        "ELSE 'Unsafe' END"
    )


def category(k: str) -> str:
    return (
        f"CASE {k} % 5 WHEN 0 THEN 'Aosp' WHEN 1 THEN 'Carrier' WHEN 2 THEN 'Google' "
        "WHEN 3 THEN 'Misc' ELSE 'Oem' END"
    )


def digest(k: str, j: str) -> str:
    """64 hex digits standing for the hash of revision j of package k's bundle."""
    return (
        f"(md5('b' || {text(k)} || '-' || {text(j)}) || md5('c' || {text(k)} || '-' || {text(j)}))"
    )


# Library names repeat inside a block of keys, so provider groups keep their size at any scale.
SHARED = f"'shared' || {text('k - k % 300')} || '.' || "


def observations(d: SparkDialect) -> str:
    k = "k"
    solo = f"{k} - {k} % 40"
    home = d.filt("'activity'", "array_of('android.intent.action.MAIN')", "array_of('android.intent.category.HOME')", "qty % 2")
    dial = d.filt("'activity'", "array_of('android.intent.action.DIAL')", "array_of()", "0")
    sms = d.filt("'receiver'", "array_of('android.provider.Telephony.SMS_DELIVER','other.action')", "array_of()", "5")
    def fill(expr: str) -> str:
        # array_of('a','b') is the one literal that needs the dialect inside a dialect call.
        while "array_of(" in expr:
            start = expr.index("array_of(")
            end = expr.index(")", start)
            inside = expr[start + len("array_of(") : end]
            items = [i for i in inside.split(",") if i]
            literal = d.strings(*items) if items else d.strings("cast(null as string)")
            expr = expr[:start] + literal + expr[end + 1 :]
        return expr
    return f"""
    SELECT package, device_key, build, partition,
      '/' || partition || CASE WHEN privileged THEN '/priv-app/p' ELSE '/app/p' END || {text('k')} || '-'
        || {text('s')} || '-' || {text('line')} || '-' || {text('qty')} || '-' || {text('disc')} || '-'
        || {text('tax')} || '-' || {text('price')} || '-' || flag || status || '-' || {text('observed_at')} || '.apk' AS device_path,
      observed_at,
      CASE WHEN qty < 5 THEN 'unknown' WHEN qty = 50 THEN NULL ELSE 'App ' || {text('k')} || ' r' || {text('qty % 7')} END AS label,
      qty < 3 AS label_unresolved,
      CASE WHEN disc = 0 THEN NULL ELSE o * 10 + disc END AS version_code,
      privileged AS priv_app,
      CASE WHEN tax = 0 THEN NULL WHEN k % 13 = 0 THEN 'Organization: Samsung Electronics'
           WHEN k % 10 = 3 OR k % 45 = 8 OR k % 45 = 12 THEN 'Email Address: android@android.com, Organization: Android'
           WHEN k % 9 = 1 AND tax > 6 THEN 'Organization: Rotated Key'
           ELSE 'Organization: Maker ' || {text('k % 25')} END AS cert_issuer,
      'CN=' || {text('k % 40')} || CASE WHEN tax = 8 AND k % 3 = 0 THEN '-rotated' ELSE '' END AS cert_subject,
      CASE WHEN k % 43 = 0 AND qty < 10 THEN NULL ELSE k % 101 = 0 AND qty > 25 END AS core_app,
      CASE WHEN k % 37 = 0 AND tax <= 4 THEN 'android.uid.system' WHEN k % 19 = 0 THEN 'com.shared.uid' || {text('tax % 2')} END AS shared_user_id,
      (k % 59 = 0 AND qty > 40) AS persistent,
      (qty <> 1 AND k % 34 <> 0) AS has_code,
      CASE WHEN k % 77 = 0 THEN package WHEN k % 7 = 0 AND disc < 9 THEN {name('(k + 1)')} WHEN k % 71 = 0 THEN 'com.absent.target' END AS overlay_target,
      (k % 14 = 0) AS overlay_static,
      (k = 17) AS is_input_method,
      (k % 61 = 0 AND qty > 10) AS is_device_admin,
      (k % 67 = 0) AS is_accessibility_service,
      (k % 103 = 0) AS is_carrier_service,
      CASE WHEN k % 40 = 0 AND k % 15 = 0 THEN {d.arr(d.lib(SHARED + text('k % 75'), "CASE WHEN qty > 30 THEN 2 END"), d.lib("'solo' || " + text('k'), "1"))}
           WHEN k % 15 = 0 THEN {d.arr(d.lib(SHARED + text('k % 75'), "CASE WHEN qty > 30 THEN 2 END"))}
           WHEN k % 40 = 0 THEN {d.arr(d.lib("'solo' || " + text('k'), "1"))}
           ELSE {d.no_libs()} END AS libraries,
      CASE WHEN k % 90 = 0 THEN {d.arr(d.lib("'static' || " + text('k - k % 720'), "3"))} ELSE {d.no_libs()} END AS static_libraries,
      {d.strings("CASE WHEN k % 12 = 5 THEN " + SHARED + text('(k % 5) * 15') + " END",
                 "CASE WHEN k % 8 = 3 OR k % 80 = 0 THEN 'solo' || " + text(solo) + " END",
                 "CASE WHEN k % 16 = 1 THEN 'platform.lib' || " + text('k % 3') + " END",
                 "CASE WHEN k % 33 = 2 AND qty > 20 THEN 'missing.lib' END",
                 "CASE WHEN k % 36 = 1 THEN 'static' || " + text('k - k % 720') + " END")} AS uses_libraries_required,
      {d.strings("CASE WHEN k % 21 = 0 THEN 'opt' || " + text('k % 4') + " END")} AS uses_libraries_optional,
      {d.strings("CASE WHEN k % 25 = 0 THEN 'bcast.' || " + text('qty % 3') + " END")} AS protected_broadcasts,
      {d.strings("CASE WHEN k % 10 = 0 THEN 'auth.' || " + text('k') + " END",
                 "CASE WHEN k % 50 = 0 THEN 'auth.shared' || " + text('k % 100') + " END")} AS provider_authorities,
      {d.strings("CASE WHEN k % 9 = 0 THEN " + name('(k + 3)') + " END",
                 "CASE WHEN k % 9 = 0 THEN 'com.absent.q' || " + text('qty % 2') + " END")} AS queries_packages,
      {d.strings("CASE WHEN k % 14 = 0 THEN 'auth.' || " + text('k') + " END",
                 "CASE WHEN k % 14 = 0 THEN 'auth.' || " + text('k + 6') + " END",
                 "CASE WHEN k % 28 = 0 THEN 'auth.none' || " + text('qty % 2') + " END",
                 "CASE WHEN k % 50 = 0 THEN 'auth.shared' || " + text('k % 100') + " END")} AS content_uri_authorities,
      CASE WHEN k % 500 = 1 THEN {d.arr(fill(home))} WHEN k = 23 THEN {d.arr(fill(dial))}
           WHEN k = 29 AND qty > 20 THEN {d.arr(fill(sms))} ELSE {d.no_filters()} END AS intent_filters,
      CASE WHEN qty > 48 THEN {d.binary("'icon' || " + text('k') + " || '-' || " + text('o'))} END AS icon_bytes,
      CASE WHEN qty > 48 THEN 'image/png' END AS icon_mime
    FROM (
      SELECT l_partkey AS k, l_suppkey AS s, l_orderkey AS o, l_linenumber AS line, l_returnflag AS flag,
        l_linestatus AS status, l_shipdate AS observed_at,
        CAST(l_quantity AS BIGINT) AS qty, CAST(ROUND(l_discount * 100) AS BIGINT) AS disc,
        CAST(ROUND(l_tax * 100) AS BIGINT) AS tax, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS price,
        {name('l_partkey')} AS package,
        (l_partkey % 11 = 0 AND CAST(ROUND(l_discount * 100) AS BIGINT) >= 8) AS privileged,
        CASE l_returnflag WHEN 'A' THEN 'system' WHEN 'N' THEN 'product' ELSE 'vendor' END AS partition,
        'B' || {text('l_orderkey')} AS build,
        CASE WHEN l_partkey % 5 = 0 THEN 'oem1' ELSE 'oem' || {text('l_suppkey % 6')} END || ':' ||
          CASE WHEN l_partkey % 41 = 0 OR l_suppkey % 20 = 0
               THEN CASE WHEN l_suppkey % 2 = 0 THEN 'sdk_gphone' ELSE 'Emulator-' END
               ELSE 'dev' END || {text('l_suppkey')} AS device_key
      FROM {{lineitem}}) base"""


def reference_list(d: SparkDialect) -> str:
    """Entries already carried by the external list, and neighbours the corpus does not ship."""
    return f"""
    SELECT {name('p_partkey')} || CASE WHEN p_partkey % 6 = 3 THEN '' WHEN p_partkey % 9 = 1 THEN '.ref' ELSE '' END AS package,
      CASE WHEN p_partkey % 45 = 0 THEN NULL ELSE {category('p_partkey')} END AS list,
      {tier('(p_partkey + 1)')} AS removal,
      CASE WHEN p_partkey % 30 = 0 THEN '  ' ELSE p_name END AS description
    FROM {{part}} WHERE p_partkey % 3 = 0 OR p_partkey % 9 = 1"""


def config_rows(d: SparkDialect) -> str:
    """Harvested config rows: one per (device, kind, key, value)."""
    dev = f"'oem' || {text('s_suppkey % 6')} || ':dev' || {text('s_suppkey')}"
    return f"""
    SELECT {dev} AS device_key, 'privapp' AS kind, {name('(s_suppkey * 3)')} AS key, 'perm.A' AS value FROM {{supplier}}
    UNION ALL SELECT {dev}, 'privapp', {name('(s_suppkey * 3)')}, 'perm.' || {text('s_suppkey % 7')} FROM {{supplier}}
    UNION ALL SELECT {dev}, 'privapp', {name('(s_suppkey % 50)')}, 'perm.B' || {text('s_suppkey % 3')} FROM {{supplier}}
    UNION ALL SELECT {dev}, 'role', 'role.' || {text('s_suppkey')}, {name('(s_suppkey * 2)')} FROM {{supplier}} WHERE s_suppkey % 10 = 1
    UNION ALL SELECT {dev}, 'role', 'role.' || {text('s_suppkey % 30')}, CASE WHEN s_suppkey % 4 = 0 THEN 'com.absent.holder' ELSE {name('(s_suppkey % 60)')} END FROM {{supplier}}
    UNION ALL SELECT {dev}, 'library', 'platform.lib' || {text('s_suppkey % 2')}, CAST(NULL AS STRING) FROM {{supplier}}
    UNION ALL SELECT {dev}, 'read', 'etc/permissions/a.xml', CAST(NULL AS STRING) FROM {{supplier}}
    UNION ALL SELECT {dev}, 'failed', 'etc/bad' || {text('s_suppkey % 4')} || '.xml', CAST(NULL AS STRING) FROM {{supplier}} WHERE s_suppkey % 17 = 0"""


def classification(d: SparkDialect) -> str:
    k = "p_partkey"
    return f"""
    SELECT {name(k)} AS package, {digest(k, f'{k} % 3')} AS bundle_sha256, 'model-' || {text(f'{k} % 2')} AS model,
      CASE WHEN {k} % 13 = 0 THEN NULL WHEN {k} % 8 = 1 THEN 'unknown' WHEN {k} % 27 = 2 THEN 'bad text ' || chr(10) || ' here'
           WHEN {k} % 31 = 2 THEN 'zero\u200bwidth' ELSE 'Describes ' || p_name || ' number ' || {text(k)} END AS description,
      CASE WHEN {k} % 26 = 0 THEN NULL ELSE {category(k)} END AS target_list,
      CASE WHEN {k} % 13 = 0 THEN NULL WHEN {k} % 3 = 0 THEN 'Unsafe' WHEN {k} % 3 = 1 THEN 'Expert' ELSE {tier('(' + k + ' + 2)')} END AS removal,
      CASE {k} % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
      CASE WHEN {k} % 8 = 1 THEN {d.strings("'description'")} ELSE {d.strings("cast(null as string)")} END AS unknown_fields,
      'because ' || {text(f'{k} % 9')} AS reasoning_brief,
      CASE WHEN {k} % 6 = 2 THEN 'human:triage' ELSE 'llm:model-' || {text(f'{k} % 2')} END AS description_owner,
      CASE WHEN {k} % 10 = 4 THEN 'human:triage' ELSE 'llm:model-' || {text(f'{k} % 2')} END AS removal_owner,
      '{{{{"prompt_cache_hit_tokens": ' || {text(f'{k} % 50')} || ', "completion_tokens_details": {{{{"reasoning_tokens": ' ||
        CASE WHEN {k} % 5 = 0 THEN '"none"' ELSE {text(f'{k} % 70')} END || '}}}}}}}}' AS usage,
      {k} % 4 AS attempts,
      {k} % 17 = 5 AS parked,
      CASE WHEN {k} % 17 = 5 THEN 'description: too short' END AS parked_reason,
      {k} AS part_key
    FROM {{part}} WHERE {k} % 2 = 0 OR {k} % 5 = 1"""


def stored_analysis(d: SparkDialect) -> str:
    """Floors and neighbours as an earlier run stored them; some packages have none yet."""
    k = "p_partkey"
    return f"""
    SELECT {name(k)} AS package,
      CASE WHEN {k} % 19 = 6 THEN NULL WHEN {k} % 3 = 0 THEN 'Expert' WHEN {k} % 4 = 1 THEN 'Advanced' WHEN {k} % 33 = 2 THEN 'Nonsense' ELSE 'Recommended' END AS floor,
      CASE WHEN {k} % 101 = 2 THEN {d.strings("'bad name!'")} WHEN {k} % 7 = 0 THEN {d.strings(name('(' + k + ' + 1)'))} ELSE {d.strings("cast(null as string)")} END AS dependencies,
      CASE WHEN {k} % 11 = 0 THEN {d.strings(name('(' + k + ' + 2)'), name('(' + k + ' + 3)'))} ELSE {d.strings("cast(null as string)")} END AS needed_by
    FROM {{part}} WHERE {k} % 23 <> 1"""


def decisions(d: SparkDialect) -> str:
    k = "o_custkey"
    return f"""
    SELECT o_orderkey AS id, {name(k)} AS package, {digest(k, 'o_orderkey % 3')} AS bundle_sha256,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'approve' WHEN o_orderpriority = '2-HIGH' THEN 'approve'
           WHEN o_orderpriority = '3-MEDIUM' THEN CASE o_orderstatus WHEN 'F' THEN 'reject' WHEN 'O' THEN 'edit' ELSE 'reopen' END
           WHEN o_orderpriority = '5-LOW' THEN 'defer' ELSE 'approve' END AS action,
      CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F'
           THEN CASE WHEN o_orderkey % 40 = 0 THEN ' ' ELSE 'reason ' || {text('o_orderkey % 5')} END END AS reason,
      o_orderdate AS decided_at
    FROM {{orders}}"""


def emissions(d: SparkDialect) -> str:
    return f"""
    SELECT s_suppkey AS emission_id, 'oem' || {text('s_suppkey % 6')} AS vendor, 'add/oem' || {text('s_suppkey % 6')} || '-' || {text('s_suppkey')} AS branch,
      TIMESTAMP '2024-01-01 00:00:00' AS created_at,
      CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE md5('c' || {text('s_suppkey')}) END AS commit_oid,
      CASE WHEN s_suppkey % 4 = 3 OR s_suppkey % 33 = 1 THEN NULL ELSE TIMESTAMP '2024-01-02 00:00:00' END AS committed_at,
      s_suppkey % 5 = 3 AS reconciled,
      s_suppkey % 12 AS package_count
    FROM {{supplier}}"""


def emission_packages(d: SparkDialect) -> str:
    return f"""
    SELECT p_partkey % 97 AS emission_id, {name('p_partkey')} AS package, {tier('p_partkey')} AS removal FROM {{part}} WHERE p_partkey % 7 = 2
    UNION ALL SELECT p_partkey % 89, {name('p_partkey')}, {tier('p_partkey')} FROM {{part}} WHERE p_partkey % 14 = 2"""


def corroboration(d: SparkDialect) -> str:
    k = "p_partkey"
    return f"""
    SELECT {name(k)} AS package,
      CASE {k} % 5 WHEN 0 THEN 'search_failed' WHEN 1 THEN 'judge_failed' WHEN 2 THEN 'uncorroborated' ELSE 'corroborated' END AS status,
      {k} % 3 = 0 AS stale,
      CASE WHEN {k} % 5 > 2 THEN {d.strings("'http://src/' || " + text(f'{k} % 9'), "'javascript:x' || " + text(f'{k} % 4'))} ELSE {d.strings("cast(null as string)")} END AS sources,
      CASE WHEN {k} % 5 > 2 OR {k} % 55 = 0 THEN 'fits' END AS reasoning,
      CASE WHEN {k} % 5 < 2 OR {k} % 65 = 4 THEN 'timeout' END AS failure_reason
    FROM {{part}} WHERE {k} % 4 <> 3"""


def job_runs(d: SparkDialect) -> str:
    """Stage runs and jobs from events."""
    return f"""
    SELECT event_id AS job_id,
      CASE event_id % 3 WHEN 0 THEN 'firmware_analysis' WHEN 1 THEN 'classification' ELSE 'branch_emission' END AS kind,
      CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'claimed' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS state,
      CASE WHEN event_id % 11 = 0 THEN NULL
           WHEN event_id % 3 = 0 THEN CASE (event_id % 5) WHEN 0 THEN 'acquire' WHEN 1 THEN 'unpack' WHEN 2 THEN 'extract_facts' WHEN 3 THEN 'filter' ELSE 'rule_ladder' END
           WHEN event_id % 3 = 1 THEN CASE event_id % 2 WHEN 0 THEN 'llm' ELSE 'corroborate' END ELSE 'branch' END AS stage,
      event_id % 4 AS attempt,
      CASE WHEN event_type = 'click' THEN NULL ELSE 'worker-' || {text('user_id % 9')} END AS worker_id,
      ts AS created_at,
      CASE WHEN event_type = 'click' THEN NULL ELSE ts END AS started_at,
      CASE WHEN event_type IN ('purchase', 'error') THEN {d.plus_minutes('ts', 'event_id % 90')} END AS finished_at,
      CASE WHEN event_type IN ('view', 'signup') AND event_id % 13 <> 0 THEN {d.plus_minutes('ts', 'event_id % 70')} END AS heartbeat_at,
      CASE WHEN event_type = 'purchase' THEN 'succeeded' WHEN event_type = 'error' THEN 'failed' END AS outcome
    FROM {{events}}"""


def lease_events(d: SparkDialect) -> str:
    return f"""
    SELECT event_id AS id, CASE WHEN event_id % 101 = 0 THEN NULL ELSE 'job-' || {text('user_id')} END AS job_id,
      CASE event_type WHEN 'click' THEN 'requested' WHEN 'view' THEN 'acquired' WHEN 'purchase' THEN 'released'
        WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'reclaimed' ELSE 'acquired' END ELSE 'noise' END AS event,
      ts AS happened_at
    FROM {{events}}"""


def scratch_dirs(d: SparkDialect) -> str:
    return f"""
    SELECT o_orderkey AS id, 'job-' || {text('o_custkey')} AS job_id, o_orderkey % 3 AS dir_attempt,
      o_custkey % 3 AS job_attempt,
      CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'queued' END AS job_state,
      CAST(ROUND(o_totalprice * 100) AS BIGINT) AS size, o_orderdate AS mtime
    FROM {{orders}}"""


def responses(d: SparkDialect) -> str:
    """Raw proposal responses, one JSON text per package."""
    k = "p_partkey"
    quoted = (
        f"CASE WHEN {k} % 19 = 0 THEN 'short' WHEN {k} % 23 = 1 THEN ' padded description text here' "
        f"WHEN {k} % 29 = 2 THEN 'a space next to ' || chr(92) || 'n newline in the text' WHEN {k} % 31 = 3 THEN repeat('long text ', 70) "
        f"WHEN {k} % 8 = 1 THEN 'unknown' ELSE 'Describes ' || p_name || ' in package ' || {text(k)} END"
    )
    return f"""
    SELECT {name(k)} AS package, 'model-' || {text(f'{k} % 2')} AS model, {k} % 4 + 1 AS attempts,
      CASE WHEN {k} % 61 = 0 THEN 'not json at all' WHEN {k} % 67 = 0 THEN '[1, 2]' ELSE
      '{{{{"description": "' || {quoted} || '", "list": ' ||
        CASE WHEN {k} % 43 = 0 THEN '"Pending"' WHEN {k} % 47 = 0 THEN '7' ELSE '"' || {category(k)} || '"' END ||
        ', "removal": "' || CASE WHEN {k} % 37 = 0 THEN 'Danger' ELSE {tier(f'({k} + 3)')} END ||
        '", "confidence": "' || CASE {k} % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END || '"' ||
        CASE WHEN {k} % 8 = 1 OR {k} % 17 = 0 THEN ', "unknown_fields": ["description"]' WHEN {k} % 41 = 0 THEN ', "unknown_fields": ["removal"]' ELSE '' END ||
        CASE WHEN {k} % 53 = 0 THEN ', "labels": []' WHEN {k} % 59 = 0 THEN ', "extra": 1' ELSE '' END ||
        ', "reasoning_brief": "' || CASE WHEN {k} % 71 = 0 THEN repeat('why ', 120) ELSE 'seen' END || '"}}}}' END AS response
    FROM {{part}} WHERE {k} % 3 <> 1"""


def search_results(d: SparkDialect) -> str:
    """Search rows of a package: several blocks, one page shared by both blocks."""
    k = "page_id"
    return f"""
    SELECT {name(d.idiv(k, '4'))} AS package, {k} AS result_id,
      CASE WHEN {k} % 3 = 0 THEN 'discussions' ELSE 'web' END AS block,
      {k} % 4 AS block_index,
      CASE WHEN {k} % 7 = 0 THEN 'https://forum.example.org/t/' || {text(d.idiv(k, '4'))} ELSE url END AS url,
      'Title ' || {text(k)} AS title,
      CASE WHEN {k} % 9 = 0 THEN '' ELSE html END AS snippet,
      CASE WHEN {k} % 4 = 0 THEN NULL WHEN {k} % 5 = 0 THEN 'Shell' ELSE html END AS page_text,
      CASE WHEN {k} % 5 = 2 THEN {k} % 3 END AS display_rank,
      {d.plus_minutes("TIMESTAMP '2024-01-01 00:00:00'", f'({k} * 37) % 5000')} AS fetched_at
    FROM {{pages}}"""


def verdict_responses(d: SparkDialect) -> str:
    """One judge response per conversation, as JSON text; some are not of the shape that was asked for."""
    forum = "'\"https://forum.example.org/t/' || " + text("conv_id") + " || '\"'"
    return f"""
    SELECT conv_id AS response_id, {name('conv_id')} AS package,
      CASE WHEN conv_id % 37 = 5 THEN 'I would say it fits' WHEN conv_id % 41 = 6 THEN '["corroborated"]' ELSE
      '{{{{' || CASE WHEN conv_id % 43 = 7 THEN '' WHEN conv_id % 47 = 8 THEN '"status": 1, ' ELSE '"status": "' ||
        CASE conv_id % 7 WHEN 0 THEN 'uncorroborated' WHEN 1 THEN 'search_failed' WHEN 2 THEN 'maybe' ELSE 'corroborated' END || '", ' END ||
        CASE WHEN conv_id % 53 = 9 THEN '"sources": "none", ' WHEN conv_id % 59 = 10 THEN '"sources": [7], ' WHEN conv_id % 19 = 3 THEN ''
          WHEN conv_id % 5 = 0 THEN '"sources": [], ' WHEN conv_id % 11 = 4 THEN '"sources": ["https://invented.example/x", ' || {forum} || '], '
          WHEN count(*) > 2 THEN '"sources": [' || {forum} || ', ' || {forum} || '], ' ELSE '"sources": [' || {forum} || '], ' END ||
        CASE WHEN conv_id % 61 = 11 THEN '"confidence": "high", ' ELSE '' END ||
        '"reasoning": ' || CASE WHEN conv_id % 67 = 12 THEN 'false' WHEN conv_id % 31 = 3 THEN '"' || repeat('x', 401) || '"' ELSE '"it fits"' END || '}}}}' END AS response
    FROM {{conversations}} GROUP BY conv_id"""


def citations(d: SparkDialect) -> str:
    """(response, position, url) cited by a judge."""
    return f"""
    SELECT conv_id AS response_id, turn AS position,
      CASE WHEN conv_id % 11 = 4 AND turn = 0 THEN 'https://invented.example/x'
           ELSE 'https://forum.example.org/t/' || {text('conv_id')} END AS url
    FROM {{conversations}}"""


def catalogue_raw(d: SparkDialect) -> str:
    """Index rows of several sources, some of them invalid."""
    k = "o_orderkey"
    return f"""
    SELECT {k} AS file_position, 'src' || {text(f'{k} % 4')} AS driver,
      CASE WHEN {k} % 50 = 7 THEN 'bad device!' ELSE 'dev_' || {text('o_custkey % 40')} END AS device,
      CASE WHEN {k} % 3 = 0 THEN 'V' || {text(f'{k} % 20')} || '.0.' || {text(k)} || '.TGOIMXM'
           WHEN {k} % 3 = 1 THEN 'CP2A.' || {text('20 + o_custkey % 6')} || '0' || {text(f'1 + {k} % 9')} || CASE WHEN {k} % 31 = 4 THEN '99' ELSE '1' || {text(f'{k} % 9')} END || '.00' || {text(f'{k} % 7')}
           ELSE 'B4-' || {text(k)} END AS build,
      CASE WHEN {k} % 60 = 9 THEN 'http://plain.example/' ELSE 'https://cdn.example/' END || {text(k)} || '.zip' AS url,
      CASE WHEN {k} % 5 = 0 THEN md5({text(k)}) || md5('x' || {text(k)}) END AS sha256,
      CASE WHEN {k} % 4 = 1 THEN md5({text(k)}) END AS md5,
      CASE WHEN {k} % 70 = 3 THEN 0 ELSE CAST(ROUND(o_totalprice) AS BIGINT) END AS size,
      CASE WHEN {k} % 6 = 0 THEN 'Phone ' || {text('o_custkey % 40')} || CASE WHEN {k} % 12 = 0 THEN ' Pro' ELSE '' END END AS marketing_name,
      CASE WHEN {k} % 13 = 2 THEN '' WHEN {k} % 13 = 3 THEN 'https://other.example/api' ELSE 'https://gate' || {text(f'{k} % 3')} || '.example/api' END AS source_url,
      o_orderdate AS published_at, o_orderstatus AS region
    FROM {{orders}}"""


TABLES: dict[str, tuple[Callable[[SparkDialect], str], tuple[str, ...]]] = {
    "observations": (observations, ("lineitem",)),
    "reference_list": (reference_list, ("part",)),
    "config_rows": (config_rows, ("supplier",)),
    "classification": (classification, ("part",)),
    "stored_analysis": (stored_analysis, ("part",)),
    "decisions": (decisions, ("orders",)),
    "emissions": (emissions, ("supplier",)),
    "emission_packages": (emission_packages, ("part",)),
    "corroboration": (corroboration, ("part",)),
    "job_runs": (job_runs, ("events",)),
    "lease_events": (lease_events, ("events",)),
    "scratch_dirs": (scratch_dirs, ("orders",)),
    "responses": (responses, ("part",)),
    "search_results": (search_results, ("pages",)),
    "verdict_responses": (verdict_responses, ("conversations",)),
    "citations": (citations, ("conversations",)),
    "catalogue_raw": (catalogue_raw, ("orders",)),
}


def table(spark: SparkSession, sf_dir: str, derived: str, together: str | None = None) -> DataFrame:
    """One derived table as a lazy DataFrame over the parquet scan. Rows that share the given column `together` come in the same
    partition, or in few where they are very many, one after another; the given columns are far narrower than what is derived from them."""
    rule, sources = TABLES[derived]
    frames = {s: read_table(spark, f"{sf_dir}/{s}.parquet") for s in sources}
    if together:
        frames = {s: df.hint("rebalance", together).sortWithinPartitions(together) for s, df in frames.items()}
    return spark.sql(fill_names(rule(SPARK), SPARK), **frames)


def duck_text(derived: str) -> str:
    """The same rule over the checking engine's views."""
    rule, sources = TABLES[derived]
    return fill_names(rule(DUCK), DUCK).format(**{s: s for s in sources})
