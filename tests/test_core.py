import random

import pytest

from corpus_spark.operators.devices import device_profiles
from corpus_spark.fixed_values import RULES, TIERS
from corpus_spark.operators import anchors, graph, ladder, queueing
from pyspark.sql import functions as F

from factories import corpus


def no_config(spark):
    return spark.createDataFrame([], "package string, permissions array<string>"), spark.createDataFrame([], "role string, holder string")


def floors(spark, *rows, privapp=(), roles=()):
    p, r = no_config(spark)
    if privapp:
        p = spark.createDataFrame(privapp, p.schema)
    if roles:
        r = spark.createDataFrame(roles, r.schema)
    return {x.package: x for x in ladder.compute_floors(corpus(spark, *rows), p, r).collect()}


CASES = {
    "core_app": ([{"package": "a.b", "core_app": True}], "Unsafe"),
    "sole_library_provider": ([{"package": "a.b", "libraries": ["l"]}, {"package": "c.d", "uses_libraries_required": ["l"]}], "Unsafe"),
    "sole_static_role_holder": ([{"package": "a.b"}], "Unsafe"),
    "deny_list": ([{"package": "com.cellbroadcast.x"}], "Unsafe"),
    "system_shared_uid": ([{"package": "a.b", "shared_user_id": "android.uid.system"}], "Expert"),
    "persistent": ([{"package": "a.b", "persistent": True}], "Expert"),
    "sole_core_intent_handler": ([{"package": "a.b", "handles_dialer": True}], "Expert"),
    "privileged": ([{"package": "a.b", "priv_app": True}], "Advanced"),
    "overlay_target": ([{"package": "a.b", "overlay_target": "c.d"}, {"package": "c.d", "core_app": True}], "Advanced"),
    "default": ([{"package": "a.b"}], "Recommended"),
}


def test_every_rule_has_a_case():
    assert set(CASES) == set(RULES)


@pytest.mark.parametrize("rule", RULES)
def test_rule_sets_its_tier(spark, rule):
    rows, tier = CASES[rule]
    roles = [("r", "a.b"), ("r", "gone")] if rule == "sole_static_role_holder" else ()
    found = floors(spark, *rows, roles=roles)[rows[0]["package"]]
    assert (found.floor, found.floor_rule) == (tier, rule)
    assert found.floor_reasons[-1].rule == "default"


def test_self_provider_leaves_the_other_one_sole(spark):
    rows = [{"package": "a", "libraries": ["l"], "uses_libraries_required": ["l"]}, {"package": "b", "libraries": ["l"]}]
    found = floors(spark, *rows)
    assert found["b"].floor_rule == "sole_library_provider" and found["a"].floor_rule == "default"


def test_overlay_reads_the_base_floor_and_is_capped(spark):
    found = floors(
        spark,
        {"package": "o1", "overlay_target": "o2"},
        {"package": "o2", "overlay_target": "t"},
        {"package": "t", "core_app": True},
        {"package": "self", "overlay_target": "self"},
    )
    assert found["o2"].floor == "Advanced" and found["o1"].floor == "Recommended"
    assert found["self"].floor_rule == "default"


def test_allowlist_counts_permissions(spark):
    found = floors(spark, {"package": "a"}, privapp=[("a", ["p", "q"])])["a"]
    assert (found.floor, found.privapp_permission_count) == ("Advanced", 2)
    assert "privapp-permissions allowlist" in found.floor_reasons[0].detail


@pytest.mark.parametrize(
    ("name", "hit"),
    [("com.Emergency.x", True), ("a.wea.b", True), ("com.weather", False), ("x.amber", True), ("x.chamber", False), ("a.sarctl", True), ("hu.mobilvasarlas", False)],
)
def test_deny_list(spark, name, hit):
    got = spark.createDataFrame([(name,)], "p string").select(ladder.deny_list_reason(F.col("p")).alias("r")).first().r
    assert (got is not None) is hit


def test_tier_order_is_not_string_order():
    assert list(TIERS) != sorted(TIERS)


def test_evidence_buckets(spark):
    frame = corpus(
        spark,
        {"package": "a", "overlay_target": "a", "uses_libraries_required": ["own", "plat", "none"], "libraries": ["own"], "queries_packages": ["b", "z"], "provider_authorities": ["au", "sh"], "content_uri_authorities": ["au", "sh", "nobody"]},
        {"package": "b", "provider_authorities": ["sh"]},
    )
    platform = spark.createDataFrame([("plat",)], "library string")
    row = graph.evidence(frame, platform).filter("package = 'a'").first()
    assert row.overlay_target_absent == "a"
    assert row.required_libraries_from_platform == ["plat"]
    assert row.required_libraries_unresolved == ["none", "own"]  # providing it itself does not help
    assert (row.queries_packages_in_corpus, row.queries_packages_absent) == (["b"], ["z"])
    assert row.shared_provider_authorities == ["sh"]
    assert (row.content_uri_authorities_in_corpus, row.content_uri_authorities_absent) == (["sh"], ["nobody"])


@pytest.mark.parametrize(
    ("package", "devices", "want"),
    [
        ("listed", ["google:emulator-a16"], "already_upstream"),
        ("x.auto_generated_rro_vendor__", [], "auto_generated_rro"),
        ("e", ["google:emulator-a16", "x:SDK_gphone64"], "emulator_only"),
        ("e", ["google:emulator-a16", "x:phone"], "queued"),
        ("e", ["emulator:"], "emulator_only"),
        ("e", ["emulator:phone"], "queued"),
        ("e", [], "queued"),
    ],
)
def test_filter_verdict(spark, package, devices, want):
    reference = spark.createDataFrame([("listed",)], "package string")
    frame = corpus(spark, {"package": package, "devices": devices})
    assert queueing.filter_verdicts(frame, reference).first().filter_verdict == want
    rows = spark.createDataFrame([(package, d) for d in devices or [None]], "package string, device_key string")
    assert queueing.filter_verdicts(device_profiles(rows), reference).first().filter_verdict == want


def nearest_by_force(package, entries, k):
    def shared(a, b):
        n = 0
        for x, y in zip(a.split("."), b.split("."), strict=False):
            if x != y:
                break
            n += 1
        return n

    scored = sorted((-shared(package, e), e) for e, d in entries if e != package and d.strip() and shared(package, e) >= 2)
    return [e for _, e in scored[:k]]


def test_nearest_entries_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "dd"])
    names = sorted({".".join(word() for _ in range(rng.randint(1, 6))) for _ in range(400)})
    entries = [(n, rng.choice(["text", "text", " "])) for n in names if rng.random() < 0.7]
    packages = [n for n in names if rng.random() < 0.7]
    reference = spark.createDataFrame([(n, "Oem", "Expert", d) for n, d in entries], "package string, list string, removal string, description string")
    got = {}
    for r in anchors.nearest_entries(spark.createDataFrame([(p,) for p in packages], "package string"), reference).orderBy("package", "rank").collect():
        got.setdefault(r.package, []).append(r.anchor)
    want = {p: found for p in packages if (found := nearest_by_force(p, entries, 4))}
    assert got == want


def test_incidence_moves_the_other_package_only(spark):
    rows = [("library", "a", "b", "lib"), ("library", "a", "b", "b"), ("overlay", "c", "a", "a"), ("overlay", "b", "c", "c")]
    edge_rows = spark.createDataFrame(rows, "kind string, dependent string, provider string, detail string")
    incident = graph.incidence(edge_rows)
    got = {r.package: [tuple(e) for e in r.edges] for r in incident.collect()}
    assert got == {p: sorted(e for e in rows if p in e[1:3]) for p in "abc"}
    plan = incident._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("Aggregate [package") :].splitlines()[0]
    assert "collect_list(end" in grouped
