import pytest
from pyspark.sql import functions as F

from corpus_spark.operators import devices as profiles
from corpus_spark.operators import emission, rewrite, triage, validation

CLASSIFICATION = "package string, bundle_sha256 string, removal string, confidence string, parked boolean, unknown_fields array<string>"


def board(spark, parked=False, decisions=(), shipped=(), commit="c"):
    classification = spark.createDataFrame([("p", "now", "Expert", "low", parked, [])], CLASSIFICATION)
    log = spark.createDataFrame([(i, "p", h, a, None, f"2024-01-0{d} 00:00:00") for i, (h, a, d) in enumerate(decisions)], "id int, package string, bundle_sha256 string, action string, reason string, decided_at string")
    none = spark.createDataFrame([], "package string, device_count int, has_conflict boolean, icon_mime string, floor string, status string")
    packages = spark.createDataFrame([(1, "p")] if shipped else [], "emission_id int, package string")
    emissions = spark.createDataFrame([(1, "b", commit)], "emission_id int, branch string, commit_oid string")
    row = triage.with_views(triage.triage_rows(classification, none, none, none, log, packages, emissions)).first()
    return [v for v in triage.VIEWS if row[f"in_{v}"]]


@pytest.mark.parametrize(
    ("kwargs", "views"),
    [
        ({}, ["queue"]),
        ({"decisions": [("now", "approve", 1)]}, ["decided"]),
        ({"decisions": [("now", "approve", 1)], "shipped": True}, ["shipped"]),
        ({"decisions": [("now", "approve", 1)], "shipped": True, "commit": None}, ["decided"]),
        ({"decisions": [("now", "reject", 1), ("old", "approve", 2)]}, ["queue"]),  # an older match stays history
        ({"decisions": [("now", "defer", 2), ("now", "approve", 2)]}, ["decided"]),  # equal times: the later id
        ({"decisions": [("now", "defer", 1)]}, ["deferred"]),
        ({"decisions": [("now", "reopen", 1)]}, ["queue"]),
        ({"parked": True, "decisions": [("now", "approve", 1)]}, ["parked"]),
    ],
)
def test_views(spark, kwargs, views):
    assert board(spark, **kwargs) == views


GOOD = '{"description": "A description of twenty chars", "list": "Misc", "removal": "Expert", "confidence": "low"%s}'


@pytest.mark.parametrize(
    ("response", "floor", "category", "field"),
    [
        (GOOD % "", "Expert", None, None),
        (GOOD % "", "Unsafe", None, "removal"),
        (GOOD % "", "Advanced", "Oem", "list"),
        (GOOD % "", None, None, None),
        (GOOD % ', "neededBy": []', "Expert", None, "neededBy"),
        (GOOD % ', "more": 1', "Expert", None, "more"),
        (GOOD % ', "unknown_fields": ["list"]', "Expert", None, "unknown_fields"),
        (GOOD % ', "unknown_fields": ["description"]', "Expert", None, "description"),
        (GOOD % ', "unknown_fields": []', "Expert", None, None),
        (GOOD % ', "unknown_fields": "description"', "Expert", None, "unknown_fields"),
        (GOOD % (', "reasoning_brief": "%s"' % ("x" * 401)), "Expert", None, "reasoning_brief"),
        (GOOD.replace("A description of twenty chars", "short") % "", "Expert", None, "description"),
        (GOOD.replace('"Misc"', "null") % "", "Expert", None, "list"),
        (GOOD.replace('"confidence": "low"', '"confidence": "LOW"') % "", "Expert", None, "confidence"),
        ("[]", "Expert", None, "response"),
        ("nonsense", "Expert", None, "response"),
    ],
)
def test_proposals_are_refused_by_field(spark, response, floor, category, field):
    rows = spark.createDataFrame([("p", response, floor, category, "r")], "package string, response string, floor string, category string, rule string")
    rejected = validation.validate_proposals(rows).first().rejected
    assert (rejected.field if rejected else None) == field


@pytest.mark.parametrize(
    ("text", "prose", "fault"),
    [
        ("fine", False, None), (" ", False, "blank"), ("a\tb", False, "hidden character"), ("a\nb", True, None), ("a\nb", False, "hidden character"),
        ("a​b", True, "hidden character"), ("a b", True, "hidden character"), (" a", False, "padded"), (" a", True, None), ("x" * 256, False, "too long"), ("x" * 256, True, None),
    ],
)
def test_text_faults(spark, text, prose, fault):
    got = spark.createDataFrame([(text,)], "t string").select(validation.text_fault(F.col("t"), prose).alias("f")).first().f
    assert got == fault


@pytest.mark.parametrize(
    ("devices", "vendor"),
    [(["a:1", "a:2"], "a"), (["a:1", "b:1"], "shared"), ([], None), (["a"], None), ([" a:1"], None), (["a:"], None), (["a:1:2"], "a")],
)
def test_vendor(spark, devices, vendor):
    got = spark.createDataFrame([(devices,)], "d array<string>").select(emission.vendor_of(F.col("d")).alias("v")).first().v
    assert got == vendor
    # The same from observation rows, whose state is of constant size, and from the profile of the array.
    rows = spark.createDataFrame([("p", d) for d in [*devices, *devices, None]], "package string, device_key string")
    assert profiles.device_profiles(rows).select(profiles.vendor().alias("v")).first().v == vendor
    framed = spark.createDataFrame([(devices,)], "d array<string>").select(*[c.alias(n) for n, c in profiles.profile_of(F.col("d")).items()])
    assert framed.select(profiles.vendor().alias("v")).first().v == vendor


STORED = "package string, bundle_sha256 string, description string, target_list string, removal string, confidence string, reasoning_brief string, unknown_fields array<string>, provenance map<string,string>"
FRESH = "package string, bundle_sha256 string, model string, description string, target_list string, removal string, confidence string, reasoning_brief string, unknown_fields array<string>, provenance map<string,string>, attempts int"


def rewritten(spark, owner, stored_removal, new_removal, floor):
    stored = spark.createDataFrame([("p", "h", "unknown", "Oem", stored_removal, "low", "b", ["x", "description"], {"removal": owner, "description": "human:triage"})], STORED)
    fresh = spark.createDataFrame([("p", "h2", "m", "new words", "Misc", new_removal, "high", "c", [], {"removal": "llm:m", "description": "llm:m"}, 1)], FRESH)
    floors = spark.createDataFrame([("p", floor)], "package string, floor string")
    return rewrite.rewrite_accepted(stored, fresh, floors).first()


def test_human_fields_survive(spark):
    row = rewritten(spark, "human:triage", "Unsafe", "Expert", "Expert")
    assert (row.removal, row.description, row.target_list, row.unknown_fields) == ("Unsafe", "unknown", "Misc", ["description", "x"])
    assert row.provenance == {"removal": "human:triage", "description": "human:triage"} and row.refusal is None


def test_a_human_rating_below_the_floor_is_superseded(spark):
    row = rewritten(spark, "human:triage", "Advanced", "Expert", "Expert")
    assert row.removal == "Expert" and row.provenance["removal"] == "llm:m" and row.refusal is None
    assert row.provenance["removal_superseded"] == "rule:floor superseded human:triage Advanced"


def test_the_floor_is_never_lowered(spark):
    assert rewritten(spark, "llm:m", "Advanced", "Advanced", "Expert").refusal == "below the floor"
    assert rewritten(spark, "llm:m", "Advanced", "Advanced", None).refusal is None
    assert rewritten(spark, "llm:m", "Advanced", "Advanced", "Odd").refusal == "unreadable floor"


def test_park_keeps_or_clears(spark):
    stored = spark.createDataFrame([("p", "h", "words", "Oem", "Expert", "low", "b", [], {"removal": "llm:m", "description": "human:triage"})], STORED)
    floors = spark.createDataFrame([("p", "Expert")], "package string, floor string")

    def park(bundle):
        rows = spark.createDataFrame([("p", bundle, "m", 3, "why")], "package string, bundle_sha256 string, model string, attempts int, reason string")
        return rewrite.rewrite_parked(stored, rows, floors).first()

    assert park("h").removal == "Expert"
    cleared = park("other")
    assert cleared.removal is None and cleared.description == "words" and cleared.provenance == {"description": "human:triage"}


@pytest.mark.parametrize(
    ("response", "field", "reason"),
    [
        ("it fits", "response", "not a JSON object"),
        ("[1]", "response", "not a JSON object"),
        (None, "response", "not a JSON object"),
        ("{}", "status", "missing"),
        ('{"sources": [], "reasoning": "x"}', "status", "missing"),
        ('{"status": null}', "status", "not text"),
        ('{"status": 1}', "status", "not text"),
        ('{"status": "corroborated", "sources": "u"}', "sources", "not a list of urls"),
        ('{"status": "corroborated", "sources": ["u", 7]}', "sources", "not a list of urls"),
        ('{"status": "corroborated", "sources": ["u", null]}', "sources", "not a list of urls"),
        ('{"status": "corroborated", "reasoning": false}', "reasoning", "not text"),
        ('{"status": "corroborated", "sources": ["u"], "confidence": "high"}', "confidence", "extra field"),
        ('{"status": "search_failed"}', "status", "a pipeline fact, not a judgement"),
        ('{"status": "corroborated"}', "sources", "corroborated without a source"),
        ('{"status": "corroborated", "sources": ["elsewhere"]}', "sources", "fabricated citation"),
        ('{"status": "corroborated", "sources": ["u", "u"]}', None, None),
        ('{"status": "uncorroborated"}', None, None),
    ],
)
def test_verdicts_from_response_text(spark, response, field, reason):
    raw = spark.createDataFrame([(1, "p", response)], "response_id int, package string, response string")
    sources = spark.createDataFrame([("p", "u", "text", None)], "package string, url string, page_text string, snippet string")
    verdicts = validation.parse_verdicts(raw)
    got = validation.validate_verdicts(verdicts, validation.cited_sources(verdicts), sources).first().rejected
    assert (got and tuple(got)) == (field and (field, reason))
