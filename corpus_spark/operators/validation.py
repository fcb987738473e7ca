"""Validators: they name the first thing wrong and never repair it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.fixed_values import (
    ANSWERABLE_STATUSES,
    CATEGORIES,
    CONFIDENCES,
    DESCRIPTION_MAX_CHARS,
    DESCRIPTION_MIN_CHARS,
    FORBIDDEN_KEYS,
    MAX_NAME_CHARS,
    MAX_NAMES_PER_FIELD,
    MAX_PROSE_CHARS,
    PROPOSAL_KEYS,
    REASONING_MAX_CHARS,
    TIERS,
    UNKNOWN,
    VERDICT_KEYS,
)
from corpus_spark.functions.text import judged_text, strip
from corpus_spark.functions.tiers import is_below_floor, is_tier

REJECTED = "struct<field:string,reason:string>"


def _reject(field: str | Column, reason: str) -> Column:
    name = field if isinstance(field, Column) else F.lit(field)
    return F.struct(name.alias("field"), F.lit(reason).alias("reason"))


def _first(rules: list[tuple[Column, Column]]) -> Column:
    """The rejection of the first rule that holds, else NULL. A NULL test does not hold."""
    chain = F.when(rules[0][0], rules[0][1])
    for test, outcome in rules[1:]:
        chain = chain.when(test, outcome)
    return chain


def description_rules(description: Column, declared_unknown: Column) -> list[tuple[Column, Column]]:
    told = ~declared_unknown
    return [
        (declared_unknown & (description != UNKNOWN), _reject("description", "declared unknown but described")),
        (told & (description != strip(description)), _reject("description", "leading or trailing whitespace")),
        (told & (F.char_length(description) < DESCRIPTION_MIN_CHARS), _reject("description", "too short")),
        (told & (F.char_length(description) > DESCRIPTION_MAX_CHARS), _reject("description", "too long")),
        (told & description.rlike(" \n|\n "), _reject("description", "space next to a newline")),
    ]


def validate_proposals(responses: DataFrame) -> DataFrame:
    """Adds the parsed fields and `rejected` (NULL when accepted) to rows of
    (package, response JSON text, floor, category, rule). Order of checks: forbidden keys, shape,
    unknown_fields, description, floor, decided category, reasoning."""
    parsed = responses.withColumn("v", F.try_parse_json("response"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    parsed = parsed.withColumn(
        "keys",
        F.when(is_object, F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))),
    )

    def kind(key: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant")), F.lit("MISSING"))

    def value(key: str) -> Column:
        return F.try_variant_get("v", f"$.{key}", "string")

    parsed = parsed.select(
        "*",
        *[value(k).alias(f"p_{k}") for k in PROPOSAL_KEYS if k != "unknown_fields"],
        F.coalesce(F.try_variant_get("v", "$.unknown_fields", "array<string>"), F.array().cast("array<string>")).alias("p_unknown_fields"),
        *[kind(k).alias(f"k_{k}") for k in PROPOSAL_KEYS],
    )
    keys = F.col("keys")

    def wrong_text(key: str, optional: bool = False) -> Column:
        fine = (F.col(f"k_{key}") == "STRING") | (F.lit(optional) & ~F.array_contains(keys, key))
        return ~fine

    forbidden = F.filter(F.array(*[F.lit(k) for k in FORBIDDEN_KEYS]), lambda k: F.array_contains(keys, k))
    extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in PROPOSAL_KEYS])))
    names_only = F.col("k_unknown_fields").isin("ARRAY<STRING>", "ARRAY<VOID>") | ~F.array_contains(keys, "unknown_fields")
    described_unknown = F.array_contains("p_unknown_fields", "description")
    rules = [
        (keys.isNull(), _reject("response", "not a JSON object")),
        (F.size(forbidden) > 0, _reject(forbidden[0], "never model output")),
        (wrong_text("description"), _reject("description", "not text")),
        (wrong_text("list") | ~F.col("p_list").isin(*CATEGORIES), _reject("list", "not a category")),
        (wrong_text("removal") | ~F.col("p_removal").isin(*TIERS), _reject("removal", "not a tier")),
        (wrong_text("confidence") | ~F.col("p_confidence").isin(*CONFIDENCES), _reject("confidence", "not a level")),
        (~names_only, _reject("unknown_fields", "not a list of names")),
        (wrong_text("reasoning_brief", optional=True), _reject("reasoning_brief", "not text")),
        (F.size(extra) > 0, _reject(extra[0], "extra field")),
        (F.size(F.array_except("p_unknown_fields", F.array(F.lit("description")))) > 0, _reject("unknown_fields", "field cannot be unknown")),
        *description_rules(F.col("p_description"), described_unknown),
        (is_below_floor(F.col("p_removal"), F.col("floor")), _reject("removal", "below the floor")),
        (F.col("category").isNotNull() & (F.col("p_list") != F.col("category")), _reject("list", "contradicts the decided category")),
        (F.char_length("p_reasoning_brief") > REASONING_MAX_CHARS, _reject("reasoning_brief", "too long")),
    ]
    return parsed.withColumn("rejected", _first(rules)).drop("v", "keys", *[f"k_{k}" for k in PROPOSAL_KEYS])


def proposal_provenance(model: Column, rule: Column, category: Column) -> Column:
    """Field to owner, for every emitted field."""
    owner = F.concat(F.lit("llm:"), model)
    pairs = {
        "description": owner,
        "list": F.when(category.isNotNull(), rule).otherwise(owner),
        "removal": owner,
        "confidence": owner,
        "reasoning_brief": owner,
        "dependencies": F.lit("graph:corpus"),
        "neededBy": F.lit("graph:corpus"),
        "floor": F.lit("rule:ladder"),
    }
    return F.create_map(*[x for key, value in pairs.items() for x in (F.lit(key), value)])


def parse_verdicts(raw: DataFrame) -> DataFrame:
    """`raw` with its column `response`, JSON text, replaced by status, sources, reasoning, reasoning_chars and
    `shape`: what is wrong with the text, or NULL. Checked in order: an object, status (no default), sources and
    reasoning (empty where left out), then fields nobody asked for. Text that is no JSON has NULL fields."""
    parsed = raw.withColumn("v", F.try_parse_json("response"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    keys = F.when(is_object, F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")))
    parsed = parsed.withColumns(
        {
            "keys": keys,
            **{f"k_{k}": F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")) for k in VERDICT_KEYS},
            "sources": F.coalesce(F.try_variant_get("v", "$.sources", "array<string>"), F.array().cast("array<string>")),
            **{k: F.try_variant_get("v", f"$.{k}", "string") for k in ("status", "reasoning")},
        }
    )
    extra = F.array_sort(F.array_except("keys", F.array(*[F.lit(k) for k in VERDICT_KEYS])))
    rules = [
        (F.col("keys").isNull(), _reject("response", "not a JSON object")),
        (~F.array_contains("keys", "status"), _reject("status", "missing")),
        (F.col("k_status") != "STRING", _reject("status", "not text")),
        (~F.col("k_sources").isin("ARRAY<STRING>", "ARRAY<VOID>"), _reject("sources", "not a list of urls")),
        (F.exists("sources", lambda url: url.isNull()), _reject("sources", "not a list of urls")),
        (F.col("k_reasoning") != "STRING", _reject("reasoning", "not text")),
        (F.size(extra) > 0, _reject(extra[0], "extra field")),
    ]
    return parsed.withColumns(
        {
            "shape": _first(rules),
            "reasoning": F.coalesce("reasoning", F.lit("")),
            "reasoning_chars": F.char_length(F.coalesce("reasoning", F.lit(""))),
        }
    ).drop("v", "response", "keys", *[f"k_{k}" for k in VERDICT_KEYS])


def cited_sources(verdicts: DataFrame) -> DataFrame:
    """(response_id, position, url): every citation of parsed verdicts, repeats included."""
    return verdicts.select("response_id", F.posexplode("sources").alias("position", "url"))


def check_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Per response: how many distinct urls it cites, and whether one was never handed over
    (`fabricated`) or was handed over without any text (`unread`). Citations carry package."""
    handed = (
        sources.select("package", "url", judged_text(F.col("page_text"), F.col("snippet")).alias("judged"))
        .groupBy("package", "url")
        .agg(F.bool_and(F.length("judged") == 0).alias("empty"))
    )
    return (
        citations.join(handed, ["package", "url"], "left")
        .groupBy("response_id", "url")
        .agg(F.bool_or(F.col("empty").isNull()).alias("fabricated"), F.bool_or(F.coalesce("empty", F.lit(False))).alias("unread"))
        .groupBy("response_id")
        .agg(
            F.count(F.lit(1)).alias("cited"),
            F.bool_or("fabricated").alias("fabricated"),
            F.bool_or("unread").alias("unread"),
        )
    )


def validate_verdicts(responses: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds `rejected` to judge responses (response_id, package, status, reasoning_chars, and `shape`
    where they come from text). One bad citation rejects the whole response, and so does no status."""
    cited = citations.join(responses.select("response_id", "package"), "response_id")
    rows = responses.join(check_citations(cited, sources), "response_id", "left").withColumns(
        {
            "cited": F.coalesce("cited", F.lit(0)),
            "fabricated": F.coalesce("fabricated", F.lit(False)),
            "unread": F.coalesce("unread", F.lit(False)),
        }
    )
    shape = F.col("shape") if "shape" in responses.columns else F.lit(None).cast(REJECTED)
    rules = [
        (shape.isNotNull(), shape),
        (F.col("status").isNull(), _reject("status", "missing")),
        (~F.col("status").isin("corroborated", "uncorroborated", "search_failed", "judge_failed"), _reject("status", "not a status")),
        (~F.col("status").isin(*ANSWERABLE_STATUSES), _reject("status", "a pipeline fact, not a judgement")),
        (F.col("fabricated"), _reject("sources", "fabricated citation")),
        (F.col("unread"), _reject("sources", "cites a source without text")),
        ((F.col("status") == "corroborated") & (F.col("cited") == 0), _reject("sources", "corroborated without a source")),
        ((F.col("status") == "uncorroborated") & (F.col("cited") > 0), _reject("sources", "uncorroborated with sources")),
        (F.col("reasoning_chars") > REASONING_MAX_CHARS, _reject("reasoning", "too long")),
    ]
    return rows.withColumn("rejected", _first(rules))


# Characters a diff cannot show for what they are; a newline is fine in prose only.
_HIDDEN = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]"
_HIDDEN_IN_PROSE = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\p{Zs}&&[^ \n]]"


def text_fault(value: Column, prose: bool = False) -> Column:
    """Why a string may not ship, or NULL."""
    limit = MAX_PROSE_CHARS if prose else MAX_NAME_CHARS
    chain = F.when(value.isNull() | (strip(value) == ""), "blank")
    chain = chain.when(value.rlike(_HIDDEN_IN_PROSE if prose else _HIDDEN), "hidden character")
    if not prose:
        chain = chain.when(value != strip(value), "padded")
    return chain.when(value.rlike(r"\p{Cs}"), "lone surrogate").when(F.char_length(value) > limit, "too long")


def name_fault(value: Column) -> Column:
    return F.coalesce(
        text_fault(value), F.when(~value.rlike(r"^[A-Za-z0-9._-]+\z"), "not a package name")
    )


def emission_fault() -> Column:
    """The first thing that keeps a shippable row from being emitted, as `field: reason`, or NULL.
    Rows carry package, target_list, removal, description, floor, dependencies, needed_by, labels,
    bundle_sha256 and model."""

    def named(field: str, fault: Column) -> Column:
        return F.when(fault.isNotNull(), F.concat(F.lit(f"{field}: "), fault))

    def listed(field: str, column: str, fault) -> list[Column]:
        faulty = F.filter(F.col(column), lambda x: fault(x).isNotNull())
        return [
            F.when(F.size(column) > MAX_NAMES_PER_FIELD, f"{field}: too many names"),
            F.when(F.size(faulty) > 0, F.concat(F.lit(f"{field}: "), fault(faulty[0]))),
        ]

    return F.coalesce(
        named("package", name_fault(F.col("package"))),
        F.when(~F.coalesce(F.col("target_list").isin(*CATEGORIES), F.lit(False)), "list: not a category"),
        F.when(~is_tier(F.col("removal")), "removal: not a tier"),
        named("description", text_fault(F.col("description"), prose=True)),
        F.when(F.col("description").rlike(r"(?U)[^\S\n]\n|\n[^\S\n]"), "description: whitespace next to a newline"),
        F.when(~is_tier(F.col("floor")), "floor: not a tier"),
        F.when(is_below_floor(F.col("removal"), F.col("floor")), "removal: below the floor"),
        *listed("dependencies", "dependencies", name_fault),
        *listed("neededBy", "needed_by", name_fault),
        *listed("labels", "labels", text_fault),
        F.when(~F.coalesce(F.col("bundle_sha256").rlike(r"^[0-9a-f]{64}\z"), F.lit(False)), "bundle_sha256: not a digest"),
        named("model", text_fault(F.col("model"))),
    )
