"""The removal floor: ten rules, the strictest that fires wins, ties go to the earlier rule.

Seven rules are row-local expressions. The three corpus-wide ones (sole library provider, sole
static-role holder, sole intent handler) come from small grouped frames joined by package, and the
overlay rule is one self-join over base floors, so no rule needs a union of ten frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.fixed_values import DENY_LIST, OVERLAY_CAP, RULES, SYSTEM_SHARED_UID, TIERS
from corpus_spark.functions.tiers import danger_rank, mildest
from corpus_spark.operators.graph import owners, provided_libraries, required_libraries


def deny_list_reason(package: Column) -> Column:
    """Why a name is legally risky to remove, or NULL."""
    name = F.lower(package)
    chain = None
    for pattern, reason in DENY_LIST:
        hit = name.rlike(pattern)
        chain = F.when(hit, reason) if chain is None else chain.when(hit, reason)
    return chain


def sole_library_consumers(corpus: DataFrame) -> DataFrame:
    """(provider, consumer): the provider is the only other source of a library it requires.

    With the count and the lowest and highest provider of a library, a consumer's single other
    provider is known without listing providers.
    """
    joined = required_libraries(corpus).join(
        owners(provided_libraries(corpus), "library"), "library"
    )
    own = (F.col("first_owner") == F.col("package")) | (F.col("last_owner") == F.col("package"))
    # Among two providers a consumer that is one of them is the lowest or the highest.
    single = (F.col("owner_count") == 1) & ~own
    paired = (F.col("owner_count") == 2) & own
    other = F.when(single, F.col("first_owner")).when(
        paired,
        F.when(F.col("first_owner") == F.col("package"), F.col("last_owner")).otherwise(
            F.col("first_owner")
        ),
    )
    return (
        joined.select(other.alias("provider"), F.col("package").alias("consumer"))
        .filter("provider IS NOT NULL")
        .distinct()
    )


def sole_static_roles(corpus: DataFrame, roles: DataFrame) -> DataFrame:
    """(package, role): the only corpus holder of a static role. `roles` is (role, holder)."""
    present = (
        roles.select("role", F.col("holder").alias("package"))
        .distinct()
        .join(corpus.select("package"), "package", "left_semi")
    )
    return (
        present.groupBy("role")
        .agg(F.count(F.lit(1)).alias("holders"), F.min("package").alias("package"))
        .filter("holders = 1")
        .select("package", "role")
    )


def sole_intent_surfaces(corpus: DataFrame) -> DataFrame:
    """(package, surface): the only handler of a core intent surface. One global partial
    aggregate over four flags, then four rows."""
    flags = {
        "HOME": "handles_home",
        "DIALER": "handles_dialer",
        "SMS_DELIVER": "handles_sms_deliver",
        "IME": "is_input_method",
    }
    counted = corpus.agg(
        F.array(
            *[
                F.struct(
                    F.lit(surface).alias("surface"),
                    F.count_if(F.col(flag)).alias("handlers"),
                    F.min(F.when(F.col(flag), F.col("package"))).alias("package"),
                )
                for surface, flag in flags.items()
            ]
        ).alias("surfaces")
    )
    return (
        counted.select(F.inline("surfaces"))
        .filter("handlers = 1")
        .select("package", "surface")
    )


def _gathered(pairs: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    return pairs.groupBy(F.col(key).alias("package")).agg(
        F.sort_array(F.collect_list(value)).alias(alias)
    )


def _rule(name: str, floor: Column | str, detail: Column | str, fires: Column) -> Column:
    tier = floor if isinstance(floor, Column) else F.lit(floor)
    text = detail if isinstance(detail, Column) else F.lit(detail)
    fired = F.struct(
        (-danger_rank(tier)).alias("strictness"),
        F.lit(RULES.index(name)).alias("position"),
        F.lit(name).alias("rule"),
        tier.alias("floor"),
        text.alias("detail"),
    )
    return F.when(fires, fired)


def base_rules(corpus: DataFrame, privapp: DataFrame, roles: DataFrame) -> DataFrame:
    """Every package with its fired rules, the overlay rule still missing.

    `privapp` is (package, permissions), one row per allowlisted package.
    """
    libraries = _gathered(sole_library_consumers(corpus), "provider", "consumer", "consumers")
    held = _gathered(sole_static_roles(corpus, roles), "package", "role", "roles")
    surfaces = _gathered(sole_intent_surfaces(corpus), "package", "surface", "surfaces")
    listed = privapp.select(
        "package", F.size("permissions").alias("permission_count"), F.lit(True).alias("allowlisted")
    )
    allowed = F.coalesce(F.col("allowlisted"), F.lit(False))
    where = F.when(F.col("priv_app"), "priv-app").otherwise("privapp-permissions allowlist")
    privileged = F.concat(
        F.lit("privileged ("),
        where,
        F.lit(")"),
        F.when(
            allowed,
            F.concat(F.lit(", "), F.col("permission_count").cast("string"), F.lit(" allowlisted permission(s)")),
        ).otherwise(""),
    )

    def listing(prefix: str, column: str) -> Column:
        return F.concat(F.lit(prefix), F.array_join(column, ", "))

    rules = (
        _rule("core_app", "Unsafe", 'coreApp="true": AOSP puts it in the minimalist boot environment', F.col("core_app")),
        _rule("sole_library_provider", "Unsafe", listing("sole corpus provider of a required library for ", "consumers"), F.col("consumers").isNotNull()),
        _rule("sole_static_role_holder", "Unsafe", listing("sole corpus holder of static role(s) ", "roles"), F.col("roles").isNotNull()),
        _rule("deny_list", "Unsafe", deny_list_reason(F.col("package")), deny_list_reason(F.col("package")).isNotNull()),
        _rule("system_shared_uid", "Expert", f'sharedUserId="{SYSTEM_SHARED_UID}"', F.col("shared_user_id") == SYSTEM_SHARED_UID),
        _rule("persistent", "Expert", 'persistent="true": the platform keeps it running', F.col("persistent")),
        _rule("sole_core_intent_handler", "Expert", listing("sole corpus handler of ", "surfaces"), F.col("surfaces").isNotNull()),
        _rule("privileged", "Advanced", privileged, F.col("priv_app") | allowed),
        _rule("default", "Recommended", "no rule fired", F.lit(True)),
    )
    return (
        corpus.select("package", "overlay_target", "core_app", "persistent", "shared_user_id", "priv_app")
        .join(libraries, "package", "left")
        .join(F.broadcast(surfaces), "package", "left")  # four rows at most
        .join(held, "package", "left")
        .join(listed, "package", "left")
        .select(
            "package",
            "overlay_target",
            allowed.alias("privapp_allowlisted"),
            F.coalesce("permission_count", F.lit(0)).alias("privapp_permission_count"),
            F.sort_array(F.array_compact(F.array(*rules))).alias("fired"),
        )
        .withColumn("base_floor", F.col("fired")[0]["floor"])
    )


def inherit_from_target(base: DataFrame) -> DataFrame:
    """Adds the overlay rule: the target's base floor, capped. The base floor (not the final one)
    keeps chains and cycles from being followed."""
    targets = base.select(F.col("package").alias("overlay_target"), F.col("base_floor").alias("target_floor"))
    inherited = _rule(
        "overlay_target",
        mildest(F.col("target_floor"), F.lit(OVERLAY_CAP)),
        F.concat(
            F.lit("overlay of "), F.col("overlay_target"), F.lit(" (its floor "),
            F.col("target_floor"), F.lit(f", capped at {OVERLAY_CAP})"),
        ),
        F.col("target_floor").isNotNull() & (F.col("overlay_target") != F.col("package")),
    )
    return base.join(targets, "overlay_target", "left").withColumn(
        "fired", F.sort_array(F.array_compact(F.concat("fired", F.array(inherited))))
    )


def compute_floors(corpus: DataFrame, privapp: DataFrame, roles: DataFrame) -> DataFrame:
    """(package, floor, floor_rule, floor_reasons, privapp columns) for the whole corpus."""
    return inherit_from_target(base_rules(corpus, privapp, roles)).select(
        "package",
        F.col("fired")[0]["floor"].alias("floor"),
        F.col("fired")[0]["rule"].alias("floor_rule"),
        F.transform(
            "fired", lambda r: F.struct(r["rule"].alias("rule"), r["floor"].alias("floor"), r["detail"].alias("detail"))
        ).alias("floor_reasons"),
        "privapp_allowlisted",
        "privapp_permission_count",
    )


def floor_distribution(floors: DataFrame) -> DataFrame:
    """Package count per tier and per deciding rule."""
    return floors.groupBy("floor", "floor_rule").agg(F.count(F.lit(1)).alias("packages"))


def rule_table(spark) -> DataFrame:
    """The tier each rule sets; the overlay rule's is a maximum."""
    tiers = ("Unsafe", "Unsafe", "Unsafe", "Unsafe", "Expert", "Expert", "Expert", "Advanced", "Advanced", "Recommended")
    rows = [(i, rule, tier, TIERS.index(tier)) for i, (rule, tier) in enumerate(zip(RULES, tiers, strict=True))]
    return spark.createDataFrame(rows, "position int, rule string, floor string, danger int")
