"""The corpus view of merged facts: what the graph, the filter and the ladder read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.fixed_values import DIALER_ACTION, HOME_ACTION, HOME_CATEGORY, SMS_ACTION

CORPUS_SCALARS = (
    "package",
    "devices",
    "partitions",
    "device_count",
    "priv_app",
    "core_app",
    "persistent",
    "shared_user_id",
    "overlay_target",
    "uses_libraries_required",
    "uses_libraries_optional",
    "queries_packages",
    "provider_authorities",
    "content_uri_authorities",
    "is_input_method",
)
DERIVED_FROM = ("libraries", "static_libraries", "intent_filters")
# What a bundle shows and the graph, the filter and the ladder never read.
IDENTITY = ("label", "label_unresolved", "cert_issuer", "version_code", "has_conflict")
# The fact columns that the graph, the filter, the ladder and bundles read between them.
BUNDLE_FACTS = (*CORPUS_SCALARS[1:], *DERIVED_FROM, *IDENTITY)


def library_names(column: str) -> Column:
    """Distinct non-empty names of a list of library structs."""
    names = F.transform(F.col(column), lambda x: x["name"])
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def handles(action: str, category: str | None = None) -> Column:
    def matches(item: Column) -> Column:
        found = F.array_contains(item["actions"], action)
        if category is not None:
            found = found & F.array_contains(item["categories"], category)
        return found

    return F.coalesce(F.exists("intent_filters", matches), F.lit(False))


def load_corpus(facts: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Corpus rows, with further fact columns if asked for. The icon payload is never selected, so
    a parquet scan does not read it."""
    return facts.select(*CORPUS_SCALARS, *_derived(), *extra)


def corpus_part(facts: DataFrame) -> DataFrame:
    """What can be said of the corpus from facts that were merged in part (`merge.merge_columns`)."""
    return facts.select(*[c for c in CORPUS_SCALARS if c in facts.columns], *_derived(facts.columns))


def _derived(present: Sequence[str] = DERIVED_FROM) -> list[Column]:
    surfaces = {"handles_home": handles(HOME_ACTION, HOME_CATEGORY), "handles_dialer": handles(DIALER_ACTION), "handles_sms_deliver": handles(SMS_ACTION)}
    names = [library_names(c).alias(c) for c in DERIVED_FROM[:2] if c in present]
    return names + [c.alias(name) for name, c in surfaces.items() if DERIVED_FROM[2] in present]
