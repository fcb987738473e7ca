"""Text and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace, plus the separators U+001C..U+001F that (?U)\s leaves out.
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def clean_text(text: Column) -> Column:
    """No NUL, every whitespace run one space, trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\x00"), F.lit("")), _SPACES, " "))


def strip(text: Column) -> Column:
    """Unicode whitespace off both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$", "")


def content_authorities(text: Column) -> Column:
    """Distinct ASCII authorities of content:// references, sorted."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)content:///?([^/]*)"), F.lit(1))
    kept = F.filter(found, lambda a: (F.length(a) > 0) & a.rlike(r"^[\x00-\x7F]+$"))
    return F.array_sort(F.array_distinct(kept))


def judged_text(page_text: Column, snippet: Column) -> Column:
    """The page body when it says more than its own snippet, else the snippet, else the body."""
    return F.when(uses_page_text(page_text, snippet), page_text).otherwise(
        F.coalesce(F.nullif(snippet, F.lit("")), page_text, F.lit(""))
    )


def uses_page_text(page_text: Column, snippet: Column) -> Column:
    return F.length(F.coalesce(page_text, F.lit(""))) > F.length(F.coalesce(snippet, F.lit("")))


def evidence_kind(page_text: Column, snippet: Column) -> Column:
    return F.when(uses_page_text(page_text, snippet), "page_text").otherwise("search_snippet")


def device_key_parts(key: Column) -> Column:
    """struct(driver, device), or NULL for a key that is not `<driver>:<device>` exactly."""
    at = F.instr(key, ":")
    driver = F.substring(key, F.lit(1), at - 1)
    device = F.substring(key, at + 1, F.length(key))
    sound = (at > 1) & (F.length(device) > 0) & (driver == strip(driver)) & (device == strip(device))
    return F.when(sound, F.struct(driver.alias("driver"), device.alias("device")))


def canonical_device_path(partition: Column, image_path: Column) -> Column:
    rooted = F.substring_index(image_path, "/", 1) == partition
    return F.when(rooted, F.concat(F.lit("/"), image_path)).otherwise(
        F.concat(F.lit("/"), partition, F.lit("/"), image_path)
    )


def build_date(build: Column) -> Column:
    """The date in a `.YYMMDD.` field, NULL when there is none or it is no date."""
    digits = F.regexp_extract(build, r"\.(\d{6})\.", 1)
    # Two-digit years: 69-99 are 19xx, the rest 20xx.
    century = F.when(F.substring(digits, 1, 2) >= "69", "19").otherwise("20")
    return F.try_to_timestamp(F.concat(century, F.nullif(digits, F.lit(""))), F.lit("yyyyMMdd")).cast("date")


def normalize_version(version: Column) -> Column:
    """Three slash-separated parts get the first repeated as a fourth; an empty third part takes
    the first."""
    parts = F.split(version, "/")
    four = F.when(F.size(parts) == 3, F.array_append(parts, parts[0])).otherwise(parts)
    filled = F.when(
        (F.size(four) >= 3) & (F.get(four, F.lit(2)) == ""),
        F.transform(four, lambda p, i: F.when(i == 2, four[0]).otherwise(p)),
    ).otherwise(four)
    return F.array_join(filled, "/")


def usage_counters(usage: Column) -> Column:
    """struct(cache_hit_tokens, reasoning_tokens), 0 when absent or not an integer."""
    parsed = F.try_parse_json(usage)

    def counter(path: str) -> Column:
        value = F.try_variant_get(parsed, path, "bigint")
        kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
        return F.coalesce(F.when(kind == "BIGINT", value), F.lit(0))

    return F.struct(
        counter("$.prompt_cache_hit_tokens").alias("cache_hit_tokens"),
        counter("$.completion_tokens_details.reasoning_tokens").alias("reasoning_tokens"),
    )
