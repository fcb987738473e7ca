"""Config rows (device_key, kind, key, value) unioned over devices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def privapp_permissions(config: DataFrame) -> DataFrame:
    """(package, permissions): granted permissions of any device. A package that is listed without
    a permission is listed all the same."""
    return (
        config.filter("kind = 'privapp'")
        .select(F.col("key").alias("package"), "value")
        .distinct()
        .groupBy("package")
        .agg(F.sort_array(F.collect_list("value")).alias("permissions"))
    )


def static_roles(config: DataFrame) -> DataFrame:
    """(role, holder), each pair once."""
    return (
        config.filter("kind = 'role'")
        .select(F.col("key").alias("role"), F.col("value").alias("holder"))
        .distinct()
    )


def platform_libraries(config: DataFrame) -> DataFrame:
    return config.filter("kind = 'library'").select(F.col("key").alias("library")).distinct()


def config_union(config: DataFrame) -> DataFrame:
    """The whole union in long form: (kind, key, values), files counted or named once."""
    listed = (
        config.filter("kind IN ('privapp', 'role')")
        .select("kind", "key", "value")
        .distinct()
        .groupBy("kind", "key")
        .agg(F.sort_array(F.collect_list("value")).alias("values"))
    )
    named = (
        config.filter("kind IN ('library', 'failed')")
        .select("kind", "key")
        .distinct()
        .select("kind", "key", F.array().cast("array<string>").alias("values"))
    )
    read = config.filter("kind = 'read'").agg(F.count(F.lit(1)).cast("string").alias("n")).select(
        F.lit("read").alias("kind"), F.lit("files").alias("key"), F.array("n").alias("values")
    )
    return listed.unionByName(named).unionByName(read)
