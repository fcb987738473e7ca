"""What later stages need of a package's devices, as a state of constant size.

A package may stand on any number of devices, so no stage should read them as one array. `device_profiles` keeps a few
values per package that two partial results merge into; `profile_of` gives the same values for the array of a
merged fact row, where one has that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.fixed_values import SHARED_VENDOR
from corpus_spark.functions.text import device_key_parts
from corpus_spark.operators.queueing import is_emulator

PROFILE = ("emulators_only", "low_driver", "high_driver", "malformed")


def device_profiles(observations: DataFrame) -> DataFrame:
    """(package, emulators_only, low_driver, high_driver, malformed) from one pass over observation rows.

    Every value is a minimum or a maximum, so it is combined before the shuffle, repeated rows change nothing, and a package with a
    third of all rows arrives as one row per task. Rows without a device key say nothing; a package without any has nulls.
    """
    driver = device_key_parts(F.col("device_key"))["driver"]
    stated = F.col("device_key").isNotNull()
    return observations.groupBy("package").agg(
        F.min(F.when(stated, is_emulator(F.col("device_key")))).alias("emulators_only"),
        F.min(F.when(stated, driver)).alias("low_driver"),
        F.max(F.when(stated, driver)).alias("high_driver"),
        F.max(F.when(stated, driver.isNull())).alias("malformed"),
    )


def profile_of(devices: Column) -> dict[str, Column]:
    """The same values of an array of device keys."""
    drivers = F.transform(devices, lambda d: device_key_parts(d)["driver"])
    some = F.size(devices) > 0
    return {
        "emulators_only": F.when(some, F.forall(devices, is_emulator)),
        "low_driver": F.array_min(drivers),
        "high_driver": F.array_max(drivers),
        "malformed": F.when(some, F.exists(drivers, lambda d: d.isNull())),
    }


def vendor() -> Column:
    """The vendor of a row with a profile: the one driver of all its devices, `shared` for several, NULL when there is no device or
    a malformed key (the batch is refused)."""
    sound = ~F.coalesce(F.col("malformed"), F.lit(True))
    return F.when(sound, F.when(F.col("low_driver") == F.col("high_driver"), F.col("low_driver")).otherwise(SHARED_VENDOR))
