"""Which rows a model may learn from: a stable split by the CRC-32 of the id as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(id_column: str, modulus: int, remainder: int) -> Column:
    """True for the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
