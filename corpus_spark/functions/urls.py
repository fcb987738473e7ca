"""Which urls may be fetched, and what class of address a host literal is."""

from __future__ import annotations

import ipaddress
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_spark.fixed_values import ADDRESS_NETWORKS

_WIDTH = {4: 32, 6: 128}


def _ranges(version: int) -> tuple[list[int], list[str | None]]:
    """The address space cut at every border of a labelled network: (first number, label) of each piece.

    A piece has the label of the first listed network that holds it."""
    nets = [(ipaddress.ip_network(block), label) for label, blocks in ADDRESS_NETWORKS for block in blocks]
    nets = [(int(n[0]), int(n[-1]) + 1, label) for n, label in nets if n.version == version]
    starts = sorted({0, *(edge for low, high, _ in nets for edge in (low, high) if edge < 2 ** _WIDTH[version])})
    return starts, [next((label for low, high, label in nets if low <= s < high), None) for s in starts]


_RANGES = {version: _ranges(version) for version in _WIDTH}
_MAPPED = int(ipaddress.ip_address("::ffff:0:0")) >> 32


@lru_cache(maxsize=65536)
def _network_label(host: str) -> str | None:
    """The label of the piece that an address literal's number falls into."""
    try:
        literal = ipaddress.ip_address(host)
    except ValueError:
        return None
    number, version = int(literal), literal.version
    if version == 6 and number >> 32 == _MAPPED:
        number, version = number & 0xFFFFFFFF, 4
    starts, labels = _RANGES[version]
    return labels[bisect_right(starts, number) - 1]


@lru_cache(maxsize=65536)
def _encodable(host: str) -> bool:
    try:
        return bool(host.encode("idna")) and not any(c.isspace() for c in host)
    except UnicodeError:
        return False


@F.pandas_udf(
    T.StructType([T.StructField("encodable", T.BooleanType()), T.StructField("blocked", T.StringType())])
)
def _inspect(host: pd.Series) -> pd.DataFrame:
    hosts = host.fillna("")
    return pd.DataFrame(
        {
            "encodable": [bool(h) and (":" in h or _encodable(h)) for h in hosts],
            "blocked": [_network_label(h) for h in hosts],
        }
    )


def url_host(url: Column) -> Column:
    """Host without the brackets of an IPv6 literal; NULL for a url that does not parse."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^\[|\]$", "")


def url_check(url: Column) -> Column:
    """struct(fetchable, blocked). One Arrow-batched pass; repeated hosts are answered from memory,
    so there is no shuffle to find the distinct ones."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    seen = _inspect(url_host(url))
    return F.struct(
        F.coalesce(scheme.isin("http", "https") & seen["encodable"], F.lit(False)).alias("fetchable"),
        seen["blocked"].alias("blocked"),
    )
