"""Secret scans with multipart credential linking, in DataFrame expressions only.

Three kinds stand by themselves: `assign`, `access` and `hex`. Three weak ones are reported only where complementary
parts co-occur within SCOPE code points: `key` (identifiers: key ids, assigned users, accounts, clients) beside a secret,
`secret` (short assigned values and opaque strings) beside an identifier or an endpoint, and `endpoint` (addresses)
beside a secret. A weak part that overlaps one of the three kinds adds nothing, an opaque string that ends within an
identifier is none but that, and a secret inside an address completes no other address.

One pass over the texts writes the lengths of matches and of the gaps between them, never their characters. A running
sum over those gives positions, and the interval join meets parts in cells of CELL code points, so what
a part meets is bounded by the cell and not by the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpus_spark.session import materialize

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the runs of 16 and more are those of [0-9a-f]+ that are long enough
KEY_ID = (
    r"(?:AKIA|ASIA|AIDA|AROA|AGPA|ANPA|ANVA|ABIA|ACCA|APKA|ASCA|GOOG)[A-Z0-9]{8,}|(?<![A-Za-z0-9])(?:LTAI|AKID)[A-Za-z0-9]{8,}"
    r"|ocid1\.[a-z0-9]+\.[a-z0-9._-]+|[0-9]{6,}-[a-z0-9]{16,}\.apps\.googleusercontent\.com"
)
NAMED = (
    r"(?i:(?:(?:user|account|acct|client|customer|tenant|subscription|app|application|principal|key)[_\x20-]?(?:id|name|email)"
    r"|(?<!secret)(?<!secret[_-])access[_-]?key|(?<![A-Za-z0-9])(?:user|usr|login|account|acct|e?mail))"
    r"""["']?\x20*[:=]\x20*["']?(?!(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])[A-Za-z0-9._%+@-]+)"""
)
KEY = f"{KEY_ID}|{NAMED}"
# Both lookaheads stay inside of the run, so a run is read a fixed number of times however long the text goes on behind it.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(?:https?|s3a?|ftp|jdbc:[a-z]+)://[^\x20\x09-\x0D"'<>]+"""
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "key": KEY, "secret": OPAQUE, "endpoint": ENDPOINT}
KINDS = ("assign", "access", "hex", "key", "secret", "endpoint")
BASE = KINDS[:3]
LEAST = {"assign": 12, "access": 18, "hex": 16, "key": 12, "secret": 20, "endpoint": 10}
SCOPE, CELL = 200, 256

_LENGTHS = "array<struct<gap:int,match:int,value:int>>"


def _found(text: Column, kind: str, where: Column) -> Column:
    """The gap before each match, its length and the length of its value, in order; null without a match."""
    pattern = F.lit(PATTERNS[kind])
    group = 2 if kind == "assign" else 0
    parts = F.arrays_zip(
        F.transform(F.split(text, PATTERNS[kind], -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length).alias("match"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), F.char_length).alias("value"),
    )
    return F.when(where & text.rlike(PATTERNS[kind]), parts.cast(_LENGTHS))


def lengths(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(rid, id, digest, one array of lengths per kind) per row, written; `digest` where anything matched."""
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    found = rows.withColumn("linked", linkable(text)).select(
        "id",
        F.when(strong_matches(text) | F.col("linked"), F.sha2("text", 256)).alias("digest"),
        *[_found(text, k, F.lit(True) if k in BASE else F.col("linked")).alias(k) for k in KINDS],
    )
    return materialize(found.withColumn("rid", F.monotonically_increasing_id()), "secret-lengths")


def strong_matches(text: Column) -> Column:
    return text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX)


def linkable(text: Column) -> Column:
    """Whether weak parts can count: every rule needs a secret, and an identifier or an endpoint."""
    return (text.rlike(ENDPOINT) | text.rlike(KEY)) & (text.rlike(ASSIGN) | text.rlike(HEX) | text.rlike(OPAQUE))


def suspicious(text: Column) -> Column:
    """Whether a text can hold any span at all."""
    return strong_matches(text) | linkable(text)


def _positions(measured: DataFrame) -> DataFrame:
    """(rid, kind, start, end, value): every match, failing ones included, in code points."""
    long = None
    for kind in KINDS:
        part = measured.filter(F.col(kind).isNotNull()).select(
            "rid", F.lit(kind).alias("kind"), F.posexplode(kind).alias("place", "at")
        )
        long = part if long is None else long.unionByName(part)
    order = W.partitionBy("rid", "kind").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    through = F.sum(F.col("at.gap") + F.coalesce(F.col("at.match"), F.lit(0))).over(order)
    return (
        long.withColumn("end", through.cast("bigint"))
        .filter("at.match IS NOT NULL")
        .select("rid", "kind", (F.col("end") - F.col("at.match")).alias("start"), "end", F.col("at.value").alias("value"))
    )


def _least() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k, LEAST[k])]), F.col("kind"))


def settled(parts: DataFrame) -> DataFrame:
    """`parts` without opaque strings that an identifier holds up to their end; `inside`: a secret in an address."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor(F.col("end") / CELL)))
    holder = F.col("kind").isin("access", "key", "endpoint")
    secrets = parts.filter(~holder).withColumn("cell", cells).alias("s")
    holders = parts.filter(holder).withColumn("cell", cells).alias("h")
    overlap = (F.col("h.start") < F.col("s.end")) & (F.col("h.end") > F.col("s.start"))
    address = F.col("h.kind") == "endpoint"
    held = (
        secrets.join(holders, (F.col("s.rid") == F.col("h.rid")) & (F.col("s.cell") == F.col("h.cell")) & overlap)
        .groupBy("s.rid", "s.kind", "s.start", "s.end")
        .agg(F.bool_or(~address & (F.col("h.end") >= F.col("s.end"))).alias("own"), F.bool_or(address).alias("inside"))
    )
    return (
        parts.join(held, ["rid", "kind", "start", "end"], "left")
        .filter(~(F.col("opaque") & F.coalesce("own", F.lit(False))))
        .select("rid", "kind", "start", "end", "strong", F.coalesce("inside", F.lit(False)).alias("inside"))
    )


def linked_parts(parts: DataFrame) -> DataFrame:
    """Weak parts with their complement in scope: the interval join, on (rid, cell) with a range condition."""
    weak = parts.filter("NOT strong")
    covered = F.explode(F.sequence(F.floor((F.col("start") - SCOPE) / CELL), F.floor((F.col("end") + SCOPE) / CELL)))
    left = weak.withColumn("cell", covered).alias("w")
    own = F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor(F.col("end") / CELL)))
    right = parts.withColumn("cell", own).alias("p")
    near = (F.col("p.start") <= F.col("w.end") + SCOPE) & (F.col("p.end") >= F.col("w.start") - SCOPE)
    overlap = (F.col("p.start") < F.col("w.end")) & (F.col("p.end") > F.col("w.start"))
    met = left.join(right, (F.col("w.rid") == F.col("p.rid")) & (F.col("w.cell") == F.col("p.cell")) & near)
    identifier, address = F.col("p.kind").isin("access", "key"), F.col("p.kind") == "endpoint"
    secret = ~identifier & ~address & ~overlap
    beside = met.groupBy("w.rid", "w.kind", "w.start", "w.end").agg(
        F.bool_or(identifier & ~overlap).alias("has_identifier"),
        F.bool_or(address & ~overlap).alias("has_endpoint"),
        F.bool_or(secret).alias("has_secret"),
        F.bool_or(secret & ~F.col("p.inside")).alias("has_free"),
        F.bool_or("w.inside").alias("inside"),
        F.bool_or(F.col("p.strong") & overlap).alias("covered"),
    )
    complete = (
        F.when(F.col("kind") == "key", F.col("has_secret"))
        .when(F.col("kind") == "secret", F.col("has_identifier") | (F.col("has_endpoint") & ~F.col("inside")))
        .otherwise(F.col("has_free") | (F.col("has_identifier") & F.col("has_secret")))
    )
    return beside.filter(complete & ~F.col("covered")).select("rid", "kind", "start", "end")


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, digest, spans) per row of `df`: spans array<struct<start, rank, kind, end>> by start, then
    by kind as in KINDS; positions are code points, the end is exclusive.

    Null texts are empty; rows that repeat are scanned each by itself; other columns are ignored; an empty
    table gives an empty one. `digest` is the SHA-256 of texts that may hold a span, else null.
    """
    measured = lengths(df, id_column, text_column)
    positions = _positions(measured)
    strong = F.col("kind").isin(*BASE) & (F.col("value") >= _least())
    # A failing assignment is a weak secret; another failing match is nothing.
    kind = F.when((F.col("kind") == "assign") & ~strong, F.lit("secret")).otherwise(F.col("kind"))
    parts = positions.withColumns({"strong": strong, "renamed": kind}).filter(
        "strong OR kind = 'assign' OR kind IN ('key', 'secret', 'endpoint')"
    )
    opaque = (F.col("kind") == "secret").alias("opaque")
    parts = materialize(parts.select("rid", F.col("renamed").alias("kind"), "start", "end", "strong", opaque), "secret-parts")
    parts = materialize(settled(parts), "secret-settled")
    base = parts.filter("strong").select("rid", "kind", "start", "end")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = (
        base.unionByName(linked_parts(parts))
        .groupBy("rid")
        .agg(F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    )
    none = F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,end:bigint>>")
    return measured.select("rid", "id", "digest").join(spans, "rid", "left").select(
        F.col("id").alias(id_column), "digest", F.coalesce("spans", none).alias("spans")
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts per kind, the hash of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        id_column,
        *[count(k) for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`df` with every span of `scan` replaced by its kind in brackets; overlapping spans become one.

    Columns, whatever their names, their order and rows without a span stay as they are; null and empty texts
    have no span, repeated rows are replaced alike. Whether a row may hold a span is tested once and written with it; only
    those that may take part in the join.
    """
    # Rows travel as one struct, so that no column of theirs meets one of the scan.
    whole = F.col(text_column).cast("string")
    rows = materialize(
        df.select(F.struct("*").alias("row"), F.coalesce(suspicious(whole), F.lit(False)).alias("may")), "redact-rows"
    )
    some = rows.filter("may").select(
        "row", F.col("row")[id_column].alias("row_id"), F.col("row")[text_column].cast("string").alias("row_text")
    )
    findings = (
        scan(some.select("row_id", "row_text"), "row_id", "row_text")
        .filter(F.size("spans") > 0)
        .groupBy(F.col("row_id").alias("found_id"), F.col("digest").alias("found_digest"))
        .agg(F.first("spans").alias("spans"))
    )
    text = F.col("row_text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("pos"))

    def step(done: Column, s: Column) -> Column:
        kept = F.substring(text, done["pos"] + 1, F.greatest(s["start"] - done["pos"], F.lit(0)))
        longer = F.struct(F.concat(done["out"], kept, F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("pos"))
        return F.when(s["end"] <= done["pos"], done).when(
            s["start"] < done["pos"], F.struct(done["out"].alias("out"), s["end"].alias("pos"))
        ).otherwise(longer)

    rest = lambda done: F.concat(done["out"], F.substring(text, done["pos"] + 1, F.char_length(text)))
    clean = F.when(F.col("spans").isNotNull(), F.aggregate("spans", start, step, rest)).otherwise(text).alias(text_column)
    marked = (
        some.withColumn("row_digest", F.sha2("row_text", 256))
        .join(findings, F.col("row_id").eqNullSafe(F.col("found_id")) & (F.col("row_digest") == F.col("found_digest")), "left")
        .select(*[clean if c == text_column else F.col("row")[c].alias(c) for c in df.columns])
    )
    return rows.filter("NOT may").select("row.*").unionByName(marked)
