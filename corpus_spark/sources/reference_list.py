"""The external reference list: one JSON object keyed by package.

One object is one value to a JSON reader, so a large list would be one task's work. Here it is read at its commas, in Spark's own splits
of the file: whether a split begins inside of a string, and how deep, follows from what all splits before it do to a reader that
begins outside of one or inside (a scan over one row per split). Commas at depth one then part the entries, and an entry
that crosses splits is put together from its pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.session import materialize

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_BRACKET = re.compile(r"[\[\]{}]")
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)


class ReferenceListError(RuntimeError):
    """The file cannot be trusted as a list, and treating nothing as listed would be worse."""


def entry_fields(value: Column) -> dict[str, Column]:
    """The anchor fields of one entry (a variant); a field of the wrong type is lost, the entry's
    key stays."""

    def text(field: str) -> Column:
        got = F.try_variant_get(value, f"$.{field}", "variant")
        return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(value, f"$.{field}", "string"))

    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return {
        "list": F.when(is_object, text("list")),
        "removal": F.when(is_object, text("removal")),
        "description": F.when(is_object, F.coalesce(text("description"), F.lit(""))),
    }


def entries(rows: DataFrame) -> DataFrame:
    """(package, value JSON text) to (package, list, removal, description). Where the source is too
    large for one JSON object, it comes as one row per entry and is read here in parallel."""
    parsed = rows.withColumn("v", F.try_parse_json("value"))
    return parsed.select("package", *[c.alias(n) for n, c in entry_fields(F.col("v")).items()])


def _outside(fragment: str, inside: bool) -> tuple[str, bool]:
    """(what of a fragment lies outside of strings, whether it ends inside of one)."""
    if inside:
        end = _STRING_END.match(fragment)
        if not end:
            return "", True
        fragment = fragment[end.end() :]
    bare, quote, _ = _STRING.sub("", fragment).partition('"')
    return bare, bool(quote)


def _deeper(bare: str) -> int:
    return bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")


def _ends_well(bare: str, depth: int) -> bool:
    """Whether nothing but blanks follows where the depth falls to zero."""
    if bare.count("}") + bare.count("]") < depth:
        return True
    for bracket in _BRACKET.finditer(bare):
        depth += 1 if bracket[0] in "{[" else -1
        if depth <= 0:
            return not bare[bracket.end() :].strip(" \t\r\n")
    return True


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each split does to a reader: (block, inside at its start, inside at its end, how much deeper)."""
    state: dict[tuple[int, bool], tuple[bool, int]] = {}
    for batch in batches:
        for block, fragment in zip(batch["block"], batch["fragment"], strict=True):
            for start in (False, True):
                inside, depth = state.get((block, start), (start, 0))
                bare, inside = _outside(fragment, inside)
                state[block, start] = inside, depth + _deeper(bare)
    rows = [(int(block), start, inside, depth) for (block, start), (inside, depth) in state.items()]
    yield pd.DataFrame(rows, columns=["block", "start", "inside", "deeper"])


def _pieces(starts: dict[int, tuple[bool, int]]):
    """Runs of fragments between commas of depth one: (block, number in it, text, whether the comma after it is such a one,
    whether it keeps inside of the object)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for batch in batches:
            out = []
            for block, fragment in zip(batch["block"], batch["fragment"], strict=True):
                if block != at:
                    if at is not None and held:
                        out.append((at, number, ",".join(held), False, sound))
                    at, number, held, sound = block, 0, [], True
                    inside, depth = starts[int(block)]
                bare, inside = _outside(fragment, inside)
                before, depth = depth, depth + _deeper(bare)
                sound &= (before > 0 or block == 0 and number == 0 and not held) and _ends_well(bare, before)
                held.append(fragment)
                if depth == 1 and not inside:
                    out.append((at, number, ",".join(held), True, sound))
                    number, held, sound = number + 1, [], True
            yield pd.DataFrame(out, columns=["block", "number", "text", "closed", "sound"])
        if at is not None and held:
            yield pd.DataFrame([(at, number, ",".join(held), False, sound)], columns=["block", "number", "text", "closed", "sound"])

    return cut


def split_entries(spark: SparkSession, path: str) -> DataFrame:
    """(place, package, v) of every entry of one JSON object, in as many tasks as the file has splits; `v` is a variant.

    A file that is not one sound JSON object is refused. An entry that is no single sound pair of a name and a value is, too.
    """
    text = spark.read.option("lineSep", ",").text(path)
    fragments = text.select(F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("fragment"))
    if fragments.filter(~F.is_valid_utf8("fragment")).limit(1).count():
        raise ReferenceListError(f"{path} is not UTF-8")
    effects: dict[int, dict[bool, tuple[bool, int]]] = {}
    # Two rows per split of one file.
    for r in fragments.mapInPandas(_effects, "block bigint, start boolean, inside boolean, deeper bigint").collect():
        effects.setdefault(r["block"], {})[r["start"]] = r["inside"], r["deeper"]
    starts, inside, depth = {}, False, 0
    for block in sorted(effects):
        starts[block] = inside, depth
        inside, more = effects[block][inside]
        depth += more
    if inside or depth != 0 or not effects:
        raise ReferenceListError(f"{path} is not a JSON object")
    pieces = materialize(
        fragments.mapInPandas(_pieces(starts), "block bigint, number bigint, text string, closed boolean, sound boolean"), "list-pieces"
    )
    # Which block a split's first piece goes on from, where the comma before the split parts no entries: one row per split.
    last = F.max_by(F.struct("number", "closed"), "number").alias("last")
    owner, owners, open_before = 0, {}, False
    for r in pieces.groupBy("block").agg(last).orderBy("block").collect():
        owners[r["block"]] = owner if open_before else r["block"]
        begins_here = r["last"]["number"] > 0 or not open_before
        owner = (r["block"] if begins_here else owner)
        open_before = not r["last"]["closed"]
    firsts = spark.createDataFrame(list(owners.items()), "block bigint, owner bigint")
    goes_on = (F.col("number") == 0) & (F.col("owner") != F.col("block"))
    # A piece that goes on belongs to the last entry that its owner begins.
    named = pieces.join(F.broadcast(firsts), "block").withColumn("of", F.when(goes_on, F.col("owner")).otherwise(F.col("block")))
    crossing = goes_on | ~F.col("closed")
    joined = (
        named.filter(crossing)
        .groupBy("of")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "number", "text"))), lambda x: x["text"]), ",").alias("text"),
            F.max("number").alias("number"),
            F.bool_and("sound").alias("sound"),
        )
    )
    whole = named.filter(~crossing).select("of", "text", "number", "sound").unionByName(joined)
    place = F.struct(F.col("of").alias("block"), "number")
    bounds = whole.agg(F.min(place).alias("first"), F.max(place).alias("last")).first()
    is_first, is_last = ((F.col("of") == bounds[b]["block"]) & (F.col("number") == bounds[b]["number"]) for b in ("first", "last"))
    # The object's own braces stand before the first entry and behind the last.
    space = "[\\x20\\t\\n\\r]*"
    opened = F.when(is_first, F.regexp_replace("text", f"^\\uFEFF?{space}\\{{", "")).otherwise(F.col("text"))
    bare = F.when(is_last, F.regexp_replace(opened, f"\\}}{space}$", "")).otherwise(opened)
    fair = F.col("sound") & (~is_first | F.col("text").rlike(f"^\\uFEFF?{space}\\{{")) & (~is_last | F.col("text").rlike(f"\\}}{space}$"))
    parsed = whole.select(place.alias("place"), F.when(fair, F.try_parse_json(F.concat(F.lit("{"), bare, F.lit("}")))).alias("v"), bare.alias("bare"))
    pair = parsed.withColumn("pair", F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")))
    return materialize(
        pair.select("place", "bare", F.size("pair").alias("pairs"), F.get("pair", F.lit(0))["key"].alias("package"), F.get("pair", F.lit(0))["value"].alias("v")),
        "list-entries",
    )


def load_reference_list(spark: SparkSession, path: str, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, one provenance row) of a list file. A file that is no object, has no entry, or is
    larger than `max_bytes`, if that is given, is refused. Entries are read in the file's splits (see `split_entries`); a name that stands
    there twice counts with its last entry. Only the digest, whose algorithm takes bytes in sequence, is one task's work."""
    files = spark.read.format("binaryFile").load(path)
    sized = files.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length")).first()
    if sized["n"] != 1:
        raise ReferenceListError(f"{path} is not one file")
    if max_bytes is not None and sized["length"] > max_bytes:
        raise ReferenceListError(f"{path} is {sized['length']} bytes, which is no reference list")
    found = split_entries(spark, path)
    blank = F.trim(F.translate("bare", "\t\n\r", "   ")) == ""
    state = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("pairs") == 1, F.lit(False))).alias("odd"), F.count_if(blank).alias("blank")).first()
    if state["n"] == 1 and state["blank"] == 1:
        raise ReferenceListError(f"{path} has no entries")
    if state["odd"]:
        raise ReferenceListError(f"{path} is not a JSON object")
    single = found.groupBy("package").agg(F.max_by(F.struct("v"), "place").alias("r")).select("package", F.col("r.v").alias("v"))
    rows = single.select("package", *[c.alias(n) for n, c in entry_fields(F.col("v")).items()])
    digest = files.select("path", F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("obtained_at"))
    return rows, digest.withColumn("entry_count", F.lit(single.count()).cast("int"))


def with_provenance(verdicts: DataFrame, provenance: DataFrame) -> DataFrame:
    """Every verdict row with the bytes that decided it; the provenance is one row."""
    packed = provenance.select(F.struct(*[F.col(c) for c in provenance.columns])).scalar()
    return verdicts.withColumn("list_provenance", packed)
