"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 52-bit hash. A source's tokens are summed by leading hash bits; the buckets below the
one in which the running sum passes the budget are taken whole, and only the documents of that boundary bucket
are summed again, by the next bits. What results is one threshold per source, and the mix is a filter on the
hash: no document is sorted, and a larger budget takes a superset. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpus_spark.session import materialize

WEIGHTS = (5, 2, 1)
BUDGET = 1.5  # of all sizes
MOST = 2  # times a source's size, and a document's
LEVELS, LEVEL_BITS, HASH_BITS = 4, 13, 52
WORD = "[^\\x20\\x09-\\x0D]+"


def _fill(sources: DataFrame) -> DataFrame:
    """Adds `target`: shares of the budget by weight, none above MOST times its source's size, and the
    excess of those reshared by weight until none is above.

    The level of the others only rises as sources reach their limit, so each round is one sum over the
    sources and needs no order; rounds end when no further source is full.
    """
    limit = F.col("source_size") * MOST
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:
        filled = (limit <= F.lit(level) * F.col("weight")) if full is not None else F.lit(False)
        n, held, weights = sources.agg(
            F.count_if(filled),
            F.coalesce(F.sum(F.when(filled, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~filled, F.col("weight"))), F.lit(0)),
        ).first()
        if n == full or not weights:
            break
        full, level = n, (total * BUDGET - held) / weights
    return sources.withColumn("target", F.least(limit.cast("double"), F.lit(float(level)) * F.col("weight")))


def _thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below): documents whose hash is less than `below` come as near to the budget of their source as
    whole documents allow; the one in which the running sum passes it is taken where the sum ends nearer with it."""
    state = budgets.select(
        "source", F.col("budget").alias("left"), F.lit(0).cast("bigint").alias("prefix"), F.lit(False).alias("nearer")
    )
    for level in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        bucket = F.shiftright("hash", shift)
        # Only the boundary bucket of the level before is looked at again.
        inside = sized.join(state, sized["source"].eqNullSafe(state["source"])).filter(
            F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")
        )
        sums = inside.groupBy(sized["source"].alias("source"), bucket.alias("bucket")).agg(
            F.sum("size").alias("held"), F.first("left").alias("left")
        )
        order = W.partitionBy("source").orderBy("bucket")  # 2 ** LEVEL_BITS sums per source
        running = sums.withColumn("through", F.sum("held").over(order.rowsBetween(W.unboundedPreceding, 0)))
        passed = running.filter("through > left").groupBy("source").agg(F.min_by(
            F.struct("bucket", (F.col("left") - F.col("through") + F.col("held")).alias("left"), "held"), "bucket").alias("at"))
        state = (
            state.alias("s")
            .join(passed.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")), "left")
            .select(
                "s.source",
                F.coalesce("p.at.left", "s.left").alias("left"),
                # Nothing passes where the budget holds all that is left: then the next prefix is the end.
                F.coalesce(
                    "p.at.bucket", F.shiftleft(F.col("s.prefix") + 1, LEVEL_BITS)
                ).alias("prefix"),
                F.coalesce(F.col("p.at.held") < 2 * F.col("p.at.left"), F.lit(False)).alias("nearer"),
            )
        )
        state = materialize(state, "mix-thresholds")
    return state.select("source", (F.col("prefix") + F.col("nearer").cast("bigint")).alias("below"))


def _hash(id_column: str):
    digits = F.substring(F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("null"))), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint")


def _size(text_column: str):
    return F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("bigint")


def plan(df: DataFrame, id_column: str, source_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """The sized rows (id, source, size, hash), written, and a row per source (plan_source, source_size, target,
    passes, below): documents are taken `passes` times, and once more with a hash below `below`."""
    sized = materialize(
        df.select(
            F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"), _size(text_column).alias("size")
        ).withColumn("hash", _hash("id")),
        "mix-sizes",
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))  # one row per source
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = sizes.withColumn("weight", F.element_at(weights, (F.pmod(place - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    targets = materialize(_fill(materialize(ranked, "mix-sources")), "mix-targets")
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    budgets = targets.withColumn("passes", whole).withColumn(
        "budget", F.col("target") - F.col("passes") * F.col("source_size")
    )
    below = _thresholds(sized, budgets)
    per_source = budgets.alias("b").join(below.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    return sized, per_source.select(
        F.col("b.source").alias("plan_source"), "source_size", "target", "passes", "below"
    )


def _times():
    # A source that is taken MOST times has no budget left, not even for documents without words.
    more = (F.col("passes") < MOST) & (F.col("hash") < F.col("below"))
    return (F.col("passes") + F.when(more, 1).otherwise(0)).cast("int")


def mix(
    df: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text"
) -> DataFrame:
    """(id_column, size, source_size, target, taken) per row of `df`.

    `size` counts the runs of non-space in the text (null: 0). Sources in the order of their code points, null
    last, weigh 5, 2, 1 and so on again. `taken` is 0, 1 or 2 times `size`: as many whole passes as the target
    holds, and one more for documents under the source's threshold. Rows of one id share a hash, so
    they are taken together; a null id is one id. A source without words has target 0. Other columns are ignored; an
    empty table gives an empty one.
    """
    sized, per_source = plan(df, id_column, source_column, text_column)
    return sized.join(per_source, F.col("source").eqNullSafe(F.col("plan_source"))).select(
        F.col("id").alias(id_column),
        "size",
        "source_size",
        "target",
        (F.col("size") * _times()).cast("bigint").alias("taken"),
    )


def mixed(
    df: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text"
) -> DataFrame:
    """The rows of `df` that `mix` takes, as often as it takes them (MOST times at most), with the same columns.

    Columns may have any names; an empty table gives an empty one.
    """
    _, per_source = plan(df, id_column, source_column, text_column)
    # Rows travel as one struct, so that no column of theirs meets one of the plan.
    rows = df.select(
        F.struct("*").alias("row"), F.col(source_column).cast("string").alias("row_source"), _hash(id_column).alias("hash")
    )
    return (
        rows.join(
            per_source.select("plan_source", "passes", "below"), F.col("row_source").eqNullSafe(F.col("plan_source"))
        )
        .select("row", F.explode(F.array_repeat(F.lit(True), _times())))
        .select("row.*")
    )
