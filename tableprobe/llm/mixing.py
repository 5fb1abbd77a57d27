"""A mix of sources by target weights.

Sources, in order of code points and null last, have the weights 5, 2, 1, 5, 2, 1, ... and share the total size of all rows. No source gets
more than `most` times its own size; what it cannot use is shared by weight among the others until none is above.
Within a source, every complete epoch its target holds takes all rows once. The rest of the target is filled with rows in the
order of Efraimidis-Spirakis keys, -ln(u) / weight with u drawn from a hash of the id, up to the budget; the row that
crosses it is taken if that comes nearer to the target.

Cases: null and empty texts have size 0 and are never taken. A missing or non-positive weight counts as 1; weights are
held to 0.1 to 10. Ties of the key fall back on id and size, and rows equal in these are interchangeable. A row without an id has the hash of ''.

Scale: there is no window over a source. Keys are cut into bins, more for larger sources, with 1,000 rows on average (and at most
16 times that by the bound on weights); sizes are summed per bin first, prefix sums run over the bins, then within each bin.
Only the rows' id, source, size and key are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprobe.llm.common import prepare, saved

WORD = r"[^\x20\x09-\x0D]+"
#: The weights of the sources in turn.
WEIGHTS = (5, 2, 1)
_BIN, _LEAST, _MOST = 1_000, 0.1, 10.0
#: Weights whose keys the bins suit; every weight is less than 3.2 times the next lower one of these.
_RATES = (0.1, 0.316, 1.0, 3.16, 10.0)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_column: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of an id."""
    digits = F.conv(F.substring(F.md5(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """`target` and `weight` for every row (source, total); one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (turn + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("limit", F.lit(most) * F.col("total"))
    rows = rows.withColumn("ratio", F.col("limit") / F.col("weight"))
    # sources that reach their limit are those of the smallest ratios; the level of the others is the highest met
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("total").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    level = F.max("level").over(everything)
    return rows.withColumn("target", F.least(F.col("limit"), level * F.col("weight"))).select("source", "total", "weight", "target")


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", most: float = 3.0
) -> DataFrame:
    """For every row of `docs`: the id, source, size, source_size, source_weight, target, epochs (times taken) and taken (words).

    `weights` has one row (`id`, `weight`) for each id that has a weight.
    """
    prepare(docs.sparkSession)
    id_ = docs[f"`{id_column}`"]
    rows = docs.select(
        id_.alias("id"),
        docs[f"`{source_column}`"].alias("source"),
        size_of(docs[f"`{text_column}`"]).alias("size"),
    )
    quality = F.lit(1.0)
    if weights is not None:
        weights = weights.select(F.col("id").alias("of"), F.col("weight").cast("double").alias("weight"))
        rows = rows.join(weights, F.col("id") == F.col("of"), "left")
        quality = F.when(F.col("weight") > 0, F.least(F.greatest("weight", F.lit(_LEAST)), F.lit(_MOST))).otherwise(1.0)
    rows = saved(rows.select("id", "source", "size", (-F.log(uniform(F.col("id"))) / quality).alias("key")), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    plan = targets(sources, most).join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    full = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total") + 1e-9)).otherwise(0)
    plan = plan.withColumn("full", full).withColumn("rest", F.greatest(F.col("target") - F.col("full") * F.col("total"), F.lit(0.0)))
    plan = saved(plan.withColumn("bins", F.ceil(F.col("n") / _BIN)).withColumnRenamed("source", "of"), "mix-plan")
    # a monotone map of the key to bins: the mean of the distributions that keys of the rates have
    share = sum(1 - F.exp(-rate * F.col("key")) for rate in _RATES) / len(_RATES)
    binned = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    binned = binned.withColumn("bin", F.least(F.floor(share * F.col("bins")), F.col("bins") - 1))
    sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("bin").alias("b"), F.coalesce(F.sum("in_bin").over(earlier), F.lit(0)).alias("offset"))
    placed = binned.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("b"))).drop("of", "b")
    within = Window.partitionBy("source", "bin").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = placed.withColumn("before", before)
    over = F.col("before") + F.col("size") - F.col("rest")
    partly = (F.col("before") < F.col("rest")) & ((over <= 0) | (over < F.col("rest") - F.col("before")))
    epochs = F.when(F.col("size") > 0, F.col("full") + F.when(partly, 1).otherwise(0)).otherwise(0).cast("long")
    return placed.select(
        F.col("id").alias(id_column), F.col("source").alias(source_column), "size", F.col("total").alias("source_size"), F.col("weight").alias("source_weight"), "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken")
    )
