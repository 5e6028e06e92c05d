"""Ordered positions and running sums over whole tables without a single-partition sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.session import Scratch

#: Low bits of ``monotonically_increasing_id`` that number the rows of one partition.
_ROW_BITS = 33


def _dealt(scratch: Scratch, df: DataFrame, order: list[Column | str], name: str, least_parts: int, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` (or what ``then`` makes of it) written in the given order over range partitions, with ``_p`` (the partition) and ``_i`` (the row in it)."""
    parts = max(1, least_parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = then(dealt) if then else dealt
    table = scratch.save(dealt.withColumn("_m", F.monotonically_increasing_id()), name)
    return table.withColumn("_p", F.shiftright("_m", _ROW_BITS)).withColumn("_i", F.col("_m").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_m")


def _offsets(scratch: Scratch, table: DataFrame, amount: Column, name: str) -> DataFrame:
    """(_p, _o): what the partitions before hold together; one row a partition, so it is summed in one task and broadcast."""
    w = Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.groupBy("_p").agg(amount.alias("_n"))
    return F.broadcast(scratch.save(sizes.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_o")).coalesce(1), f"{name}_offsets"))


def global_rank(
    scratch: Scratch, df: DataFrame, order: list[Column | str], name: str, least_parts: int = 1, then: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Add ``rank`` (0-based, dense over the whole table) in the given order. With ``then``, rows are sorted first, ``then``
    makes others of them within their partitions (it mustn't shuffle), and those are ranked as they come out.

    Rows are range-partitioned and sorted; the per-partition counts (one row a partition) give the offsets. The order
    has to end in columns that tell rows apart, or rows that are alike share a partition and are numbered arbitrarily.
    """
    table = _dealt(scratch, df, order, name, least_parts, then)
    joined = table.join(_offsets(scratch, table, F.count("*"), name), "_p")
    return joined.withColumn("rank", F.col("_o") + F.col("_i")).drop("_p", "_o", "_i")


def prefix_sums(df: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows with a smaller ``key``, which must be unique and may be sparse."""
    scratch = Scratch(df.sparkSession)
    table = _dealt(scratch, df.withColumn("_v", value), [key], "dealt", 1)
    inside = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    joined = table.withColumn("_s", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(_offsets(scratch, table, F.sum("_v"), "dealt"), "_p")
    return joined.withColumn(out, F.col("_o") + F.col("_s")).drop("_p", "_i", "_v", "_s", "_o")


def dense_index(keys: DataFrame, key: str, out: str) -> DataFrame:
    """0-based position of each unique ``key`` in ascending order."""
    return global_rank(Scratch(keys.sparkSession), keys, [key], "keys").withColumnRenamed("rank", out)


def rank_in_group(scratch: Scratch, df: DataFrame, group: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Add ``place`` (0-based) in each group and ``n`` (its rows): groups of any size are split over tasks."""
    ranked = global_rank(scratch, df, [*group, *order], name)
    g = ranked.groupBy(*group).agg(F.min("rank").alias("_first"), F.count("*").alias("n"))
    right = g.select(F.struct(*group).alias("_g"), "_first", "n")
    return ranked.join(right, F.struct(*group).eqNullSafe(F.col("_g"))).withColumn("place", F.col("rank") - F.col("_first")).drop("_g", "_first", "rank")


def carried(df: DataFrame, key: str, order: list[str], folds: dict[str, tuple[str, Column]], own: bool) -> DataFrame:
    """Add each name in ``folds``: what the rows of the same key up to this one (``own``), or before it, come to in order.

    A fold is "max", "sum" or "last" (the last value that is not null) and a value; null where there is none. Null keys
    are a key as any other. Rows are dealt to range partitions, so a key of any size is split over tasks; what a partition
    holds of a key is one row, and those rows are carried on from partition to partition.
    """
    scratch = Scratch(df.sparkSession)
    table = _dealt(scratch, df.withColumns({f"_f{i}": value for i, (_, value) in enumerate(folds.values())}), [key, *order], "dealt", 1)
    here = Window.partitionBy("_p", key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    ahead = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    hows = [how for how, _ in folds.values()]
    told = {"max": lambda c: F.max(c), "sum": lambda c: F.sum(c), "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("_i")))}
    running = {"max": lambda c: F.max(c), "sum": lambda c: F.sum(c), "last": lambda c: F.last(c, ignorenulls=True)}
    both = {
        "max": lambda now, before: F.greatest(now, before),
        "sum": lambda now, before: F.coalesce(now + before, now, before),
        "last": lambda now, before: F.coalesce(now, before),
    }
    marks = table.groupBy(F.col("_p").alias("_part"), F.col(key).alias("_key")).agg(*[told[how](F.col(f"_f{i}")).alias(f"_f{i}") for i, how in enumerate(hows)])
    marks = marks.select("_part", "_key", *[running[how](F.col(f"_f{i}")).over(ahead).alias(f"_b{i}") for i, how in enumerate(hows)])
    inside = table.withColumns({f"_r{i}": running[how](F.col(f"_f{i}")).over(here) for i, how in enumerate(hows)})
    joined = inside.join(marks, (F.col("_p") == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key")))
    out = [both[how](F.col(f"_r{i}"), F.col(f"_b{i}")).alias(name) for i, (name, how) in enumerate(zip(folds, hows, strict=True))]
    return joined.select(*df.columns, *out)


def composed(df: DataFrame, key: str, order: list[str], step: Column, initial: int, out: str) -> DataFrame:
    """Add ``out``: where the rows of each key lead, in order, from the state ``initial``. ``step`` is a row's map, an array of the next state for each.

    Maps are composed by doubling, first inside range partitions and then over the partitions of a key, one row each: n
    rows take log2(n) windows, and a key of any size is split over tasks. Null keys are a key as any other.
    """
    scratch = Scratch(df.sparkSession)
    table = _dealt(scratch, df.withColumn("_map", step), [key, *order], "dealt", 1).withColumn("_key", F.col(key))

    def doubled(rows: DataFrame, group: list[str], at: str) -> DataFrame:
        w, span = Window.partitionBy(*group).orderBy(at), 1
        longest = rows.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        while span < longest:
            rows = rows.withColumn("_before", F.lag("_map", span).over(w))
            after = F.transform("_before", lambda i: F.get(F.col("_map"), i))
            rows = rows.withColumn("_map", F.when(F.col("_before").isNull(), F.col("_map")).otherwise(after)).drop("_before")
            span *= 2
        return rows

    inside = doubled(table, ["_p", "_key"], "_i")
    marks = scratch.save(inside.groupBy("_p", "_key").agg(F.max_by("_map", "_i").alias("_map")), "marks")
    start = F.lag("_map").over(Window.partitionBy("_k").orderBy("_part"))[initial]
    marks = doubled(marks, ["_key"], "_p").select(F.col("_p").alias("_part"), F.col("_key").alias("_k"), "_map")
    marks = marks.select("_part", "_k", F.coalesce(start, F.lit(initial)).alias("_start"))
    joined = inside.join(marks, (F.col("_p") == F.col("_part")) & F.col("_key").eqNullSafe(F.col("_k")))
    return joined.select(*df.columns, F.get("_map", F.col("_start")).alias(out))
