"""Helpers shared by the training-data operators: texts, seeded numbers, ranks, components and dropping rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.prefix import global_rank
from waymark.session import Scratch, shuffles_cleared  # noqa: F401

#: Characters that separate words in size counts, as a character class body.
SPACE = r"\x20\x09-\x0D"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs without the separators in ``SPACE``."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def seeded(*parts: Column | str) -> Column:
    """A non-negative long from md5, the same in every SQL engine; nulls count as empty text."""
    text = F.concat_ws("|", *[F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def dense_ranks(scratch: Scratch, rows: DataFrame, order: list[str], rank: str, name: str) -> DataFrame:
    """The distinct ``rows`` with their 0-based ``rank`` in the given order, numbered without a single-partition sort."""
    return global_rank(scratch, rows, list(order), name).withColumnRenamed("rank", rank)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcasting if it has at most ``rows`` rows; a join by shuffling remains the way beyond that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, comp) of the nodes in ``links`` (x, y): the smallest node of each connected component.

    Each round, every component hooks to its smallest neighbour if that is smaller, chains of hooks are halved until they
    are flat, and links inside a component go. Components at least halve a round. Tables go once their last reader is written.
    """
    edges = scratch.save(links.where("x <> y").select("x", "y"), f"edges_{name}0")
    labels = scratch.save(edges.select(F.col("x").alias("node")).union(edges.select("y")).distinct().withColumn("comp", F.col("node")), f"labels_{name}0")
    k = 0
    while not edges.isEmpty():
        k += 1
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        last = f"hooks_{name}{k}"
        hooks = scratch.save(both.groupBy("x").agg(F.min("y").alias("up")).select(F.col("x").alias("c"), F.least("x", "up").alias("up")), last)
        j, moving = 0, True
        while moving:
            above = hooks.select(F.col("c").alias("up"), F.col("up").alias("_up"))
            further = hooks.join(above, "up").select("c", F.col("_up").alias("new"), (F.col("_up") != F.col("up")).alias("moved"))
            j += 1
            further = scratch.save(further, f"hooks_{name}{k}_{j}")
            scratch.drop(last)
            last, hooks = f"hooks_{name}{k}_{j}", further.select("c", F.col("new").alias("up"))
            moving = not further.where("moved").isEmpty()
        to = hooks.select(F.col("c").alias("comp"), F.col("up").alias("_up"))
        labels = scratch.save(labels.join(to, "comp", "left").select("node", F.coalesce("_up", "comp").alias("comp")), f"labels_{name}{k}")
        x, y = hooks.withColumnsRenamed({"c": "x", "up": "_x"}), hooks.withColumnsRenamed({"c": "y", "up": "_y"})
        edges = edges.join(x, "x").join(y, "y").where("_x <> _y")
        edges = scratch.save(edges.select(F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y")).distinct(), f"edges_{name}{k}")
        scratch.drop(last, f"labels_{name}{k - 1}", f"edges_{name}{k - 1}")
    scratch.drop(f"edges_{name}{k}")
    return labels


def drop_rows(scratch: Scratch, docs: DataFrame, keys: dict[str, Column], lost: DataFrame, again: DataFrame, broadcast_keys: int = 400_000) -> DataFrame:
    """``docs`` without the rows whose keys are in ``lost``, and with one row of each key in ``again``."""
    names = list(keys)
    mark = {f"_k{i}": k for i, k in enumerate(keys.values())}
    lost, again = (scratch.save(d.select(*[F.col(n).alias(f"_r{i}") for i, n in enumerate(names)]).distinct(), t) for d, t in ((lost, "lost"), (again, "again")))
    keyed = docs.withColumns(mark)

    def on(left: DataFrame, right: DataFrame) -> Column:
        out = F.lit(True)
        for i in range(len(names)):
            out = out & left[f"_k{i}"].eqNullSafe(right[f"_r{i}"])
        return out

    lost = small(lost, broadcast_keys)
    kept = keyed.join(lost, on(keyed, lost), "left_anti")
    if not again.isEmpty():
        again = small(again, broadcast_keys)
        once = kept.join(again, on(kept, again), "left_anti")
        kept = once.unionByName(kept.join(again, on(kept, again), "left_semi").dropDuplicates(list(mark)))
    return kept.drop(*mark)
