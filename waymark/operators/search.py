"""Ranked search over names: a trigram index finds candidates, tiers and lengths rank them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions import text


def index(records: DataFrame) -> DataFrame:
    """Records (id, display, subtitle) with their normal forms ``shown`` and ``all``."""
    return records.withColumn("shown", text.normal_form(F.col("display"))).withColumn("all", text.normal_form(F.concat_ws(" ", "display", F.coalesce("subtitle", F.lit("")))))


def postings(indexed: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(g, id, visible): each record's trigrams, and pieces of one and two letters for short queries; whether the visible text has them.

    With ``of`` (g, few), only those pieces: one lies inside a word where the text, whose words have spaces between, contains it.
    """
    if of is not None:
        return indexed.join(F.broadcast(of), F.contains(F.col("all"), F.col("g"))).select("g", "id", F.contains(F.col("shown"), F.col("g")).alias("visible"))
    grams = lambda c: F.concat(text.trigrams(F.col(c)), _pieces(F.col(c)))
    told = lambda c, seen: F.transform(c, lambda g: F.struct(g.alias("g"), F.lit(seen).alias("visible")))
    rows = indexed.select("id", grams("shown").alias("_v"), grams("all").alias("_a"))  # all words of the visible text are among all words
    return rows.select("id", F.explode(F.concat(told(F.col("_v"), True), told(F.array_except("_a", "_v"), False))).alias("p")).select("p.g", "id", "p.visible")


def looked_up(queries: DataFrame) -> DataFrame:
    """(g): the pieces that ``search`` asks the postings for."""
    q = queries.select(text.normal_form(F.col("query")).alias("q")).where("q <> ''")
    grams = q.select("q", text.trigrams(F.col("q")).alias("g"))
    return grams.select(F.explode(F.when(F.size("g") > 0, F.col("g")).otherwise(F.array(_longest(F.col("q"))))).alias("g")).distinct()


def _longest(normal: Column) -> Column:
    return F.array_max(F.transform(text.words(normal), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def _pieces(normal: Column) -> Column:
    """Distinct runs of one and two letters inside words."""
    runs = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substr(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(text.words(normal), lambda w: F.concat(runs(w, 1), runs(w, 2)))))


def search(indexed: DataFrame, posted: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """(query, rank, id, tier): the k best records of each query, by tier, excess length, visible length and id.

    Of a query's trigrams the rarest drives: every match has it, so its posting list holds all candidates, and only those
    are compared. A query without a trigram (all words below three letters) looks its longest word up among the posted
    pieces of one and two letters instead. Each task keeps the k best of a query before they meet in one.
    """
    q = queries.select("query", text.normal_form(F.col("query")).alias("q")).where("q <> ''").distinct()
    grams = q.select("query", "q", F.explode_outer(text.trigrams(F.col("q"))).alias("g"))
    often = posted.join(grams.where("g IS NOT NULL").select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count("*").alias("n"))
    driver = grams.join(often, "g", "left").groupBy("query", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("d"))
    driver = driver.select("query", "q", "d.g")
    listed = driver.withColumn("g", F.coalesce("g", _longest(F.col("q")))).join(posted.select("g", "id"), "g").select("query", "q", "id").join(indexed, "id")
    tier = text.match_tier(F.col("q"), F.col("shown"), F.col("all"))
    scored = listed.withColumn("tier", tier).where("tier IS NOT NULL")
    excess = F.greatest(F.lit(0), F.length("shown") - F.length("q"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("tier", excess, F.length("display"), "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query", "rank", "id", "tier")


def distinct_join(*parts: Column) -> Column:
    """Non-blank parts in order, each once, with spaces between."""
    trimmed = F.transform(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), lambda p: F.trim(p))
    return F.array_join(F.array_distinct(F.filter(trimmed, lambda p: p != "")), " ")
