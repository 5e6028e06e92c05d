"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources are ordered by code point (null last) and weigh as ``weights``, repeating. The mix asks for ``share`` of all
words; a source's target stops at ``cap`` times its words and the excess is shared again by weight. The mix is counted
in blocks of ``block_words`` words. Highest quotients deal the blocks to sources, and each source's blocks to its
shards, so that each shard has an integer quota. In a shard the documents stand in a seeded order, are cut into blocks,
and a seeded run of blocks (cyclic) is taken; a quota above the shard's number of blocks takes all blocks again first.

A null text has no words. A document without words is never taken. Rows that are alike are separate documents; shards and
the order in them go by id and text, so rows without an id or with the same one are dealt out as others are. An empty table gives an empty result. Only ``id_col``,
``source_col`` and ``text_col`` are read; other columns are carried along, whatever their names. A long text is measured
whole, and a part of it is cut out in one task.

Sources, one row each, are ranked in one task; shards and documents are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, Scratch, global_rank, seeded, text_or_empty, word_count

WEIGHTS, SHARE, CAP, BLOCK_WORDS, SHARD_WORDS, SEED = (3, 1, 2), 1.5, 2, 64, 1 << 18, "mix"
#: Divisors that a round of the apportionment counts at, and rounds.
POINTS, ROUNDS = 128, 3
#: Groups whose totals are broadcast at most; more are joined by shuffling.
BROADCAST_GROUPS = 100_000


def sainte_lague(scratch: Scratch, parties: DataFrame, group: list[str], key: Column, votes: str, total: str, limit: str, name: str) -> DataFrame:
    """Add ``seats``: the ``total`` seats of each group go to the highest quotients votes / (2 k + 1), k < limit.

    How many quotients reach a divisor is a sum over parties, so each round counts them at ``POINTS`` divisors at once and
    keeps the gap that holds the last seat. Then only the few quotients inside the gap are ordered, by range partitions
    over all groups. Sums go by partial aggregates, so a group of any size is split over tasks. Parties without votes get
    what others can't take.
    """
    keyed = parties.withColumn("_g", F.struct(*group) if group else F.struct(F.lit(0).alias("all"))).withColumn("_key", key)
    keyed = scratch.save(keyed.withColumn("_id", F.monotonically_increasing_id()), f"{name}_parties")

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:  # null is a group as any other
        right = right.withColumnRenamed("_g", "_r")
        return left.join(F.broadcast(right) if groups <= BROADCAST_GROUPS else right, left["_g"].eqNullSafe(right["_r"])).drop("_r")

    def reached(divisor: Column) -> Column:
        return F.least(F.floor((F.col(votes) / divisor + 1) / 2), F.col(limit)).cast("long")

    some = F.col(votes) > 0
    gaps = keyed.groupBy("_g").agg(
        (F.min(F.when(some, F.col(votes))) / (2 * F.max(limit) + 3)).alias("_lo"), (2.0 * F.max(votes)).alias("_hi"), F.first(total).alias("_seats"), F.coalesce(F.sum(F.when(some, F.col(limit))), F.lit(0)).alias("_most")
    )
    gaps, groups = scratch.save_counted(gaps, f"{name}_gaps0")
    for k in range(1, ROUNDS + 1):
        at = lambda j: F.col("_lo") * F.pow(F.col("_hi") / F.col("_lo"), j / POINTS)
        points = F.transform(F.sequence(F.lit(0), F.lit(POINTS)), at)
        tried = joined(keyed.where(some), gaps.withColumn("_points", points)).select("_g", F.posexplode(F.transform("_points", reached)).alias("_j", "_n"))
        counted = joined(tried.groupBy("_g", "_j").agg(F.sum("_n").alias("_n")), gaps).withColumn("_d", at(F.col("_j")))
        over = F.col("_n") > F.col("_seats")
        gap = counted.groupBy("_g").agg(F.coalesce(F.max(F.when(over, F.col("_d"))), F.min("_d")).alias("_lo"), F.coalesce(F.min(F.when(~over, F.col("_d"))), F.max("_d")).alias("_hi"), F.first("_seats").alias("_seats"), F.first("_most").alias("_most"))
        gaps = scratch.save(gap, f"{name}_gaps{k}")
        scratch.drop(f"{name}_gaps{k - 1}")
    # A hair outside the gap, so that rounding leaves no quotient between what is given and what is compared.
    bounds = joined(keyed, gaps).withColumn("_low", F.when(some, reached(F.col("_hi") * (1 + 1e-9))).otherwise(0))
    bounds = bounds.withColumn("_high", F.when(some, reached(F.col("_lo") * (1 - 1e-9))).otherwise(F.least(F.col(limit), F.greatest(F.lit(0), F.col("_seats") - F.col("_most")))))
    bounds = scratch.save(bounds.select("_g", "_id", "_key", votes, "_low", "_high", "_seats"), f"{name}_bounds")
    few = F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1))
    close = bounds.select("_g", "_id", "_key", votes, F.explode(few).alias("_k")).select("_g", "_id", "_key", (F.col(votes) / (2 * F.col("_k") + 1)).alias("_quotient"))
    ranked = global_rank(scratch, close, ["_g", F.col("_quotient").desc_nulls_last(), F.col("_key").asc_nulls_last()], f"{name}_quotients")
    left = bounds.groupBy("_g").agg((F.first("_seats") - F.sum("_low")).alias("_left"))
    ends = joined(ranked.groupBy("_g").agg(F.min("rank").alias("_first")), left).select("_g", (F.col("_first") + F.col("_left")).alias("_end"))
    won = joined(ranked, ends).where(F.col("rank") < F.col("_end")).groupBy("_id").agg(F.count("*").alias("_more"))
    given = bounds.select("_id", "_low").join(won, "_id", "left").select("_id", (F.col("_low") + F.coalesce("_more", F.lit(0))).cast("long").alias("seats"))
    return keyed.join(given, "_id", "left").select(*parties.columns, F.coalesce("seats", F.lit(0)).alias("seats"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: source, source_size, target. ``sizes`` has source and size; one row a source is ranked in one task."""
    every, by_source = Window.partitionBy(), Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("_n", F.row_number().over(by_source))
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_n") - 1) % len(weights) + 1))
    s = s.withColumn("_cap", F.col("source_size") * float(cap))
    # Sources reach their cap in the order of cap / weight: what is capped is a prefix of that order.
    before = Window.partitionBy().orderBy(F.col("_cap") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    capped, used = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("_cap", "_w"))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - capped) / (F.sum("_w").over(every) - used)
    s = s.withColumn("_level", level).withColumn("_place", F.row_number().over(Window.partitionBy().orderBy(F.col("_cap") / F.col("_w"), "_n")))
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct("_place", "_level"))
    s = s.withColumn("_level", F.min(fits).over(every)["_level"])
    return s.select("source", "source_size", F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.col("_cap")).alias("target"))


def _quotas(scratch: Scratch, measured: DataFrame, weights, share, cap, block_words: int, shard_words: int, seed: str) -> DataFrame:
    """Per (source, shard): source_size, target, shards, words, blocks, quota, start."""
    blocks = lambda words: F.ceil(words / block_words)
    s = source_targets(measured, weights, share, cap)
    s = s.withColumn("_total", F.floor(F.sum("target").over(Window.partitionBy()) / block_words + 0.5))
    s = s.withColumn("_limit", F.floor(cap * blocks(F.col("source_size"))))
    s = sainte_lague(scratch, s, [], F.col("source"), "target", "_total", "_limit", "by_source")
    s = s.withColumn("shards", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_words)))
    s = scratch.save(s.withColumnRenamed("seats", "source_blocks").drop("_total", "_limit"), "sources")
    shards = with_source(measured, s).withColumn("shard", _shard(seed))
    shards = shards.groupBy("source", "shard", "source_size", "target", "shards", "source_blocks").agg(F.sum("size").alias("words"))
    shards = shards.withColumn("blocks", blocks(F.col("words"))).withColumn("_limit", F.floor(cap * F.col("blocks")))
    quotas = sainte_lague(scratch, shards, ["source"], F.col("shard"), "words", "source_blocks", "_limit", "by_shard").withColumnRenamed("seats", "quota")
    start = F.when(F.col("blocks") > 0, F.pmod(seeded(seed, "start", F.col("source"), F.col("shard")), F.col("blocks")))
    return scratch.save(quotas.withColumn("start", F.coalesce(start, F.lit(0))).drop("_limit", "source_blocks"), "quotas")


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    right = sources.withColumnRenamed("source", "_source")
    return rows.join(right, rows.source.eqNullSafe(right._source)).drop("_source")


def _shard(seed: str) -> Column:
    """By id and text, so that rows without an id, or with the same one, are spread as others are."""
    return F.pmod(seeded(seed, "shard", F.col("doc_id"), F.col("mark")), F.col("shards"))


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: list[str] | None = None,
    weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, passes, first_*, second_*, taken and ``row``.

    ``passes`` counts whole takes; (first_from, first_words) and (second_from, second_words) are the word ranges of the
    last, partial take. ``row`` is a struct of the columns named in ``carry``.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_or_empty(text_col)).alias("size"),
        seeded(text_or_empty(text_col)).alias("mark"), F.xxhash64(text_or_empty(text_col)).alias("hash"), *([F.struct(*carry).alias("row")] if carry else []),
    )
    measured = scratch.save(rows.select("doc_id", "source", "size", "mark", "hash"), "sizes")
    q = _quotas(scratch, measured, weights, share, cap, block_words, shard_words, seed)
    placed = with_source(rows if carry else measured, q.select("source", "shards").distinct()).withColumn("shard", _shard(seed))
    right = q.drop("shards").withColumnsRenamed({"source": "_source", "shard": "_shard"})
    placed = placed.join(right, placed.source.eqNullSafe(right._source) & (placed.shard == right._shard)).drop("_source", "_shard")
    w = Window.partitionBy("source", "shard").orderBy(seeded(seed, "order", F.col("doc_id"), F.col("mark")), "doc_id", "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    p = placed.withColumn("_a", F.coalesce(F.sum("size").over(w), F.lit(0))).withColumn("_b", F.col("_a") + F.col("size"))
    some = F.col("blocks") > 0
    p = p.withColumn("passes", F.when(some, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long"))
    p = p.withColumn("_end", F.col("start") + F.when(some, F.col("quota") % F.col("blocks")).otherwise(0))
    for name, low, high in (
        ("first", F.col("start") * block_words, F.least(F.col("_end") * block_words, F.col("words"))),
        ("second", F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("_end") - F.col("blocks")) * block_words),
    ):
        begin = F.greatest(F.col("_a"), low)
        p = p.withColumn(f"{name}_from", begin - F.col("_a"))
        p = p.withColumn(f"{name}_words", F.greatest(F.lit(0).cast("long"), F.least(F.col("_b"), high) - begin))
    taken = F.col("passes") * F.col("size") + F.col("first_words") + F.col("second_words")
    return p.withColumn("taken", taken).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "passes", "first_from", "first_words", "second_from", "second_words",
        *(["row"] if carry else []),
    )


def words_slice(text: Column, begin: Column, words: Column, size: Column) -> Column:
    """The part of ``text`` that holds ``words`` words from word ``begin`` on, white space as it stands."""
    parts = F.split(text, f"(?<=[^{SPACE}])(?=[{SPACE}])")
    length = F.when(begin + words == size, F.size(parts)).otherwise(words)
    return F.when(words == size, text).otherwise(F.array_join(F.slice(parts, (begin + 1).cast("int"), length.cast("int")), ""))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each whole take and one for each partial range.

    A partial row's text is the range that the mix takes; ``n_chars``, where there is such a column, follows the text.
    """
    p = plan_mix(docs, id_col, source_col, text_col, carry=docs.columns, **options)
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("begin"), F.col("size").alias("words")), F.col("passes").cast("int"))
    partial = F.array(*[F.struct(F.col(f"{n}_from").alias("begin"), F.col(f"{n}_words").alias("words")) for n in ("first", "second")])
    takes = F.filter(F.concat(whole, partial), lambda x: x["words"] > 0)
    p = p.withColumn("_take", F.explode(takes)).where("size > 0")
    text = words_slice(text_or_empty(f"row.{text_col}"), F.col("_take.begin"), F.col("_take.words"), F.col("size"))
    out = p.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out


SQL = f"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS mark FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM s0),
s2 AS (SELECT *, CAST([3, 1, 2][(n - 1) % 3 + 1] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY cap / w, n) AS place,
  (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
  FROM s2 WINDOW b AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, arg_min(lev, place) FILTER (lev <= cap / w) OVER () AS lam FROM s3),
s5 AS (SELECT source, source_size, coalesce(least(cap, lam * w), cap) AS target,
  greatest(1, ceil(source_size / {SHARD_WORDS}.0))::BIGINT AS shards, (2 * ceil(source_size / {BLOCK_WORDS}.0))::BIGINT AS lim FROM s4),
s6 AS (SELECT *, floor(sum(target) OVER () / {BLOCK_WORDS} + 0.5)::BIGINT AS total FROM s5),
q0 AS (SELECT source, target / (2 * k + 1) AS q, k FROM s6, unnest(range(lim)) AS t(k)),
q1 AS (SELECT source, row_number() OVER (ORDER BY q DESC, source ASC NULLS LAST) AS r FROM q0),
seats AS (SELECT s6.*, (SELECT count(*) FROM q1 WHERE q1.source IS NOT DISTINCT FROM s6.source AND r <= s6.total) AS source_blocks FROM s6),
d AS (SELECT z.*, s.source_size, s.target, s.shards, s.source_blocks,
  ('0x' || substr(md5('mix|shard|' || coalesce(z.doc_id::VARCHAR, '') || '|' || z.mark), 1, 15))::BIGINT % s.shards AS shard
  FROM sizes z JOIN seats s ON z.source IS NOT DISTINCT FROM s.source),
h0 AS (SELECT source, shard, source_blocks, sum(size)::BIGINT AS words, ceil(sum(size) / {BLOCK_WORDS}.0)::BIGINT AS blocks FROM d GROUP BY ALL),
h1 AS (SELECT source, shard, words / (2.0::DOUBLE * k + 1) AS q FROM h0, unnest(range(2 * blocks)) AS t(k)),
h2 AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard) AS r FROM h1),
h3 AS (SELECT h2.source, h2.shard, count(*) AS quota FROM h2 JOIN h0 ON h2.source IS NOT DISTINCT FROM h0.source AND h2.shard = h0.shard
  WHERE r <= h0.source_blocks GROUP BY ALL),
h AS (SELECT h0.*, coalesce(h3.quota, 0) AS quota, CASE WHEN blocks > 0 THEN
  ('0x' || substr(md5('mix|start|' || coalesce(h0.source, '') || '|' || h0.shard), 1, 15))::BIGINT % blocks ELSE 0 END AS start
  FROM h0 LEFT JOIN h3 ON h3.source IS NOT DISTINCT FROM h0.source AND h3.shard = h0.shard),
p AS (SELECT d.*, h.words, h.blocks, h.quota, h.start, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS passes,
  h.start + CASE WHEN blocks > 0 THEN quota % blocks ELSE 0 END AS fin,
  coalesce(sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY ('0x' || substr(md5('mix|order|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.mark), 1, 15))::BIGINT, d.doc_id, d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source AND d.shard = h.shard)
SELECT doc_id, size, source_size, target, CAST(passes * size
  + greatest(0, least(a + size, least(fin * {BLOCK_WORDS}, words)) - greatest(a, start * {BLOCK_WORDS}))
  + greatest(0, least(a + size, greatest(0, fin - blocks) * {BLOCK_WORDS}) - a) AS BIGINT) AS taken
FROM p
"""


def query(spark, sf_dir: str) -> DataFrame:
    return plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
