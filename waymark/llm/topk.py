"""Exact top-k inner-product search by distributed histogram selection.

Every candidate is scored against every query. A first pass counts scores per query in equal bins over the range that
the vector norms allow; the bin that holds the k-th value is refined pass by pass until the bin is one value wide or few
rows lie above its lower end. The last pass keeps rows at or above that threshold, and ties go to the smaller id.

Queries go out in groups of at most ``group_queries`` vectors, broadcast to scans of the candidates in Arrow batches;
a task emits, per query, only bins at or above the one that holds its own k-th value, so little is shuffled.

Scores are exact. Where the norms say that no sum can reach 2**53, floating-point products are, and they are used; beyond
that the same products are taken in 64-bit integers, and where a sum may leave those, in Python's. A result's score that
is no long raises an error: at 2**63 or more as soon as it is met, as it is among the best; at -2**63 or less only if too
few other candidates are left. So does a component whose 256-fold is no finite double, if it has a say.

Vectors that are null or hold null or non-finite components take no part. A query and a candidate of different lengths
are not compared; two empty vectors score 0. Each row is a query or a candidate of its own: only the very row is no candidate of its query,
another with the same id is one, and query rows that repeat an id have a result each. A null id takes no part. Rows equal
in score and id are ranked arbitrarily, which shows nowhere. A query with fewer than k candidates returns all of them. An
empty table gives an empty result. Other columns are not read, whatever their names.

A group of queries scans the candidates once for each round of refinement and once for the results, so N queries take
about 3 N / ``group_queries`` scans, one group after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

BINS, ENOUGH, BLOCK = 1024, 8, 512
#: Below EXACT, sums of products are exact in a double; scores are longs up to LIMIT and above LOWEST, which stands for all below.
EXACT, LIMIT, LOWEST = 1 << 53, (1 << 63) - 1, -(1 << 63) + 1


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): vectors of whole numbers floor(scale * x), as doubles, of rows that take part."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    x = x.withColumn("v", F.transform("v", lambda c: c.cast("double")))
    x = x.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    # Doubles from 2**53 on are whole numbers, which the floor, a long, might not hold.
    whole = lambda c: F.when(F.abs(c * scale) < EXACT, F.floor(c * scale).cast("double")).otherwise(c * scale)
    return x.select("id", F.transform("v", whole).alias("v"))


def _products(cand: np.ndarray, queries: np.ndarray, exact: bool, other: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers, a row a query, of each ``other`` row. ``exact``: none reaches 2**53."""
    if exact:
        return (cand @ queries).T.astype("int64")
    with np.errstate(all="ignore"):
        # What a sum's parts add up to at most; sums modulo 2**64 are right where they and the components surely fit.
        reach = (np.abs(cand) @ np.abs(queries)).T
        out = (cand.astype("int64") @ queries.astype("int64")).T
        fits = (reach < 2.0**62) & (np.abs(cand).max(axis=1, initial=0) < 2.0**62) & (np.abs(queries).max(axis=0, initial=0) < 2.0**62)[:, None]
    for q, c in zip(*np.nonzero(~fits & other), strict=True):
        score = sum(int(a) * int(b) for a, b in zip(cand[c].tolist(), queries[:, q].tolist(), strict=True) if a and b)
        if score > LIMIT:
            raise OverflowError(f"an inner product of {score} is no long")
        out[q, c] = max(score, LOWEST)
    return out


def _scorer(rows: np.ndarray, vectors: list[np.ndarray], exact: bool):
    """Blocks of queries by vector length; ``run`` yields (query positions, candidate ids, scores, whether it's another row)."""
    lengths = np.array([len(v) for v in vectors])
    blocks = []
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), BLOCK):
            part = at[i : i + BLOCK]
            blocks.append((n, part, np.stack([vectors[p] for p in part]).astype("float64").T))

    def run(batch: pd.DataFrame):
        size = batch["v"].map(len).to_numpy()
        for n in np.unique(size):
            some = batch[size == n]
            cand, c = some["id"].to_numpy(), np.stack(some["v"].to_numpy()).astype("float64")
            for length, part, q in blocks:
                if length == n:
                    other = rows[part][:, None] != some["row"].to_numpy()[None, :]
                    yield part, cand, _products(c, q, exact, other), other

    return run


def _histograms(low: np.ndarray, width: np.ndarray, run, k: int, batches: Iterator[pd.DataFrame], bins: int) -> Iterator[pd.DataFrame]:
    """(q, bin, n): bins from the top down to the one that holds the task's own k-th value. Above the range: bin ``bins``."""
    counts = np.zeros((len(low), bins + 1), dtype="int64")
    for batch in batches:
        for part, _, scores, other in run(batch):
            base = low[part][:, None]
            ok = other & (scores >= base)
            at = np.minimum(np.where(ok, (scores - base).astype("uint64") // width[part][:, None].astype("uint64"), 0), bins)
            flat = (np.arange(len(part))[:, None] * (bins + 1) + at.astype("int64"))[ok]
            counts[part] += np.bincount(flat, minlength=len(part) * (bins + 1)).reshape(len(part), bins + 1)
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
    q, b = np.nonzero((counts > 0) & (above < k))
    yield pd.DataFrame({"q": q.astype("int64"), "bin": b.astype("int64"), "n": counts[q, b]})


def _survivors(low: np.ndarray, run, k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The task's rows at or above each query's threshold, at most its own k best a query."""
    best: list[pd.DataFrame] = []
    for batch in batches:
        for part, cand, scores, other in run(batch):
            r, c = np.nonzero(other & (scores >= low[part][:, None]))
            best.append(pd.DataFrame({"q": part[r], "vec_id": cand[c], "score": scores[r, c]}))
        if sum(map(len, best)) > 200_000:
            best = [_first(pd.concat(best), k)]
    yield _first(pd.concat(best), k) if best else pd.DataFrame({"q": [], "vec_id": [], "score": []}).astype("int64")


def _first(x: pd.DataFrame, k: int) -> pd.DataFrame:
    return x.sort_values(["q", "score", "vec_id"], ascending=[True, False, True]).groupby("q").head(k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, group_queries: int = 8192
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates among all other rows."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    table = scratch.save(usable(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = table.where(is_query(F.col("id")) if callable(is_query) else is_query)
    norm = table.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))).first()[0] or 0.0
    asked = scratch.save(asked, "queries")
    groups = max(1, -(-asked.count() // group_queries))
    # Groups of bounded size: hashed row numbers spread evenly, so twice the mean is never reached by a group of thousands.
    in_group = F.pmod(F.xxhash64("row"), F.lit(groups))
    parts = []
    for g in range(groups):
        rows = asked.where(in_group == g).orderBy("id", "row").collect()  # at most about group_queries vectors
        if rows:
            parts.append(_group(spark, scratch, table, rows, norm, k, g))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _group(spark, scratch: Scratch, table: DataFrame, rows: list, norm: float, k: int, g: int) -> DataFrame:
    ids, vectors = np.array([r["id"] for r in rows]), [np.array(r["v"]) for r in rows]
    with np.errstate(all="ignore"):
        norms = [float(np.sqrt((v**2).sum())) * norm if v.any() else 0.0 for v in vectors]
    exact = max(norms) < EXACT / 2
    sent = spark.sparkContext.broadcast((np.array([r["row"] for r in rows]), vectors, exact))
    bound = [int(x * (1 + 1e-9)) + 1 if x < 2.0**62 else LIMIT for x in norms]
    low, width = np.array([-b for b in bound], "int64"), np.array([-(-(2 * b + 1) // BINS) for b in bound], "int64")
    open_ = np.ones(len(rows), dtype=bool)
    while open_.any():

        def count(batches, low=low, width=width):
            yield from _histograms(low, width, _scorer(*sent.value), k, batches, BINS)

        counted = table.mapInPandas(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        from_top = Window.partitionBy("q").orderBy(F.col("bin").desc())
        counted = counted.withColumn("above", F.sum("n").over(from_top) - F.col("n"))
        found = counted.where(F.col("above") < k).groupBy("q").agg(F.min_by(F.struct("bin", (F.col("above") + F.col("n")).alias("reach")), "bin").alias("_"))
        seen = np.zeros(len(rows), dtype=bool)
        for r in found.select("q", "_.*").collect():  # one row a query of the group
            seen[r["q"]] = True
            if open_[r["q"]] and r["bin"] < BINS:
                low[r["q"]] = int(low[r["q"]]) + r["bin"] * int(width[r["q"]])
                open_[r["q"]] = k <= r["reach"] and r["reach"] > ENOUGH * k and width[r["q"]] > 1
                width[r["q"]] = -(-int(width[r["q"]]) // BINS) if open_[r["q"]] else width[r["q"]]
            else:
                open_[r["q"]] = False
        open_ &= seen

    def keep(batches, low=low):
        yield from _survivors(low, _scorer(*sent.value), k, batches)

    best = table.mapInPandas(keep, "q long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    best = best.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)
    id_of = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(ids)), "query_id": ids}), "q long, query_id long")
    known = F.when(F.col("score") > LOWEST, F.col("score")).otherwise(F.raise_error(F.lit("an inner product is no long")).cast("long"))
    done = scratch.save(best.join(F.broadcast(id_of), "q").select("query_id", "rank", "vec_id", known.alias("score")), f"best{g}")
    sent.destroy()
    return done


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND q.vec_id % 50 = 0 AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)
