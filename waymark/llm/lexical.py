"""Ranked lexical search by sort-based accumulation.

Items are queries, documents are ranked for each. One pass over the texts counts all terms and keeps, of each document,
the terms that some item asks for; document frequencies and the corpus's length are sums over that table. A second pass
over it scores: in a block of documents the matched postings are concatenated as (item, document, impact), the packed keys
are radix sorted, impacts of equal keys are added with ``reduceat``, and a heap an item keeps the task's best. The tasks'
best are range-partitioned by item and score, and each item takes the first of them.

Items go out in groups of about ``group_terms`` term occurrences, broadcast to the scans, so what a worker holds follows
that parameter (and the longest item), not the number of items. Expanded postings are held ``BLOCK`` at a time.

A null text has no terms. An item without terms, or with terms that no document has, has no rows. Each row is an item or a
document of its own, also where ids repeat: rows with equal ids and scores are ranked arbitrarily among each other, and an
item row ranks by itself. Documents with a null id follow the others of the same score. Empty tables give an empty result.
Whole texts are read, whatever their length; other columns are not, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.prefix import rank_in_group

from .common import Scratch

#: A term is a maximal run of characters outside these ASCII ranges.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 as terms see them: A-Z lower-cased, other ASCII marks as spaces.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Postings that a worker expands at a time.
BLOCK = 1 << 20


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return raw.translate(_FOLDED).split()


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative integers, sorted by 16-bit digits from the lowest up."""
    order = np.arange(len(keys))
    for shift in range(0, max(1, int(keys.max(initial=0)).bit_length()), 16):
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


class Postings:
    """The items' side: for each term number, its items with their weights."""

    def __init__(self, items: list[list[bytes]]) -> None:
        self.number: dict[bytes, int] = {}
        times: dict[tuple[int, int], int] = {}
        for q, words in enumerate(items):
            for w in words:
                at = (self.number.setdefault(w, len(self.number)), q)
                times[at] = times.get(at, 0) + 1
        pairs = np.array(sorted(times), "int64").reshape(-1, 2)
        self.item = pairs[:, 1]
        self.weight = np.array([times[t, q] for t, q in pairs.tolist()], "int64")
        self.count = np.bincount(pairs[:, 0], minlength=len(self.number))
        self.start = np.cumsum(self.count) - self.count
        self.items = len(items)

    def weigh(self, holding: dict[int, int], documents: int) -> None:
        """Multiply the items' own counts by the terms' weights."""
        w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(self.number))], "int64")
        self.weight = self.weight * np.repeat(w, self.count)


def matched_terms(batches: Iterator[pd.DataFrame], number: dict[bytes, int]) -> Iterator[pd.DataFrame]:
    """(doc_id, n, terms, tfs) of documents with a term: their length, and the asked terms with their occurrences."""
    get = number.get
    for b in batches:
        rows = []
        for doc, raw in zip(b["doc_id"], b["raw"], strict=True):
            words = terms(raw)
            if words:
                hits = np.fromiter((t for t in map(get, words) if t is not None), "int32")
                found, tf = np.unique(hits, return_counts=True)
                rows.append((doc, len(words), found, tf.astype("int32")))
        yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "tfs"]).astype({"doc_id": "Int64"})


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose postings add up to about BLOCK, one document at least, 65,536 at most."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        done = ends[first - 1] if first else 0
        last = min(max(first + 1, int(np.searchsorted(ends, done + BLOCK, side="right"))), first + 65_536)
        yield first, last
        first = last


def _accumulated(post: Postings, terms_: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of a block: the document's place in it, each pair once, by item and document."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    unit = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[doc])
    count = post.count[terms_]
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(post.start[terms_], count) + within
    keys = (post.item[at] << 16) | np.repeat(doc, count)
    order = radix_order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], "int64")
    sums = np.add.reduceat((post.weight[at] * np.repeat(unit, count))[order], starts) if len(keys) else np.array([], "int64")
    return keys[starts] >> 16, keys[starts] & 0xFFFF, sums


def best_in_task(batches: Iterator[pd.DataFrame], post: Postings, documents: int, total: int, k: int) -> Iterator[pd.DataFrame]:
    """(q, doc_id, no_id, score): the k best documents of each item among the task's, by a heap each."""
    heaps: list[list[tuple]] = [[] for _ in range(post.items)]
    bar = np.ones(post.items, "int64")  # a score has to reach it
    for b in batches:
        sizes = b["terms"].map(len).to_numpy("int64")
        no_id = b["doc_id"].isna().to_numpy()
        ids = b["doc_id"].fillna(0).to_numpy("int64")
        m = 100 - 25 + (25 * b["n"].to_numpy("int64") * documents) // total
        held = np.repeat(np.arange(len(sizes)), sizes)
        flat, tfs = (np.concatenate(b[c].to_list()).astype("int64") if len(held) else held for c in ("terms", "tfs"))
        offsets = np.r_[0, np.cumsum(sizes)]
        for i, j in _blocks(np.bincount(held, post.count[flat], len(sizes)).astype("int64")):
            part = slice(offsets[i], offsets[j])
            item, doc, score = _accumulated(post, flat[part], tfs[part], sizes[i:j], m[i:j])
            ok = score >= bar[item]
            item, doc, score = item[ok], doc[ok] + i, score[ok]
            order = np.lexsort((ids[doc], no_id[doc], -score, item))
            item, doc, score = item[order], doc[order], score[order]
            first = np.searchsorted(item, item)
            ok = np.arange(len(item)) - first < k
            for q, d, s in zip(item[ok].tolist(), doc[ok].tolist(), score[ok].tolist(), strict=True):
                entry, heap = (s, not no_id[d], -int(ids[d])), heaps[q]
                if len(heap) < k:
                    heappush(heap, entry)
                elif entry > heap[0]:
                    heapreplace(heap, entry)
                if len(heap) == k:
                    bar[q] = max(1, heap[0][0])
    rows = [(q, -d, not named, s) for q, heap in enumerate(heaps) for s, named, d in heap]
    yield pd.DataFrame(rows, columns=["q", "doc_id", "no_id", "score"]).astype({"q": "int64", "doc_id": "int64", "no_id": "bool", "score": "int64"})


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", group_terms: int = 200_000
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw")).where("raw IS NOT NULL")
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    asked = asked.withColumn("n", F.regexp_count("text", F.lit(TERM)).cast("long")).where("n > 0").withColumn("row", F.monotonically_increasing_id())
    asked = scratch.save(asked, "items")
    groups = -(-(asked.agg(F.sum("n")).first()[0] or 0) // group_terms)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).orderBy("item_id", "row").collect()  # about group_terms terms
        if rows:
            out = out.unionByName(_group(scratch, raw, rows, k, g)) if g else _group(scratch, raw, rows, k, g)
    return out


def _group(scratch: Scratch, raw: DataFrame, rows: list, k: int, g: int) -> DataFrame:
    spark = scratch.spark
    post = Postings([terms(r["text"].encode("utf-8", "replace")) for r in rows])
    number = spark.sparkContext.broadcast(post.number)
    table = scratch.save(raw.mapInPandas(lambda b: matched_terms(b, number.value), "doc_id long, n long, terms array<int>, tfs array<int>"), f"matched{g}")
    size = table.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
    holding = {r["t"]: r["count"] for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # the group's terms
    post.weigh(holding, size["documents"])
    post.number = {}
    sent, documents, total = spark.sparkContext.broadcast(post), size["documents"], size["total"] or 1
    best = table.where(F.size("terms") > 0).mapInPandas(lambda b: best_in_task(b, sent.value, documents, total, k), "q long, doc_id long, no_id boolean, score long")
    best = rank_in_group(scratch, scratch.save(best, f"best{g}"), ["q"], [F.col("score").desc(), "no_id", "doc_id"], f"ranked{g}").where(F.col("place") < k)
    id_of = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], "q long, item_id long")
    out = best.join(F.broadcast(id_of), "q").select("item_id", (F.col("place") + 1).cast("int").alias("rank"), F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "score")
    done = scratch.save(out, f"results{g}")
    scratch.drop(f"matched{g}", f"best{g}", f"ranked{g}")
    number.destroy()
    sent.destroy()
    return done


_TERMS = rf"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
SQL = f"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
item AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark),
asked AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(t) AS term FROM item) GROUP BY ALL),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM doc) SEMI JOIN asked USING (term) GROUP BY ALL),
s AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM doc WHERE len(t) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, s.n),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(t) * s.n) // s.l AS m FROM doc, s WHERE len(t) > 0),
scored AS (SELECT i, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM asked JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored JOIN item USING (i) JOIN m USING (r) WHERE score > 0 QUALIFY rank <= 20
"""


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
