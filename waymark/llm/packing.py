"""Packing by shortest-pack-first over the length histogram.

Documents become token ids plus an end id and are cut at multiples of the sequence length; the rest of each is placed
whole. Only the histogram of piece lengths (at most one row a length) goes to the driver. Lengths are placed longest
first, each into the packs with the smallest sum that still fit; a group of equal packs is split where only part of it is
filled. Each placement names a length, a range of ranks, a first sequence and an offset, so pieces, ranked within their
length over the whole table, find their place by a look-up.

A null text counts as empty and still has its end id. Rows that repeat an id are separate documents. An empty table gives
an empty result. A long text is tokenised whole, in one task, and handed on in pieces. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, global_rank, text_or_empty
from .tokens import encode_in_parts

SEQUENCE, END_ID = 2048, 1
#: Ids after which a worker hands on what it has cut.
HELD_IDS = 1 << 21
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and (``with_ids``) ids, little-endian unsigned 32-bit."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    def cut(batches):
        for b in batches:
            rows, held = [], 0
            for doc, ids in zip(b["doc_id"], encode_in_parts(path, b["text"].tolist()), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length].tobytes()
                    rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), len(ids), piece)[: 6 if with_ids else 5])
                held += len(ids)
                if held > HELD_IDS:  # what a worker holds doesn't follow the lengths of texts
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(cut, schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, ranks, first sequence, offset). Sequences are numbered from 0 without gaps.

    Packs of equal sum are kept as ranges of sequence numbers, so the work follows the histogram, not the documents.
    """
    packs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # sum -> ranges (first sequence, number)
    heap, placed, sequences = [], [], 0

    def put(total: int, first: int, number: int) -> None:
        if total < size:
            if not packs[total]:
                heappush(heap, total)
            packs[total].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        made: list[tuple[int, int, int]] = []
        while left and heap and heap[0] + length <= size:
            total = heap[0]
            first, number = packs[total].pop()
            used = min(left, number)
            placed.append((length, rank, used, first, total))
            made.append((total + length, first, used))
            if used < number:
                packs[total].append((first + used, number - used))
            if not packs[total]:
                heappop(heap)
            left, rank = left - used, rank + used
            if not heap or heap[0] + length > size:  # packs filled just now may take this length again
                for m in made:
                    put(*m)
                made = []
        for m in made:
            put(*m)
        if left:
            each = max(1, size // length)
            full, rest = divmod(left, each)
            for count, number in ((each, full), (rest, 1)):
                if count and number:
                    for i in range(count):
                        placed.append((length, rank, number, sequences, i * length))
                        rank += number
                    put(count * length, sequences, number)
                    sequences += number
    return placed


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Each piece with its place: the columns of ``token_pieces``, sequence_id and offset."""
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.save(token_pieces(docs, path, size, end_id, id_col, text_col, with_ids), "pieces")
    ranked = global_rank(scratch, pieces, ["length", "doc_id", "start", "ids_crc32"], "ranked")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    placed = sorted(shortest_pack_first(histogram, size))
    below, n = {}, 0
    for length in sorted(histogram):
        below[length], n = n, n + histogram[length]
    # Ranks run over all lengths, ascending; a placement starts at below[length] + first rank.
    begins = np.array([below[p[0]] + p[1] for p in placed], "int64")
    firsts, offsets = np.array([p[3] for p in placed], "int64"), np.array([p[4] for p in placed], "int64")
    sent = docs.sparkSession.sparkContext.broadcast((begins, firsts, offsets))  # follows the histogram

    @F.pandas_udf("sequence_id long, offset long")
    def place(rank: pd.Series) -> pd.DataFrame:
        b, f, o = sent.value
        at = np.searchsorted(b, rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": f[at] + (rank.to_numpy() - b[at]), "offset": o[at]})

    return ranked.withColumn("_place", place("rank")).select(*pieces.columns, "_place.*")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), with_ids=False)
