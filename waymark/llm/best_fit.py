"""Best-fit packing by sums of squares.

Documents become token ids plus an end id; only those longer than a sequence are cut, at multiples of its length. Pieces
are ranked by length over the whole table, longest first, and dealt in turn to shards of at most about ``shard_pieces``
pieces, so every shard holds the same mixture of lengths and all are equally large, whatever ids or texts repeat. A shard
is packed by one task: each piece goes to the open bin for which the sum, over the residual gaps, of the squared number of
open bins with that gap becomes smallest; bins that become full close. A new bin is opened where no open one has room.
Sequence ids are the shard's number and the bin's. A shard leaves a few bins unfilled, which is the cost of packing shards
apart: none in tables of one shard.

A null text counts as empty and still has its end id. Rows that repeat an id are separate documents. An empty table gives
an empty result. A long text is tokenised whole, in one task, and handed on in pieces. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, global_rank
from .packing import END_ID, token_pieces, tokenizer_path

SEQUENCE = 4096


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, placed in the given order. Bins are numbered from 0.

    Moving a bin from gap h to h - s changes the sum by 2 (N[h - s] - N[h]) + 2, or by 1 - 2 N[s] if it becomes full.
    Among equal changes the smallest gap is taken, and of its bins the one that came to it last.
    """
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by gap
    n = np.zeros(size + 1, "int64")
    placed, offsets, bins = np.empty(len(lengths), "int64"), np.empty(len(lengths), "int64"), 0
    for i, s in enumerate(lengths.tolist()):
        roomy = np.flatnonzero(n[s:])  # gaps from s up that have bins, less s
        if len(roomy):
            change = 2 * (n[roomy] - n[roomy + s]) + 2  # n[0] stays 0: full bins are closed
            if roomy[0] == 0:
                change[0] = 1 - 2 * n[s]
            gap = int(roomy[np.argmin(change)]) + s
            b = open_bins[gap].pop()
            n[gap] -= 1
        else:
            gap, b, bins = size, bins, bins + 1
        placed[i], offsets[i] = b, size - gap
        if gap > s:
            open_bins[gap - s].append(b)
            n[gap - s] += 1
    return placed, offsets


def pack_best_fit(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = 50_000, with_ids: bool = True) -> DataFrame:
    """Each piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset and (``with_ids``) ids."""
    scratch = Scratch(docs.sparkSession)
    pieces, total = scratch.save_counted(token_pieces(docs, path, size, end_id, id_col, text_col, with_ids), "pieces")
    shards = max(1, -(-total // shard_pieces))
    ranked = global_rank(scratch, pieces.drop("doc_tokens"), [F.col("length").desc(), "doc_id", "start", "ids_crc32"], "ranked")
    # The places only need lengths; ids stay where they are and are joined by rank.
    lengths = ranked.select("rank", "length", (F.col("rank") % shards).alias("shard"))

    def place(shard: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("rank")
        b, offset = sum_of_squares(x["length"].to_numpy(), size)
        return pd.DataFrame({"rank": x["rank"], "sequence_id": shard[0] + shards * b, "offset": offset})

    places = lengths.groupBy("shard").applyInPandas(place, "rank long, sequence_id long, offset long")
    out = ranked.join(places, "rank")
    return out.select("doc_id", F.floor(F.col("start") / size).cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def query(spark, sf_dir: str) -> DataFrame:
    return pack_best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), with_ids=False)
