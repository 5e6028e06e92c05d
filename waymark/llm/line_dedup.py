"""Line dedup: a suffix array over line ids by distributed prefix doubling; later copies of repeated line runs go.

A text is the sequence of its lines (split at ``\\n``); a run is a number of adjacent lines of one text. The order of all
lines is (id, hash of the text, line number), null ids first. Rank k orders all suffixes by their first 2**k lines: rank 0
orders the lines that occur more than once, and rank k + 1 orders the pairs (rank k here, rank k 2**k lines on). Suffixes
that share their first n lines are an interval of the suffix array with a longest common prefix of n or more; two
overlapping ranks name it. Lines that occur once can be in no repeated run, so only islands of repeated lines are ranked.

A line goes if it lies in a run of ``min_words`` words or more that also begins earlier in the order. Every such run is
covered by the shortest runs with that many words that begin or end at each of its lines, so the array is only needed to
the depth of those: doubling ends at the longest of them. In the sorted suffixes, those whose longest common prefix with
their neighbours reaches n are one interval, and they are just the suffixes that agree in two overlapping ranks; so an
interval is a group of (n, rank, rank), of any size, without a sort in one task. The first suffix of an interval stays,
and the run goes from every later one. Adjacent lines that go are the maximal repeated runs (``repeated_runs``).

A null text counts as empty; it has one empty line. Runs of fewer words, such as single short lines, are never the
reason to delete. Rows that repeat both id and text are treated alike, as one document. A run that overlaps its own
earlier copy loses the lines of the later one. An empty table gives an empty result. Other columns are not read, whatever
their names. A long text is split once and rebuilt from slices, in one task; its lines are spread over tasks. Only texts that
lose lines (and a sixteenth of the others, at most) are shuffled to their line numbers: a bitmap tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, Scratch, dense_ranks, text_or_empty, word_count

MIN_WORDS = 5
#: Bits a document takes in the bitmap of those that lose lines, and the bits of one row of it.
MARK_BITS, ROW_BITS = 16, 4096 * 8
#: Documents that a bitmap is made for (96 MB); if more lose lines, all texts are shuffled.
MARKED = 50_000_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _line_id(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit("line")).alias("b"))


def _repeated(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(doc, pos, words, r): the lines that occur more than once, with rank 0. doc is the struct (id, hash)."""
    again = docs.groupBy("doc").count().where("count > 1")
    lines = docs.select("doc", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    lines = scratch.save(lines.select("doc", "pos", _line_id(F.col("line")).alias("line"), word_count(F.col("line")).cast("int").alias("words")), "lines")
    if not again.isEmpty():
        lines = lines.dropDuplicates(["doc", "pos"])
    common = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")
    ranks = dense_ranks(scratch, common, ["line"], "r", "rank0")
    out = scratch.save(lines.join(ranks, "line").select("doc", "pos", "words", "r"), "level0")
    scratch.drop("lines")
    return out


def _needed_runs(level0: DataFrame, min_words: int) -> DataFrame:
    """(doc, pos, n): the shortest runs of ``min_words`` words or more from each line on, and up to each line, in islands."""
    by_doc = Window.partitionBy("doc").orderBy("pos")
    x = level0.withColumn("island", F.col("pos") - F.row_number().over(by_doc))
    upto = Window.partitionBy("doc", "island").orderBy("pos")
    every = Window.partitionBy("doc", "island")
    x = x.withColumn("c", F.sum("words").over(upto)).withColumn("b", F.col("c") - F.col("words"))
    x = x.withColumn("total", F.sum("words").over(every)).withColumn("first", F.min("pos").over(every)).withColumn("last", F.max("pos").over(every))
    x = x.select("doc", "island", "pos", "words", "b", "c", "total", "first", "last")
    # A line with enough words is a run by itself; the shorter ones around it may still need it at an end of theirs.
    short = x.where(F.col("words") < min_words)

    def met(bound: Column, key: str, order: Column, places: Column) -> DataFrame:
        """The short lines with ``met``, the last line's place up to their bound: lines and bounds are merged into one order and walked once."""
        asked = short.withColumn("at", bound).withColumn("line", F.lit(None).cast("int"))
        lines = x.withColumn("at", F.col(key)).withColumn("line", F.col("pos"))
        walk = Window.partitionBy("doc", "island").orderBy(order, F.col("line").isNull(), places).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return lines.unionByName(asked).withColumn("met", F.last("line", ignorenulls=True).over(walk)).where("line IS NULL")

    # The run from a line ends before the first line that has ``min_words`` words between itself and that line.
    ends = met(F.col("b") + min_words, "b", F.col("at").desc(), F.col("pos").desc())
    ends = ends.withColumn("end", F.coalesce("met", F.when(F.col("total") - F.col("b") >= min_words, F.col("last") + 1)) - 1)
    begins = met(F.col("c") - min_words, "c", F.col("at").asc(), F.col("pos").asc())
    begins = begins.withColumn("begin", F.coalesce("met", F.when(F.col("c") >= min_words, F.col("first") - 1)) + 1)
    runs = x.where(F.col("words") >= min_words).select("doc", "pos", F.lit(1).alias("n"))
    runs = runs.unionByName(ends.select("doc", "pos", (F.col("end") - F.col("pos") + 1).alias("n")))
    runs = runs.unionByName(begins.select("doc", F.col("begin").alias("pos"), (F.col("pos") - F.col("begin") + 1).alias("n")))
    return runs.where("n IS NOT NULL").distinct()


def _named_runs(scratch: Scratch, level0: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc, pos, n, a, b): runs with the ranks of their first and last 2**k lines, k as large as fits."""
    longest = runs.agg(F.max("n")).first()[0] or 0
    level, k, named = level0.select("doc", "pos", "r"), 0, None
    while (1 << k) <= longest:
        step = 1 << k
        here = runs.where((F.col("n") >= step) & (F.col("n") < 2 * step))
        part = here.join(level.withColumnRenamed("r", "a"), ["doc", "pos"])
        if k == 0:
            part = part.withColumn("b", F.col("a"))
        else:
            tail = level.select("doc", F.col("pos").alias("_tail"), F.col("r").alias("b"))
            part = part.withColumn("_tail", F.col("pos") + F.col("n") - step).join(tail, ["doc", "_tail"]).drop("_tail")
        part = part.select("doc", "pos", "n", "a", "b")
        named = part if named is None else named.unionByName(part)
        if 2 * step <= longest:
            level = _doubled(scratch, level, step, k + 1)
        k += 1
    return named if named is not None else runs.withColumn("a", F.lit(0).cast("long")).withColumn("b", F.lit(0).cast("long"))


def _doubled(scratch: Scratch, level: DataFrame, step: int, k: int) -> DataFrame:
    """Rank k of the suffixes whose first 2 * ``step`` lines occur more than once; the others leave the array."""
    further = level.select("doc", (F.col("pos") - step).alias("pos"), F.col("r").alias("s"))
    pairs = scratch.save(level.join(further, ["doc", "pos"]), f"pairs{k}")
    common = pairs.groupBy("r", "s").agg(F.count("*").alias("n")).where("n > 1").select("r", "s")
    ranks = dense_ranks(scratch, common, ["r", "s"], "t", f"rank{k}")
    return scratch.save(pairs.join(ranks, ["r", "s"]).select("doc", "pos", F.col("t").alias("r")), f"level{k}")


def later_copies(scratch: Scratch, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, pos): the lines to delete. ``docs``: doc, text; rows of the same doc have the same text."""
    level0 = _repeated(scratch, docs)
    runs = scratch.save(_needed_runs(level0, min_words), "runs")
    named = scratch.save(_named_runs(scratch, level0, runs), "named")
    place = F.struct("doc", "pos")
    first = named.groupBy("n", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    first = scratch.save(first, "first")
    later = named.join(first, ["n", "a", "b"]).where(place != F.col("first")).select("doc", "pos", (F.col("pos") + F.col("n") - 1).alias("last"))
    return _lines_of_runs(later)


def _lines_of_runs(runs: DataFrame) -> DataFrame:
    """(doc, pos): each line of the runs (doc, pos, last) once. Runs that overlap are merged before they are told line by line."""
    w = Window.partitionBy("doc").orderBy("pos", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("_new", F.when(before.isNull() | (F.col("pos") > before), 1).otherwise(0))
    merged = opened.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = merged.groupBy("doc", "_run").agg(F.min("pos").alias("pos"), F.max("last").alias("last"))
    return merged.select("doc", F.explode(F.sequence("pos", "last")).alias("pos"))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("hash"))
    return docs.select(key.alias("doc"), text_or_empty(text_col).alias("text"))


def _deleted(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, int]:
    """(doc, lines): sorted line numbers to delete, a row for each document that loses any, and how many those are."""
    gone = later_copies(scratch, _documents(docs, id_col, text_col), min_words)
    out = scratch.save_counted(gone.groupBy("doc").agg(F.sort_array(F.collect_list("pos")).alias("lines")), "deleted")
    scratch.keep("deleted")
    return out


def _marked(scratch: Scratch, keyed: DataFrame, key: str, gone: DataFrame, number: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``keyed`` in two parts: what may have its ``key`` in ``gone`` (doc), and what can't. ``number``: the keys in ``gone``.

    Each key sets a bit at its hash. The bitmap has ``MARK_BITS`` for each, so it is a small part of the texts and broadcast.
    Beyond ``most`` keys there is none, and all rows are the first part.
    """
    if number > most:
        return keyed, None
    bits = -(-max(1, number) * MARK_BITS // ROW_BITS) * ROW_BITS
    place = lambda doc: F.pmod(F.xxhash64(doc), F.lit(bits)) + 1
    marks = gone.select(place("doc").alias("at")).groupBy(F.bitmap_bucket_number("at").alias("_row"))
    marks = F.broadcast(scratch.save(marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bits")), "marks"))
    told = keyed.withColumn("_at", place(key)).withColumn("_row", F.bitmap_bucket_number("_at")).join(marks, "_row", "left")
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    told = told.withColumn("_set", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("_at", "_row", "_bits")
    return told.where("_set").drop("_set"), told.where("NOT _set").drop("_set")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, first_line, lines): the maximal runs of lines that are deleted."""
    gone, _ = _deleted(Scratch(docs.sparkSession), docs, id_col, text_col, min_words)
    gone = gone.select("doc", F.posexplode("lines").alias("i", "pos"))
    runs = gone.groupBy("doc", (F.col("pos") - F.col("i")).alias("_")).agg(F.min("pos").alias("first_line"), F.count("*").alias("lines"))
    return runs.select(F.col("doc.id").alias("doc_id"), F.col("doc.hash").alias("text_hash"), "first_line", "lines")


def _without(parts: Column, gone: Column) -> Column:
    """The lines but for the sorted numbers in ``gone``. A lambda names the split text, so it is split once and sliced at the gaps."""

    def cut(lines: Column) -> Column:
        before, after = F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(lines)))
        gaps = F.filter(F.zip_with(before, after, lambda a, b: F.struct((a + 2).alias("first"), (b - a - 1).alias("n"))), lambda g: g["n"] > 0)
        return F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["first"], g["n"]))), "\n")

    return F.get(F.transform(F.array(parts), cut), F.lit(0))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, report: bool = False, marked: int = MARKED) -> DataFrame:
    """``docs`` with the later copies deleted from its texts; ``n_chars``, where there is such a column, follows the text.

    With ``report``, the columns ``_lines`` and ``_deleted`` (counts) are added. Texts that lose nothing stay as they
    are, nulls included.
    """
    scratch = Scratch(docs.sparkSession)
    deleted, number = _deleted(scratch, docs, id_col, text_col, min_words)
    gone = deleted.withColumnsRenamed({"doc": "_doc", "lines": "_gone"})
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("hash"))
    some, none = _marked(scratch, docs.withColumn("_key", key), "_key", deleted, number, marked)
    j = some.join(gone, some["_key"].eqNullSafe(gone["_doc"]), "left").drop("_doc")
    j = j if none is None else j.unionByName(none, allowMissingColumns=True)
    parts = lines_of(text_or_empty(text_col))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(_without(parts, F.col("_gone")))
    j = j.withColumn("_text", text)
    counts = [F.size(parts).cast("long").alias("_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_deleted")]
    chars = lambda c: F.when(F.col("_gone").isNull(), F.col(c)).otherwise(F.length("_text")).cast(docs.schema[c].dataType)
    out = [F.col("_text").alias(c) if c == text_col else chars(c).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return j.select(*out, *(counts if report else []))


SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l0 AS (SELECT doc, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
l AS (SELECT *, CAST(len(regexp_extract_all(line, '[^{SPACE}]+')) AS BIGINT) AS w, count(*) OVER (PARTITION BY line) AS n FROM l0),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc ORDER BY pos) AS c, sum(w) OVER (PARTITION BY doc ORDER BY pos) - w AS b FROM l),
e AS (SELECT *, sum(w) OVER (PARTITION BY doc) AS total, max(pos) OVER (PARTITION BY doc) AS last FROM c),
f AS (SELECT doc, n, pos AS lo, coalesce(min(pos) OVER (PARTITION BY doc ORDER BY b RANGE BETWEEN {MIN_WORDS} FOLLOWING AND UNBOUNDED FOLLOWING) - 1, CASE WHEN total - b >= {MIN_WORDS} THEN last END) AS hi FROM e),
g AS (SELECT doc, n, coalesce(max(pos) OVER (PARTITION BY doc ORDER BY c RANGE BETWEEN UNBOUNDED PRECEDING AND {MIN_WORDS} PRECEDING) + 1, CASE WHEN c >= {MIN_WORDS} THEN 1 END) AS lo, pos AS hi FROM e),
r AS (SELECT x.*, array_to_string(d.ls[lo:hi], chr(10)) AS run FROM (SELECT doc, lo, hi FROM f WHERE n > 1 UNION SELECT doc, lo, hi FROM g WHERE n > 1) x JOIN d USING (doc) WHERE lo <= hi),
k AS (SELECT *, (doc, lo) > min((doc, lo)) OVER (PARTITION BY run) AS later FROM r),
gone AS (SELECT DISTINCT doc, unnest(range(lo, hi + 1)) AS pos FROM k WHERE later),
stay AS (SELECT l0.doc, string_agg(line, chr(10) ORDER BY l0.pos) AS text FROM l0 ANTI JOIN gone ON l0.doc = gone.doc AND l0.pos = gone.pos GROUP BY ALL),
n AS (SELECT doc, count(*) AS n FROM gone GROUP BY ALL)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS lines, coalesce(n.n, 0) AS deleted, CAST(length(coalesce(stay.text, '')) AS BIGINT) AS kept_chars,
  sha256(coalesce(stay.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc) LEFT JOIN stay USING (doc)
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = text_or_empty("text")
    return drop_repeated_lines(docs, report=True).select(
        "doc_id", F.col("_lines").alias("lines"), F.col("_deleted").alias("deleted"), F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256")
    )
