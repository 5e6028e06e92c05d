"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

A word of L code points, padded on both sides, has L + Q - 1 positional grams of Q. One edit touches at most Q of them, so
two words one edit apart, the longer of length L, share at least L - 1 grams, at places that differ by 0 (before the edit)
or by 1 (after an edit that changes the length). Hence they share one of the Q + 1 grams that come first in any common
order of grams (Q, of the shorter word): the rarest, as told by how frequent their letter pairs are (a table bounded by
the alphabet). Words are posted under those grams, their places and the longer word's length; a shuffle brings together
what shares a posting.

Inside a posting's words a task builds the inverted index of all their grams by place. For each word it takes the lists of
its own grams under the limits on length and place and merges, by a heap, as many of the shortest as hold every word that
is in L - 1 of them; words that share L - 1 grams by place are kept and verified for exactly one edit. Postings with more than ``BLOCK`` words are dealt into blocks: each word is indexed
in one block and asks all blocks, one after the other, so a task's memory is bounded and no pair is lost.

Words and their numbers are counted over all documents; a pair found under several postings is one link. A word's form
and root follow from the links, roots by pointer doubling: forms at least double the number each time, so chains are short.

A null text has no words. A null id counts as empty text where words are corrupted. Rows that repeat count each time. An
empty table gives an empty result. Whole texts are read; a word may be of any length. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from itertools import islice
from operator import eq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

Q, PAD = 3, "#"
#: Words of a posting that one task indexes at a time, and distinct words that a counting worker holds.
BLOCK, HELD_WORDS = 2000, 300_000
#: Bytes of Latin-1 as words see them: letters (A-Z lower-cased), all else as spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def corrupted_words(doc: str, text: str, every: int = 97) -> Counter:
    """The words of a text with their numbers, after the deletions that the document's id seeds."""
    found, out = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()), Counter()
    seed = zlib.crc32(f"{doc}:".encode())
    for raw, n in found.items():
        word = raw.decode("latin-1")
        h = zlib.crc32(word.encode(), seed)
        if every and h % every == 0:
            word = word[: h % len(word)] + word[h % len(word) + 1 :]
        out[word] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, fewest: int = 3, every: int = 97) -> DataFrame:
    """(word, n) over all texts, of words of at least ``shortest`` code points (2 or more) that occur ``fewest`` times. ``every`` 0: as they stand."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for doc, text in zip(b["doc"], b["text"], strict=True):
                for word, n in corrupted_words(doc, text, every).items():
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield pd.DataFrame(held.items(), columns=["word", "n"])
                    held = Counter()
        yield pd.DataFrame(held.items(), columns=["word", "n"]).astype({"word": "object", "n": "int64"})

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def _padded(word: str) -> str:
    return PAD * (Q - 1) + word + PAD * (Q - 1)


def _grams(word: str) -> list[str]:
    p = _padded(word)
    return [p[i : i + Q] for i in range(len(p) - Q + 1)]


def letter_pairs(words: DataFrame) -> dict[str, int]:
    """How common each pair of adjacent letters is, on a scale of whole numbers. At most the square of the alphabet."""
    padded = F.concat(F.lit(PAD), F.col("word"), F.lit(PAD))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(2)))).alias("pair"))
    return {r["pair"]: round(1000 * math.log2(r["count"])) for r in pairs.groupBy("pair").count().collect()}


def rarest_grams(word: str, common: dict[str, int]) -> list[int]:
    """Places of the Q + 1 grams of the padded word that come first in the order all words share: rare letter pairs, then the gram."""
    p = _padded(word)
    pair = [common.get(p[i : i + 2], 1 << 20) for i in range(len(p) - 1)]
    grams = [(sum(pair[i : i + Q - 1]), p[i : i + Q], i) for i in range(len(p) - Q + 1)]
    return [i for _, _, i in sorted(grams)[: Q + 1]]


def postings(words: DataFrame, common) -> DataFrame:
    """(at, length, word, n): where each word is indexed (length: its own) and where it asks for longer ones (one more). ``at`` hashes gram and place."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for word, n in zip(b["word"], b["n"], strict=True):
                p, size = _padded(word), len(word)
                for k, i in enumerate(rarest_grams(word, common.value)):
                    gram = p[i : i + Q]
                    rows.append((gram, i, size, word, n))
                    if k < Q:  # a word has one gram less than a longer one, so one less is left out of what comes first
                        rows += [(gram, i, size + 1, word, n), (gram, i + 1, size + 1, word, n)]
            yield pd.DataFrame(rows, columns=["gram", "place", "length", "word", "n"])

    return words.mapInPandas(post, "gram string, place int, length int, word string, n long").select(F.xxhash64("gram", "place").alias("at"), "length", "word", "n")


def merged(lists: list[list[int]], least: int) -> Iterator[int]:
    """Candidates for occurring in at least ``least`` of the ascending lists, in order, each once.

    Such a number is in one of any ``len(lists) - least + 1`` lists: the shortest are merged, by a heap over their heads.
    """
    short = sorted(lists, key=len)[: max(0, len(lists) - least + 1)]
    if len(short) == 1:
        yield from short[0]
        return
    heap, at = [(x[0], i) for i, x in enumerate(short)], [1] * len(short)
    heapify(heap)
    last = -1
    while heap:
        number, i = heap[0]
        if at[i] < len(short[i]):
            heapreplace(heap, (short[i][at[i]], i))
            at[i] += 1
        else:
            heappop(heap)
        if number != last:
            yield number
            last = number


def one_edit(short: str, long: str) -> bool:
    """Whether the words, the shorter first, are one replaced or one further code point apart."""
    for i, c in enumerate(short):
        if c != long[i]:
            return short[i + (len(short) == len(long)) :] == long[i + 1 :]
    return len(long) == len(short) + 1


class Posting:
    """The words of one posting that are indexed, by their grams and places; ``length`` is theirs."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.words: list[tuple[str, int]] = []
        self.grams: list[list[str]] = []
        self.index: list[dict[str, list[int]]] = [{} for _ in range(length + Q - 1)]  # by place

    def add(self, word: str, n: int) -> None:
        grams, k = _grams(word), len(self.words)
        for at, gram in zip(self.index, grams, strict=True):
            at.setdefault(gram, []).append(k)
        self.words.append((word, n))
        self.grams.append(grams)

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Indexed words one edit from this one, which is as long or one code point shorter."""
        grams, index, lists, shorter = _grams(word), self.index, [], len(word) < self.length
        least, spare = self.length - 1, Q - shorter  # grams that have to occur, and those that need not
        for i, gram in enumerate(grams):
            here = index[i].get(gram)
            if shorter and (later := index[i + 1].get(gram)):
                here = sorted({*here, *later}) if here else later
            if here:
                lists.append(here)
            elif spare:
                spare -= 1
            else:
                return
        for k in merged(lists, least):
            shared = sum(map(eq, grams, self.grams[k]))
            if shorter and shared < least:
                shared += sum(map(eq, grams, islice(self.grams[k], 1, None)))
            if shared >= least and one_edit(word, self.words[k][0]):
                yield self.words[k]


def near_pairs(rows: Iterator[tuple]) -> Iterator[tuple[str, int, str, int]]:
    """Pairs (word, n, near, near_n) of rows (key, word, n, home) that come by key, the indexed words (home) of each first, in order."""
    now, posting = None, None
    for key, word, n, home in rows:
        if key != now:
            now, posting = key, Posting(key[1])
        if posting.words:
            for other, other_n in posting.near(word):
                if home or len(word) < posting.length or word < other:  # of two blocks, the greater word's finds the pair
                    yield word, n, other, other_n
        if home:
            posting.add(word, n)


def links(scratch: Scratch, words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words (word, n) that are one edit apart, once."""
    common = scratch.spark.sparkContext.broadcast(letter_pairs(words))
    posted = scratch.save(postings(words, common), "postings")
    key = ["at", "length"]
    sizes = posted.groupBy(*key).agg(F.count("*").alias("size"), F.count_if(F.length("word") == F.col("length")).alias("homes"))
    # A posting of one word, or of words that only ask, pairs nothing; most are so. Larger ones say into how many blocks they go.
    wanted = sizes.where("size > 1 AND homes > 0").select(*key, F.ceil(F.col("homes") / BLOCK).cast("int").alias("blocks"))
    dealt = posted.join(wanted, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    home = (F.length("word") == F.col("length")) & (F.pmod(F.xxhash64("word"), F.col("blocks")) == F.col("block"))
    key = [*key, "block"]
    dealt = dealt.select(*key, "word", "n", home.alias("home"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = (tuple(b[c].tolist() for c in (*key, "word", "n", "home")) for b in batches)
        rows = ((r[:3], *r[3:]) for columns in lists for r in zip(*columns, strict=True))
        pairs = near_pairs(rows)
        while part := list(islice(pairs, 10_000)):
            yield pd.DataFrame(part, columns=["a", "a_n", "b", "b_n"])

    parts = max(1, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.repartition(parts, *key).sortWithinPartitions(*key, F.col("home").desc(), "word")
    found = rows.mapInPandas(find, "a string, a_n long, b string, b_n long")
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    out = scratch.save(found.select(pick("a", "b"), pick("a_n", "b_n"), pick("b", "a"), pick("b_n", "a_n")).distinct(), "links")
    scratch.drop("postings")
    common.destroy()
    return out


def variants(words: DataFrame, dominance: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root of distinct words (word, n). A form is the most frequent near word, ``dominance`` times as frequent at least."""
    scratch = Scratch(words.sparkSession)
    words = scratch.save(words, "words")
    pairs = links(scratch, words)
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near")).alias("s"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("near")).alias("s")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("s").alias("s"))
    formed = (-F.col("s.less")) >= dominance * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("s.near")).alias("form"), F.when(formed, -F.col("s.less")).alias("form_n"))
    out = scratch.save(out, "formed")
    up, k, moving = scratch.save(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "up0"), 0, True
    while moving:
        k += 1
        above = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = scratch.save(up.join(above, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"up{k}")
        moving = not step.where("moved").isEmpty()
        up = step.select("word", "root")
        scratch.drop(f"up{k - 1}")
    return out.join(up, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


_CRC = """xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)]), 4294967295::BIGINT))"""
SQL = f"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
run AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
coded AS (SELECT w, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END)) AS bytes FROM run),
hashed AS (SELECT w, n, {_CRC} AS h FROM coded, crc),
word AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, CAST(i AS BIGINT)) || substr(word, CAST(i AS BIGINT) + 2) AS v FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN word b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN word b ON a.v = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'less': -near_n, 'near': near}}) AS s FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -s.less >= 2 * n THEN s.near END AS form, CASE WHEN -s.less >= 2 * n THEN -s.less END AS form_n FROM word LEFT JOIN best USING (word)),
up(word, root, depth) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT up.word, f.form, depth + 1 FROM up JOIN formed f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root FROM formed f JOIN (SELECT word, arg_max(root, depth) AS root FROM up GROUP BY word) r USING (word)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
