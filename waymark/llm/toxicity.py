"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of a seed lexicon and of a lexicon learnt from labels (words, and stems of five letters), the rate of
lexicon hits near a second-person pronoun, capitals, punctuation, and obfuscated words (digits or symbols in a word) with
the hits that they hide. Nothing but the text is an input of a score.

Labels are learnt from rows whose crc32(doc_id as text) mod 4 is not 2. Those rows are dealt into three disjoint parts by
the rest of that number: half give the lexicon, a quarter each the trees and the calibration, so no fit sees features
that were made from its own labels. Each part takes at most about ``fit_rows`` labelled rows, chosen by a hash of the id.
Their texts are written once; beyond that, documents are read for scoring only.

A null text counts as empty, and an empty text is scored as any other, labelled or not. A null id is in no fold but the
first. Rows that repeat an id are scored each; of repeated labels the largest counts. Without labels of both classes the
score is 1 - exp(-hits of the seed lexicon). An empty table gives an empty result. A long text is worked on whole, in one
task. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

FIT_ROWS, LEXICON, THRESHOLD, NEAR, STEM = 20_000, 400, 0.3, 5, 5
#: Common English insults, and second-person pronouns of the corpus languages.
SEEDS = ("idiot", "stupid", "moron", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "fool", "dumb", "ugly", "jerk", "hate")
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti usted ustedes vosotros su".split())
#: Characters that stand for letters in obfuscated words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
_EDGE = ".,;:!?\"'()[]{}<>%#&*-_/\\|~`+=…«»“”„’"
_MIXED = re.compile(r"[^\W\d_]+(?:[0-9@$!|*._\-]+[^\W\d_]+)+|[0-9@$]+[^\W\d_]+|[^\W\d_]+[0-9@$]+(?=\W|$)")
_JOINERS = re.compile(r"[*._\-]+")


#: Marks after which a word of letters is plain; none of them can be inside an obfuscated word's end.
_AFTER = ".,;:!?\"')]}"


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w]


def obfuscated(tokens: list[str]) -> list[str]:
    """Words with digits or symbols between letters or at their ends; tokens of letters, the most by far, are not searched."""
    odd = [t for t in tokens if not t.rstrip(_AFTER).isalpha()]
    return _MIXED.findall(" ".join(odd)) if odd else []


def features_of(text: str, lexicon: frozenset, stems: frozenset) -> list[float]:
    """The dense features of one text."""
    words = words_of(text)
    n, chars = max(1, len(words)), max(1, len(text))
    vocabulary = set(words)
    seed_hits, learnt = vocabulary.intersection(SEEDS), vocabulary & lexicon
    stemmed = {w for w in vocabulary if w[:STEM] in stems and len(w) >= STEM} if stems else set()
    hits = seed_hits | learnt | stemmed
    counts = Counter(w for w in words if w in hits) if hits else {}
    close = 0
    if hits and not vocabulary.isdisjoint(SECOND_PERSON):
        you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        for i in (i for i, w in enumerate(words) if w in hits):
            at = np.searchsorted(you, i)
            close += any(abs(int(you[j]) - i) <= NEAR for j in (at - 1, at) if 0 <= j < len(you))
    mixed = obfuscated(text.lower().split())
    plain = [_JOINERS.sub("", m.translate(LEET)) for m in mixed]
    hidden = sum(p in lexicon or p in SEEDS for p in plain)
    total = lambda s: float(sum(counts[w] for w in s)) if s else 0.0
    upper = len(re.findall(r"\b[^\W\d_a-zß-öø-ÿ]{2,}\b", text))
    return [
        total(seed_hits) / n, math.log1p(total(seed_hits)), total(learnt) / n, math.log1p(total(learnt)), total(stemmed) / n,
        math.log1p(total(stemmed)), close / n, upper / n, (text.count("!") + text.count("?")) / chars,
        sum(map(text.count, _EDGE)) / chars, len(mixed) / n, math.log1p(hidden), math.log1p(len(words)), len(vocabulary) / n,
    ]


def feature_column(text: Column, lexicon: frozenset = frozenset(), stems: frozenset = frozenset()) -> Column:
    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features_of(t, lexicon, stems))

    return features(text)


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


#: What each of the eight parts of the labelled rows is for.
LEXICON_PARTS, TREE_PARTS, CALIBRATION_PARTS = (0, 1, 2, 3), (4, 5), (6, 7)


def part_of(id_col: str = "doc_id") -> Column:
    """The part, 0 to 7, of a labelled row; independent of ``fold``."""
    return F.floor(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) / 4) % 8


def _sample(labels: DataFrame, fit_rows: int) -> DataFrame:
    """doc_id, label, use: at most about ``fit_rows`` labelled rows for each use, by a hash of the id."""
    use = F.when(F.col("part").isin(*LEXICON_PARTS), "lexicon").when(F.col("part").isin(*TREE_PARTS), "trees").otherwise("calibration")
    rows = labels.where(fold() != 2).withColumn("part", part_of()).select("doc_id", "label", use.alias("use"))
    share = F.lit(1.0)
    for r in rows.groupBy("use").count().collect():  # three rows
        share = F.when(F.col("use") == r["use"], fit_rows / r["count"]).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < share * (1 << 20))


def learn_lexicon(labelled: DataFrame, size: int = LEXICON, least: int = 4, scratch: Scratch | None = None) -> tuple[frozenset, frozenset]:
    """Words and stems whose document frequencies tell label 1 from 0, at most ``size`` of each. ``labelled``: text, label."""
    scratch = scratch or Scratch(labelled.sparkSession)

    def counted(batches):
        for b in batches:
            n = {0: Counter(), 1: Counter()}
            for text, label in zip(b["text"], b["label"], strict=True):
                seen = set(words_of(text))
                n[label].update({f"w{w}" for w in seen} | {f"s{w[:STEM]}" for w in seen if len(w) >= STEM})
            both = list(n[0].keys() | n[1].keys())
            if both:  # texts without words have no terms
                yield pd.DataFrame({"term": both, "n1": [n[1][t] for t in both], "n0": [n[0][t] for t in both]})

    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    p, q = totals.get(1, 0), totals.get(0, 0)
    terms = labelled.select("text", "label").mapInPandas(counted, "term string, n1 long, n0 long")
    terms = terms.groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") >= least)
    odds = F.log((F.col("n1") + 0.5) / (p + 1.0)) - F.log((F.col("n0") + 0.5) / (q + 1.0))
    z = odds / F.sqrt(1.0 / (F.col("n1") + 0.5) + 1.0 / (F.col("n0") + 0.5))
    terms = terms.withColumn("odds", odds).withColumn("z", z).where((F.col("odds") >= math.log(6.0)) & (F.col("z") >= 2.5))
    terms = scratch.save(terms.select("term", "z"), "terms")
    found = {}
    for kind in "ws":
        best = terms.where(F.col("term").startswith(kind)).orderBy(F.col("z").desc(), "term").limit(size).collect()
        found[kind] = frozenset(r["term"][1:] for r in best)
    return found["w"], found["s"]


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, carry: list[str] | None = None
) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.3), and ``row`` (struct of the columns in ``carry``)."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), *([F.struct(*carry).alias("row")] if carry else []))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    # The sample is bounded by fit_rows, so it is broadcast; the scan's own tasks write its texts.
    sample = scratch.save(rows.select("doc_id", "text").join(F.broadcast(_sample(known, fit_rows)), "doc_id"), "sample")
    lexicon, stems = learn_lexicon(sample.where("use = 'lexicon'"), scratch=scratch)
    wide = sample.where("use <> 'lexicon'").select("use", F.col("label").cast("double").alias("label"), feature_column(F.col("text"), lexicon, stems).alias("f"))
    wide = scratch.save(wide, "features")
    fit = lambda use: scratch.save(wide.where(F.col("use") == use).coalesce(4), use).select("label", array_to_vector("f").alias("features"))
    trees, rest = fit("trees"), fit("calibration")
    scored = rows.withColumn("f", feature_column(F.col("text"), lexicon, stems))
    if min(x.select("label").distinct().count() for x in (trees, rest)) < 2:
        score = 1.0 - F.exp(1.0 - F.exp(F.get("f", F.lit(1))))
    else:
        model = GBTClassifier(maxIter=25, maxDepth=4, stepSize=0.2, minInstancesPerNode=4, maxBins=64, seed=7).fit(trees)
        raw = lambda df: model.transform(df).withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        level = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw(rest).select("raw", "label"))
        scored = level.transform(raw(scored.withColumn("features", array_to_vector("f"))))
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.998 * F.col("prediction") + 0.002 * F.col("raw")))  # keeps the trees' order in a step
    return scored.select(
        "doc_id", (fold() == 2).alias("held_out"), score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"), *(["row"] if carry else [])
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
