"""Quality classifier by co-training: text content and page metadata teach each other.

Two logistic models see a document differently. The text view has rates of the whole text (symbols, capitals, bars,
digits, word lengths, repetition, line shape); the page view has what is known beside it (source and language hashed to
slots, length as recorded). Both start from labelled rows. In each round each is calibrated on rows of its own, and the
unlabelled rows that it is sure of (calibrated probability at most ``sure`` from 0 or 1) are given with that label to the
other's training rows. A view that is never sure gives none. Last, one logistic model over both calibrated margins scores
every document.

Labels are learnt from rows whose crc32(doc_id as text) mod 4 is not 2: 1 and 3 train, 0 calibrates. ``fit_rows``
bounds the labelled rows of each part, chosen by a hash of the id. Every unlabelled row is scored in each round, and all that
a view is sure of teach the other. The views of every document are written once and read again for fits and scores.

A null text counts as empty and is scored as any other; null source or language is a value of its own. Rows that repeat
an id are each scored; of repeated labels the largest counts. Without labels of both classes every score is the labels'
mean, or 0.5 without labels. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small, text_or_empty
from .toxicity import fold

FIT_ROWS, ROUNDS, SURE, SLOTS, THRESHOLD, BROADCAST_LABELS = 20_000, 3, 0.05, 32, 0.5, 400_000
_SYMBOLS = re.compile(r"[#$%&*@^~=<>\\{}\[\]+]")
_VOWELS = frozenset("aeiouyäöüáéíóúàèùâêîôûœæ")


def text_features(text: str) -> list[float]:
    """The text view of one text."""
    words, chars = text.split(), max(1, len(text))
    n = max(1, len(words))
    lines = text.split("\n")
    kept = [x for x in lines if x.strip()]
    count, letters = Counter(words), sum(map(str.isalpha, text))
    pairs = set(zip(words, words[1:], strict=False))
    lengths = [len(w) for w in words]
    spread = math.sqrt(sum(x * x for x in lengths) / n - (sum(lengths) / n) ** 2) if words else 0.0
    return [
        len(_SYMBOLS.findall(text)) / n, text.count("|") / n, text.count("!") / n, text.count("?") / n, sum(map(text.count, ".,;:")) / n,
        sum(map(str.isupper, text)) / max(1, letters), sum(w.isupper() and len(w) > 1 for w in words) / n, sum(map(str.isdigit, text)) / chars,
        letters / chars, sum(lengths) / n, spread, len(count) / n, max(count.values(), default=0) / n, len(pairs) / n,
        1 - len(set(kept)) / max(1, len(kept)), math.log1p(len(words) / max(1, len(lines))), sum(x.rstrip()[-1] in ".!?" for x in kept) / max(1, len(kept)),
        sum(c in _VOWELS for c in text.lower()) / max(1, letters), math.log1p(len(words)), float(not words),
    ]


def _text_view(text: str) -> Column:
    @F.pandas_udf("array<double>")
    def view(texts: pd.Series) -> pd.Series:
        return texts.map(text_features)

    return view(text)


def _page_view(columns: list[str], source_col: str, lang_col: str, chars_col: str) -> Column:
    """Hashed slots of source and language, and the recorded length."""
    parts = []
    for c in (source_col, lang_col):
        if c in columns:
            slot = F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(SLOTS))
            parts += [F.when(slot == i, 1.0).otherwise(0.0) for i in range(SLOTS)]
    if chars_col in columns:
        size = F.greatest(F.coalesce(F.col(chars_col).cast("double"), F.lit(0.0)), F.lit(0.0))
        parts += [F.log1p(size), F.log1p(size) * F.log1p(size) / 10, F.when(F.col(chars_col).isNull(), 1.0).otherwise(0.0)]
    return F.array(*parts, F.lit(0.0))


def _dot(view: str, model) -> Column:
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
    return F.aggregate(F.zip_with(view, weights, lambda a, b: a * b), F.lit(float(model.intercept)), lambda s, x: s + x)


def _fit(rows: DataFrame, features: Column):
    return LogisticRegression(maxIter=40, regParam=1e-3).fit(rows.select(F.col("label").cast("double").alias("label"), array_to_vector(features).alias("features")))


def _margin(view: str, train: DataFrame, held: DataFrame) -> Column:
    """The calibrated log-odds that the view gives."""
    raw = _dot(view, _fit(train, F.col(view)))
    platt = _fit(held, F.array(raw))
    return F.lit(float(platt.coefficients[0])) * raw + F.lit(float(platt.intercept))


def _probability(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(margin, F.lit(-40.0)), F.lit(40.0))))


def co_train(train: DataFrame, held: DataFrame, free: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> tuple[Column, Column, Column]:
    """Calibrated margins of the text and the page view, and of both. Tables: t, p (arrays), and label but for ``free``."""
    edge = math.log((1 - sure) / sure)
    train = train.select("t", "p", "label")
    rows = {"t": train, "p": train}
    margins = {v: _margin(v, train, held) for v in rows}
    for _ in range(rounds):
        taught = {}
        for v, other in (("t", "p"), ("p", "t")):
            told = free.withColumn("_m", margins[v]).where(F.abs("_m") >= edge)
            told = told.select("t", "p", F.when(F.col("_m") > 0, 1).otherwise(0).alias("label"))
            taught[other] = train.unionByName(told)
        rows = taught
        margins = {v: _margin(v, rows[v], held) for v in rows}
    both = _fit(held, F.array(margins["t"], margins["p"]))
    joint = F.lit(float(both.coefficients[0])) * margins["t"] + F.lit(float(both.coefficients[1])) * margins["p"] + F.lit(float(both.intercept))
    return margins["t"], margins["p"], joint


def _chosen(name: str, part: float) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(name)), F.lit(1 << 20)) < int(min(1.0, part) * (1 << 20))


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", source_col: str = "source", lang_col: str = "lang",
    chars_col: str = "n_chars", fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, sure: float = SURE,
) -> DataFrame:
    """doc_id, held_out, text_score, page_score, score (0 to 1) and predicted (score >= 0.5)."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), _page_view(docs.columns, source_col, lang_col, chars_col).alias("p"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    known = scratch.save(known.groupBy("doc_id").agg(F.max("label").alias("label")), "known")
    seen = known.where(fold() != 2)
    n = {r["f"]: r["n"] for r in seen.groupBy((fold() == 0).alias("f")).agg(F.count("*").alias("n")).collect()}
    part = F.when(fold() == 0, _chosen("fit", fit_rows / max(1, n.get(True, 0)))).otherwise(_chosen("fit", fit_rows / max(1, n.get(False, 0))))
    sample = seen.where(part)  # bounded by fit_rows, so it is broadcast
    views = scratch.save(rows.select("doc_id", _text_view("text").alias("t"), "p"), "views")
    fitted = scratch.save(views.join(F.broadcast(sample), "doc_id"), "fitted")
    train, held = (scratch.save(fitted.where(c).coalesce(4), name) for c, name in ((fold() != 0, "train"), (fold() == 0, "held")))
    classes = [x.select("label").distinct().count() for x in (train, held)]
    if min(classes) < 2:
        level = fitted.agg(F.avg("label")).first()[0]
        margins = [F.lit(0.0 if level is None else math.log((level + 1e-9) / (1 - level + 1e-9)))] * 3
    else:
        free = scratch.save(views.join(small(known.select("doc_id"), BROADCAST_LABELS), "doc_id", "left_anti").select("t", "p"), "free")
        margins = co_train(train, held, free, rounds, sure)
        scratch.drop("free")
    t, p, score = (_probability(m) for m in margins)
    scored = views.select("doc_id", t.alias("text_score"), p.alias("page_score"), score.alias("score"))
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "text_score", "page_score", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
