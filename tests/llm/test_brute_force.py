"""Operators against plain versions on small tables, round trips and held-out accuracy."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from waymark.llm import line_dedup, materialise, mixing, near_dedup, packing, quality, topk, toxicity
from waymark.llm.common import Scratch
from waymark.llm.tokens import tokenizer


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def plain_lines(docs: list[tuple[int, str]], least: int) -> dict[int, str]:
    """Every run of lines with enough words is looked up among all that begin earlier."""
    first: dict[tuple, tuple] = {}
    lines = {d: t.split("\n") for d, t in docs}
    gone = {d: set() for d, _ in docs}
    for d, _ in sorted(docs):
        ls = lines[d]
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                run = tuple(ls[i:j])
                if first.setdefault(run, (d, i)) != (d, i) and sum(len(x.split()) for x in run) >= least:
                    gone[d] |= set(range(i, j))
    return {d: "\n".join(x for i, x in enumerate(ls) if i not in gone[d]) for d, ls in lines.items()}


@pytest.mark.parametrize("seed", range(3))
def test_line_runs(spark, seed):
    r = random.Random(seed)
    made = [(d, "\n".join(" ".join(r.choice("abc") for _ in range(r.randint(0, 3))) for _ in range(r.randint(1, 12)))) for d in range(12)]
    made.append((12, made[3][1] + "\n" + made[5][1]))
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["text"] for x in out} == plain_lines(made, line_dedup.MIN_WORDS)


def links_of(texts: dict[int, str]) -> dict[int, int]:
    """Class of each text, by comparing all pairs with a plain longest common subsequence."""
    import re

    words = {d: re.sub(r"[^\w]+|_", " ", (t or "").lower()).split() for d, t in texts.items()}
    s = {d: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [] for d, w in words.items()}
    up = {d: d for d in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] == s[b] or (len(set(s[a]) & set(s[b])) >= 0.7 * max(len(set(s[a])), len(set(s[b]))) and (m := lcs(s[a], s[b])) >= 0.8 * (len(s[a]) + len(s[b]) - m) - 1e-9):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in ids}


def test_near_classes_on_documents(docs, texts):
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert found == links_of(texts)


def test_near_classes_of_a_chain_and_a_star(spark):
    """Copies that are like their original but less like one another, and chains of copies, are one class each."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]

    def edited(words, n):
        out = list(words)
        for i in r.sample(range(len(out)), n):
            out[i] = f"v{r.randrange(10**6)}"
        return out

    made, chain = [base], [f"c{r.randrange(10**6)}" for _ in range(300)]
    made += [edited(base, 5) for _ in range(40)]
    for _ in range(12):
        made.append(chain)
        chain = edited(chain, 4)
    made += [[f"u{r.randrange(10**6)}" for _ in range(200)] + base[:60] for _ in range(40)]
    texts = {i: " ".join(w) for i, w in enumerate(made)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = links_of(texts)
    assert {x["doc_id"]: x["class_id"] for x in near_dedup.near_classes(df).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_banded_alignment(seed):
    r = random.Random(seed)
    for _ in range(60):
        a = [r.randrange(8 if seed % 2 else 400) for _ in range(r.randint(1, 60))]
        b = [x for x in a if r.random() > 0.04] or [0]
        for i in r.sample(range(len(b)), min(len(b), r.randint(0, 3))):
            b[i] = r.randrange(400)
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
        m = row[-1]
        assert near_dedup.aligned(np.array(a, "uint64"), np.array(b, "uint64")) == (m >= 0.8 * (len(a) + len(b) - m) - 1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    x = np.arange(n)
    p = materialise.permuted(x, n)
    assert sorted(p) == list(x)
    assert n < 1000 or (materialise.permuted(x, n, key=1) != p).mean() > 0.9


def ids_of(text: str) -> list[int]:
    t = Tokenizer.from_file(packing.tokenizer_path())
    return [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_shards_round_trip(spark, docs, texts):
    shards = materialise.materialise(docs, packing.tokenizer_path(), length=128, shard_sequences=64)
    back = {r["slot"]: np.frombuffer(r["ids"], f"<u{shards.id_bytes}") for r in materialise.read_sequences(spark, shards).collect()}
    got: dict[int, list] = {}
    for r in shards.index.collect():
        ids = back.pop(r["slot"])
        assert len(ids) == 128 and not ids[r["length"] :].any()
        got.setdefault(r["doc_id"], []).append((r["start"], ids[: r["length"]].tolist()))
    assert not back
    assert {d: sum((p for _, p in sorted(v)), []) for d, v in got.items()} == {d: ids_of(t) for d, t in texts.items()}


def test_packing(docs, texts):
    rows = packing.pack(docs, packing.tokenizer_path()).collect()
    pieces: dict[int, list] = {}
    places: dict[int, list] = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], np.frombuffer(r["ids"], "<u4").tolist()))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
    for d, v in pieces.items():
        assert sum((ids for _, _, ids in sorted(v)), []) == ids_of(texts[d])
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert sorted(places) == list(range(len(places)))
    tokens = sum(r["length"] for r in rows)
    assert len(places) <= -(-tokens // packing.SEQUENCE) * 1.05 + 1


def test_tokenizer_cache_equals_library():
    r = random.Random(1)
    t = tokenizer(packing.tokenizer_path())
    pool = ["Hello,", "wörld!", "don't", "x1y2", "a-b", "İ", "ﬁn", "<|endoftext|>", "naïve.", "ZWJ‍", "½", "...", "ok?!", " ", "中文", "é", "O'Neill's", "1,000.5"]
    made = [" ".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(200)] + ["", "\n\n", "a b"]
    whole = Tokenizer.from_file(packing.tokenizer_path())
    for text, ids in zip(made, t.encode(made), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_mix_near_targets(docs):
    rows = mixing.plan_mix(docs).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(taken - target) <= 2 * mixing.BLOCK_WORDS + 0.02 * target for target, taken in by.values())
    again = mixing.plan_mix(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_topk_blocks(spark):
    r = np.random.default_rng(0)
    v = np.round(r.normal(size=(300, 12)), 2).astype("float32")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    w = np.floor(v.astype("float64") * 256).astype("int64")
    want = set()
    for q in range(0, 300, 3):
        s = sorted((-int(w[q] @ w[c]), c) for c in range(300) if c != q)[:5]
        want |= {(q, k, c, -x) for k, (x, c) in enumerate(s, 1)}
    got = topk.top_k(df, lambda i: i % 3 == 0, group_queries=30).collect()
    assert {tuple(r) for r in got} == want


@pytest.mark.parametrize("model, column, least", [(toxicity, "toxic", 0.97), (quality, "quality", 0.97)])
def test_held_out_accuracy(spark, model, column, least):
    d = "/root/testdata/sf0.1"  # the smaller tables hold some 15 toxic documents in the held-out fold, too few to tell
    rows = model.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("predicted", column).collect()
    assert sum(r["predicted"] == r[column] for r in rows) >= least * len(rows)


def test_co_training_uses_every_unlabelled_row(spark, docs, sf, monkeypatch):
    labels, seen = spark.read.parquet(f"{sf}/labels.parquet"), []
    plain = quality.co_train

    def spy(*tables, **more):
        free = next(x for x in tables if hasattr(x, "columns") and "label" not in x.columns)
        seen.append(free.count())
        return plain(*tables, **more)

    monkeypatch.setattr(quality, "co_train", spy)
    scores = quality.score_documents(docs, labels, fit_rows=60, rounds=1)
    assert scores.count() == docs.count()
    assert seen == [docs.join(labels, "doc_id", "left_anti").count()]


def test_toxicity_reads_texts_with_the_scan_s_own_tasks(spark, docs, sf, monkeypatch):
    plain, plans = Scratch.save, []

    def spy(self, df, name):
        plans.append(df._jdf.queryExecution().toString())
        return plain(self, df, name)

    monkeypatch.setattr(Scratch, "save", spy)
    toxicity.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    read = [p for p in plans if "documents.parquet" in p]
    assert len(read) == 1 and "Coalesce" not in read[0]  # the sample's texts, once; all else before the scores reads what was written


def test_held_out_labels_are_not_read(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = ({r["doc_id"]: round(r["score"], 9) for r in toxicity.score_documents(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_pipeline_equals_its_stages(spark, sf, docs):
    """Each stage's decisions, taken one after the other by plain code where it is plain."""
    toxic = {r["doc_id"] for r in toxicity.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    kept = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in toxic]
    stages = dict(corpus_pipeline.STAGES)
    first = stages["toxicity"](spark, docs, sf)
    assert {r["doc_id"] for r in first.collect()} == {d for d, _ in kept}
    second = stages["line_dedup"](spark, first, sf)
    lined = {r["doc_id"]: r["text"] for r in second.collect()}
    con = duckdb.connect()  # the operator's SQL over what the first stage kept
    con.register("documents", pa.table({"doc_id": [d for d, _ in kept], "text": [t for _, t in kept]}))
    cut = {d: (deleted, sha) for d, deleted, sha in con.execute(f"SELECT doc_id, deleted, kept_sha256 FROM ({line_dedup.SQL})").fetchall()}
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in lined.items()} == {d: sha for d, (deleted, sha) in cut.items() if d in lined}
    assert all(cut[d][0] for d in cut.keys() - lined.keys()) and len(lined) > 0.9 * len(cut)  # only texts that lost lines may go
    third = stages["near_dedup"](spark, second, sf)
    classes = links_of(lined)
    assert {r["doc_id"] for r in third.collect()} == set(classes.values())
    run = {(r["doc_id"], r["start"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in corpus_pipeline.run(spark, sf).collect()}
    fourth = stages["mixing"](spark, third, sf)
    words = sum(len(r["text"].split()) for r in fourth.collect())
    assert abs(words - 1.5 * sum(len(t.split()) for d, t in lined.items() if d in set(classes.values()))) <= 0.02 * words + 64 * 40
    assert run == {(r["doc_id"], r["start"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in stages["packing"](spark, fourth, sf).collect()}
