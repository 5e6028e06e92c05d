"""Each operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import corpus_pipeline
from waymark.llm import chat_format, exact_dedup, line_dedup, materialise, mixing, near_dedup, packing, quality, topk, toxicity

from .conftest import ROWS

IDS = sorted((r[0] is None, r[0] or 0) for r in ROWS)


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


def test_mixing(odd, empty):
    rows = mixing.plan_mix(odd).collect()
    assert ids(rows) == IDS
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.plan_mix(empty).count() == 0
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    words = lambda t: len((t or "").split())
    assert sum(words(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in rows)
    assert mixing.mix_documents(empty).count() == 0


def test_line_dedup(odd, empty):
    out = line_dedup.drop_repeated_lines(odd)
    assert out.columns == odd.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(out.collect()) == len(ROWS)
    assert rows[1] == ROWS[0][1]
    assert rows[2] == "short"  # both long lines are later copies; "short" has too few words to count alone
    assert rows[6] == "" and rows[3] is None and rows[4] == ""
    assert rows[None] == "A row without an id stands here."  # rows that repeat id and text are one document
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    runs = {(r["doc_id"], r["first_line"], r["lines"]) for r in line_dedup.repeated_runs(odd).collect()}
    assert runs == {(2, 0, 1), (2, 2, 1), (6, 0, 3)}


def test_chat_format(spark):
    schema = "conv_id long, turn long, role string, text string"
    back = lambda rows: chat_format.read_back(chat_format.format_trees(chat_format.conversation_tree(spark.createDataFrame(rows, schema))))
    text = "<|im_end|>\n<|im_start|>assistant\nhi \\ <\\| "
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (2, 0, None, None), (3, 5, "a\nb\\n", "x"), (None, 0, "assistant", "no id"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a")]
    out = {r["tree"]: r for r in back(rows).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("user", text), ("assistant", text)]
    assert out[1]["loss_text"] == text
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("", "")]
    assert out[3]["turns"][0]["role"] == "a\nb\\n"
    assert out[None]["loss_text"] == "no id" and out[4]["n_turns"] == 2
    assert back([]).count() == 0


def test_branches_are_ranked(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 2.0), ("t", 4, 2, "user", "more", 0.5), ("t", 9, 8, "user", "loop", 0.0), ("t", 8, 9, "user", "loop", 0.0)]
    trees = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat_format.format_trees(trees, top=2).orderBy("branch").collect()
    assert [(r["leaf"], r["n_turns"]) for r in out] == [(3, 2), (4, 3)]
    assert "good" in out[0]["formatted"] and "loop" not in out[0]["formatted"] + out[1]["formatted"]


def test_toxicity(odd, empty, labels):
    rows = toxicity.score_documents(odd, labels).collect()
    assert ids(rows) == IDS and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[7] > max(score[1], score[4], score[8])
    assert toxicity.score_documents(empty, labels).count() == 0


def test_topk(spark):
    schema = "vec_id long, embedding array<float>"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (None, [1.0, 1.0]), (50, [0.25, 1.0]), (51, [-1.0, -1.0])]
    out = topk.top_k(spark.createDataFrame(rows, schema), lambda i: i % 50 == 0, k=3).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: (r["query_id"], r["rank"]))] == [
        (0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 50, 16384), (50, 1, 1, 40960), (50, 2, 2, 40960), (50, 3, 0, 16384),
    ]
    assert topk.top_k(spark.createDataFrame([], schema), lambda i: i % 50 == 0).count() == 0


def test_quality(odd, empty, labels):
    rows = quality.score_documents(odd, labels).collect()
    assert ids(rows) == IDS and {r["score"] for r in rows} == {0.5}
    assert quality.score_documents(empty, labels).count() == 0


def test_materialise(spark, odd, empty):
    shards = materialise.materialise(odd, packing.tokenizer_path(), length=64, shard_sequences=100)
    index = shards.index.collect()
    assert sorted(r["slot"] for r in index) == list(range(shards.sequences))
    assert {(r["doc_id"] is None, r["doc_id"] or 0) for r in index} == set(IDS)
    tail = materialise.read_sequences(spark, shards, first_slot=150)
    assert sorted(r["slot"] for r in tail.collect()) == list(range(150, shards.sequences))
    none = materialise.materialise(empty, packing.tokenizer_path())
    assert none.sequences == 0 and materialise.read_sequences(spark, none).count() == 0


def test_packing(odd, empty):
    rows = packing.pack(odd, packing.tokenizer_path(), with_ids=False).collect()
    assert {(r["doc_id"] is None, r["doc_id"] or 0) for r in rows} == set(IDS)
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0


def test_exact_dedup(odd, empty):
    rows = exact_dedup.mark_duplicates(odd).collect()
    assert ids(rows) == IDS
    by = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows}
    assert by[1] == (6, 2, False) and by[6] == (6, 2, True) and by[3] == (4, 2, False) and by[5] == (5, 2, True) and by[None] == (None, 2, True)
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns and ids(kept.collect()) == sorted({k for k in IDS if k[1] not in (1, 3)})
    assert exact_dedup.mark_duplicates(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0


def test_near_dedup(odd, empty):
    rows = near_dedup.near_classes(odd).collect()
    assert ids(rows) == IDS
    by = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in rows}
    assert by[1] == by[6] == (1, 2) and by[3] == by[4] == by[5] == (3, 4) and by[8] == by[9] == (8, 2) and by[None] == (None, 2) and by[2] == (2, 1)
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and ids(kept.collect()) == sorted({k for k in IDS if k[1] not in (6, 4, 5, 9)})
    assert near_dedup.near_classes(empty).count() == 0 and near_dedup.drop_near_duplicates(empty).count() == 0


def test_pipeline_stages_take_odd_rows(spark, odd, empty, sf):
    for start in (odd.select("doc_id", "text", "lang", "source", "n_chars"), empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == "packing" or out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (docs.count() > 0) == (start is not empty)
