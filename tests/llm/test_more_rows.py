"""Odd rows with labels, large numbers, repeated ids, clashing columns and plain versions of what the operators work out."""

import math
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import chat_format, line_dedup, materialise, mixing, near_dedup, packing, quality, topk, toxicity
from waymark.llm.common import Scratch

from .test_brute_force import ids_of, links_of, plain_lines


@pytest.fixture(scope="module")
def labelled(spark):
    """Rows with both labels in every part, among them null, empty and punctuation-only texts, with clashing columns."""
    good, bad = "the river runs past the old mill and the field", "you are an idiot and a moron , you stupid clown"
    rows = [(i, f"{bad if i % 3 == 0 else good} {i % 7}", "en", f"s{i % 4}", 40 + i % 9) for i in range(400)]
    rows += [(400, None, "en", "s1", None), (401, "", None, None, 0), (402, "?!...", "en", "s1", 5), (403, " \n\t", "de", "s2", 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("label", "f", "features", "raw", "use", "part", "score", "t", "p", "row"):
        docs = docs.withColumn(name, F.lit("clash"))
    labels = [(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(400)] + [(400, 0, 0), (401, 0, 1), (402, 1, 0), (403, 0, 0), (403, 0, 1), (None, 1, 1), (999, 0, 1)]
    return docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_from_odd_rows(labelled):
    docs, labels = labelled
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == 408 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in rows if r["doc_id"] < 400) >= 396
    only = docs.where("doc_id >= 400")  # labelled rows without a single word
    assert only.count() == 8 and len(toxicity.score_documents(only, labels).collect()) == 8


def test_toxicity_parts_are_disjoint(spark):
    r = spark.range(4000).select(F.col("id").alias("doc_id"), toxicity.fold().alias("fold"), toxicity.part_of().alias("part")).collect()
    uses = [set(p) for p in (toxicity.LEXICON_PARTS, toxicity.TREE_PARTS, toxicity.CALIBRATION_PARTS)]
    assert set.union(*uses) == set(range(8)) and sum(map(len, uses)) == 8
    for part in range(8):
        assert {x["fold"] for x in r if x["part"] == part} == {0, 1, 2, 3}


def test_toxicity_features_by_plain_code():
    text = "You stupid loser! What a MORON, he said. st*pid you are; id1ot"
    got = toxicity.features_of(text, frozenset({"said"}), frozenset())
    words = [w.strip(toxicity._EDGE) for w in text.lower().split()]
    words = [w for w in words if w]
    seeds = [i for i, w in enumerate(words) if w in toxicity.SEEDS]
    hits = sorted(seeds + [words.index("said")])
    you = [i for i, w in enumerate(words) if w in ("you",)]
    assert got[0] == len(seeds) / len(words) and got[1] == math.log1p(len(seeds)) and got[2] == 1 / len(words)
    assert got[6] == sum(any(abs(i - y) <= toxicity.NEAR for y in you) for i in hits) / len(words)
    assert got[7] == 1 / len(words) and got[8] == 1 / len(text) and got[12] == math.log1p(len(words)) and got[13] == len(set(words)) / len(words)


def test_quality_learns_from_odd_rows(labelled):
    docs, labels = labelled
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == 408 and all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in rows)
    assert sum(r["predicted"] == (r["doc_id"] % 3 != 0) for r in rows if r["doc_id"] < 400) >= 396


def test_quality_margin_by_plain_code(spark):
    """A view's margin: a logistic fit, then a second fit of its output on other rows, applied to new rows."""
    rng = np.random.default_rng(3)
    made = [([float(a), float(b)], int(a - 2 * b + rng.normal() * 0.3 > 0)) for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(made, "t array<double>, label int")
    train, held = df.limit(200), df.subtract(df.limit(200))
    train, held = spark.createDataFrame(train.collect(), df.schema), spark.createDataFrame(held.collect(), df.schema)
    got = [r["m"] for r in held.select(quality._margin("t", train, held).alias("m")).collect()]
    model = quality._fit(train, F.col("t"))
    raw = [sum(w * x for w, x in zip(model.coefficients, r["t"], strict=True)) + model.intercept for r in held.collect()]
    platt = quality._fit(held.withColumn("raw", quality._dot("t", model)), F.array("raw"))
    assert got == pytest.approx([platt.coefficients[0] * x + platt.intercept for x in raw])


def _best(v, rows, queries, k):
    out = []
    for q in queries:
        s = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), rows[c][0]) for c in range(len(rows)) if c != q and len(v[c]) == len(v[q]))[:k]
        out += [(rows[q][0], i, c, -x) for i, (x, c) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 5000.0, 1e6])
def test_topk_of_large_components_and_repeated_ids(spark, size):
    rng = random.Random(4)
    rows = [(i % 90, [rng.uniform(-size, size) for _ in range(16)]) for i in range(120)] + [(50, [size, 1.0]), (3, [-size, 2.0]), (4, [size, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("id", "v", "row", "q", "rank", "score"):
        df = df.withColumn(name, F.lit("clash"))
    v = [[math.floor(256 * x) for x in e] for _, e in rows]
    want = _best(v, rows, [i for i, (vec, _) in enumerate(rows) if vec % 50 == 0], 4)
    got = topk.top_k(df.repartition(3), lambda i: i % 50 == 0, k=4).collect()
    assert sorted(tuple(r) for r in got) == want


def test_topk_beyond_a_long(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="is no long"):  # of 1 and 0
        topk.top_k(df, lambda i: i == 0).collect()
    with pytest.raises(Exception, match="is no long"):  # of 2 and 0, as too few others are left
        topk.top_k(df.where("vec_id <> 1"), lambda i: i == 0, k=2).collect()
    got = topk.top_k(df.where("vec_id <> 1"), lambda i: i == 0, k=1).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(3, 256 * 512)]


def test_topk_up_to_a_long(spark):
    """Scores between 2**62 and 2**63 are exact and told apart, those near -2**63 too, and giant components that meet zeros count 0."""
    big = 2**31.25 / 256
    rows = [(50, [big, 0.0]), (51, [big, 0.0]), (52, [big, 2.0**30 / 256]), (53, [-big, 0.0]), (54, [0.0, 1e300]), (55, [big * 0.999, 0.5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 50).orderBy("rank").collect()
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    want = sorted((-sum(a * b for a, b in zip(v[50], v[i], strict=True)), i) for i in v if i != 50)
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, -s) for s, i in want] and got[0]["score"] > 2**62
    assert got[0]["score"] == 6521908909838825889
    empty = spark.createDataFrame([(0, []), (1, []), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(empty, lambda i: i == 0).collect()] == [(0, 1, 1, 0)]


@pytest.mark.parametrize("seed", range(2))
def test_reply_trees_equal_plain_recursion(spark, seed):
    rng = random.Random(seed)
    rows = []
    for tree in range(6):
        for n in range(rng.randint(1, 25)):
            rows.append((tree, n, rng.randrange(n) if n and rng.random() < 0.9 else None, rng.choice(("user", "assistant")), f"t{tree} n{n} <|im_end|>", float(rng.randint(0, 3))))
    rows.append((9, 0, None, "user", "x" * 400_000, 0.0))
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    for name in ("leaf", "branch", "height", "total", "up", "formatted"):
        df = df.withColumn(name, F.lit("clash"))
    want = set()
    for tree in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == tree}
        paths = []
        for n in nodes:
            if not any(r[2] == n for r in nodes.values()):
                path = [n]
                while nodes[path[-1]][2] is not None:
                    path.append(nodes[path[-1]][2])
                paths.append((-sum(nodes[p][5] for p in path), n, len(path)))
        want |= {(tree, b, leaf, turns) for b, (_, leaf, turns) in enumerate(sorted(paths)[:3], 1)}
    out = chat_format.format_trees(df, top=3)
    assert {(r["tree"], r["branch"], r["leaf"], r["n_turns"]) for r in out.collect()} == want
    texts = {(r["tree"], r["text"]) for r in chat_format.read_back(out).select("tree", F.explode("turns.text").alias("text")).collect()}
    assert texts <= {(r[0], r[4]) for r in rows}


def test_slots_are_permuted_ranks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shards = materialise.materialise(docs, packing.tokenizer_path(), length=128, shard_sequences=64)
    keys = sorted((r["doc_id"], s, len(ids)) for r in docs.collect() for ids in [ids_of(r["text"])] for s in range(0, len(ids), 128))
    slots = materialise.permuted(np.arange(len(keys)), len(keys))
    want = {(d, s): int(slot) for (d, s, _), slot in zip(keys, slots, strict=True)}
    assert {(r["doc_id"], r["start"]): r["slot"] for r in shards.index.collect()} == want


@pytest.mark.parametrize("seed", range(5))
def test_packs_equal_plain_shortest_pack_first(seed):
    """The histogram form places every piece once and needs at most a twentieth more sequences than placing pieces one by one."""
    rng = random.Random(seed)
    size = rng.choice((8, 50, 2048))
    histogram = {n: rng.randint(1, 40) for n in rng.sample(range(1, size + 1), min(size, 30))}
    packs: list[int] = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fits = [s for s in packs if s + n <= size]
            if fits:
                packs[packs.index(min(fits))] += n
            else:
                packs.append(n)
    sums, placed = defaultdict(int), defaultdict(int)
    for n, rank, number, first, offset in packing.shortest_pack_first(histogram, size):
        for i in range(number):
            assert sums[first + i] <= offset + n <= size
            sums[first + i] = max(sums[first + i], offset + n)
            placed[n, rank + i] += 1
    assert set(placed) == {(n, i) for n, k in histogram.items() for i in range(k)} and set(placed.values()) == {1}
    assert sum(sums.values()) == sum(n * k for n, k in histogram.items())
    assert len(sums) <= len(packs) * 1.05 + 1


@pytest.mark.parametrize("lines", [["word"] * 100_000, [""] * 100_000 + ["five words are in here"], [f"line {i % 3000}" for i in range(100_000)]])
def test_lines_that_repeat_side_by_side(spark, lines):
    """A hundred thousand short or blank lines in one text, and again in another: work in proportion to them, in seconds."""
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["first line is told apart", *lines]))], "doc_id long, text string")
    began = time.monotonic()
    got = {r["doc_id"]: (r["_lines"], r["_deleted"], r["text"]) for r in line_dedup.drop_repeated_lines(df, report=True).collect()}
    assert time.monotonic() - began < 120
    assert got[2] == (len(lines) + 1, len(lines), "first line is told apart")
    assert got[1][0] == len(lines) and (lines[0] != "" or got[1][1] == 0)


def test_conversation_of_many_turns(spark):
    """Twenty thousand turns are written and read back in seconds."""
    said = [("user" if i % 2 == 0 else "assistant", f"turn {i} <|im_end|> " + "x" * 300) for i in range(20_000)]
    df = spark.createDataFrame([(1, i, r, x) for i, (r, x) in enumerate(said)], "conv_id long, turn long, role string, text string")
    began = time.monotonic()
    row = chat_format.read_back(chat_format.format_trees(chat_format.conversation_tree(df))).first()
    assert time.monotonic() - began < 60
    assert [(t["role"], t["text"]) for t in row["turns"]] == said and row["loss_text"] == "".join(x for r, x in said if r == "assistant")


def test_line_rebuild_is_exact(spark):
    lines = [f"line {i % 50} of a table that is long" if i % 3 else "" for i in range(30_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(reversed(lines)))], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(df).collect()}
    assert len(set(x for x in got[1].split("\n") if x)) == len([x for x in got[1].split("\n") if x])
    assert not [x for x in got[2].split("\n") if x]


def test_near_classes_under_a_large_hub(spark):
    """Many texts that share half of what they say with one hub are told apart, and the few pairs among them are found."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    made = []
    for i in range(150):
        own = [f"o{i}x{j}" for j in range(90)]
        made.append(base + own)
        if i % 10 == 0:
            made.append(base + own[:-2] + ["v1", "v2"])
    made += [base + [f"e{rng.randrange(9)}"] for _ in range(60)]
    texts = {i: " ".join(w) for i, w in enumerate(made)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {x["doc_id"]: x["class_id"] for x in near_dedup.near_classes(df).collect()} == links_of(texts)


def test_rows_without_an_id_are_dealt_to_all_shards(spark):
    rows = [(None if i % 3 else 7, "a", f"w{i} of a text") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = df.select("doc_id", "source", F.lit(4).cast("long").alias("size"), mixing.seeded(F.col("text")).alias("mark"))
    words = [r["words"] for r in mixing._quotas(Scratch(spark), sizes, (3, 1, 2), 1.5, 2, 64, 1000, "mix").collect()]
    assert len(words) == 16 and sum(words) == 16_000 and max(words) < 1400
    taken = mixing.plan_mix(df, shard_words=1000).collect()
    assert len(taken) == 4000 and abs(sum(r["taken"] for r in taken) - taken[0]["target"]) < 64 * 16


def test_mix_does_not_depend_on_the_order_of_equal_ids(spark):
    rng = random.Random(2)
    rows = [(i % 20, " ".join(f"{rng.randrange(10**6)}" for _ in range(40)), f"s{i % 3}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(r["text"] for r in mixing.mix_documents(x).collect()) for x in (df, df.orderBy(F.rand(3)).repartition(5)))
    assert a == b


@pytest.mark.parametrize("seed", range(3))
def test_seats_equal_plain_sainte_lague(spark, seed):
    rng = random.Random(seed)
    parties = [(g, i, float(rng.randint(0, 900)), total, rng.randint(0, 40)) for g, total in (("a", 200), (None, 37), ("c", 5)) for i in range(rng.randint(1, 30))]
    df = spark.createDataFrame(parties, "g string, id long, votes double, total long, most long")
    got = {(r["g"], r["id"]): r["seats"] for r in mixing.sainte_lague(Scratch(spark), df, ["g"], F.col("id"), "votes", "total", "most", "t").collect()}
    want = {}
    for g in {p[0] for p in parties}:
        rows = [p for p in parties if p[0] == g]
        quotients = sorted((-p[2] / (2 * k + 1), p[1]) for p in rows for k in range(p[4]))[: rows[0][3]]
        want |= {(g, p[1]): sum(i == p[1] for _, i in quotients) for p in rows}
    assert got == want


def test_pipeline_carries_clashing_columns(spark, odd, sf):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", *[c for c in ("rank", "node", "size", "row", "shard", "label", "score", "_text", "doc", "hash") if c in odd.columns])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert {r["node"] for r in docs.collect()} == {"clash"}


def test_line_stage_equals_plain_code_on_whole_texts(spark, sf):
    """No text is left out. The table's ids are unique."""
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(df).collect()} == plain_lines(docs, line_dedup.MIN_WORDS)


def test_pairs_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text, none of them like all others, are one class; pairs aligned follow the copies, not their square."""
    aligned_pairs, verified = [0], near_dedup._verified

    def counted(scratch, pairs, *more):
        aligned_pairs[0] += pairs.count()
        return verified(scratch, pairs, *more)

    monkeypatch.setattr(near_dedup, "_verified", counted)
    r, per_copy = random.Random(3), []
    base = [f"b{i}" for i in range(150)]
    texts = {}
    for size in (250, 1000):
        for i in range(len(texts), size):
            words = list(base)
            for at in r.sample(range(150), r.choice([1, 1, 2, 2, 3])):
                words[at] = f"v{r.randrange(10**6)}"
            texts[i] = " ".join(words)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
        aligned_pairs[0] = 0
        got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_classes(df).collect()}
        per_copy.append(aligned_pairs[0] / size)
        s = [near_dedup.shingles(t) for t in texts.values()]
        todo, seen = [0], {0}
        while todo:  # what is linked to the first, through any others
            x = todo.pop()
            new = [y for y in range(size) if y not in seen and near_dedup.aligned(s[x], s[y])]
            seen.update(new)
            todo += new
        assert len(seen) == size and set(got.values()) == {0}
    assert per_copy[1] < 1.5 * per_copy[0], per_copy


def _bytes_shuffled(plan) -> int:
    """Bytes that the exchanges of an executed plan took."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _bytes_shuffled(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return _bytes_shuffled(plan.plan())
    own = plan.metrics().apply("dataSize").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(_bytes_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_texts_that_lose_no_line_are_not_shuffled(spark):
    rng = random.Random(5)
    made = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(300))) for i in range(300)]
    made += [(1000 + i, f"own {i}\nthis line is in several texts") for i in range(5)]
    made += [(None, "no id\nthis line is in several texts"), (2000, None)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3).cache()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = line_dedup.drop_repeated_lines(df)
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        moved = _bytes_shuffled(out._jdf.queryExecution().executedPlan())
        assert moved < sum(len(t or "") for _, t in made) / 4, moved
        assert got[None] == made[-2][1] and got[2000] is None
        assert {d for d, t in made if got[d] != t} == {1000 + i for i in range(5)} and got[1003] == "own 3"
        every = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(df, marked=0).collect()}  # without a bitmap
        assert every == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        df.unpersist()


def test_components_are_told_to_members_not_to_their_shingles(spark, monkeypatch):
    """Pairs that share 60 of 210 words beyond a common text are no links; what is relabelled follows the texts, not those words."""
    told, relabelled = [], near_dedup._relabelled

    def counted(rows, merged):
        told.append(rows.count())
        return relabelled(rows, merged)

    monkeypatch.setattr(near_dedup, "_relabelled", counted)
    base, made = [f"b{i}" for i in range(120)], []
    for i in range(100):
        own = [f"o{i}x{j}" for j in range(90)]
        made += [base + own, base + own[:60] + [f"p{i}x{j}" for j in range(30)]]
    texts = {i: " ".join(w) for i, w in enumerate(made)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {x["doc_id"]: x["class_id"] for x in near_dedup.near_classes(df).collect()} == links_of(texts)
    assert 0 < max(told) < 4 * len(texts), told
