"""Lexical search, spelling variants and best-fit packing against plain versions, on odd rows and on hot keys."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import best_fit, lexical, spelling
from waymark.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_search(docs, items, k):
    held = [(d, Counter(plain_terms(t))) for d, t in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        asked = Counter(plain_terms(text))
        scores = []
        for d, c, size in held:
            m = 75 + (25 * size * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, q in asked.items() if w in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if gone else d, -s) for r, (s, gone, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("group_terms", [200_000, 20])
def test_search_equals_plain_scores(spark, odd, monkeypatch, group_terms):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["été", "ÉTÉ", "x_y", "don't", "İ"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(150)] + [(7, "w1 w2"), (None, "w1 w2"), (None, "w1 w2"), (500, None), (501, ""), (502, "...")]
    rows += [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = [(1, "w1 W1 w2 nowhere"), (1, "w3"), (2, None), (3, "  "), (None, "été ÉTÉ x y"), (4, "plain words here"), (5, " ".join(words) * 3)]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("doc_id", F.lit("clash")).withColumn("row", F.lit("clash"))
    got = lexical.search(docs.withColumn("n", F.lit("clash")), items, k=6, group_terms=group_terms)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(rows, asked, 6)


def test_search_takes_odd_and_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "a row stands here")], "item_id long, text string")
    assert lexical.search(odd, items).count() > 0
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0


def test_blocks_hold_each_document_once_and_radix_order_is_stable(monkeypatch):
    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000) // 7 * 7 % (1 << 36)
    assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexical.radix_order(np.array([], "int64"))) == 0
    monkeypatch.setattr(lexical, "BLOCK", 10)
    sizes = np.array([3, 3, 3, 3, 50, 0, 0, 9, 2])
    ranges = list(lexical._blocks(sizes))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(9)) and all(b - a == 1 or sizes[a:b].sum() <= 10 for a, b in ranges)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, dominance=2):
    out = {}
    for w, n in words.items():
        close = [(-m, v) for v, m in words.items() if v != w and near(w, v)]
        best = min(close, default=None)
        form = best[1] if best and -best[0] >= dominance * n else None
        out[w] = [w, n, len(close), form, words[form] if form else None, w]
    for w, row in out.items():
        while out[row[5]][3]:
            row[5] = out[row[5]][3]
    return sorted(map(tuple, out.values()), key=repr)


@pytest.mark.parametrize("block", [2000, 7])
def test_variants_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)  # 7: postings go in many blocks
    rng = random.Random(3)
    words = {"".join(rng.choices(letters, k=rng.randint(3, 9))): rng.randint(3, 40) for letters in ("ab", "aé", "abcdefgh") for _ in range(250)}
    stems = ["interstellar", "aaaaaaaaaaaa", "überÿgang"]
    for s in stems:
        for i in range(len(s)):
            words[s[:i] + s[i + 1 :]] = rng.randint(3, 9)
            words[s[:i] + "z" + s[i + 1 :]] = rng.randint(3, 90)
            words[s[:i] + "y" + s[i:]] = 3
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = spelling.variants(df).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_variants(words)


def test_words_are_counted_as_plain_code_does(spark, odd, empty):
    want = Counter()
    for r in odd.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    for shortest, fewest in ((2, 1), (5, 3)):
        got = {r["word"]: r["n"] for r in spelling.word_counts(odd, shortest=shortest, fewest=fewest).collect()}
        assert got == {w: n for w, n in want.items() if len(w) >= shortest and n >= fewest}
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    assert spelling.variants(spelling.word_counts(odd)).count() > 0


def test_a_heap_merges_lists_as_counting_does():
    rng = random.Random(8)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 12))) for _ in range(rng.randint(0, 8))]
        least = rng.randint(1, 5)
        count = Counter(x for part in lists for x in part)
        got = list(spelling.merged(lists, least))
        assert got == sorted(set(got)) and {x for x, n in count.items() if n >= least} <= set(got) <= set(count)


def test_links_are_found_once(spark):
    words = spark.createDataFrame([("house", 9), ("hause", 3), ("houses", 4), ("horse", 5)], "word string, n long")
    got = sorted(map(tuple, spelling.links(Scratch(spark), words).collect()))
    assert got == [("hause", 3, "house", 9), ("horse", 5, "house", 9), ("house", 9, "houses", 4)]


def plain_sum_of_squares(lengths, size):
    """Bins as a list; each placement tries every gap that an open bin has and adds up the squares anew."""
    gaps, placed = [], []
    for s in lengths:
        best = None
        for h in sorted({g for g in gaps if g >= s}):
            n = Counter(g for g in gaps if g > 0)
            n[h] -= 1
            if h > s:
                n[h - s] += 1
            cost = sum(v * v for v in n.values())
            if best is None or cost < best[0]:
                best = (cost, h)
        gaps.append(size) if best is None else None
        h = size if best is None else best[1]
        gaps[gaps.index(h)] = h - s
        placed.append(h)
    return len(gaps), placed


def test_sum_of_squares_takes_the_gap_that_adding_up_anew_takes():
    rng = random.Random(2)
    for _ in range(20):
        lengths = sorted((rng.choice([5, 7, 9, 20, 33, 64]) if rng.random() < 0.5 else rng.randint(1, 64) for _ in range(120)), reverse=rng.random() < 0.5)
        bins, offsets = best_fit.sum_of_squares(np.array(lengths), 64)
        n, gaps = plain_sum_of_squares(lengths, 64)
        assert bins.max() + 1 == n and (64 - offsets).tolist() == gaps


@pytest.mark.parametrize("shard_pieces", [50_000, 5])
def test_best_fit_places_every_token_once(spark, odd, shard_pieces):
    from waymark.llm.packing import tokenizer_path
    from waymark.llm.tokens import tokenizer

    size = 500
    rows = [r.asDict() for r in best_fit.pack_best_fit(odd, tokenizer_path(), size, shard_pieces=shard_pieces).collect()]
    want = Counter()
    for r in odd.collect():
        ids = np.append(tokenizer(tokenizer_path()).encode([r["text"] or ""])[0], 1).astype("<u4")
        for i in range(0, len(ids), size):
            part = ids[i : i + size]
            want[r["doc_id"], i // size, i, len(part), zlib.crc32(part.tobytes()), part.tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= size
    total = sum(r["length"] for r in rows)
    assert len(held) <= -(-total // size) + 1 + len(rows) // shard_pieces


def test_best_fit_takes_empty_tables(empty):
    from waymark.llm.packing import tokenizer_path

    assert best_fit.pack_best_fit(empty, tokenizer_path()).count() == 0
