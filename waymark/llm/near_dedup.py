"""Near-duplicates by order MinHash, verified by banded alignment.

A text is compared as words: lower case, anything but letters and digits separates. Its shingles are five adjacent words
(fewer, if the text has fewer), numbered where one recurs. With m shingles matched by an alignment that keeps their
order, texts of n1 and n2 shingles are n1 + n2 - 2 m apart, and their similarity is m / (n1 + n2 - m); a link is a
similarity of 0.8 or more. Classes are the connected components of the links.

Order MinHash: each of ``sketches`` seeds picks the ``tuple_size`` smallest labelled shingles and keeps them in text order;
texts with an equal tuple share a bucket. Two texts at 0.8 share a given tuple with a chance of about 0.8 ** 3, so all 16
miss with about 1e-5. Equal texts are one node from the start. In each bucket the member that shares most buckets with
others is the hub, and each member is aligned with it: links grow with the input, not with pairs. Where a bucket still
holds several components, its pairs across components are aligned too: directly if there are few, else only those that
share one of their rarest shingles (prefix filter: a pair at 0.8 must), which loses none. Before that, what is outside a
large component meets the few members nearest to its hub, and components so linked are merged; in a large group of near
copies nearly all merge there, so the pairs left don't grow with its square.

Alignment only looks within the band of n1 + n2 - 2 m <= (n1 + n2) / 9 that a similarity of 0.8 allows.

A null text counts as empty; texts without words are one class. The class id is the smallest doc_id of the class, nulls
last. Rows that repeat an id each have a row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, components, drop_rows, small, text_or_empty

WORDS, SIMILARITY, SKETCHES, TUPLE, COMMON = 5, 0.8, 16, 3, 32
#: Central members of a component that those outside it meet first.
CENTRES = 16
#: Nodes whose ids are broadcast at most; above that, texts are fetched by a shuffled join.
BROADCAST_NODES = 400_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def node_of(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    return x ^ (x >> np.uint64(29))


def shingles(norm: str, words: int = WORDS, cache: dict[str, int] | None = None) -> np.ndarray:
    """64-bit hashes of the text's shingles, in order; a text of fewer words has one shingle, an empty text none."""
    cache = {} if cache is None else cache
    w = norm.split(" ") if norm else []
    if len(cache) > 300_000:
        cache.clear()
    ids = []
    for x in w:
        h = cache.get(x)
        if h is None:
            b = x.encode()
            h = cache[x] = zlib.crc32(b) << 32 | zlib.crc32(b, 0x5BD1E995)
        ids.append(h)
    h = _mix(np.array(ids, dtype="uint64"))
    k = min(words, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    s = np.zeros(n, dtype="uint64")
    for i in range(k):
        s = s * _M2 + h[i : i + n]
    return _mix(s)


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles told apart where they recur, by their number so far."""
    order = np.argsort(s, kind="stable")
    v = s[order]
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.array([], dtype="int64")
    if len(start) == len(v):
        return s
    nth = np.arange(len(v)) - np.repeat(start, np.diff(np.append(start, len(v))))
    out = np.empty_like(s)
    out[order] = _mix(v + nth.astype("uint64") * _M2)
    return out


def order_minhash(s: np.ndarray, sketches: int = SKETCHES, tuple_size: int = TUPLE) -> np.ndarray:
    """One key for each seed: the hash of its smallest labelled shingles, in text order."""
    x, n = labelled(s), len(s)
    size = min(tuple_size, n)
    seeds = _mix(np.arange(1, sketches + 1, dtype="uint64") * _M2)
    keys = np.empty(sketches, dtype="uint64")
    step = max(1, 2_000_000 // n)
    for i in range(0, sketches, step):
        v = (x[None, :] ^ seeds[i : i + step, None]) * _M1
        v ^= v >> np.uint64(32)
        at = np.argpartition(v, size - 1, axis=1)[:, :size] if size < n else np.tile(np.arange(n), (len(v), 1))
        at.sort(axis=1)
        k = seeds[i : i + step].copy()
        for j in range(size):
            k = _mix(k * _M2 + s[at[:, j]])
        keys[i : i + step] = k
    return keys.astype("int64")


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether an alignment within the band of ``similarity`` matches enough shingles of ``a`` and ``b`` in order."""
    total = len(a) + len(b)
    band = int(total * (1 - similarity) / (1 + similarity) + 1e-9)
    if abs(len(a) - len(b)) > band:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    apart = len(a) + len(b)
    if apart <= band:
        return True
    if not len(a) or not len(b):
        return False
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if apart - 2 * int(np.minimum(ca[ia], cb[ib]).sum()) > band:
        return False
    return apart - 2 * _matches(a.tolist(), b.tolist(), band) <= band


def _matches(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence of pairs at most ``band`` apart, by a row of 2 * band + 1 bits that slides along.

    A bit is 0 where the length grows. Where values of ``b`` lie in ``a`` is kept in chunks as wide as the row, so a step
    looks at two chunks and costs what the band is wide, not what the text is long.
    """
    width = 2 * band + 1
    at: dict[tuple[int, int], int] = {}
    for i, x in enumerate(a):
        k = (x, (i + band) // width)
        at[k] = at.get(k, 0) | 1 << (i + band) % width
    full = (1 << width) - 1
    row, found = full, 0
    for j, x in enumerate(b):  # bit 0 is position j - band of ``a``
        chunk, off = divmod(j, width)
        hit = at.get((x, chunk), 0) >> off
        if off:
            hit |= at.get((x, chunk + 1), 0) << (width - off) & full
        if hit:
            hit &= row
            row = ((row + hit) | (row - hit)) & full
        found += not row & 1
        row = row >> 1 | 1 << (width - 1)
    return found + width - row.bit_count()


def _sketched(texts: DataFrame, words: int, sketches: int, tuple_size: int) -> DataFrame:
    """(node, hash, n, keys) for each text with words."""

    def run(batches):
        cache: dict[str, int] = {}
        for b in batches:
            s = [shingles(t, words, cache) for t in b["norm"]]
            yield pd.DataFrame({"node": b["node"], "hash": b["hash"], "n": [len(x) for x in s], "keys": [order_minhash(x, sketches, tuple_size) for x in s]})

    return texts.where("norm <> ''").mapInPandas(run, "node long, hash binary, n long, keys array<long>")


def _texts_joined(scratch: Scratch, pairs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """(x, y, _x, _y): pairs with both texts. A sort-merge join leaves them sorted by y, so what y gives can be kept from pair to pair."""
    wanted = scratch.save(pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct(), f"wanted_{name}")
    texts = scratch.save(rows.join(small(wanted, BROADCAST_NODES), "node", "left_semi").select("node", "norm"), f"texts_{name}")
    scratch.drop(f"wanted_{name}")
    t = lambda k: texts.select(F.col("node").alias(k), F.col("norm").alias(f"_{k}"))
    return pairs.join(t("x"), "x").join(t("y"), "y").select("x", "y", "_x", "_y")


def _verified(scratch: Scratch, pairs: DataFrame, rows: DataFrame, words: int, similarity: float, name: str) -> DataFrame:
    """The (x, y) that align."""

    def run(batches):
        cache: dict[str, int] = {}
        for b in batches:
            ok, last, hub = [], None, None
            for x, y, tx, ty in zip(b["x"], b["y"], b["_x"], b["_y"], strict=True):
                if y != last:
                    last, hub = y, shingles(ty, words, cache)
                ok.append(aligned(shingles(tx, words, cache), hub, similarity))
            yield b.loc[ok, ["x", "y"]]

    links = scratch.save(_texts_joined(scratch, pairs, rows, name).mapInPandas(run, "x long, y long"), f"links_{name}")
    scratch.drop(f"texts_{name}")
    return links


def _near_sizes(low: Column, high: Column, similarity: float) -> Column:
    return F.least(low, high) >= F.greatest(low, high) * similarity - 1e-9


def _under_hubs(scratch: Scratch, buckets: DataFrame, hubs: DataFrame, comps: DataFrame) -> DataFrame:
    """(hub, main, own, node, n, comp): members of buckets with several components, under the hubs they are held against.

    Each large component of a bucket (more members than the square root of all) has its centre as a hub, over all members
    of the bucket; ``main`` is that component and ``own`` tells its members. All members outside large components are under
    the bucket's first hub, where ``main`` and ``own`` are null. A bucket of m rows gives at most m ** 1.5.
    """
    b = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    b = scratch.save(b.select("key", "node", "n", "weight", "comp"), "held")
    parts = b.groupBy("key", "comp").agg(F.count("*").alias("k"), F.max_by("node", F.struct("weight", "node")).alias("centre"))
    parts = scratch.save(parts, "parts")
    mixed = parts.groupBy("key").agg(F.count("*").alias("comps"), F.sum("k").alias("m")).where("comps > 1")
    mixed = scratch.save(mixed.select("key", "m"), "mixed")
    large = parts.join(mixed, "key").where(F.col("k") > F.greatest(F.lit(4.0), F.sqrt("m")))
    large = scratch.save(large.select("key", F.col("comp").alias("main"), F.col("centre").alias("hub")), "large")
    held = b.join(mixed.select("key"), "key")
    to_centre = held.join(large, "key").select("hub", "main", (F.col("comp") == F.col("main")).alias("own"), "node", "n", "comp")
    rest = held.join(large.select("key", F.col("main").alias("comp")), ["key", "comp"], "left_anti")
    to_first = rest.join(hubs, "key").select(F.col("y").alias("hub"), F.lit(None).cast("long").alias("main"), F.lit(None).cast("boolean").alias("own"), "node", "n", "comp")
    under = scratch.save(to_centre.unionByName(to_first).distinct(), "under")
    scratch.drop("held", "parts", "mixed", "large")
    return under


def _beyond(scratch: Scratch, under: DataFrame, rows: DataFrame, words: int, similarity: float, common: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What tells which pairs of different components may still be alike: pairs with hubs, members, their shared prefixes, members made of H.

    Let H be the shingles of a hub and all those that more than ``common`` members under it have. If x and y share no
    shingle beyond H, they share at most the lesser count in the hub (``c``) and the lesser count of frequent ones beyond it
    (``cf``), and are alike only if both together are half of what their sizes ask for. Only members that are made of H come
    so far. All other pairs share a shingle beyond H, and if those come first in the order of a prefix filter, one of them
    is in both prefixes. As at most ``common`` members have it, pairs follow the rows.

    Most shingles occur once under their hub. So each goes out as a 64-bit key of (hub, shingle), only keys that recur are
    joined back, and a shingle's place follows from its index and the frequent ones before it. Keys that collide add to H
    or to the pairs, which are verified, so none is lost.
    """

    def beyond(batches):
        cache: dict[str, int] = {}
        for x in batches:
            last, hub, out = None, None, []
            for y, tx, ty in zip(x["y"], x["_x"], x["_y"], strict=True):
                if y != last:
                    last, hub = y, labelled(shingles(ty, words, cache))
                own = labelled(shingles(tx, words, cache))
                new = np.sort(own[~np.isin(own, hub)])
                most = len(own) - int(np.ceil(len(own) * similarity - 1e-9)) + 1
                out.append((len(own) - len(new), most, len(new) <= 2 * most, new[: 2 * most].astype("int64")))
            yield pd.DataFrame({"node": x["x"], "hub": x["y"]} | {k: [o[i] for o in out] for i, k in enumerate(("c", "most", "whole", "new"))})

    asked = under.where("node <> hub").select(F.col("node").alias("x"), F.col("hub").alias("y")).distinct()
    found = _texts_joined(scratch, asked, rows, "under").mapInPandas(beyond, "node long, hub long, c long, most long, whole boolean, new array<long>")
    found = found.join(under, ["node", "hub"]).withColumn("first", F.col("own").isNull())
    found = scratch.save(found.withColumn("p", F.monotonically_increasing_id()), "beyond")
    scratch.drop("texts_under")
    to_hub = found.where("NOT own").select(F.least("node", "hub").alias("x"), F.greatest("node", "hub").alias("y"))
    to_hub = scratch.save(to_hub.distinct(), "to_hub")
    seen = found.select("p", "comp", "hub", "first", F.posexplode("new").alias("i", "s")).select("p", "i", "comp", F.xxhash64("hub", "first", "s").alias("k"))
    often = seen.groupBy("k").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("m > 1")
    often = scratch.save(often.select("k", (F.col("m") > common).alias("often"), (F.col("low") != F.col("high")).alias("mixed")), "often")
    hits = seen.select("k", "p", "i").join(often, "k")
    before = F.sum(F.col("often").cast("int")).over(Window.partitionBy("p").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    hits = scratch.save(hits.withColumn("place", F.col("i") + 1 - before), "shared")
    facts = scratch.save(found.select("p", "main", "first", "own", "node", "n", "comp", "most"), "facts")
    shared = hits.where("NOT often AND mixed").select("k", "p", "place").join(facts.select("p", "most"), "p").where("place <= most")
    shared = scratch.save(shared.select("k", "p"), "prefixes")
    more = hits.groupBy("p").agg(F.count_if("often").alias("often"))
    inside = found.withColumn("listed", F.size("new")).drop("new").join(more, "p", "left").fillna({"often": 0})
    cut_short = ~F.col("whole") & (F.col("listed") - F.col("often") < F.col("most"))
    inside = inside.withColumn("cf", F.when(cut_short, F.col("n") - F.col("c")).otherwise(F.col("often")))
    inside = inside.where(2 * (F.col("c") + F.col("cf")) >= _asked(F.col("n") * (1 + similarity), similarity))
    inside = scratch.save(inside.select("hub", "main", "first", "own", "node", "n", "c", "cf", "comp"), "inside")
    return to_hub, facts.drop("most"), shared, inside


def _asked(sizes: Column, similarity: float) -> Column:
    """Twice the shingles that texts of these sizes in sum share if they are alike."""
    return sizes * (2 * similarity / (1 + similarity)) - 1e-9


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with merged components, without those that are in the main one of their hub by now."""
    for name in ("comp", "main"):
        to = merged.select(F.col("node").alias(name), F.col("comp").alias("_to"))
        rows = rows.join(to, name, "left").withColumn(name, F.coalesce("_to", name)).drop("_to")
    return rows.where("own IS NULL OR own OR comp <> main")


def _still_apart(inside: DataFrame, similarity: float) -> DataFrame:
    """Members made of H that some other under their hub may be like, by the most those have in common with H and the least size."""
    key, most = ["hub", "first"], {}
    for side, rows in {"in": F.expr("first OR own"), "out": F.expr("first OR NOT own")}.items():
        most |= {f"{c}_{side}": of(F.when(rows, F.col(c))) for c, of in (("c", F.max), ("cf", F.max), ("n", F.min))}
    groups = inside.groupBy(*key).agg(*[m.alias(name) for name, m in most.items()], (F.min("comp") != F.max("comp")).alias("mixed")).where("mixed")
    other = lambda c: F.when(F.col("own"), F.col(f"{c}_out")).otherwise(F.col(f"{c}_in"))
    together = F.least("c", F.coalesce(other("c"), F.lit(-1))) + F.least("cf", F.coalesce(other("cf"), F.lit(-1)))  # -1: there is no other
    least = F.greatest(F.col("n") * similarity, other("n"))
    kept = inside.join(groups, key).where(2 * together >= _asked(F.col("n") + least, similarity))
    return kept.select(*inside.columns)


def _alike_in_hub(inside: DataFrame, others: DataFrame, sides: Column, similarity: float) -> DataFrame:
    """(x, y): rows outside a hub's component and ``others`` under the hub, if H alone leaves room for a link."""
    z = others.select("hub", "first", *[F.col(c).alias(f"{c}_z") for c in ("own", "node", "n", "c", "cf", "comp")])
    room = 2 * (F.least("c", "c_z") + F.least("cf", "cf_z")) >= _asked(F.col("n") + F.col("n_z"), similarity)
    fits = sides & (F.col("comp") != F.col("comp_z")) & room & _near_sizes(F.col("n"), F.col("n_z"), similarity)
    pairs = inside.where("first OR NOT own").join(z, ["hub", "first"]).where(fits)
    return pairs.select(F.least("node", "node_z").alias("x"), F.greatest("node", "node_z").alias("y"))


def _with_centres(inside: DataFrame, centres: int, similarity: float) -> DataFrame:
    """(x, y): each row outside a hub's component with that component's ``centres`` members that have most in common with H."""
    part = F.pmod(F.xxhash64("node"), F.lit(centres)).alias("part")
    first = F.max_by(F.struct("own", "node", "n", "c", "cf", "comp"), F.struct(F.col("c") + F.col("cf"), "node")).alias("z")
    central = inside.where("first OR own").groupBy("hub", "first", part).agg(first).select("hub", "first", "z.*")
    return _alike_in_hub(inside, central, F.col("node") != F.col("node_z"), similarity)


def _component_pairs(members: DataFrame, parts: DataFrame, by: list[str], similarity: float) -> DataFrame:
    """(x, y): members of different components of a group. Components are paired first, so none is paired with itself."""
    a = parts.select(*by, F.col("comp").alias("ca"))
    c = parts.select(*by, F.col("comp").alias("cb"))
    two = a.join(c, by).where("ca < cb")
    x = members.select(*by, F.col("comp").alias("ca"), F.col("node").alias("x"), F.col("n").alias("nx"))
    y = members.select(*by, F.col("comp").alias("cb"), F.col("node").alias("y"), F.col("n").alias("ny"))
    both = two.join(x, [*by, "ca"]).join(y, [*by, "cb"]).where(_near_sizes(F.col("nx"), F.col("ny"), similarity))
    return both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _left(held: DataFrame, inside: DataFrame, similarity: float) -> DataFrame:
    """(x, y): all pairs of different components that may still be alike."""
    one = held.where("first")
    among = _component_pairs(one, one.select("k", "comp").distinct(), ["k"], similarity)
    side = lambda own, name: held.where(f"own = {own}").select("k", F.col("node").alias(name), F.col("n").alias(f"n{name}"))
    around = side("true", "y").join(side("false", "x"), "k").where(_near_sizes(F.col("nx"), F.col("ny"), similarity))
    around = around.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    sides = F.col("own").isNotNull() | (F.col("node") < F.col("node_z"))
    few = _alike_in_hub(inside, inside.where("first OR own"), sides, similarity)
    return among.unionByName(around).unionByName(few).distinct()


def _across(
    scratch: Scratch, comps: DataFrame, under: DataFrame, done: DataFrame, rows: DataFrame, words: int, similarity: float, common: int, centres: int
) -> DataFrame:
    """(x, y): links across components. Pairs that are ``done`` already are left out.

    First what is outside a hub's component meets the hub and its component's most central members, and what links is
    merged, by more centres where many pairs are still to be made. Then all pairs of components still apart are aligned.
    """
    to_hub, facts, shared, inside = _beyond(scratch, under, rows, words, similarity, common)
    scratch.drop("under", "beyond", "often", "shared")
    inside = scratch.save(_still_apart(inside, similarity), "apart0")
    scratch.drop("inside")
    of = lambda name: comps.select(F.col("node").alias(name), F.col("comp").alias(f"_{name}"))
    links, more, k = None, to_hub.unionByName(_with_centres(inside, centres, similarity)), 0
    while more is not None:
        more = scratch.save(more.distinct().join(done, ["x", "y"], "left_anti"), f"pairs_{k}")
        done = done.unionByName(more)
        found = _verified(scratch, more, rows, words, similarity, f"{k}")
        links = found if links is None else links.unionByName(found)
        between = links.join(of("x"), "x", "left").join(of("y"), "y", "left").select(F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"))
        merged = components(scratch, between, f"merged{k}_")
        inside = scratch.save(_still_apart(_relabelled(inside, merged), similarity), f"apart{k + 1}")
        scratch.drop(f"apart{k}")
        sizes = inside.groupBy("hub", "first").agg(F.count_if(F.expr("first OR own")).alias("a"), F.count_if(F.expr("first OR NOT own")).alias("b"))
        left, members, most = sizes.agg(F.sum(F.col("a") * F.col("b")), F.sum(F.col("a") + F.col("b")), F.max("a")).first()
        k, many = k + 1, left and left > common * members and most > centres and not found.isEmpty()
        centres *= 16
        more = _with_centres(inside, centres, similarity) if many else None
    # Components are told to members, of which a prefix has many rows, and before those are read several times.
    facts = scratch.save(_relabelled(facts, merged), "placed_facts")
    held = scratch.save(shared.join(facts, "p").drop("p"), "placed_prefixes")
    scratch.drop("facts", "prefixes")
    rest = _left(held, inside, similarity).join(done, ["x", "y"], "left_anti")
    links = links.unionByName(_verified(scratch, scratch.save(rest, "pairs_across"), rows, words, similarity, "across"))
    scratch.drop("to_hub", "placed_facts", "placed_prefixes", f"apart{k}", "pairs_across", *[f"pairs_{i}" for i in range(k)])
    return links


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
    sketches: int = SKETCHES, tuple_size: int = TUPLE, common: int = COMMON, centres: int = CENTRES, scratch: Scratch | None = None,
) -> DataFrame:
    """One row per document: doc_id, node (hash of its text), class_id, class_node, class_size.

    Inside, a text goes by the number of one of its rows in the table of normalised texts.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("row"), normalised(text_or_empty(text_col)).alias("norm")).withColumn("hash", node_of(F.col("norm")))
    rows = scratch.save(rows.withColumn("node", F.monotonically_increasing_id()), "normal")  # read again wherever texts are compared
    sketched = scratch.save(_sketched(rows, words, sketches, tuple_size).dropDuplicates(["hash"]), "sketches")
    members = scratch.save(rows.select("row", "hash"), "members")
    keyed = sketched.select("node", "n", F.explode("keys").alias("key"))  # a key holds its seed
    met = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "met")
    # The hub of a bucket is the member that shares the most: where copies differ from one another, it is like most of them.
    buckets = keyed.join(met, "key").withColumn("weight", F.sum("size").over(Window.partitionBy("node")))
    buckets = scratch.save(buckets.drop("size"), "buckets")
    scratch.drop("met")
    best = buckets.groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("weight", "node")).alias("hub"))
    best = scratch.save(best.select("key", F.col("hub.node").alias("y"), F.col("hub.n").alias("ny")), "hubs")
    pairs = buckets.join(best, "key").where(F.col("node") != F.col("y")).where(_near_sizes(F.col("n"), F.col("ny"), similarity))
    pairs = scratch.save(pairs.select(F.col("node").alias("x"), "y").distinct(), "pairs_hub")
    near = _verified(scratch, pairs, rows, words, similarity, "hub")
    comps = components(scratch, near, "hub")
    under = _under_hubs(scratch, buckets, best.select("key", "y"), comps)
    scratch.drop("buckets", "hubs")
    done = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    links = near.unionByName(_across(scratch, comps, under, done, rows, words, similarity, common, centres))
    scratch.drop("normal", "pairs_hub")
    named = sketched.select(F.col("node").alias("comp"), F.col("hash").alias("comp_hash"))
    comps = components(scratch, links, "all").join(named, "comp").join(sketched.select("node", "hash"), "node")
    comps = scratch.save(comps.select("hash", "comp_hash"), "comps")
    scratch.drop("sketches", "links_hub", "links_across")
    placed = members.join(comps, "hash", "left").select("row", F.col("hash").alias("node"), F.coalesce("comp_hash", "hash").alias("comp"))
    placed = scratch.save(placed, "placed")
    scratch.drop("members", "comps")
    least = F.min(F.struct(F.col("row").isNull(), "row", "node"))
    classes = scratch.save(placed.groupBy("comp").agg(least.alias("least"), F.count("*").alias("class_size")), "classes")
    return placed.join(classes, "comp").select(
        F.col("row").alias("doc_id"), "node", F.col("least.row").alias("class_id"), F.col("least.node").alias("class_node"), "class_size"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, all columns kept: the one with the class id."""
    scratch = Scratch(docs.sparkSession)
    found = near_classes(docs, id_col, text_col, scratch=scratch, **options).where("class_size > 1")
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))
    found = scratch.save(found.select("doc_id", "node", first.alias("first")), "found")
    keys = {"doc_id": F.col(id_col), "node": node_of(normalised(text_or_empty(text_col)))}
    again = found.where("first").groupBy("doc_id", "node").count().where("count > 1")
    return drop_rows(scratch, docs, keys, found.where("NOT first"), again)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))
    return found.select("doc_id", "class_id", "class_size", kept.alias("kept"))
