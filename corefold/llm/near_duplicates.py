"""Near duplicates by min-max hashing over word shingles.

A text's set holds the distinct shingles of ``words`` words, ASCII letters in lower
case (fewer words: the whole sequence; no words: nothing, linked with nothing).
PERMUTATIONS hash functions give a minimum and a maximum each, so one evaluation
serves two signature values; a band is both values of two functions. Two sets of
similarity 0.8 share none of the BANDS bands with a chance under 1e-6. Every pair
that the bands propose is confirmed on the full sets before it counts.

Equal sets are one class and compared once. In a bucket every class is compared
with the smallest one, then, where the bucket is still in several components, with
its best linked one. What then lies outside a bucket's largest component meets all of
other components, but leaves only pairs that their bitmaps allow: every bit that one
set alone has stands for a shingle that the other lacks, so the bound is never below
the true intersection and no proposed link is lost. Sets of less than four shingles
can reach 0.8 with an equal set only and enter no bucket.

``doc_id`` is the key of a document. Equal rows are answered alike; a null key never
names a component, and a component of null keys only is null and not kept.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefold.llm import common
from corefold.plans.clusters import connected_components
from corefold.session import cut_lineage, packed

PERMUTATIONS = 64
BANDS = PERMUTATIONS // 2
#: Longs of a set's bitmap; a larger one rules out more pairs of large sets.
LONGS = 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_draw = np.random.default_rng(20240229)
_XOR = _draw.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_ODD = _draw.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_powers = np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        table = np.full(max(n, 256), _BASE, np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles."""
    raw = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(raw)
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    bounds = np.cumsum([0] + [len(x) + 1 for x in raw])
    cuts = np.searchsorted(begins, bounds)
    if not len(begins):
        return [np.zeros(0, np.uint64)] * len(raw)
    inside = np.arange(begins[0], len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))
    part = data[begins[0] :]
    skip = space[begins[0] :]
    inside[skip] = 0
    weight = _power_table(int(inside.max()) + 1)[inside] * (part.astype(np.uint64) + np.uint64(1))
    weight[skip] = 0
    word = _mix(np.add.reduceat(weight, begins - begins[0]))
    joined = word[: len(word) - words + 1].copy() if len(word) >= words else word[:0]
    for i in range(1, words):
        joined = _mix(joined * np.uint64(3) + word[i : len(word) - words + 1 + i])
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            whole = word[a : a + 1].copy()
            for i in range(a + 1, b):
                whole = _mix(whole * np.uint64(5) + word[i : i + 1])
            out.append(_mix(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_max_bands(sets: list[np.ndarray]) -> np.ndarray:
    """Sets x BANDS keys; all sets hold at least one value."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(sets), BANDS), np.uint64)
    for p in range(PERMUTATIONS):
        hashed = (values ^ _XOR[p]) * _ODD[p]
        low = np.minimum.reduceat(hashed, starts).astype(np.uint64)
        high = np.maximum.reduceat(hashed, starts).astype(np.uint64)
        out[:, p // 2] = _mix(out[:, p // 2] + (low << np.uint64(32) | high) + np.uint64(p))
    return out


def bitmap(grams: np.ndarray) -> np.ndarray:
    """64 * LONGS flags, one set for each shingle."""
    out = np.zeros(64 * LONGS, bool)
    out[(grams >> np.uint64(7)).astype(np.int64) % len(out)] = True
    return out


def signatures(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n, f1, f2 (fingerprint of the set), bands; written."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(b: dict[str, list]) -> dict[str, list]:
        sets = shingle_sets(b["text"], words)
        large = [i for i, s in enumerate(sets) if len(s) >= 4]
        bands: list[list[int] | None] = [None] * len(sets)
        if large:
            for i, row in zip(large, min_max_bands([sets[i] for i in large]).view(np.int64).tolist()):
                bands[i] = row
        marks = [(int(np.add.reduce(_mix(s)).view(np.int64)), int(np.add.reduce(_mix(s + np.uint64(77))).view(np.int64))) if len(s) else (0, 0) for s in sets]
        return {"doc_id": b["doc_id"], "n": [len(s) for s in sets], "f1": [m[0] for m in marks], "f2": [m[1] for m in marks], "bands": bands}

    return common.written(common.scan(rows, run, "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>", common.FEW_CHARS), "signatures")


#: Keys lie below; rows without a key get a number above, drawn from their set, so
#: that the smallest member of a component is a key wherever it has one.
_NO_KEY = 1 << 62


def _node() -> F.Column:
    """The key, or for a null key a number that sorts after all keys."""
    return F.coalesce("doc_id", F.lit(_NO_KEY) + F.shiftrightunsigned(F.xxhash64("f1", "f2"), 3))


def _sets(docs: DataFrame, nodes: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """node, grams (the whole set, 8 bytes a shingle), bits (its bitmap) and over
    (shingles beyond the bits set) of the given nodes; texts of other documents are
    dropped by a hashed filter before anything is shuffled."""
    shared = common.HashFilter(nodes.select((F.xxhash64("node").bitwiseAND(F.lit(0x7FFFFFFF))).alias("h"))).shared
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("long")).bitwiseAND(F.lit(0x7FFFFFFF)).alias("h"))

    def run(b: dict[str, list]) -> dict[str, list]:
        keep = np.flatnonzero(common.HashFilter.test(shared.value, np.array(b["h"], np.int64)) | np.array([d is None for d in b["doc_id"]], bool)).tolist()
        sets = shingle_sets([b["text"][i] for i in keep], words)
        marks = [(int(np.add.reduce(_mix(s)).view(np.int64)), int(np.add.reduce(_mix(s + np.uint64(77))).view(np.int64))) if len(s) else (0, 0) for s in sets]
        maps = [bitmap(s) for s in sets]
        over = [len(s) - int(m.sum()) for s, m in zip(sets, maps)]
        bits = [np.packbits(m, bitorder="little").view(np.int64).tolist() for m in maps]
        return {"doc_id": [b["doc_id"][i] for i in keep], "f1": [m[0] for m in marks], "f2": [m[1] for m in marks], "grams": [s.tobytes() for s in sets], "bits": bits, "over": over}

    got = common.scan(rows, run, "doc_id bigint, f1 bigint, f2 bigint, grams binary, bits array<bigint>, over bigint", common.FEW_CHARS).select(_node().alias("node"), "grams", "bits", "over")
    return common.written(got.join(nodes, "node", "left_semi").dropDuplicates(), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """src, dst of the pairs whose whole sets overlap enough."""
    both = pairs.join(sets.select(F.col("node").alias("src"), F.col("grams").alias("left")), "src")
    both = both.join(sets.select(F.col("node").alias("dst"), F.col("grams").alias("right")), "dst").select("src", "dst", "left", "right")

    def run(b: dict[str, list]) -> dict[str, list]:
        src, dst = [], []
        for i, (x, y) in enumerate(zip(b["left"], b["right"])):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            common_ = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
            if 100 * common_ >= percent * (len(x) + len(y) - common_):
                src.append(b["src"][i])
                dst.append(b["dst"][i])
        return {"src": src, "dst": dst}

    return common.scan(both, run, "src bigint, dst bigint")


def _kept(df: DataFrame) -> DataFrame:
    """Checkpoint of narrow rows, read in few partitions where they are few."""
    rows = cut_lineage(df)
    return packed(rows, rows.count())


def _open_buckets(members: DataFrame, joined: DataFrame) -> DataFrame:
    """bucket, node, n, component of the buckets that hold several components."""
    placed = members.join(joined, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    apart = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("bucket")
    return _kept(placed.join(apart, "bucket"))


def _may_link(percent: int) -> F.Column:
    """Whether the bitmaps of src and dst leave room for the similarity."""
    both = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"b{i}_src").bitwiseAND(F.col(f"b{i}_dst"))) for i in range(LONGS)])
    most = both + F.least("over_src", "over_dst")
    return most * (100 + percent) >= (F.col("n_src") + F.col("n_dst")) * percent


def _grow(joined: DataFrame, found: DataFrame) -> DataFrame:
    """node, component once the found links hold as well: only the components that
    they touch are walked again, as single nodes."""
    ends = found.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    known = _kept(joined.unionByName(ends.join(joined, "node", "left_anti").select("node", F.col("node").alias("component"))))
    left, right = (known.select(F.col("node").alias(n), F.col("component").alias(f"c_{n}")) for n in ("src", "dst"))
    edges = found.join(left, "src").join(right, "dst").filter("c_src <> c_dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct()
    top = connected_components(edges).select(F.col("node").alias("component"), F.col("component").alias("top"))
    return _kept(known.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")))


def components(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), kept; one row per
    input row."""
    signed = signatures(docs, words, key, text)
    filled = signed.filter("n > 0")
    rows = filled.select("f1", "f2", _node().alias("node"))
    classes = rows.groupBy("f1", "f2").agg(F.min("node").alias("class"))
    heads = filled.withColumn("node", _node()).join(classes.withColumnRenamed("class", "node"), ["f1", "f2", "node"]).filter("bands IS NOT NULL")
    buckets = common.written(heads.select("node", "n", F.explode("bands").alias("bucket")).distinct(), "buckets")
    firsts = buckets.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last")
    members = common.written(buckets.join(firsts, "bucket").select("bucket", "node", "n", "first"), "members")
    sets = _sets(docs, members.select("node").distinct(), words, key, text)
    star = members.filter("node <> first").select(F.col("node").alias("src"), F.col("first").alias("dst")).distinct()
    links = _kept(_confirm(star, sets, percent))
    joined = connected_components(links)

    # Once more against the best linked member of each bucket that is still in parts.
    placed = _open_buckets(members, joined)
    degree = links.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    hubs = placed.join(degree, "node", "left").groupBy("bucket").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("d"), "component", "node")).alias("hub"))
    hubs = hubs.select("bucket", F.col("hub.node").alias("dst"), F.col("hub.component").alias("c"))
    again = placed.join(hubs, "bucket").filter("component <> c").select(F.col("node").alias("src"), "dst").distinct()
    joined = _grow(joined, _kept(_confirm(again, sets, percent)))

    placed = _open_buckets(members, joined)
    main = placed.groupBy("bucket", "component").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "component"))["component"].alias("main"))
    # Written as Parquet: a set's longs repeat in each of its buckets and take little room.
    longs = [F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(LONGS)]
    placed = common.written(placed.join(main, "bucket").join(sets.select("node", "over", *longs), "node"), "open-members")

    def side(name: str) -> list[F.Column]:
        # A column per long, none null: the test of a pair stays small enough to be compiled.
        compiled = [F.coalesce(f"b{i}", F.lit(0)).alias(f"b{i}_{name}") for i in range(LONGS)]
        return ["bucket", F.col("node").alias(name), F.col("component").alias(f"c_{name}"), *[F.col(x).alias(f"{x}_{name}") for x in ("n", "over")], *compiled]

    outside, others = placed.filter("component <> main").select(*side("src")), placed.select(*side("dst"), "main")
    once = (F.col("c_src") != F.col("c_dst")) & ((F.col("c_dst") == F.col("main")) | (F.col("src") < F.col("dst")))
    sizes = F.least("n_src", "n_dst") * 100 >= F.greatest("n_src", "n_dst") * percent
    rest = outside.join(others, "bucket").filter(once & sizes & _may_link(percent))
    more = _kept(_confirm(rest.select("src", "dst").distinct(), sets, percent))
    if not more.isEmpty():
        joined = _grow(joined, more)

    whole = signed.withColumn("node", _node()).join(classes, ["f1", "f2"], "left").join(joined.withColumnRenamed("node", "class"), "class", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "class")).otherwise(F.col("doc_id"))
    return whole.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(component < _NO_KEY, component).cast("long").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
