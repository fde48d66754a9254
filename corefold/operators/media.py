"""Frames, segments, boxes and pooled vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corefold.functions import text as X
from corefold.functions import vectors as V
from corefold.operators import order
from corefold.operators.pairs import BLOCK, block_scores, meet
from corefold.session import cut_lineage


def vector_mean(rows: DataFrame, keys: Sequence[str], vector: str = "emb", weight: str | None = None, out: str = "emb") -> DataFrame:
    """(Weighted) mean vector per keys: one partial vector per key and map task
    goes through the shuffle, not one row per dimension."""
    packed = rows.select(*keys, array_to_vector(vector).alias("_v"), *([F.col(weight).alias("_w")] if weight else []))
    mean = Summarizer.mean(F.col("_v"), F.col("_w")) if weight else Summarizer.mean(F.col("_v"))
    return packed.groupBy(*keys).agg(mean.alias("_m")).select(*keys, vector_to_array("_m").alias(out))


def time_to_frame(seconds: Column, duration: Column, n_frames: int | Column = 100) -> Column:
    count = n_frames if isinstance(n_frames, Column) else F.lit(n_frames)
    return F.floor(seconds / duration * count).cast("long")


def annotation_frames(segments: DataFrame, n_frames: int = 100) -> DataFrame:
    return segments.withColumn("f0", time_to_frame(F.col("t0"), F.col("duration"), n_frames)).withColumn(
        "f1", time_to_frame(F.col("t1"), F.col("duration"), n_frames)
    )


def frames_in_segment(segments: DataFrame, frames: DataFrame, *carry: str) -> DataFrame:
    """Frames with f0 <= frame <= f1. A video has a fixed number of frame slots,
    so a segment lists its slots and the join is an equi join."""
    slots = segments.select("doc", "seg", *carry, F.explode(F.sequence("f0", "f1")).alias("frame"))
    return slots.join(frames, ["doc", "frame"])


def keyframe_arguments(arguments: DataFrame, frames: DataFrame, entity_ids: DataFrame, role_ids: DataFrame) -> DataFrame:
    """Vector of the key frame of each argument with its (entity, role) ids; -1
    where a name is unknown. The first frame of a slot counts."""
    slot = frames.groupBy("doc", "frame").agg(F.min_by("emb", "fidx").alias("emb"))
    return (
        arguments.join(slot, ["doc", "frame"], "left")
        .join(entity_ids, "entity_type", "left")
        .join(role_ids, "role", "left")
        .withColumn("entity_id", F.coalesce("entity_id", F.lit(-1)))
        .withColumn("role_id", F.coalesce("role_id", F.lit(-1)))
    )


def hull_overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over the enclosing hull of boxes (x_min, y_min, x_max, y_max);
    0 if they are apart."""
    left, bottom = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    right, top = F.least(a[2], b[2]), F.least(a[3], b[3])
    hull = (F.greatest(a[3], b[3]) - F.least(a[1], b[1])) * (F.greatest(a[2], b[2]) - F.least(a[0], b[0]))
    return F.when((top < bottom) | (right < left), 0.0).otherwise((top - bottom) * (right - left) / hull)


BOX = ("x0", "y0", "x1", "y1")


def box_overlap_join(predicted: DataFrame, gold: DataFrame, threshold: float, cell: float) -> DataFrame:
    """Pairs of boxes of a document that overlap by more than ``threshold`` (>= 0).

    Both sides are keyed by the grid cells they touch; a pair is kept in the cell
    of the lower corner of its intersection only, so it appears once."""

    def celled(boxes: DataFrame, prefix: str) -> DataFrame:
        def cells(lo, hi):
            return F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))

        named = boxes.withColumn("_cx", cells("x0", "x1")).withColumn("_cy", cells("y0", "y1"))
        return named.select("doc", "_cx", "_cy", F.col("box").alias(f"{prefix}_box"), *[F.col(c).alias(f"{prefix}_{c}") for c in BOX])

    a, b = [F.col(f"p_{c}") for c in BOX], [F.col(f"g_{c}") for c in BOX]
    home = (F.col("_cx") == F.floor(F.greatest(a[0], b[0]) / cell)) & (F.col("_cy") == F.floor(F.greatest(a[1], b[1]) / cell))
    return (
        celled(predicted, "p").join(celled(gold, "g"), ["doc", "_cx", "_cy"])
        .filter(home)
        .withColumn("overlap", hull_overlap(a, b))
        .filter(F.col("overlap") > threshold)
        .select("doc", "p_box", "g_box", "overlap")
    )


def phrase_box_join(boxes: DataFrame, phrases: DataFrame) -> DataFrame:
    """The last phrase seen for a box's cluster id, empty text if none."""
    last = phrases.groupBy("doc", "cluster").agg(F.max_by("phrase", "ord").alias("phrase"))
    return boxes.join(last, ["doc", "cluster"], "left").withColumn("phrase", F.coalesce("phrase", F.lit("")))


def token_vectors(tokens: DataFrame, word_vectors: DataFrame, dim: int) -> DataFrame:
    """Vector of the lower-cased token, zeros for unknown words.

    Distinct words meet the vector table first, so a frequent word sends one row
    per map task to that join; its vector then joins back by word."""
    words = tokens.select(F.lower("tok").alias("word")).distinct().join(word_vectors.select("word", "emb"), "word")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return (
        tokens.withColumn("word", F.lower("tok")).join(words, "word", "left")
        .withColumn("emb", F.coalesce("emb", zeros)).drop("word")
    )


def piece_vectors(pieces: DataFrame, token_vecs: DataFrame, piece_vecs: DataFrame, on: Sequence[str] = ("doc", "tid")) -> DataFrame:
    """Vector of each piece followed by the vector of its token. Pieces that carry the
    word find it in a table of words (``on``), which is sent once and not by token."""
    own = piece_vecs.select("doc", "piece", F.col("emb").alias("_p"))
    word = token_vecs.select(*on, F.col("emb").alias("_t"))
    return pieces.join(own, ["doc", "piece"]).join(word, list(on)).withColumn("emb", F.concat("_p", "_t")).drop("_p", "_t")


def mention_vector_mean(mentions: DataFrame, token_vecs: DataFrame) -> DataFrame:
    covered = mentions.select("doc", "idx", F.explode(F.sequence("m_start", "m_end")).alias("tid"))
    return vector_mean(covered.join(token_vecs.select("doc", "tid", "emb"), ["doc", "tid"]), ["doc", "idx"])


def mention_vector_head(mentions: DataFrame, word_vectors: DataFrame, means: DataFrame) -> DataFrame:
    """Vector of the head lemma if the vocabulary has it, else the span mean."""
    head = word_vectors.select(F.col("word").alias("lemma"), F.col("emb").alias("_h"))
    return (
        mentions.select("doc", "idx", "lemma").join(head, "lemma", "left")
        .join(means.select("doc", "idx", F.col("emb").alias("_m")), ["doc", "idx"])
        .select("doc", "idx", F.coalesce("_h", "_m").alias("emb"))
    )


def argument_slots(arguments: DataFrame, vectors: DataFrame) -> DataFrame:
    """doc, e_idx, slot, emb: the vectors of all arguments of each event, from slot 0."""
    rank = Window.partitionBy("doc", "e_idx").orderBy("a_start", "a_idx")
    placed = arguments.withColumn("slot", (F.row_number().over(rank) - 1).cast("long"))
    return placed.join(vectors.select("doc", F.col("idx").alias("a_idx"), "emb"), ["doc", "a_idx"]).select("doc", "e_idx", "slot", "emb")


def argument_vectors(events: DataFrame, arguments: DataFrame, vectors: DataFrame, dim: int, slots: int = 10) -> DataFrame:
    """The first ``slots`` argument vectors of each event, zero padded to a fixed
    width: the layout of the feature files. ``argument_slots`` has all of them."""
    parts = (
        argument_slots(arguments, vectors).filter(F.col("slot") < slots)
        .groupBy("doc", "e_idx").agg(F.array_sort(F.collect_list(F.struct("slot", "emb"))).alias("_v"))
    )
    flat = F.flatten(F.transform("_v", lambda s: s["emb"]))
    return (
        events.join(parts.withColumnRenamed("e_idx", "idx"), ["doc", "idx"], "left")
        .select("doc", "idx", V.pad_or_truncate(F.coalesce(flat, F.array().cast("array<double>")), slots * dim, F.lit(0.0)).alias("emb"))
    )


def concat_features(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("doc", "row")) -> DataFrame:
    return left.join(right.withColumnRenamed("emb", "_r"), list(keys)).withColumn("emb", F.concat("emb", "_r")).drop("_r")


FRAME_BLOCK = 4096  # frames of a video that are pooled at a time


def frame_means(members: DataFrame, frames: DataFrame, keys: Sequence[str], block: int = FRAME_BLOCK) -> DataFrame:
    """Mean vector per ``keys`` (doc and whole numbers) of the frames (doc, fidx, emb)
    that ``members`` (keys, fidx) name, one row per frame met; repeated frames count by
    their mean.

    Vectors are sent once, by video, and are pooled where they arrive. Only groups of
    videos beyond ``block`` frames are pooled per block and put together by weight."""
    keys = list(keys)
    others = [k for k in keys if k != "doc"]
    at_once = 1 << 16

    def mean(l: pd.DataFrame, r: pd.DataFrame):
        if l.empty or r.empty:
            return {}
        at, back, times = np.unique(r["fidx"].to_numpy(), return_inverse=True, return_counts=True)
        vectors = np.stack(r["emb"].to_numpy())
        if len(at) < len(r):
            sums = np.zeros((len(at), vectors.shape[1]))
            np.add.at(sums, back, vectors)
            vectors = sums / times[:, None]
        else:
            vectors = vectors[np.argsort(back)]
        place = np.minimum(np.searchsorted(at, l["fidx"].to_numpy()), len(at) - 1)
        known = at[place] == l["fidx"].to_numpy()
        place, groups = place[known], [l[c].to_numpy()[known] for c in others]
        if not len(place):
            return {}
        by_group = np.lexsort(groups[::-1])
        place, groups = place[by_group], [g[by_group] for g in groups]
        change = np.zeros(len(place), dtype=bool)
        change[0] = True
        for g in groups:
            change[1:] |= g[1:] != g[:-1]
        starts = np.flatnonzero(change)
        n = np.diff(starts, append=len(place))
        means, first = [], 0
        while first < len(starts):  # whole groups, about ``at_once`` rows at a time
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + at_once)))
            end = starts[last] if last < len(starts) else len(place)
            part = np.add.reduceat(vectors[place[starts[first] : end]], starts[first:last] - starts[first], axis=0)
            means.extend(part / n[first:last, None])
            first = last
        return {"doc": l["doc"].to_numpy()[: len(starts)], **{c: g[starts] for c, g in zip(others, groups)}, "emb": means, "_n": n.astype(float)}

    types = dict(members.select(*keys).dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in ["doc", *others]) + ", emb array<double>, _n double"
    named, vectors = members.select(*keys, "fidx"), frames.select("doc", "fidx", "emb")
    long = frames.filter(F.col("fidx") >= block).select("doc").distinct()
    if long.isEmpty():
        return meet(named, vectors, ["doc"], mean, schema).select(*keys, "emb")
    short = meet(named.join(long, "doc", "left_anti"), vectors.join(long, "doc", "left_anti"), ["doc"], mean, schema)
    cut = [side.join(long, "doc", "left_semi").withColumn("_b", order.blocks_of(F.col("fidx"), block)) for side in (named, vectors)]
    parts = meet(*cut, ["doc", "_b"], mean, schema)
    return short.select(*keys, "emb").unionByName(vector_mean(parts, keys, weight="_n"))


def pool_segments(members: DataFrame, how: str, k: int = 4, frames: DataFrame | None = None) -> DataFrame:
    """(doc, seg, pos, emb) -> one vector per segment. With ``frames`` (doc, fidx, emb)
    the members name theirs by fidx and carry no vectors; a mean needs no pos then.

    mean: average. resample: the last frame repeats up to k frames, then the mean
    of k equal chunks (the rest is dropped). concat: rows in order, not pooled."""

    def pooled(rows: DataFrame, *keys: str) -> DataFrame:
        return vector_mean(rows, keys) if frames is None else frame_means(rows, frames, keys)

    if how == "mean":
        return pooled(members, "doc", "seg")
    if how == "concat":
        return order.number_rows(members, ["doc"], ["seg", "pos"], order.blocks_of(F.col("seg"), 1024), "row")
    sizes = members.groupBy("doc", "seg").agg(F.count("*").alias("_n"), F.max("pos").alias("_last"))
    short_end = (F.col("pos") == F.col("_last")) & (F.col("_n") < k)
    places = F.when(short_end, F.sequence("pos", F.col("_last") + k - F.col("_n"))).otherwise(F.array("pos"))
    full = members.join(sizes, ["doc", "seg"]).withColumn("pos", F.explode(places))
    full = full.withColumn("_w", F.floor(F.greatest("_n", F.lit(k)) / k)).filter(F.col("pos") < F.col("_w") * k)
    return pooled(full.withColumn("chunk", F.floor(F.col("pos") / F.col("_w"))), "doc", "seg", "chunk")


def merge_segments_by_label(members: DataFrame, limit: int | None = None) -> DataFrame:
    """Frames of equal label in order of segment and frame, with their place; with a
    ``limit`` only the first rows of each label, the input length of a model. The rank
    runs in two steps, per segment and over the segments' sizes, so a frequent label is
    spread."""
    own = Window.partitionBy("doc", "label", "seg").orderBy("fidx")
    first = members.withColumn("_r", F.row_number().over(own))
    first = first if limit is None else first.filter(F.col("_r") <= limit)
    sizes = first.groupBy("doc", "label", "seg").agg(F.count("*").alias("_n"))
    before = order.running_total(sizes, ["doc", "label"], ["seg"], order.blocks_of(F.col("seg"), 4096), F.col("_n"), "_sofar")
    before = before if limit is None else before.filter(F.col("_sofar") < limit)
    placed = first.join(before.select("doc", "label", "seg", "_sofar"), ["doc", "label", "seg"]).withColumn("row", F.col("_r") + F.col("_sofar") - 1)
    return (placed if limit is None else placed.filter(F.col("row") < limit)).drop("_sofar", "_r")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.zeros((0, 0))


def align_mean_actions(mentions: DataFrame, actions: DataFrame, dim: int) -> DataFrame:
    """Per mention the mean vector of the actions with a positive dot product,
    zeros if there is none. Blocks give partial sums, never the pairs."""

    def part(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame()
        actions_ = _matrix(r["emb"])
        mask = (_matrix(l["emb"]) @ actions_.T > 0).astype(float)
        return pd.DataFrame({"doc": l["doc"], "idx": l["idx"], "n": mask.sum(axis=1), "s": list(mask @ actions_)})

    parts = block_scores(mentions, actions, ["doc"], "idx", "fidx", part, "doc long, idx long, n double, s array<double>")
    means = vector_mean(
        parts.filter("n > 0").select("doc", "idx", "n", F.expr("transform(s, x -> x / n)").alias("emb")), ["doc", "idx"], weight="n"
    )
    zeros = F.array_repeat(F.lit(0.0), dim)
    return mentions.select("doc", "idx").join(means, ["doc", "idx"], "left").withColumn("emb", F.coalesce("emb", zeros))


def matchmap_similarity(tokens: DataFrame, regions: DataFrame, how: str) -> DataFrame:
    """Similarity of the texts and the images that share ``doc``: the mean of the
    token x region dot map, the mean over tokens of the best region (mean_max), or
    over regions of the best token (max_mean).

    The mean of all products is the product of the means; the maxima come from
    blocks that give one number per row."""
    if how == "mean":
        left = vector_mean(tokens, ["doc"], out="_a")
        right = vector_mean(regions, ["doc"], out="_b")
        return left.join(right, "doc").select("doc", V.dot(F.col("_a"), F.col("_b")).alias("score"))
    side = {"mean_max": 0, "max_mean": 1}[how]

    def best(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame()
        products = _matrix(l["emb"]) @ _matrix(r["emb"]).T
        rows = l["idx"] if side == 0 else r["fidx"]
        return pd.DataFrame({"doc": l["doc"].iloc[0], "row": rows.to_numpy(), "best": products.max(axis=1 - side)})

    parts = block_scores(tokens, regions, ["doc"], "idx", "fidx", best, "doc long, row long, best double")
    return parts.groupBy("doc", "row").agg(F.max("best").alias("best")).groupBy("doc").agg(F.avg("best").alias("score"))


def attention_rows(mentions: DataFrame, actions: DataFrame) -> DataFrame:
    """Softmax over the actions of a document of each mention's dot products, a row
    per mention and action: where the probabilities themselves are asked for."""

    def products(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame()
        dots = _matrix(l["emb"]) @ _matrix(r["emb"]).T
        return pd.DataFrame(
            {
                "doc": l["doc"].iloc[0], "idx": np.repeat(l["idx"].to_numpy(), len(r)),
                "fidx": np.tile(r["fidx"].to_numpy(), len(l)), "s": dots.ravel(),
            }
        )

    sides = mentions.select("doc", "idx", "emb"), actions.select("doc", "fidx", "emb")
    scored = block_scores(*sides, ["doc"], "idx", "fidx", products, "doc long, idx long, fidx long, s double")
    mass = attention_mass(mentions, actions).select("doc", "idx", "log_total")
    return scored.join(mass, ["doc", "idx"]).select("doc", "idx", "fidx", F.exp(F.col("s") - F.col("log_total")).alias("p"))


def attention_mass(mentions: DataFrame, actions: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc, idx, peak, log_total: the largest dot product of each mention with the
    actions of its document and the log of the sum of their exponentials. A block of
    actions gives one (maximum, sum scaled by it) per mention; these are merged."""

    def partial(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame()
        dots = _matrix(l["emb"]) @ _matrix(r["emb"]).T
        peak = dots.max(axis=1)
        return pd.DataFrame({"doc": l["doc"].iloc[0], "idx": l["idx"].to_numpy(), "m": peak, "z": np.exp(dots - peak[:, None]).sum(axis=1)})

    sides = mentions.select("doc", "idx", "emb"), actions.select("doc", "fidx", "emb")
    parts = cut_lineage(block_scores(*sides, ["doc"], "idx", "fidx", partial, "doc long, idx long, m double, z double", block))
    peaks = parts.groupBy("doc", "idx").agg(F.max("m").alias("peak"))
    scaled = parts.join(peaks, ["doc", "idx"]).groupBy("doc", "idx", "peak").agg(F.sum(F.col("z") * F.exp(F.col("m") - F.col("peak"))).alias("_z"))
    return scaled.select("doc", "idx", "peak", (F.col("peak") + F.ln("_z")).alias("log_total"))


def attention_pair_features(pairs: DataFrame, mentions: DataFrame, actions: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc, i, j) -> best attention of each side, their product, and the best joint
    attention; documents without actions give no row.

    The product of two attentions on an action is largest where the sum of the two
    vectors has its largest dot product, so one number per pair and block of actions
    leaves a task, and no table of mentions by actions exists."""
    vectors = mentions.select("doc", "idx", "emb")
    a = vectors.select("doc", F.col("idx").alias("i"), F.col("emb").alias("_a"))
    b = vectors.select("doc", F.col("idx").alias("j"), F.col("emb").alias("_b"))
    both = pairs.select("doc", "i", "j").join(a, ["doc", "i"]).join(b, ["doc", "j"])
    both = both.select("doc", "i", "j", F.zip_with("_a", "_b", lambda x, y: x + y).alias("emb"))

    def best(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame()
        top = (_matrix(l["emb"]) @ _matrix(r["emb"]).T).max(axis=1)
        return pd.DataFrame({"doc": l["doc"].iloc[0], "i": l["i"].to_numpy(), "j": l["j"].to_numpy(), "s": top})

    parts = block_scores(both, actions.select("doc", "fidx", "emb"), ["doc"], "i", "fidx", best, "doc long, i long, j long, s double", block)
    joint = parts.groupBy("doc", "i", "j").agg(F.max("s").alias("_s"))
    mass = cut_lineage(attention_mass(mentions, actions, block))
    first = mass.select("doc", F.col("idx").alias("i"), F.col("peak").alias("_p1"), F.col("log_total").alias("_t1"))
    second = mass.select("doc", F.col("idx").alias("j"), F.col("peak").alias("_p2"), F.col("log_total").alias("_t2"))
    return joint.join(first, ["doc", "i"]).join(second, ["doc", "j"]).select(
        "doc", "i", "j", F.exp(F.col("_p1") - F.col("_t1")).alias("first"), F.exp(F.col("_p2") - F.col("_t2")).alias("second"),
        F.exp(F.col("_p1") - F.col("_t1") + F.col("_p2") - F.col("_t2")).alias("product"), F.exp(F.col("_s") - F.col("_t1") - F.col("_t2")).alias("joint"),
    )


def fuse_scores(trigger: Column, visual: Column | None, argument: Column, weights: Sequence[float]) -> Column:
    total = trigger * weights[0] + argument * weights[-1]
    return total if visual is None else total + visual * weights[1]


def max_abs_cosine_mean(pairs: DataFrame, token_vecs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Mean over the tokens of j of the best |cos| with the tokens of i; 1 for the
    null candidate. ``token_vecs`` is (doc, idx, tid, emb).

    The pairs meet their tokens by document, in pairs of blocks where a document is
    longer than ``block``, so a vector is sent once per block pair and not per pair,
    and no side is broadcast for what its files weigh."""
    listed = pairs.filter("i >= 0 AND doc IS NOT NULL").select("doc", "i", "j")
    vectors = token_vecs.filter("doc IS NOT NULL").select("doc", "idx", "tid", "emb")
    at_once = 1 << 16

    def best(l: pd.DataFrame, r: pd.DataFrame):
        if l.empty or r.empty:
            return {}
        r = r.sort_values(["idx", "tid"])
        idx, tid = r["idx"].to_numpy(), r["tid"].to_numpy()
        units = np.stack(r["emb"].to_numpy())
        units = units / np.maximum(np.sqrt((units * units).sum(axis=1, keepdims=True)), V.EPS)
        ij = np.unique(l[["i", "j"]].to_numpy(), axis=0)
        a, n_a = np.searchsorted(idx, ij[:, 0]), np.searchsorted(idx, ij[:, 0], "right") - np.searchsorted(idx, ij[:, 0])
        b, n_b = np.searchsorted(idx, ij[:, 1]), np.searchsorted(idx, ij[:, 1], "right") - np.searchsorted(idx, ij[:, 1])
        met = (n_a > 0) & (n_b > 0)
        ij, a, n_a, b, n_b = ij[met], a[met], n_a[met], b[met], n_b[met]
        upto, sims, first = np.cumsum(n_a * n_b), [], 0
        while first < len(ij):  # whole pairs, about ``at_once`` products at a time
            before = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, before + at_once)))
            size = n_a[first:last] * n_b[first:last]
            pair = np.repeat(np.arange(first, last), size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            left, right = a[pair] + place % n_a[pair], b[pair] + place // n_a[pair]
            products = np.abs(np.einsum("ij,ij->i", units[left], units[right]))
            change = np.ones(len(pair), dtype=bool)
            change[1:] = (pair[1:] != pair[:-1]) | (tid[right[1:]] != tid[right[:-1]])
            starts = np.flatnonzero(change)
            top, of = np.maximum.reduceat(products, starts), pair[starts] - first
            sims.append(np.bincount(of, weights=top) / np.bincount(of))
            first = last
        if not sims:
            return {}
        return {"doc": np.repeat(r["doc"].to_numpy()[:1], len(ij)), "i": ij[:, 0], "j": ij[:, 1], "sim": np.concatenate(sims)}

    schema = f"doc {dict(pairs.dtypes)['doc']}, i long, j long, sim double"
    if listed.filter((F.col("i") >= block) | (F.col("j") >= block)).isEmpty():
        real = meet(listed, vectors, ["doc"], best, schema)
    else:
        listed = listed.withColumn("_lb", order.blocks_of(F.col("i"), block)).withColumn("_rb", order.blocks_of(F.col("j"), block))
        reach = listed.select("doc", "_lb", "_rb").distinct().withColumn("_b", F.explode(F.array_distinct(F.array("_lb", "_rb"))))
        near = vectors.withColumn("_b", order.blocks_of(F.col("idx"), block)).join(reach.hint("merge"), ["doc", "_b"])
        real = meet(listed, near, ["doc", "_lb", "_rb"], best, schema)
    null = pairs.filter("i < 0").select("doc", "i", "j", F.lit(1.0).alias("sim"))
    return real.unionByName(null)


def best_segments(frames: DataFrame, query: DataFrame, longest: int = 20) -> DataFrame:
    """Best window of up to ``longest`` frames per query (doc, q, q_emb) by the dot
    product with the window's mean vector, if positive.

    The product with a mean is the mean of the products, so windows are sums of
    one number per frame: differences of a running total."""
    scored = frames.join(query, "doc").select("doc", "q", "fidx", V.dot(F.col("emb"), F.col("q_emb")).alias("s"))
    totals = order.running_total(scored, ["doc", "q"], ["fidx"], order.blocks_of(F.col("fidx"), 4096), F.col("s"), "_c", inclusive=True)
    ends = totals.select("doc", "q", F.col("fidx").alias("end"), F.col("_c").alias("_end"))
    starts = totals.select(
        "doc", "q", F.col("fidx").alias("start"), (F.col("_c") - F.col("s")).alias("_before"),
        F.explode(F.sequence(F.col("fidx"), F.col("fidx") + longest - 1)).alias("end"),
    )
    windows = starts.join(ends, ["doc", "q", "end"]).withColumn(
        "score", (F.col("_end") - F.col("_before")) / (F.col("end") - F.col("start") + 1)
    )
    best = F.struct(F.round("score", 9), -F.col("start"), -F.col("end"))
    return (
        windows.filter("score > 0").groupBy("doc", "q")
        .agg(F.max_by(F.struct("start", "end", "score"), best).alias("_w")).select("doc", "q", "_w.*")
    )


def log_mean_posterior(posteriors: DataFrame) -> DataFrame:
    return posteriors.groupBy("doc", "k").agg(F.ln(F.avg("p")).alias("log_p"))


def role_names(keyframes: DataFrame, roles: DataFrame, types: DataFrame) -> DataFrame:
    """Names in place of the role and entity indexes."""
    return keyframes.join(roles, "role_id", "left").join(types, "entity_id", "left")
