"""Translation-style EM over antecedents (Ma et al. 2016) as rounds of joins and
grouped sums.

The probability of a candidate depends on its word only (and on its sentence
distance), so the rounds run over candidate words, not over pairs of mentions:
``candidates`` is (mode, doc, j, tgt, src, dist, n, first, open), where n counts
the candidates of mention j with word src at that distance and first is the
lowest of their indexes. Visual candidates enter the same table, with a cluster
as src and the posterior mass of the document's frames as n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corefold.functions import text as X
from corefold.operators.order import blocks_of
from corefold.operators.pairs import block_scores
from corefold.operators.ranking import rank_antecedents
from corefold.plans import similar
from corefold.plans.clusters import visual_cluster_link
from corefold.plans.dealt import Dealt, deal
from corefold.plans.mixture import numbers
from corefold.plans.similar import Similar
from corefold.session import broadcast_if_small, cut_lineage, written

EPS = 1e-100
COLUMNS = ("mode", "doc", "j", "tgt", "src", "dist", "n", "first", "open")


def candidate_words(
    mentions: DataFrame, antecedents: DataFrame | None = None, keys: Sequence[str] = ("doc",), word: str = "lemma",
    positions: bool = False, mode: str = "text", block: int = 256,
) -> DataFrame:
    """Candidate words of each mention among the earlier mentions of its ``keys``.

    Within a block of index values mentions meet one by one; all earlier blocks
    are met as running word counts. A large document costs mentions x (distinct
    words + block), not mentions squared."""
    keys = list(keys)
    antecedents = mentions if antecedents is None else antecedents
    place = F.col("sent").cast("long") if positions else F.lit(0).cast("long")
    j = mentions.select(*keys, F.col("idx").alias("j"), F.col(word).alias("tgt"), place.alias("_sj"), blocks_of(F.col("idx"), block).alias("_b"))
    i = antecedents.select(*keys, F.col("idx").alias("i"), F.col(word).alias("src"), place.alias("_si"), blocks_of(F.col("idx"), block).alias("_b"))
    out = [*keys, "j", "tgt", "src", "_sj", "_si", "n", "first"]
    near = j.join(i, [*keys, "_b"]).filter(F.col("i") < F.col("j")).withColumn("n", F.lit(1.0)).withColumnRenamed("i", "first").select(*out)
    tops = j.filter(F.col("_b") > 0).groupBy(*keys).agg(F.max("_b").alias("_top"))
    steps = Window.partitionBy(*keys, "src", "_si").orderBy("_b")
    history = (
        i.groupBy(*keys, "src", "_si", "_b").agg(F.count("*").cast("double").alias("n"), F.min("i").alias("first"))
        .join(tops, keys).filter(F.col("_b") < F.col("_top"))
        .withColumn("n", F.sum("n").over(steps)).withColumn("first", F.min("first").over(steps))
        .withColumn("_until", F.coalesce(F.lead("_b").over(steps), F.col("_top")))
        .withColumn("_b", F.explode(F.sequence(F.col("_b") + 1, "_until")))
        .drop("_top", "_until")
    )
    far = j.join(history, [*keys, "_b"]).select(*out)
    return (
        near.unionByName(far).groupBy("doc", "j", "tgt", "src", "_sj", "_si")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        .select(
            F.lit(mode).alias("mode"), "doc", "j", "tgt", "src", (F.col("_sj") - F.col("_si")).alias("dist"), "n", "first", F.lit(True).alias("open")
        )
    )


def null_candidates(mentions: DataFrame, word: str = "lemma", positions: bool = False, mode: str = "text", accepts: Column | None = None) -> DataFrame:
    """The null candidate of each mention; its distance is the mention's own
    sentence. One that is not accepted stays in the mean of the likelihood."""
    place = F.col("sent").cast("long") if positions else F.lit(0).cast("long")
    return mentions.select(
        F.lit(mode).alias("mode"), "doc", F.col("idx").alias("j"), F.col(word).alias("tgt"), F.lit(X.NEW_TEXT).alias("src"),
        place.alias("dist"), F.lit(1.0).alias("n"), F.lit(-1).cast("long").alias("first"), (F.lit(True) if accepts is None else accepts).alias("open"),
    )


def text_candidates(mentions: DataFrame, keys: Sequence[str] = ("doc",), word: str = "lemma", block: int = 256) -> DataFrame:
    return candidate_words(mentions, keys=keys, word=word, block=block).unionByName(null_candidates(mentions, word))


def visual_candidates(mentions: DataFrame, mass: DataFrame, word: str = "lemma", mode: str = "visual") -> DataFrame:
    """Clusters as candidates of visual mentions. ``mass`` is (doc, k, mass), the
    sum of the cluster posteriors over the frames of a document: the weights of
    the single frames only ever enter through it."""
    return mentions.join(mass, "doc").select(
        F.lit(mode).alias("mode"), "doc", F.col("idx").alias("j"), F.col(word).alias("tgt"), F.concat(F.lit("k:"), F.col("k").cast("string")).alias("src"),
        F.col("sent").cast("long").alias("dist"), F.col("mass").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(True).alias("open"),
    )


def cluster_mass(posteriors: DataFrame) -> DataFrame:
    return posteriors.groupBy("doc", "k").agg(F.sum("p").alias("mass"))


MATCH_KEYS = ("doc", "type", "number", "visual")


def semantic_matches(mentions: DataFrame, similarity: float = 0.5, block: int = 512, keys: Sequence[str] = MATCH_KEYS) -> DataFrame:
    """doc, j, tgt, src, dist, n, first: the earlier mentions of equal ``keys`` (type,
    number and visual flag) whose vector's |cosine| exceeds ``similarity``, counted per
    lemma and sentence distance. Blocks of mentions meet as matrix products; only the
    counts leave a block pair."""
    import numpy as np
    import pandas as pd

    rows = mentions.select(*keys, "idx", "lemma", F.col("sent").cast("long").alias("sent"), "emb")

    def units(vectors: pd.Series) -> np.ndarray:
        stacked = np.stack(vectors.to_numpy())
        return stacked / np.maximum(np.sqrt((stacked * stacked).sum(axis=1, keepdims=True)), EPS)

    def match(l: pd.DataFrame, r: pd.DataFrame):
        if l.empty or r.empty or l["idx"].to_numpy().min() >= r["idx"].to_numpy().max():
            return {}
        words, sents = l["lemma"].to_numpy(), l["sent"].to_numpy()
        seen: dict = {}
        codes = np.array([-1 if w is None or s != s else seen.setdefault((w, s), len(seen)) for w, s in zip(words, sents)])
        order = np.argsort(codes, kind="stable")
        order = order[codes[order] >= 0]
        if not len(order):
            return {}
        codes, at, to = codes[order], l["idx"].to_numpy()[order], r["idx"].to_numpy()
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        hit = np.abs(units(r["emb"]) @ units(l["emb"].iloc[order]).T) > similarity
        hit &= at[None, :] < to[:, None]
        if not hit.any():
            return {}
        n = np.add.reduceat(hit, starts, axis=1, dtype=np.int64)
        first = np.minimum.reduceat(np.where(hit, at[None, :], np.iinfo(np.int64).max), starts, axis=1)
        row, col = np.nonzero(n)
        src = order[starts][col]
        return {
            "doc": r["doc"].to_numpy()[row], "j": to[row], "tgt": r["lemma"].to_numpy()[row], "src": words[src],
            "dist": r["sent"].to_numpy()[row] - sents[src], "n": n[row, col].astype(float), "first": first[row, col],
        }

    parts = block_scores(rows, rows, list(keys), "idx", "idx", match, "doc long, j long, tgt string, src string, dist long, n double, first long", block, ordered=True)
    return parts.groupBy("doc", "j", "tgt", "src", "dist").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def assign_mode(mentions: DataFrame, semantic: DataFrame) -> DataFrame:
    """Mode of each mention: the first earlier mention that matches semantically
    (see ``semantic_matches``) or as the nominal of a pronoun decides; without one it
    is visual if the mention is, else semantic."""
    same = semantic.groupBy("doc", F.col("j").alias("idx")).agg(F.min("first").alias("_s"))
    nominal = mentions.filter("mtype = 'nominal'").groupBy("doc", "type").agg(F.min("idx").alias("_n"))
    placed = mentions.join(same, ["doc", "idx"], "left").join(nominal, ["doc", "type"], "left")
    discourse = F.when((F.col("mtype") == "pronoun") & (F.col("_n") < F.col("idx")), F.col("_n"))
    late = F.lit(2**62)
    first_s, first_d = F.coalesce("_s", late), F.coalesce(discourse, late)
    return placed.withColumn(
        "mode",
        F.when(F.col("_s").isNotNull() & (first_s <= first_d), "semantic").when(discourse.isNotNull(), "discourse")
        .when(F.col("visual"), "visual").otherwise("semantic"),
    ).drop("_s", "_n")


def assign_mode_from_matches(candidates: DataFrame, default: Column) -> DataFrame:
    """(doc, j, i, semantic, discourse) flags of real candidates -> mode: the lowest
    matching i decides, semantic first; ``default`` is over the b_* columns."""
    hit = F.when(F.col("semantic"), "semantic").when(F.col("discourse"), "discourse")
    real = F.col("i") >= 0
    return candidates.groupBy("doc", "j").agg(
        F.coalesce(F.min_by(hit, F.when(real & hit.isNotNull(), F.col("i"))), F.first(F.when(~real, default), ignorenulls=True)).alias("mode")
    ).withColumnRenamed("j", "idx")


def mode_candidates(mentions: DataFrame, semantic_words: DataFrame, mass: DataFrame | None, block: int = 256) -> DataFrame:
    """Candidates of mentions with a ``mode``: semantic ones are the words of
    ``semantic_matches``, discourse ones among the nominals of
    their type by mention type and number, visual ones among the clusters."""
    accepts = ~F.col("tag").isin(X.PRONOUN_TAGS)
    named = mentions.withColumn("_d", X.mode_feature(F.lit("discourse"), F.col("lemma"), F.col("mtype"), F.col("number")))
    semantic, discourse, visual = (named.filter(F.col("mode") == m) for m in ("semantic", "discourse", "visual"))
    met = semantic_words.join(semantic.select("doc", F.col("idx").alias("j")), ["doc", "j"], "left_semi")
    out = met.select(F.lit("semantic").alias("mode"), "doc", "j", "tgt", "src", "dist", "n", "first", F.lit(True).alias("open"))
    out = out.unionByName(null_candidates(semantic, "lemma", True, "semantic", accepts))
    pronouns = discourse.filter("mtype = 'pronoun'")
    out = out.unionByName(candidate_words(pronouns, named.filter("mtype = 'nominal'"), ["doc", "type"], "_d", True, "discourse", block))
    out = out.unionByName(null_candidates(discourse, "_d", True, "discourse", accepts))
    if mass is not None:
        out = out.unionByName(visual_candidates(visual, mass)).unionByName(null_candidates(visual, "lemma", True, "visual"))
    return out


def candidates_from_pairs(pairs: DataFrame, mode: str = "text") -> DataFrame:
    """(doc, i, j, a_lemma, b_lemma) of admitted pairs -> candidate words."""
    return pairs.groupBy("doc", "j", F.col("b_lemma").alias("tgt"), F.col("a_lemma").alias("src")).agg(
        F.count("*").cast("double").alias("n"), F.min("i").alias("first")
    ).select(F.lit(mode).alias("mode"), "doc", "j", "tgt", "src", F.lit(0).cast("long").alias("dist"), "n", "first", F.lit(True).alias("open"))


def init_translation(candidates: DataFrame, vocab_sizes: dict[str, int]) -> DataFrame:
    """mode, src, tgt, p: uniform over the words of the mode. Only observed pairs
    are stored, the others are never read."""
    size = F.create_map(*[F.lit(v) for item in vocab_sizes.items() for v in item])
    return candidates.select("mode", "src", "tgt").distinct().withColumn("p", 1.0 / size[F.col("mode")])


def vocab_sizes(mentions: DataFrame, word: str = "lemma", mode: str = "text") -> dict[str, int]:
    return {mode: mentions.select(F.countDistinct(word)).first()[0]}


def mode_vocab_sizes(mentions: DataFrame) -> dict[str, int]:
    row = mentions.select(F.countDistinct("lemma").alias("l"), F.countDistinct(F.concat_ws("__", "mtype", "number")).alias("d")).first()
    return {"semantic": row["l"], "discourse": row["d"], "visual": row["l"]}


def init_position(candidates: DataFrame) -> DataFrame:
    """mode, dist, p: uniform over the sentence distances seen."""
    seen = candidates.select("mode", "dist").distinct()
    sizes = seen.groupBy("mode").agg(F.count("*").alias("_n"))
    return seen.join(sizes, "mode").select("mode", "dist", (1.0 / F.col("_n")).alias("p"))


def e_step(candidates: DataFrame, translation: DataFrame, position: DataFrame | None = None) -> DataFrame:
    """Adds w, the probability of one candidate, and post, the posterior of all n.
    Give written tables: they are counted, and broadcast while they are small, so
    that the candidates are shuffled once, by mention."""
    table = broadcast_if_small(translation.withColumnRenamed("p", "_p"))
    joined = candidates.join(table, ["mode", "src", "tgt"], "left")
    w = F.coalesce("_p", F.lit(0.0))
    if position is not None:
        joined = joined.join(broadcast_if_small(position.withColumnRenamed("p", "_q")), ["mode", "dist"], "left")
        w = w * F.coalesce("_q", F.lit(0.0))
    weighted = joined.withColumn("w", F.when(F.col("open"), w).otherwise(0.0)).drop("_p", "_q")
    # the candidates of one mention: at most its document's distinct words
    total = F.sum(F.col("n") * F.col("w")).over(Window.partitionBy("doc", "j"))
    return weighted.withColumn("post", F.col("n") * F.col("w") / F.greatest(total, F.lit(EPS)))


def m_step(posterior: DataFrame) -> DataFrame:
    """mode, src, tgt, count, p: expected counts, normalised per source word."""
    return normalised(posterior.filter("open").groupBy("mode", "src", "tgt").agg(F.sum("post").alias("count")))


def normalised(counts: DataFrame) -> DataFrame:
    """Adds p, the share of a pair in the count of its source word."""
    totals = counts.groupBy("mode", "src").agg(F.sum("count").alias("_t"))
    return counts.join(totals, ["mode", "src"]).withColumn("p", F.col("count") / F.greatest("_t", F.lit(EPS))).drop("_t")


def position_step(posterior: DataFrame, mode: str = "discourse") -> DataFrame:
    counts = posterior.filter(F.col("open") & (F.col("mode") == mode)).groupBy("mode", "dist").agg(F.sum("post").alias("_c"))
    totals = counts.groupBy("mode").agg(F.sum("_c").alias("_t"))
    return counts.join(totals, "mode").select("mode", "dist", (F.col("_c") / F.greatest("_t", F.lit(EPS))).alias("p"))


def log_likelihood(posterior: DataFrame) -> DataFrame:
    """Sum over mentions of the log of the mean candidate probability, floored."""
    means = posterior.groupBy("doc", "j").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("_m"))
    return means.agg(F.sum(F.ln(F.greatest("_m", F.lit(EPS)))).alias("log_likelihood"))


class Fitted:
    """Tables of a fitted model, its (written) candidates and the likelihood before
    each round's update."""

    def __init__(
        self, candidates: DataFrame, translation: DataFrame, position: DataFrame | None, trace: list[float], dealt: Dealt | None = None
    ):
        self.candidates, self.translation, self.position, self.trace, self.dealt = candidates, translation, position, trace, dealt

    def posterior(self) -> DataFrame:
        """The E step under the fitted tables."""
        return e_step(self.candidates, self.translation.select("mode", "src", "tgt", "p"), self.position)


def fit(
    candidates: DataFrame, sizes: dict[str, int], rounds: int = 10, positions: bool = False, learned: str | None = "discourse",
    trace: bool = False, own: str = "tgt",
) -> Fitted:
    """Rounds of E and M. Without positions the candidates are dealt by ``own``, the word
    that those of a mention share, and no round moves them (see ``plans.dealt``).

    With positions the candidate table is written once, dealt by mention, so that no round
    moves it while the tables can be sent to all tasks; each round is two joins and three
    grouped sums, and its small tables are checkpointed."""
    if not positions:
        return fit_dealt(deal(candidates, own), sizes, rounds, trace)
    candidates = cut_lineage(candidates.repartition("doc", "j"))
    translation = cut_lineage(init_translation(candidates, sizes))
    position = cut_lineage(init_position(candidates)) if positions else None
    likelihoods: list[float] = []
    for _ in range(rounds):
        posterior = e_step(candidates, translation.select("mode", "src", "tgt", "p"), position)
        if trace or (positions and learned):
            posterior = cut_lineage(posterior)
        if trace:
            likelihoods.append(log_likelihood(posterior).first()[0])
        translation = cut_lineage(m_step(posterior))
        if positions and learned:
            position = cut_lineage(
                position.filter(F.col("mode") != learned).unionByName(position_step(posterior, learned))
            )
    return Fitted(candidates, translation, position, likelihoods)


def fit_dealt(dealt: Dealt, sizes: dict[str, int], rounds: int, trace: bool = False) -> Fitted:
    translation = cut_lineage(init_translation(dealt.pairs, sizes))
    likelihoods: list[float] = []
    for _ in range(rounds):
        if trace:
            likelihoods.append(dealt.log_likelihood(translation).first()[0])
        translation = written(normalised(written(dealt.counts(translation), "counts")), "translation")
    return Fitted(dealt.candidates, translation, None, likelihoods, dealt)


def predict_antecedents(candidates: DataFrame | Dealt, translation: DataFrame, position: DataFrame | None = None) -> DataFrame:
    """doc, idx, antecedent, score: the best word's first mention, ties to the
    lowest index; -1 opens a cluster. Dealt candidates stay where they are."""
    if isinstance(candidates, Dealt):
        return candidates.best(translation).select("doc", F.col("j").alias("idx"), F.col("first").alias("antecedent"), F.col("w").alias("score"))
    scored = e_step(candidates, translation.select("mode", "src", "tgt", "p"), position)
    return rank_antecedents(scored.select("doc", "j", F.col("first").alias("i"), F.col("w").alias("score")))


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def frame_products(posteriors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """doc, _gram, _mass: the k x k products of a document's posteriors summed over its
    frames, and their sums. Frames are rows of k numbers and are added up by blocks of a
    document where they are packed, so that one shuffle moves them."""
    dealt = posteriors.withColumn("_b", blocks_of(F.col("fidx"), block)).repartition("doc", "_b")
    frames = numbers(dealt, ["doc", "_b", "fidx"], "p", "vec", k)
    rows = frames.select("doc", "_b", "vec", F.posexplode("vec").alias("k", "p"))
    sums = [F.sum(F.col("vec")[i] * F.col("p")).alias(f"_{i}") for i in range(k)]
    inside = rows.groupBy("doc", "_b", "k").agg(F.sum("p").alias("_mass"), *sums)
    whole = inside.groupBy("doc", "k").agg(F.sum("_mass").alias("_mass"), *[F.sum(f"_{i}").alias(f"_{i}") for i in range(k)])
    row = F.struct("k", F.array(*[f"_{i}" for i in range(k)]).alias("g"), "_mass")
    listed = whole.groupBy("doc").agg(F.array_sort(F.collect_list(row)).alias("_rows"))  # k rows
    return listed.select("doc", F.col("_rows.g").alias("_gram"), F.col("_rows._mass").alias("_mass"))


def visual_antecedents(
    mentions: DataFrame, antecedents: DataFrame, posteriors: DataFrame, translation: DataFrame,
    keys: Sequence[str] = ("doc", "type", "number"),
) -> DataFrame:
    """Antecedents of visual mentions: the score of a pair is the product of their
    normalised distributions over the frames and the null event.

    Frames enter through the K x K products of their posteriors per document and
    mentions through their words: each word of a document has its emissions and their
    products with the frames as K numbers, and only the words of candidates meet. Scores
    that agree to twelve digits tie."""
    table = translation.filter(F.col("mode") == "visual")
    emit = table.filter(F.col("src").startswith("k:")).select(
        F.substring("src", 3, 10).cast("int").alias("k"), F.col("tgt").alias("word"), F.col("p").alias("e")
    )
    null = table.filter(F.col("src") == X.NEW_TEXT).select(F.col("tgt").alias("word"), F.col("p").alias("e0"))
    per_doc = mentions.select("doc", "lemma").union(antecedents.select("doc", "lemma")).distinct().withColumnRenamed("lemma", "word")
    last = emit.agg(F.max("k")).first()[0]
    width = 1 if last is None else last + 1
    vectors = numbers(emit, ["word"], "e", "_e", width).join(null, "word")
    seen = per_doc.join(vectors, "word").join(frame_products(posteriors, width), "doc")
    norm = cut_lineage(
        seen.withColumn("_m", _dot("_e", "_mass")).withColumn("total", F.col("_m") + F.col("e0"))
        .withColumn("_h", F.transform("_gram", lambda row: _dot("_e", row))).select("doc", "word", "total", "e0", "_m", "_e", "_h")
    )
    pairs = candidate_words(mentions, antecedents, keys, mode="visual").select("doc", "j", "tgt", "src", F.col("first").alias("i"))
    late = norm.select("doc", F.col("word").alias("tgt"), "_h", "e0", "total")
    early = norm.select("doc", F.col("word").alias("src"), F.col("_e").alias("_e2"), F.col("_m").alias("_m2"))
    scored = pairs.join(late, ["doc", "tgt"]).join(early, ["doc", "src"])
    score = (_dot("_h", "_e2") + F.col("e0") * F.col("e0")) / (F.col("total") * (F.col("_m2") + F.col("e0")))
    real = scored.select("doc", "j", "i", score.alias("score"))
    own = mentions.select("doc", F.col("idx").alias("j"), F.col("lemma").alias("word")).join(norm, ["doc", "word"])
    every = real.unionByName(own.select("doc", "j", F.lit(-1).cast("long").alias("i"), (F.col("e0") / F.col("total")).alias("score")))
    return rank_antecedents(every.withColumn("score", F.round("score", 12)))


def amodal_antecedents(fitted: Fitted, mentions: DataFrame, posteriors: DataFrame) -> DataFrame:
    """doc, idx, antecedent, score of every mention, each decoded in its own ``mode``:
    by word and distance in the text modes, by what both see in the frames (among the
    earlier visual mentions) in the visual one. Without frames a visual mention opens a
    cluster. Scores that agree to twelve digits tie, ties go to the lowest index."""
    scored = fitted.posterior().filter("mode <> 'visual'")
    text = rank_antecedents(scored.select("doc", "j", F.col("first").alias("i"), F.round("w", 12).alias("score")))
    seen = mentions.filter("mode = 'visual'")
    found = visual_antecedents(seen, mentions.filter("visual"), posteriors, fitted.translation)
    every = seen.select("doc", "idx").join(found, ["doc", "idx"], "left")
    visual = every.select("doc", "idx", F.coalesce("antecedent", F.lit(-1).cast("long")).alias("antecedent"), F.coalesce("score", F.lit(1.0)).alias("score"))
    return text.unionByName(visual)


def joint_candidates(mentions: DataFrame, semantic_words: DataFrame, mass: DataFrame) -> DataFrame:
    """Partners of two kinds under one normaliser: the words of the matching earlier
    mentions and the null event (mode text), and, for visual mentions, the clusters by
    their mass in the document's frames (mode visual)."""
    text = semantic_words.select(F.lit("text").alias("mode"), "doc", "j", "tgt", "src", F.lit(0).cast("long").alias("dist"), "n", "first", F.lit(True).alias("open"))
    return text.unionByName(null_candidates(mentions)).unionByName(visual_candidates(mentions.filter("visual"), mass))


FRAME, NEW, EARLIER = 0, 1, 2  # kinds of partners, in the order of a tie


def joint_antecedents(fitted: Fitted, mentions: DataFrame, posteriors: DataFrame, block: int = 512) -> DataFrame:
    """doc, idx, kind, partner, score: the best of the document's frames (kind 0), a new
    cluster (1, partner -1) and the matching earlier mentions (2). Words meet frames
    as block products, and one frame per word leaves a block."""
    import numpy as np
    import pandas as pd

    text = fitted.posterior().filter("mode = 'text'")
    kind = F.when(F.col("src") == X.NEW_TEXT, NEW).otherwise(EARLIER)
    read = text.select("doc", F.col("j").alias("idx"), kind.alias("kind"), F.col("first").alias("partner"), F.col("w").alias("score"))
    table = fitted.translation.filter("mode = 'visual'").select(F.substring("src", 3, 10).cast("int").alias("k"), F.col("tgt").alias("lemma"), "p")
    emission = table.groupBy("lemma").agg(F.collect_list(F.struct("k", "p")).alias("v"))  # one entry per cluster
    words = mentions.filter("visual").groupBy("doc", "lemma").agg(F.min("idx").alias("word")).join(emission, "lemma").select("doc", "word", "lemma", "v")
    frames = posteriors.groupBy("doc", "fidx").agg(F.collect_list(F.struct("k", "p")).alias("v"))

    def dense(column: pd.Series, width: int) -> np.ndarray:
        out = np.zeros((len(column), width))
        for i, entries in enumerate(column):
            for e in entries:
                out[i, e["k"]] = e["p"]
        return out

    def best(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame()
        r = r.sort_values("fidx")
        width = 1 + max(e["k"] for column in (l["v"], r["v"]) for entries in column for e in entries)
        scores = np.round(dense(l["v"], width) @ dense(r["v"], width).T, 12)
        return pd.DataFrame({"doc": l["doc"], "word": l["word"], "lemma": l["lemma"], "fidx": r["fidx"].to_numpy()[scores.argmax(axis=1)], "s": scores.max(axis=1)})

    parts = block_scores(words, frames, ["doc"], "word", "fidx", best, "doc long, word long, lemma string, fidx long, s double", block)
    top = parts.groupBy("doc", "lemma").agg(F.max(F.struct("s", (-F.col("fidx")).alias("_f"))).alias("_b"))
    seen = mentions.filter("visual").join(top, ["doc", "lemma"]).select("doc", "idx", F.lit(FRAME).alias("kind"), (-F.col("_b._f")).alias("partner"), F.col("_b.s").alias("score"))
    order = F.struct(F.round("score", 12).alias("score"), (-F.col("kind")).alias("_k"), (-F.col("partner")).alias("_p"))
    chosen = read.unionByName(seen).groupBy("doc", "idx").agg(F.max(order).alias("_b"))
    return chosen.select("doc", "idx", (-F.col("_b._k")).cast("int").alias("kind"), (-F.col("_b._p")).alias("partner"), F.col("_b.score").alias("score"))


def joint_links(chosen: DataFrame) -> DataFrame:
    """doc, idx, antecedent: mentions with the same best frame belong together, the
    later ones linked to the first."""
    return visual_cluster_link(chosen.select("doc", "idx", "partner", (F.col("kind") == FRAME).alias("is_action")))


def similarity_candidates(mentions: DataFrame, keys: Sequence[str], block: int = 512) -> Similar:
    """Candidates of the exact-or-similar model. A mention with an earlier equal
    text is exact: those count 1 each. The others weigh each compatible earlier
    mention (equal ``keys``) by |cos| of their vectors, summed per word by blocks of
    matrix products; the null candidate weighs 1. They are nearly as many as the pairs and
    are made where they are used (see ``plans.similar``)."""
    return similar.candidates(mentions, keys, block)


def fit_exact_or_similar(candidates: Similar, vocab: int, rounds: int) -> DataFrame:
    """EM of the similar mode; exact mentions split evenly over their candidates."""
    return similar.fit(candidates, vocab, rounds)
