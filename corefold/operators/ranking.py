"""Best antecedents, top-k lists and retrieval."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corefold.operators import order
from corefold.operators.pairs import meet

RETRIEVAL_BLOCK = 4096
FEW_BLOCKS = 16  # so many blocks of a side may be small
WIDE_BLOCK = 16384
SCORES_AT_ONCE = 1 << 22


def rank_antecedents(candidates: DataFrame) -> DataFrame:
    """(doc, j, i, score) -> best candidate, ties to the lowest i. An aggregate
    with map-side partials instead of a sort per mention."""
    best = F.struct(F.col("score"), (-F.col("i")).alias("_i"))
    return candidates.groupBy("doc", "j").agg(F.max(best).alias("_b")).select(
        "doc", F.col("j").alias("idx"), (-F.col("_b._i")).alias("antecedent"), F.col("_b.score").alias("score")
    )


def top_per_key(rows: DataFrame, keys: Sequence[str], by: Sequence, k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows per key. Spark keeps at most k rows per key and map
    task before the shuffle (window group limit), so a hot key stays small."""
    window = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)


def retrieve_topk(queries: DataFrame, gallery: DataFrame, k: int, block: int = RETRIEVAL_BLOCK) -> DataFrame:
    """(q, emb) against (g, emb): the ``k`` best g per q by dot product, exact, ties
    to the lowest g.

    Both sides are cut into blocks by hash, of ``block`` rows while there are few blocks
    and of up to ``WIDE_BLOCK`` rows beyond, as every row is sent once per block of the
    other side. A task multiplies one block by another, some rows at a time, and gives k
    rows per query, so scores are never stored."""

    def blocks(rows: DataFrame) -> int:
        n = rows.count()
        return max(1, min(math.ceil(n / block), max(FEW_BLOCKS, math.ceil(n / max(block, WIDE_BLOCK)))))

    n_q, n_g = blocks(queries), blocks(gallery)
    left = queries.select("q", "emb", F.pmod(F.xxhash64("q"), F.lit(n_q)).alias("_qb")).withColumn(
        "_gb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_g - 1).cast("long")))
    )
    right = gallery.select("g", "emb", F.pmod(F.xxhash64("g"), F.lit(n_g)).alias("_gb")).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long")))
    )

    def best(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame()
        r = r.sort_values("g")
        at, found = r["g"].to_numpy(), []
        asked, vectors, others = l["q"].to_numpy(), np.stack(l["emb"].to_numpy()), np.stack(r["emb"].to_numpy()).T
        step = max(1, SCORES_AT_ONCE // len(r))
        for a in range(0, len(l), step):
            scores = vectors[a : a + step] @ others
            if len(r) > k:  # all that reach the k-th value, so that ties are settled by g
                known = np.where(np.isnan(scores), -np.inf, scores)
                row, col = np.nonzero(known >= np.partition(known, len(r) - k, axis=1)[:, len(r) - k, None])
            else:
                row, col = (x.ravel() for x in np.indices(scores.shape))
            value = scores[row, col]
            order = np.lexsort((col, -value, row))
            row, col, value = row[order], col[order], value[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append(pd.DataFrame({"q": asked[a + row[kept]], "g": at[col[kept]], "score": value[kept]}))
        return pd.concat(found)

    schema = f"q {queries.select('q').dtypes[0][1]}, g {gallery.select('g').dtypes[0][1]}, score double"
    parts = meet(left, right, ["_qb", "_gb"], best, schema)
    return top_per_key(parts, ["q"], [F.desc("score"), "g"], k)


def recall_at_k(ranked: DataFrame, truth: DataFrame, total: int, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Share of the queries with a true partner among the first k: (k, recall)."""
    hits = ranked.join(truth, ["q", "g"], "left_semi").groupBy("q").agg(F.min("rank").alias("rank"))
    sums = hits.agg(*[F.sum((F.col("rank") <= k).cast("long")).alias(str(k)) for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.coalesce(F.col(str(k)), F.lit(0)) / total).alias("recall")) for k in ks]))
    return sums.select(rows.alias("_r")).select("_r.*")


def top_translations(translation: DataFrame, sources: int = 200, targets: int = 100) -> DataFrame:
    """The heaviest source words by expected count with their best targets."""
    heavy = translation.groupBy("src").agg(F.sum("count").alias("_w")).orderBy(F.desc(F.round("_w", 6)), "src").limit(sources)
    kept = translation.join(heavy.select("src"), "src", "left_semi")
    return top_per_key(kept, ["src"], [F.desc(F.round("p", 6)), "tgt"], targets)


def best_epoch(results: DataFrame) -> DataFrame:
    """(run, epoch, f1, ...) -> the row with the highest f1, the later one on a tie."""
    return results.groupBy("run").agg(F.max(F.struct("f1", "epoch")).alias("_b")).select("run", "_b.*")


def mention_order(mentions: DataFrame) -> DataFrame:
    return order.number_rows(
        mentions, ["doc"], ["m_start", "m_end"], order.blocks_of(F.col("m_start"), 65536), "place"
    )
