"""Pairs of mentions, and of mentions and actions, with their match rules.

A pair table is as large as its definition makes it. Give agreement keys
(``keys``) where the rule has them, and prefer the operators that need no pairs:
the pairwise scores (plans.scoring) come from counts and the estimators
(plans.translation) from candidate words."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corefold.functions import text as X
from corefold.functions import vectors as V
from corefold.operators.order import blocks_of

BLOCK = 1024  # rows of one side that meet in one group of a pair join


def _with_top(rows: DataFrame, other: DataFrame, keys: Sequence[str], index: str, block: int) -> DataFrame:
    """Adds ``_top``, the last block of ``other`` for the row's keys. Only keys of
    more than one block are aggregated."""
    tops = (
        other.filter(F.col(index) >= block).groupBy(*keys).agg(F.max(blocks_of(F.col(index), block)).alias("_top"))
    )
    return rows.join(tops, list(keys), "left").withColumn("_top", F.coalesce("_top", F.lit(0)))


def _prefixed(rows: DataFrame, keys: Sequence[str], carry: Sequence[str], index: str, name: str, prefix: str) -> DataFrame:
    return rows.select(*keys, F.col(index).alias(name), *[F.col(c).alias(f"{prefix}_{c}") for c in carry])


def mention_pairs(
    mentions: DataFrame, keys: Sequence[str] = ("doc",), carry: Sequence[str] = (), block: int = BLOCK
) -> DataFrame:
    """Ordered pairs i < j of mentions with equal ``keys``; carried columns come
    back as a_* (of i) and b_* (of j).

    A large group is cut into blocks of ``block`` index values and every pair of
    blocks is its own join key, so no task meets a whole group. A row goes once to each
    pair that its block is in; both sides of the join read what was sent."""
    keys, carry = list(keys), [c for c in carry if c not in keys]
    own = mentions.select(*keys, "idx", *carry)
    placed = _with_top(own, mentions, keys, "idx", block).withColumn("_own", blocks_of(F.col("idx"), block))
    sent = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), "_top"))).select(
        *keys, F.least("_own", "_other").alias("_lb"), F.greatest("_own", "_other").alias("_rb"), "idx", *carry
    )
    left = sent.toDF(*keys, "_lb", "_rb", "i", *[f"a_{c}" for c in carry])
    right = sent.toDF(*keys, "_lb", "_rb", "j", *[f"b_{c}" for c in carry])
    apart = blocks_of(F.col("i"), block) < blocks_of(F.col("j"), block)
    met = left.join(right, [*keys, "_lb", "_rb"]).filter((F.col("i") < F.col("j")) & (apart | (F.col("_lb") == F.col("_rb"))))
    return met.drop("_lb", "_rb")


def antecedent_candidates(
    mentions: DataFrame, keys: Sequence[str] = ("doc",), carry: Sequence[str] = (), block: int = BLOCK
) -> DataFrame:
    """The pairs, read as (mention j, candidate i), and one row per mention with
    the null candidate i = -1."""
    pairs = mention_pairs(mentions, keys, carry, block)
    others = [c for c in carry if c not in keys]
    null = mentions.select(*keys, F.lit(-1).cast("long").alias("i"), F.col("idx").alias("j"), *[F.col(c).alias(f"b_{c}") for c in others])
    return pairs.unionByName(null, allowMissingColumns=True)


def spread(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_index: str, right_index: str, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by (keys, _lb, _rb) so that every row of the left meets
    every row of the right of its keys exactly once, at most block x block at a time.
    Rows with a negative index (null candidates) belong to the first block."""
    keys = list(keys)
    a = _with_top(left, right, keys, right_index, block).withColumn("_lb", blocks_of(F.greatest(F.col(left_index), F.lit(0)), block))
    b = _with_top(right, left, keys, left_index, block).withColumn("_rb", blocks_of(F.greatest(F.col(right_index), F.lit(0)), block))
    return (
        a.withColumn("_rb", F.explode(F.sequence(F.lit(0), "_top"))).drop("_top"),
        b.withColumn("_lb", F.explode(F.sequence(F.lit(0), "_top"))).drop("_top"),
    )


def mention_action_pairs(
    mentions: DataFrame, actions: DataFrame, keys: Sequence[str] = ("doc",), mention_index: str = "idx",
    action_index: str = "seg", block: int = BLOCK,
) -> DataFrame:
    """Every mention with every action of its document."""
    a, b = spread(mentions, actions, keys, mention_index, action_index, block)
    return a.join(b, [*keys, "_lb", "_rb"]).drop("_lb", "_rb")


def block_scores(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_index: str, right_index: str, fn, schema: str,
    block: int = BLOCK, ordered: bool = False,
) -> DataFrame:
    """``fn(left block, right block) -> rows`` in pandas per pair of blocks, for
    dense products whose result is much smaller than the pairs. ``doc long`` in the
    schema stands for the type that the document key has; the rows may also be a dict
    of arrays. ``ordered`` leaves out left blocks behind the right one, where no left
    index is the lower one."""
    schema = schema.replace("doc long", f"doc {left.select('doc').dtypes[0][1]}")
    a, b = spread(left, right, keys, left_index, right_index, block)
    if ordered:
        a, b = a.filter("_lb <= _rb"), b.filter("_lb <= _rb")
    return meet(a, b.toDF(*b.columns), [*keys, "_lb", "_rb"], fn, schema)  # fresh columns, so that a table may meet itself


def meet(left: DataFrame, right: DataFrame, on: Sequence[str], fn, schema: str) -> DataFrame:
    """``fn(left rows, right rows) -> rows`` in pandas for each key of ``on`` (null is a
    key) that either side has.

    Both sides travel in one table that is sorted inside its partitions, and a task
    reads it in batches: small keys share a batch, so a key costs a slice and not a
    transfer of its own. A task holds one batch and one key."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    on = list(on)
    sides = {"_l": left, "_r": right}
    packed = {name: F.struct(*[F.col(c) for c in side.columns]) for name, side in sides.items()}
    shapes = {name: side.select(packed[name].alias("_")).schema["_"].dataType for name, side in sides.items()}

    def tagged(mine: str) -> DataFrame:
        return sides[mine].select(*on, *[(packed[c] if c == mine else F.lit(None).cast(shapes[c])).alias(c) for c in sides])

    rows = tagged("_l").unionByName(tagged("_r")).repartition(*on).sortWithinPartitions(*on)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def begins(table: pa.Table) -> np.ndarray:
        change = np.ones(table.num_rows, dtype=bool)
        change[1:] = False
        for k in on:
            column = table.column(k)
            now, last = column.slice(1), column.slice(0, table.num_rows - 1)
            change[1:] |= pc.fill_null(pc.not_equal(now, last), False).to_numpy() | (pc.is_null(now).to_numpy() ^ pc.is_null(last).to_numpy())
        return np.flatnonzero(change)

    def part(table: pa.Table, name: str, starts: np.ndarray):
        """A side's rows, where each key begins in them, and its whole-number columns with nulls."""
        mine = pc.is_valid(table.column(name))
        at = np.concatenate([[0], np.cumsum(mine.to_numpy())])[np.append(starts, table.num_rows)]
        chunks = table.column(name).filter(mine).combine_chunks()
        flat = (chunks if isinstance(chunks, pa.Array) else pa.concat_arrays(chunks.chunks)).flatten()
        fields = list(table.schema.field(name).type)
        holed = [f.name for f, c in zip(fields, flat) if pa.types.is_integer(f.type) and c.null_count]
        frame = pa.Table.from_arrays(flat, names=[f.name for f in fields]).to_pandas(integer_object_nulls=True)
        return frame, at, holed

    def cut(side, k: int) -> pd.DataFrame:
        frame, at, holed = side
        rows = frame.iloc[at[k] : at[k + 1]]
        return rows.astype({c: float if rows[c].isna().any() else "int64" for c in holed}) if holed else rows

    def results(table: pa.Table, starts: np.ndarray):
        l, r = part(table, "_l", starts), part(table, "_r", starts)
        columns: list[list] = [[] for _ in out]
        size = 0
        for k in range(len(starts)):
            found = fn(cut(l, k), cut(r, k))
            if not len(found) or not len(found[out[0].name]):
                continue
            for field, column in zip(out, columns):
                column.append(pa.array(found[field.name], field.type, from_pandas=True))
            size += len(columns[0][-1])
            if size >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], schema=out)
                columns, size = [[] for _ in out], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], schema=out)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            starts = begins(table)
            if len(starts) > 1:
                yield from results(table.slice(0, starts[-1]), starts[:-1])
            held = table.slice(starts[-1])
        if held is not None:
            yield from results(held, np.zeros(1, dtype=int))

    return rows.mapInArrow(run, schema)


def pair_label(cluster_a: Column, cluster_b: Column, zero_is_none: bool = True) -> Column:
    same = cluster_a == cluster_b
    return ((same & (cluster_a != 0) & (cluster_b != 0)) if zero_is_none else same).cast("long")


def crosswalk_label(pairs: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """1 where the action label is among those mapped to the mention type."""
    mapped = crosswalk.select("type", "label").distinct().withColumn("_hit", F.lit(1))
    return pairs.join(mapped, ["type", "label"], "left").withColumn("y", F.coalesce("_hit", F.lit(0))).drop("_hit")


def invert_map(table: DataFrame, order: str = "ord") -> DataFrame:
    """(ord, coarse, fine array) -> fine, coarse; the last coarse name wins."""
    return (
        table.select(order, "coarse", F.posexplode("fine").alias("_p", "fine"))
        .groupBy("fine")
        .agg(F.max_by("coarse", F.struct(order, "_p")).alias("coarse"))
    )


def argument_compatibility(
    pairs: DataFrame, arguments: DataFrame, checked_types: Sequence[str] = ("Person",), similarity: float = 0.4
) -> DataFrame:
    """Adds ``compatible`` to event pairs (doc, i, j). True unless some argument of
    j of a checked type matches no argument of that type of i by string or vector;
    a type that i lacks is not checked. ``arguments`` carry a_tok, a_lemma, a_emb."""
    checked = arguments.filter(F.col("entity_type").isin(*checked_types))
    first = checked.select(
        "doc", F.col("e_idx").alias("i"), "entity_type", F.col("a_tok").alias("t1"), F.col("a_lemma").alias("l1"), F.col("a_emb").alias("v1")
    )
    second = checked.select(
        "doc", F.col("e_idx").alias("j"), "entity_type", "a_idx", F.col("a_tok").alias("t2"), F.col("a_lemma").alias("l2"), F.col("a_emb").alias("v2")
    )
    met = pairs.select("doc", "i", "j").join(first, ["doc", "i"]).join(second, ["doc", "j", "entity_type"])
    hit = X.string_match(F.col("t1"), F.col("t2"), F.col("l1"), F.col("l2")) | (V.abs_cosine(F.col("v1"), F.col("v2")) > similarity)
    verdict = (
        met.groupBy("doc", "i", "j", "entity_type", "a_idx").agg(F.bool_or(hit).alias("_ok"))
        .groupBy("doc", "i", "j").agg(F.bool_and("_ok").alias("_all"))
    )
    return pairs.join(verdict, ["doc", "i", "j"], "left").withColumn("compatible", F.coalesce("_all", F.lit(True))).drop("_all")


def _null_rule() -> Column:
    return ~F.col("b_tag").isin(X.PRONOUN_TAGS)


def match_semantic(similarity: float = 0.5) -> Column:
    """Over candidates keyed by type: cosine and number agree; the null candidate
    is accepted unless the mention is a pronoun. Vectors are of unit length."""
    real = (F.abs(V.dot(F.col("a_emb"), F.col("b_emb"))) > similarity) & X.number_match(F.col("a_number"), F.col("b_number"))
    return F.when(F.col("i") < 0, _null_rule()).otherwise(real)


def match_discourse() -> Column:
    real = (F.col("a_mtype") == "nominal") & (F.col("b_mtype") == "pronoun")
    return F.when(F.col("i") < 0, _null_rule()).otherwise(real)


def match_visual(candidates: DataFrame, translated_words: DataFrame) -> DataFrame:
    """Adds ``matched``: both visual, equal number, and the candidate's lemma has
    an entry in the visual table; the null candidate always matches."""
    known = translated_words.select(F.col("word").alias("a_lemma")).distinct().withColumn("_known", F.lit(True))
    real = F.col("a_visual") & F.col("b_visual") & (F.col("a_number") == F.col("b_number")) & F.col("_known").isNotNull()
    return (
        candidates.join(known, "a_lemma", "left")
        .withColumn("matched", F.when(F.col("i") < 0, True).otherwise(F.coalesce(real, F.lit(False))))
        .drop("_known")
    )


def match_entity_semantic() -> Column:
    """String, type and number agree; between two juxtaposed pairs the right
    neighbours must agree as well. Otherwise an acronym of each other."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    limits = {"text_limit": 0.2, "lemma_limit": 0.4}
    same = X.string_match(a("tok"), b("tok"), a("lemma"), b("lemma"), **limits)
    agree = (a("type") == b("type")) & X.number_match_entity(a("number"), b("number"), a("lemma"), b("lemma"))
    beside = X.is_consecutive(a("m_end"), a("right_start")) & X.is_consecutive(b("m_end"), b("right_start"))
    right = X.string_match(a("right_tok"), b("right_tok"), a("right_lemma"), b("right_lemma"), **limits)
    juxtaposed = F.coalesce(beside, F.lit(False))
    real = F.when(same, agree & (~juxtaposed | F.coalesce(right, F.lit(False)))).otherwise(X.is_acronym(a("tok"), b("tok")))
    return F.when(F.col("i") < 0, _null_rule()).otherwise(real)


def match_entity_discourse() -> Column:
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    agree = (a("type") == b("type")) & X.number_match_entity(a("number"), b("number"), a("lemma"), b("lemma"))
    beside = X.is_consecutive(a("m_end"), b("m_start"))
    blocked = (a("tag") == "PRP$") | ((a("tag") == "JJ") & (a("entity_type") != "Person"))
    real = F.when(beside, ~blocked & agree).when(b("tag") == "CD", agree).otherwise(False)
    return F.when(F.col("i") < 0, _null_rule()).otherwise(real)


def match_entity_pronoun() -> Column:
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    agree = (a("type") == b("type")) & X.number_match_entity(a("number"), b("number"), a("lemma"), b("lemma"))
    real = a("mtype").isin("proper", "nominal") & (b("mtype") == "pronoun") & agree
    return F.when(F.col("i") < 0, _null_rule()).otherwise(real)


def candidate_pairs(listed: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc, idx, candidates array of idx) -> doc, i, j, y with the pair label."""
    members = mentions.select("doc", "idx", "cluster")
    return (
        listed.select("doc", F.col("idx").alias("j"), F.explode("candidates").alias("i"))
        .join(members.withColumnRenamed("idx", "j").withColumnRenamed("cluster", "_cj"), ["doc", "j"])
        .join(members.withColumnRenamed("idx", "i").withColumnRenamed("cluster", "_ci"), ["doc", "i"])
        .select("doc", "i", "j", pair_label(F.col("_ci"), F.col("_cj")).alias("y"))
    )


def label_candidate_spans(spans: DataFrame, mentions: DataFrame) -> DataFrame:
    gold = mentions.groupBy("doc", "m_start", "m_end").agg(F.max("cluster").alias("cluster"))
    return spans.join(gold, ["doc", "m_start", "m_end"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))


def match_ie_to_gold(triggers: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc, t_id, m_start, m_end) -> the gold mention of the first token that the
    trigger overlaps; keyed on the tokens covered, no range join."""
    covered = triggers.select("doc", "t_id", F.explode(F.sequence("m_start", "m_end")).alias("tid"))
    marked = gold.select("doc", F.col("idx").alias("gold_idx"), F.explode(F.sequence("m_start", "m_end")).alias("tid"))
    return (
        covered.join(marked, ["doc", "tid"]).groupBy("doc", "t_id")
        .agg(F.min_by("gold_idx", F.struct("tid", "gold_idx")).alias("gold_idx"))
    )
