"""Event arguments: imputation, conditional tables and the joint pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corefold.functions import text as X
from corefold.operators import pairs as P
from corefold.plans import clusters as K
from corefold.plans import translation as T
from corefold.plans.dealt import unlisted
from corefold.session import written

EPS = 1e-100
UNK_TEXT = "###UNK###"
VALUES = 4096  # values of a document in one list, about


def imputation_candidates(slots: DataFrame) -> DataFrame:
    """(doc, e_idx, role, trigger, value or null) -> candidates of each slot in the
    layout of plans.translation: role as mode, trigger as src, argument as tgt."""
    return unlisted(listed_candidates(slots))


def listed_candidates(slots: DataFrame) -> DataFrame:
    """The candidates of each slot as lists ``_c`` of (tgt, n, first).

    A known slot has its own value. A missing one has the known values of the other
    events of its document, counted per value; with none it keeps NULL text.

    The values of a document travel as lists of VALUES at most and those of the own event
    as a map, so that only what meets the slots is shuffled, not the candidates. ``_own`` is
    the trigger that deals a slot."""
    place = F.concat_ws(":", "e_idx", "role")
    slots = slots.withColumn("_own", F.min("trigger").over(Window.partitionBy("doc", place)))
    known = slots.filter("value IS NOT NULL")
    missing = slots.filter("value IS NULL").select("doc", "e_idx", "role", "trigger", "_own")
    own = known.groupBy("doc", "e_idx", "value").agg(F.count("*").alias("_own"))
    lowest = own.groupBy("doc", "value").agg(F.sum("_own").alias("_all"), F.min("e_idx").alias("_e1"))
    second = own.join(lowest, ["doc", "value"]).groupBy("doc", "value").agg(F.min(F.when(F.col("e_idx") > F.col("_e1"), F.col("e_idx"))).alias("_e2"))
    values = lowest.join(second, ["doc", "value"])
    sizes = values.groupBy("doc").agg(F.ceil(F.count("*") / VALUES).alias("_k"), F.sum("_all").alias("_total"))
    lists = values.join(sizes.drop("_total"), "doc").groupBy("doc", F.pmod(F.xxhash64("value"), F.col("_k")).alias("_b"))
    lists = lists.agg(F.collect_list(F.struct("value", "_all", "_e1", "_e2")).alias("_v"))
    mine = own.groupBy("doc", "e_idx").agg(F.map_from_entries(F.collect_list(F.struct("value", "_own"))).alias("_m"), F.sum("_own").alias("_mine"))
    placed = missing.join(mine, ["doc", "e_idx"], "left")
    here = lambda column: F.coalesce(column, F.lit(0))
    first = lambda v: F.when(v["_e1"] == F.col("e_idx"), v["_e2"]).otherwise(v["_e1"])
    n = lambda v: (v["_all"] - here(F.try_element_at("_m", v["value"]))).cast("double")
    each = F.filter(F.transform("_v", lambda v: F.struct(v["value"].alias("tgt"), n(v).alias("n"), first(v).alias("first"))), lambda c: c["n"] > 0)
    slot = ["doc", "e_idx", "role", "trigger", "_own"]
    found = placed.join(lists, "doc").select(*slot, each.alias("_c")).filter(F.size("_c") > 0)
    alone = placed.join(sizes.drop("_k"), "doc", "left").filter(here(F.col("_total")) <= here(F.col("_mine")))
    one = lambda value: F.array(F.struct(value.alias("tgt"), F.lit(1.0).alias("n"), F.lit(-1).cast("long").alias("first"))).alias("_c")
    rows = found.unionByName(known.select(*slot, one(F.col("value")))).unionByName(alone.select(*slot, one(F.lit(X.NULL_TEXT))))
    return rows.select(
        F.col("role").alias("mode"), "doc", place.alias("j"), F.col("trigger").alias("src"), F.lit(0).cast("long").alias("dist"),
        F.lit(True).alias("open"), "e_idx", "_own", "_c",
    )


def fit_imputer(slots: DataFrame, rounds: int) -> T.Fitted:
    roles = [r["role"] for r in slots.select("role").distinct().orderBy("role").collect()]  # one row per role of the ontology
    vocab = slots.select(F.countDistinct(F.coalesce("value", F.lit(X.NULL_TEXT)))).first()[0]
    return T.fit(listed_candidates(written(slots, "slots")), {r: vocab for r in roles}, rounds, own="src")


def impute_arguments(model: T.Fitted) -> DataFrame:
    """doc, e_idx, role, value: the best-scoring value of every slot; ties go to
    the earliest event, then by name."""
    best = model.dealt.best(model.translation.withColumn("p", F.round("p", 12)))
    return best.select("doc", F.split("j", ":", 2)[0].try_cast("long").alias("e_idx"), F.col("mode").alias("role"), F.col("tgt").alias("value"))


def argument_conditional(arguments: DataFrame) -> DataFrame:
    """entity_type, trigger, arg, p: P(argument | type, trigger) by counts, with one
    UNK count per trigger and a NULL row per type over all triggers."""
    counts = arguments.groupBy("entity_type", F.col("e_lemma").alias("trigger"), F.col("a_lemma").alias("arg")).agg(F.count("*").alias("c"))
    unknown = counts.select("entity_type", "trigger").distinct().select("entity_type", "trigger", F.lit(UNK_TEXT).alias("arg"), F.lit(1).cast("long").alias("c"))
    null = counts.groupBy("entity_type", "arg").agg(F.sum("c").alias("c")).select("entity_type", F.lit(X.NULL_TEXT).alias("trigger"), "arg", "c")
    rows = counts.unionByName(unknown).unionByName(null)
    totals = rows.groupBy("entity_type", "trigger").agg(F.sum("c").alias("_t"))
    return rows.join(totals, ["entity_type", "trigger"]).select("entity_type", "trigger", "arg", (F.col("c") / F.col("_t")).alias("p"))


def argument_pair_prob(pairs: DataFrame, arguments: DataFrame, conditional: DataFrame, translation: DataFrame) -> DataFrame:
    """Adds ``arg_prob`` to event pairs (doc, i, j, a_lemma = trigger of i): the
    product over the arguments of j of the best P(argument | argument of i of its
    type); without one of that type P(argument | type, trigger of i), or P of the
    null word where the trigger is unknown. 1 without arguments."""
    table = translation.select("src", "tgt", F.col("p").alias("_pair"))
    null = translation.filter(F.col("src") == X.NEW_TEXT).select("tgt", F.col("p").alias("_null"))
    second = arguments.select("doc", F.col("e_idx").alias("j"), "a_idx", "entity_type", F.col("a_lemma").alias("tgt"))
    wanted = pairs.select("doc", "i", "j", F.col("a_lemma").alias("trigger")).join(second, ["doc", "j"])
    first = arguments.select("doc", F.col("e_idx").alias("i"), "entity_type", F.col("a_lemma").alias("src"))
    key = ["doc", "i", "j", "a_idx", "entity_type", "tgt", "trigger"]
    met = wanted.join(first, ["doc", "i", "entity_type"], "left")
    paired = met.join(table, ["src", "tgt"], "left").groupBy(*key).agg(F.count("src").alias("_met"), F.max("_pair").alias("_best"))
    known = conditional.select("entity_type", "trigger").distinct().withColumn("_trigger", F.lit(True))
    exact = conditional.select("entity_type", "trigger", F.col("arg").alias("tgt"), F.col("p").alias("_exact"))
    unknown = conditional.filter(F.col("arg") == UNK_TEXT).select("entity_type", "trigger", F.col("p").alias("_unk"))
    full = (
        paired.join(null, "tgt", "left").join(known, ["entity_type", "trigger"], "left")
        .join(exact, ["entity_type", "trigger", "tgt"], "left").join(unknown, ["entity_type", "trigger"], "left")
    )
    floor = F.coalesce("_null", F.lit(EPS))
    p = F.when(F.col("_met") > 0, F.greatest(F.coalesce("_best", floor), F.lit(EPS))).when(
        F.col("_trigger").isNotNull(), F.coalesce("_exact", "_unk")
    ).otherwise(floor)
    products = full.groupBy("doc", "i", "j").agg(F.exp(F.sum(F.ln(p))).alias("arg_prob"))
    return pairs.join(products, ["doc", "i", "j"], "left").withColumn("arg_prob", F.coalesce("arg_prob", F.lit(1.0)))


def joint_pipeline(entities: DataFrame, events: DataFrame, arguments: DataFrame, rounds: int, checked_type: str = "Person") -> DataFrame:
    """Entity clusters first, then event antecedents among the pairs whose checked
    arguments agree: each such argument of the later event must share a cluster
    with one of the earlier event's, if that has any."""
    model = T.fit(T.text_candidates(entities, ["doc", "type"]), T.vocab_sizes(entities), rounds)
    rounded = model.translation.withColumn("p", F.round("p", 12))
    links = T.predict_antecedents(model.dealt, rounded)
    labels = K.roots_of_links(links).select("doc", F.col("idx").alias("a_idx"), F.col("root").alias("_c"))
    held = arguments.filter(F.col("entity_type") == checked_type).join(labels, ["doc", "a_idx"]).select("doc", "e_idx", "_c").distinct()
    pairs = P.mention_pairs(events, ["doc", "type"], ["lemma"])
    second = held.select("doc", F.col("e_idx").alias("j"), "_c")
    first = held.select("doc", F.col("e_idx").alias("i"), "_c", F.lit(True).alias("_same"))
    checked = (
        pairs.select("doc", "i", "j").join(held.select("doc", F.col("e_idx").alias("i")).distinct(), ["doc", "i"])
        .join(second, ["doc", "j"]).join(first, ["doc", "i", "_c"], "left")
    )
    refused = checked.filter("_same IS NULL").select("doc", "i", "j").distinct()
    admitted = pairs.join(refused, ["doc", "i", "j"], "left_anti")
    cand = T.candidates_from_pairs(admitted).unionByName(T.null_candidates(events))
    fitted = T.fit(cand, T.vocab_sizes(events), rounds)
    return T.predict_antecedents(fitted.dealt, fitted.translation.withColumn("p", F.round("p", 12)))
