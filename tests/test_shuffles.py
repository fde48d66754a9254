"""What findings of round 3 asked for: rows travel once. Results against brute force,
plans for what is sent."""

import itertools
import math

from pyspark.sql import functions as F

from corefold.catalog.tables import Tables
from corefold.llm import line_dedup
from corefold.operators import media as M
from corefold.operators import pairs as P
from corefold.operators import spans as S
from corefold.plans import mixture as MX


def _plan(spark, build) -> str:
    """The plan of a table far larger than what a broadcast may hold."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return build()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_pairs_send_a_row_once(spark):
    rows = [("d", i, float(i)) for i in (0, 1, 2, 3, 4, 7, 7, 9)] + [("e", 5, 0.5), ("e", 6, 0.25), (None, 1, 0.0), (None, 2, 0.0)]
    df = spark.createDataFrame(rows, "doc string, idx long, x double")
    want = sorted((a[0], a[1], a[2], b[1], b[2]) for a, b in itertools.product(rows, rows) if a[0] and a[0] == b[0] and a[1] < b[1])
    for block in (2, 3, 100):
        got = P.mention_pairs(df, ["doc"], ["x"], block)
        assert got.columns == ["doc", "i", "a_x", "j", "b_x"]
        assert sorted((r["doc"], r["i"], r["a_x"], r["j"], r["b_x"]) for r in got.collect()) == want
    assert "ReusedExchange" in _plan(spark, lambda: P.mention_pairs(df, ["doc"], ["x"]))


def test_arguments_meet_by_cells(spark, tmp_path):
    words = ["abcdefgh", "bcdefghij", "no", "cdefghijkl", "defghijk"]
    text = " ".join(words[i * i % 5] for i in range(150))
    spark.createDataFrame([(1, 0, text), (1, 1, text[:200]), (2, 0, "abcdefgh")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    t = Tables(spark, str(tmp_path))
    m = [r.asDict() for r in t.mentions().collect()]
    want = sorted(
        (e["doc"], e["idx"], a["idx"], ["Agent", "Patient", "Place"][abs(a["m_start"] - e["m_start"]) % 3])
        for e, a in itertools.product(m, m)
        if (e["doc"], e["sent"], e["kind"], a["kind"]) == (a["doc"], a["sent"], "event", "entity") and abs(a["m_start"] - e["m_start"]) <= 10
    )
    assert len(want) > 100 and sorted((r["doc"], r["e_idx"], r["a_idx"], r["role"]) for r in t.arguments().collect()) == want
    sent = Tables.arguments.__wrapped__(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "cell#" in sent


def test_argument_rows_are_dealt_by_event_once(spark):
    arguments = spark.createDataFrame([("d", 0, a, a + 5, "r") for a in (1, 3, 5)] + [("d", 2, 1, 6, "r"), ("d", 4, 90, 9, "r")], "doc string, e_idx long, a_idx long, a_start long, role string")
    mentions = spark.createDataFrame([("d", i, i + 5, "event" if i % 2 == 0 else "entity") for i in [*range(8), 90]], "doc string, idx long, m_start long, kind string")
    got = S.event_argument_map(arguments, mentions, 2, 2, 80)
    assert sorted((r["event_row"], r["role_no"], r["a_idx"]) for r in got.collect()) == [(0, 0, 1), (0, 1, 3), (1, 0, 1)]
    plan = _plan(spark, lambda: S.event_argument_map(arguments, mentions, 2, 2, 80))
    assert plan.count("Exchange hashpartitioning(doc") == 8


def test_alignment_carries_means(spark):
    events = [("d", 0, "w", ["p", "p", "q"]), ("d", 1, "w", []), ("d", 2, "v", ["q"]), ("e", 0, "w", ["p"]), ("f", 0, "w", ["p"])]
    actions = [("d", 3, "l", ["x", "y"]), ("d", 1, "l", ["y", "x"]), ("d", 2, "k", ["z"]), ("d", 5, "k", []), ("e", 1, "l", ["z"])]
    p_action = {("w", "l"): 0.5, ("w", "k"): 0.25, ("v", "k"): 0.5}
    p_object = {("p", "x"): 0.3, ("p", "y"): 0.7, ("q", "x"): 0.9, ("q", "z"): 0.1}
    want = []
    for doc, idx, word, args in events:
        best = (0.008, 0, -1)
        for d, seg, label, objects in actions:
            if d == doc and (word, label) in p_action:
                means = [sum(p_object.get((a, o), 0) for a in args) / len(args) for o in objects] if args else []
                best = max(best, (round(p_action[word, label] * math.prod(means), 12), -seg, seg))
        want.append((doc, idx, best[2], round(best[0], 9)))
    tables = (
        spark.createDataFrame(events, "doc string, idx long, word string, args array<string>"), spark.createDataFrame(actions, "doc string, seg long, label string, objects array<string>"),
        spark.createDataFrame([(*k, p) for k, p in p_action.items()], "word string, label string, p double"), spark.createDataFrame([(*k, p) for k, p in p_object.items()], "argument string, object string, p double"),
    )
    found = MX.graph_alignment(*tables, 0.008)
    assert sorted((r["doc"], r["idx"], r["aligned"], round(r["score"], 9)) for r in found.collect()) == sorted(want)
    assert "posexplode(objects" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_find_vectors_by_word(spark):
    tokens = spark.createDataFrame([("d", 0, "ab", 1), ("d", 1, "cd", 2), ("d", 2, "", 0), ("e", 0, "ab", 1)], "doc string, tid long, tok string, n_pieces long")
    pieces = S.pieces_of_tokens(S.piece_alignment(tokens), ["tok"])
    own = pieces.select("doc", "piece", F.array(F.col("piece").cast("double")).alias("emb"))
    vectors = spark.createDataFrame([("ab", [7.0, 8.0])], "word string, emb array<double>")
    words = M.token_vectors(tokens.select("tok").distinct(), vectors, 2)
    got = M.piece_vectors(pieces, words, own, ["tok"]).collect()
    assert sorted((r["doc"], r["piece"], r["emb"]) for r in got) == [("d", 0, [0.0, 7.0, 8.0]), ("d", 1, [1.0, 0.0, 0.0]), ("d", 2, [2.0, 0.0, 0.0]), ("e", 0, [0.0, 7.0, 8.0])]


def test_mention_vectors_need_no_second_reading(spark, tmp_path):
    spark.createDataFrame([(1, 0, "abcdefgh bcdefghi cdefghij"), (None, 0, "abcdefgh")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, [float(i)] * 2, i) for i in range(2)], "vec_id long, embedding array<double>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    t = Tables(spark, str(tmp_path))
    found = t.mention_vectors()
    assert sorted((r["doc"], r["idx"], r["emb"][0]) for r in found.collect()) == [(1, 0, 0.0), (1, 1, 1.0), (1, 2, 0.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_lines_are_cut_once(spark):
    texts = ["a line of more than sixteen characters\nanother line, also long enough here", "a line of more than sixteen charakters\nshort", None]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    got = line_dedup.occurrences(docs).collect()
    assert sorted((r["doc_id"], r["place"], r["n_links"], r["kept"]) for r in got) == [(0, 0, 1, True), (0, 1, 0, True), (1, 0, 1, False)]
    assert seen.value == len(texts)


def test_near_duplicates_leave_texts_where_they_are(spark, tmp_path):
    import corpus_pipeline

    words = [" ".join(f"w{(i * j) % 31}x{i}" for j in range(1, 40)) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(words)] + [(3, words[3]), (20, words[4] + " more"), (None, words[5]), (21, None), (21, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    docs.write.parquet(f"{tmp_path}/docs")
    found = corpus_pipeline.remove_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path))
    assert sorted(r["doc_id"] for r in found.collect()) == [*range(12), 21]
    # Only rows that are there twice are sent with their text; all others meet a small table.
    plan = found._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 2 and all("BroadcastHashJoin" in line for line in joins)


def test_rounds_of_few_edges_lie_in_few_partitions(spark, monkeypatch):
    from corefold.plans import clusters as K

    sizes, cut = [], K.cut_lineage
    monkeypatch.setattr(K, "cut_lineage", lambda df: sizes.append((out := cut(df)).rdd.getNumPartitions()) or out)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 50), (50, 60), (60, 40)], "src long, dst long")
        found = {r["node"]: r["component"] for r in K.connected_components(edges).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert found == {i: 0 for i in range(21)} | {40: 40, 50: 40, 60: 40}
    assert len(sizes) > 2 and max(sizes[1:]) <= 8
