"""Reader variants that the registered round trips do not take."""

import json

from corefold.sources import readers as R
from corefold.sources import sinks as W


def test_whole_file_token_map(spark, tmp_path):
    path = tmp_path / "documents.json"
    path.write_text(json.dumps({"d_1": [[0, 0, "A", True], [0, 1, "b", False, "NN"]], "d_2": []}, indent=2))
    rows = R.read_token_documents(spark, str(path), whole_file=True).orderBy("tid").collect()
    assert [(r["doc"], r["sent"], r["tid"], r["tok"], r["flag"], r["tag"]) for r in rows] == [("d_1", 0, 0, "A", True, None), ("d_1", 0, 1, "b", False, "NN")]


def test_mention_array_file_and_empty_span(spark, tmp_path):
    path = tmp_path / "events.json"
    path.write_text(json.dumps([{"doc_id": "d", "m_id": "0", "tokens_ids": [3, 4], "event_type": "X.Y", "cluster_id": 2, "arguments": [{"start": 1, "end": 1, "role": "R", "text": "t"}]}, {"doc_id": "d", "m_id": "1", "tokens_ids": []}], indent=1))
    rows = R.read_mentions(spark, str(path), "event", array_file=True).orderBy("m_id").collect()
    assert [(r["m_start"], r["m_end"]) for r in rows] == [(3, 4), (-1, -1)]
    assert rows[0]["arguments"][0]["text"] == "t"


def test_standoff_per_document_files(spark, tmp_path):
    (tmp_path / "v1.ann").write_text("T1 Person 0 5 John Smith\nT2 Attack 6 9 hit\nE1 Attack:T2 Agent:T1\n* EventCoref E1 E2\n")
    (tmp_path / "v2.ann").write_text("\n")
    read = R.read_standoff(spark, str(tmp_path / "*.ann"))
    first = read["mentions"].filter("m_id = 'T1'").first()
    assert (first["doc"], first["text"], first["c_to"]) == ("v1", "John Smith", 4)
    assert [(r["role"], r["m_id"]) for r in read["roles"].collect()] == [("Agent", "T1")]
    assert read["coreference"].count() == 2
    assert [r["file"].split("/")[-1] for r in R.non_empty_files(spark, str(tmp_path / "*.ann")).collect()] == ["v1.ann"]


def test_inclusive_sentence_annotations(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"sentence_id": "d_0", "words": ["a", "b"], "golden-entity-mentions": [{"start": 0, "end": 1, "text": "a b", "entity-type": "P"}], "golden-event-mentions": []}))
    assert R.read_sentence_annotations(spark, str(path), inclusive=True)["entities"].first()["m_end"] == 1
    assert R.read_sentence_annotations(spark, str(path), inclusive=False)["entities"].first()["m_end"] == 0


def test_conll_order_inside_files(spark, tmp_path):
    tokens = spark.createDataFrame([(d, 0, t, f"w{t}", True, "top") for d in (1, 2) for t in range(4)], "doc long, sent long, tid long, tok string, flag boolean, topic string")
    m = spark.createDataFrame([(1, 0, 2, 5), (1, 1, 1, 6), (1, 1, 2, 7)], "doc long, m_start long, m_end long, cluster long")
    out = str(tmp_path / "conll")
    W.write_conll(W.conll_lines(W.conll_brackets(tokens, m)), out)
    lines = []
    for part in sorted((tmp_path / "conll" / "topic=top").glob("part-*")):
        lines += part.read_text().splitlines()
    assert lines[0] == "#begin document 1" and lines[5] == "#end document" and len(lines) == 12
    assert [x.split("\t")[-1] for x in lines[1:5]] == ["(5", "(6)|(7", "5)|7)", "-"] or [x.split("\t")[-1] for x in lines[1:5]] == ["(5", "(6)|(7", "7)|5)", "-"]


def test_per_document_standoff_folders(spark, tmp_path):
    lines = spark.createDataFrame([(1, "T1 A 0 1 x"), (2, "T1 B 0 1 y")], "doc long, line string")
    W.write_standoff(lines, str(tmp_path / "out"), tagged=False)
    assert sorted(p.name for p in (tmp_path / "out").glob("doc=*")) == ["doc=1", "doc=2"]
