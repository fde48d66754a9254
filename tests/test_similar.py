"""The exact-or-similar model against a plain EM over all its candidates."""

import collections
import math
import random

import pytest

from corefold.plans import similar as S
from corefold.plans import translation as T

NEW = "###NEW###"


def mentions():
    rng = random.Random(4)
    rows = []
    for doc in range(9):
        for idx in range(40 if doc == 3 else rng.randint(1, 8)):
            tok = rng.choice("abcdefgh") + rng.choice(["", "x", "y", "z"])
            rows.append((doc, idx, tok, None if tok == "hz" else tok[0] < "e", [rng.uniform(-1, 1) * (1 if doc % 2 else 0.1) for _ in range(3)]))
    return rows + [r for r in rows if r[0] == 2]  # a document whose rows come twice


def plain(rows, vocab, rounds):
    first = {}
    for doc, idx, tok, *_ in rows:
        first[doc, tok] = min(idx, first.get((doc, tok), idx))
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    weights = collections.defaultdict(lambda: collections.Counter())
    exact = {(doc, idx, tok) for doc, idx, tok, *_ in rows if first[doc, tok] < idx}
    for doc, j, tok, family, emb in rows:
        if first[doc, tok] < j:
            continue
        weights[doc, j, tok][NEW] += 1
        for d, i, src, f, other in rows:
            if d == doc and i < j and f is not None and f == family:
                weights[doc, j, tok][src] += abs(sum(x * y for x, y in zip(unit(emb), unit(other))))
    p = collections.defaultdict(lambda: 1 / vocab)
    for _ in range(rounds):
        count, total = collections.Counter(), collections.Counter()
        for (_, _, tgt), found in weights.items():
            z = sum(n * p[src, tgt] for src, n in found.items())
            for src, n in found.items():
                count[src, tgt] += n * p[src, tgt] / z
                total[src] += n * p[src, tgt] / z
        p = {(s, t): c / total[s] for (s, t), c in count.items()}
    out = {("similar", s, t): (count[s, t], p[s, t]) for s, t in count}
    return out | {("exact", t, t): (n, 1.0) for t, n in collections.Counter(tok for _, _, tok in exact).items()}


@pytest.mark.parametrize("part, few", [(1 << 23, 1 << 18), (40, 10)])
def test_rounds_without_a_table_of_candidates(spark, monkeypatch, part, few):
    monkeypatch.setattr(S, "PART", part)
    monkeypatch.setattr(S, "FEW", few)
    rows = mentions()
    given = spark.createDataFrame(rows, "doc long, idx long, tok string, family boolean, emb array<double>")
    found = T.similarity_candidates(given, ["doc", "family"], block=2)
    assert found.n == 1 if part > 40 else found.n > 5
    assert found.groups.count() <= len({(r[0], r[3]) for r in rows})  # a row per document and family, none per candidate
    assert (found.groups.filter("whole").count() > 0) == (part > 40)  # both ways to a part are met
    got = {(r["mode"], r["src"], r["tgt"]): (r["count"], r["p"]) for r in T.fit_exact_or_similar(found, 32, 3).collect()}
    want = plain(rows, 32, 3)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9)


def test_shuffles_of_written_tables_leave_no_files(spark, tmp_path):
    from corefold.session import CLEANUP, written

    before = spark.conf.get(CLEANUP, None)
    assert written(spark.range(1000).repartition(7, "id"), "kept").count() == 1000
    assert spark.conf.get(CLEANUP, None) == before
