"""Assignment and greedy choice against plain solvers on small tables."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from corefold.operators import counts as C
from corefold.operators import matching as M


def plain_best(edges):
    """Largest total by trying every choice, lefts in turn."""
    value = {}
    for l, r, v in edges:
        value[l, r] = max(v, value.get((l, r), 0.0))
    lefts = sorted({l for l, _ in value})

    @functools.cache
    def best(i, used):
        if i == len(lefts):
            return 0.0
        take = [v + best(i + 1, used | {r}) for (l, r), v in value.items() if l == lefts[i] and r not in used]
        return max([best(i + 1, used), *take])

    return best(0, frozenset())


@pytest.mark.parametrize("seed", [1, 2])
def test_auction_reaches_the_best_total(spark, seed):
    draw = random.Random(seed)
    edges, want = [], 0.0
    for part in range(4):
        size = draw.randrange(2, 6)
        mine = [(f"{part}/{i}", f"{part}/{j}", draw.choice([0.25, 0.5, 2 / 3, 0.8, 0.4])) for i in range(size) for j in range(draw.randrange(2, 6)) if draw.random() < 0.7]
        edges += mine
        want += plain_best(mine)
    edges += [("path", "a", 2.0), ("path", "b", 3.0), ("end", "b", 2.0), ("path", "a", 1.0)]  # neither pair is certain
    want += 4.0
    found = M.best_matching(spark.createDataFrame(edges, "left string, right string, value double"), tolerance=1e-3)
    pairs = found.pairs.collect()
    assert len({p["left"] for p in pairs}) == len({p["right"] for p in pairs}) == len(pairs)
    assert found.total == pytest.approx(sum(p["value"] for p in pairs))
    assert found.bound >= want - 1e-9 and found.total >= want - 1e-3 * 2 * len(edges) and found.total <= want + 1e-9
    assert found.rounds > 0 and found.forced > 0


def test_stars_and_nothing(spark):
    star = [("g1", "p", 0.5), ("g2", "p", 0.8), ("g3", "p", 0.8), ("g4", "q", 1.0)]
    found = M.best_matching(spark.createDataFrame(star, "left string, right string, value double"))
    assert (found.total, found.bound, found.rounds) == (1.8, 1.8, 0)
    none = M.best_matching(spark.createDataFrame([], "left string, right string, value double"))
    assert none.total == 0 and none.pairs.count() == 0


def plain_choice(n_rows, columns, worth):
    free, out = sorted(columns), {}
    for place in range(n_rows):
        if free:
            pick = max(free, key=lambda c: (worth.get((place, c), 0), c))
            free.remove(pick)
            out[place] = pick
    return out


@pytest.mark.parametrize("n_rows,n_columns,density", [(12, 12, 0.2), (13, 8, 0.1)])
def test_rows_choose_in_order(spark, n_rows, n_columns, density):
    draw = random.Random(n_rows)
    columns = [f"c{i:02}" for i in range(n_columns)]
    worth = {(p, c): draw.randrange(1, 4) for p in range(n_rows) for c in columns if draw.random() < density}
    got = M.choose_in_order(
        spark.range(n_rows).withColumnRenamed("id", "place"), spark.createDataFrame([(c,) for c in columns], "column string"),
        spark.createDataFrame([(p, c, n) for (p, c), n in worth.items()], "place long, column string, n long"),
    )
    assert {r["place"]: r["column"] for r in got.collect()} == plain_choice(n_rows, columns, worth)


def test_confusion_order_of_an_empty_table(spark):
    table = spark.createDataFrame([], "type1 string, type2 string, n long, share double")
    assert C.confusion_order(table).count() == 0


def test_confusion_order_equals_the_plain_pass(spark):
    draw = random.Random(8)
    cells = {(f"r{i}", f"c{j}"): draw.randrange(1, 5) for i in range(10) for j in range(12) if draw.random() < 0.25}
    totals = {r: sum(n for (a, _), n in cells.items() if a == r) for r, _ in cells}
    table = spark.createDataFrame([(a, b, n, n / totals[a]) for (a, b), n in cells.items()], "type1 string, type2 string, n long, share double")
    best = {r: max(n / totals[r] for (a, _), n in cells.items() if a == r) for r in totals}
    rows = sorted(best, key=lambda r: (-best[r], r))
    chosen = plain_choice(len(rows), {c for _, c in cells}, {(rows.index(a), b): n for (a, b), n in cells.items()})
    left = sorted({c for _, c in cells} - set(chosen.values()))
    want = {("row", r): i for i, r in enumerate(rows)} | {("column", c): p for p, c in chosen.items()} | {("column", c): len(rows) + i for i, c in enumerate(left)}
    got = C.confusion_order(table).withColumn("place", F.col("place")).collect()
    assert {(r["axis"], r["name"]): r["place"] for r in got} == want
