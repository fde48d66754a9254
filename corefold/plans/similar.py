"""The exact-or-similar model without a table of its candidates.

A mention with an earlier equal text is exact and its posterior is 1. Any other one is the
first of its text in its document (the target), and its candidates are the earlier
texts of its keys, weighed by the |cos| of the vectors: nearly as many as there are pairs of
mentions. They are made where they are used. Part g of n has the targets whose
word falls to g, so all that the rounds know of a pair of words lies in one part but for the
total of the source word: a round sends one number per word and part, and a part plays the
earlier rounds again with their totals.

Groups of few mentions are dealt to the parts once, as candidates; where the vectors
are smaller than that, each part reads them and makes the candidates of its own targets."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefold.functions import text as X
from corefold.operators import order
from corefold.operators import pairs as P
from corefold.session import fresh_path, written

EPS = 1e-100
PART = 1 << 23  # candidates of a part, about
FEW = 1 << 18  # candidates below which a part is not worth a task
STEP = 1 << 20  # candidates, or cells of a matrix product, that are held at once
CHUNK = 1 << 16  # words whose totals travel in one row
ROW = "kind string, at long, pack binary"


def _part_of(code, n: int):
    import numpy as np

    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)


def _packed(**columns) -> bytes:
    import pyarrow as pa

    table = pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for name, c in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(pack: bytes) -> dict:
    import pyarrow as pa

    table = pa.ipc.open_stream(pack).read_all()
    return {name: table.column(name).chunk(0).values for name in table.column_names}


def _deltas(lengths, src) -> bytes:
    """Ascending codes of each target as differences, byte by byte."""
    import numpy as np
    import pyarrow as pa

    steps = np.diff(src, prepend=0).astype(np.int32)
    steps[np.cumsum(lengths)[:-1]] = src[np.cumsum(lengths)[:-1]]
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _codes(lengths, packed: bytes):
    import numpy as np
    import pyarrow as pa

    size = int(lengths.sum())
    raw = pa.decompress(packed, decompressed_size=size * 4, codec="zstd", asbytes=True)
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).ravel()
    run = np.cumsum(steps, dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    return (run - np.repeat(run[starts] - steps[starts], lengths)).astype(np.int32)


@dataclass
class Similar:
    """words: code, tok (the null word among them). groups: a row per document and keys.
    exact: tok, count. ``new`` is the code of the null word, ``n`` the number of parts."""

    words: DataFrame
    groups: DataFrame
    exact: DataFrame
    new: int
    size: int
    n: int
    block: int


def candidates(mentions: DataFrame, keys: Sequence[str], block: int) -> Similar:
    """mentions: doc, idx, tok, emb and the ``keys``, doc among them. A null key has no equal."""
    import numpy as np
    import pandas as pd

    spark = mentions.sparkSession
    keys = list(keys)
    held = mentions.filter("doc IS NOT NULL AND tok IS NOT NULL")
    names = held.select(*dict.fromkeys(["doc", *keys, "idx", "tok"])).distinct()
    firsts = names.groupBy("doc", "tok").agg(F.min("idx").alias("_f"))
    placed = written(names.join(firsts, ["doc", "tok"]).withColumn("_exact", F.col("_f") < F.col("idx")).drop("_f"), "similar")
    seen = placed.select("tok").union(spark.createDataFrame([(X.NEW_TEXT,)], "tok string")).distinct()
    words = written(order.number_by_range(seen, ["tok"], "code").select("code", "tok"), "similar")
    size = words.count()
    new = words.filter(F.col("tok") == X.NEW_TEXT).first()["code"]
    exact = placed.filter("_exact").select("doc", "idx", "tok").distinct().groupBy("tok").agg(F.count("*").cast("double").alias("count"))
    targets = placed.filter("NOT _exact").groupBy(*keys).agg(F.count("*").cast("double").alias("_d"))
    total = targets.agg(F.sum(F.col("_d") * (F.col("_d") + 1) / 2)).first()[0] or 0
    n = max(1, math.ceil(total / PART), min(spark.sparkContext.defaultParallelism, math.ceil(total / FEW)))
    alone = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    light = placed.join(words, "tok").select(*keys, "idx", "code", "_exact", alone.alias("_alone"))
    heavy = held.select(*keys, "idx", "emb")

    def pack(l: pd.DataFrame, r: pd.DataFrame) -> dict:
        if l.empty or l["_exact"].all():
            return {}
        l = l.sort_values(["idx", "code"])
        r = r.sort_values("idx", kind="stable")
        at, names_ = r["idx"].to_numpy(), l["idx"].to_numpy()
        of = np.searchsorted(names_, at)
        width = max((len(v) for v in r["emb"] if v is not None), default=0)
        vectors = np.zeros((len(r), width))
        for i, v in enumerate(r["emb"]):
            if v is not None:
                vectors[i] = v
        single = vectors.astype(np.float32)
        vectors = single if (single == vectors).all() else vectors  # no digit is lost
        done = l["_exact"].to_numpy()
        d = int((~done[of]).sum())
        whole = not l["_alone"].iat[0] and 6 * d * d > n * vectors.nbytes
        packed = _packed(idx=at, code=l["code"].to_numpy()[of].astype(np.int32), exact=done[of], vec=vectors.ravel(), alone=[bool(l["_alone"].iat[0])])
        return {"whole": [whole], "pack": [packed]}

    groups = written(P.meet(light, heavy, keys, pack, "whole boolean, pack binary"), "similar")
    return Similar(words, groups, exact, new, size, n, block)


def _of_group(pack: bytes, new: int, block: int, mine=None) -> Iterator[tuple]:
    """Targets, how many candidates they have, and the candidates' codes (ascending
    but for the null word, which comes first) and weights; ``mine`` tells the targets by code."""
    import numpy as np

    part = _unpacked(pack)
    idx, code, alone = part["idx"].to_numpy(), part["code"].to_numpy(), part["alone"][0].as_py()
    wanted = ~part["exact"].to_numpy(zero_copy_only=False)
    if mine is not None:
        wanted &= mine(code)
    chosen = np.flatnonzero(wanted)
    if not len(chosen):
        return
    at, starts, times = np.unique(idx[chosen], return_index=True, return_counts=True)
    tgt = code[chosen[starts]]
    if alone:
        yield tgt, np.ones(len(tgt), np.int64), np.full(len(tgt), new, np.int32), times.astype(float)
        return
    vec = part["vec"].to_numpy().reshape(len(idx), -1).astype(float)
    vec /= np.maximum(np.sqrt((vec * vec).sum(axis=1, keepdims=True)), EPS)
    by = np.argsort(code, kind="stable")  # columns by word, and by place inside it
    column, place, across = code[by], idx[by], vec[by].T
    begins = np.flatnonzero(np.diff(column, prepend=-1))
    words, k = column[begins], max(1, min(block * 64, STEP // len(idx)))
    for low in range(0, len(at), k):
        rows, here = chosen[starts[low] : starts[low + k] if low + k < len(at) else None], at[low : low + k]
        sims = np.abs(vec[rows] @ across)
        sims[place[None, :] >= idx[rows][:, None]] = 0.0
        n = np.add.reduceat(sims, begins, axis=1)
        if len(rows) > len(here):  # a mention that has several rows
            n = np.add.reduceat(n, starts[low : low + k] - starts[low], axis=0)
        row, col = np.nonzero(n)
        lengths = np.bincount(row, minlength=len(here)) + 1
        first = np.cumsum(lengths) - lengths
        src, weight = np.full(len(row) + len(here), new, np.int32), np.empty(len(row) + len(here))
        rest = np.ones(len(src), bool)
        rest[first] = False
        src[rest], weight[rest], weight[first] = words[col], n[row, col], times[low : low + k]
        yield tgt[low : low + k], lengths, src, weight


def _deal(groups: DataFrame, new: int, n: int, block: int) -> str:
    """The candidates of the small groups in files by part; their path."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list[tuple] = []
        size = 0

        def flushed():
            tgt, lengths, src, weight = (np.concatenate(c) for c in zip(*held))
            part = _part_of(tgt, n)
            starts, out = np.cumsum(lengths) - lengths, []
            for g in np.unique(part):
                own = np.flatnonzero(part == g)
                sizes = lengths[own]
                at = np.repeat(starts[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                out.append((int(g), _packed(tgt=tgt[own], lengths=sizes.astype(np.int32), src=np.frombuffer(_deltas(sizes, src[at]), np.uint8), n=weight[at])))
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], names=["g", "pack"])

        for batch in batches:
            for pack in batch.column("pack"):
                for found in _of_group(pack.as_py(), new, block):
                    held.append(found)
                    size += len(found[2])
                    if size >= 4 * STEP:
                        yield flushed()
                        held, size = [], 0
        if held:
            yield flushed()

    path = fresh_path(groups.sparkSession, "dealt")
    groups.filter("NOT whole").select("pack").mapInArrow(run, "g long, pack binary").write.partitionBy("g").parquet(path)
    return path


def _played(model: dict, arrays: list[tuple], vocab: int, rounds: int, size: int):
    """Source and target codes, counts and sources' places of round ``rounds``; pieces of a part."""
    import numpy as np

    if not arrays:
        return
    tgt, lengths, src, weight = (np.concatenate(c) for c in zip(*arrays))
    arrays.clear()
    by = np.argsort(tgt, kind="stable")
    tgt, lengths, starts = tgt[by], lengths[by], (np.cumsum(lengths) - lengths)[by]
    ends = np.cumsum(lengths)
    word_ends = np.append(np.flatnonzero(np.diff(tgt)), len(tgt) - 1) + 1
    low = 0
    while low < len(tgt):
        # whole words, of STEP candidates or as near as one word allows
        reach = np.searchsorted(ends, (ends[low - 1] if low else 0) + STEP, side="right")
        fits = word_ends[(word_ends > low) & (word_ends <= reach)]
        high = int(fits[-1] if len(fits) else word_ends[word_ends > low][0])
        sizes = lengths[low:high]
        at = np.repeat(starts[low:high] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        row, s, n = np.repeat(np.arange(high - low), sizes), src[at], weight[at]
        what, pair = np.unique(tgt[low:high][row].astype(np.int64) * size + s, return_inverse=True)
        sources = what % size
        w = np.full(len(s), 1.0 / vocab)
        for r in range(1, rounds + 1):
            total = np.bincount(row, n * w, high - low)
            count = np.bincount(pair, n * w / np.maximum(total[row], EPS), len(what))
            if r < rounds:
                w = (count / np.maximum(model[r][sources], EPS))[pair]
        yield sources, what // size, count
        low = high


def _of_part(g: int, similar: Similar, vocab: int, rounds: int, final: bool):
    """The task of part g: rows of ``ROW`` to totals of the sources, or to the result."""
    new, size, n, block = similar.new, similar.size, similar.n, similar.block

    def run(batches):
        import numpy as np
        import pyarrow as pa

        arrays, words = [], {}
        model = {r: np.zeros(-(-size // CHUNK) * CHUNK) for r in range(1, rounds + final)}
        for batch in batches:
            for kind, at, pack in zip(batch.column("kind").to_pylist(), batch.column("at").to_pylist(), batch.column("pack")):
                pack = pack.as_py()
                if kind == "words":
                    words[at] = _unpacked(pack)["tok"]
                elif kind == "group":
                    arrays.extend(_of_group(pack, new, block, lambda code: _part_of(code, n) == g))
                elif kind == "dealt":
                    found = {k: v.to_numpy() for k, v in _unpacked(pack).items()}
                    arrays.append((found["tgt"], found["lengths"].astype(np.int64), _codes(found["lengths"].astype(np.int64), found["src"].tobytes()), found["n"]))
                else:
                    model[int(kind)][at * CHUNK : (at + 1) * CHUNK] = np.frombuffer(pack)
        if not final:
            sums = np.zeros(-(-size // CHUNK) * CHUNK)
            for sources, _, count in _played(model, arrays, vocab, rounds, size):
                sums += np.bincount(sources, count, len(sums))
            for at, chunk in enumerate(sums.reshape(-1, CHUNK)):
                if chunk.any():
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([chunk.tobytes()], pa.binary())], names=["at", "pack"])
            return
        named = pa.concat_arrays([words[at] for at in sorted(words)]) if words else pa.array([], pa.string())
        for sources, targets, count in _played(model, arrays, vocab, rounds, size):
            p = count / np.maximum(model[rounds][sources], EPS)
            for low in range(0, len(count), CHUNK):
                cut = slice(low, low + CHUNK)
                src, tgt = named.take(pa.array(sources[cut])), named.take(pa.array(targets[cut]))
                yield pa.RecordBatch.from_arrays([src, tgt, pa.array(count[cut]), pa.array(p[cut])], names=["src", "tgt", "count", "p"])

    return run


def _summed(totals: DataFrame) -> DataFrame:
    def add(rows):
        import numpy as np
        import pyarrow as pa

        sums = sum(np.frombuffer(x.as_py()) for x in rows.column("pack"))
        return pa.table({"at": rows.column("at").slice(0, 1), "pack": pa.array([sums.tobytes()], pa.binary())})

    return totals.groupBy("at").applyInArrow(add, "at long, pack binary")


def _listed(words: DataFrame) -> DataFrame:
    """The words in rows of CHUNK, by code."""

    def pack(rows):
        import pyarrow as pa

        rows = rows.sort_by("code")
        return pa.table({"kind": ["words"], "at": rows.column("at").slice(0, 1), "pack": pa.array([_packed(tok=rows.column("tok").combine_chunks())], pa.binary())})

    return words.withColumn("at", F.floor(F.col("code") / CHUNK)).groupBy("at").applyInArrow(pack, ROW)


def fit(similar: Similar, vocab: int, rounds: int) -> DataFrame:
    """mode, src, tgt, count, p after ``rounds``; exact mentions split evenly over their candidates."""
    spark = similar.words.sparkSession
    path = _deal(similar.groups, similar.new, similar.n, similar.block)
    known = [similar.groups.filter("whole").select(F.lit("group").alias("kind"), F.lit(0).cast("long").alias("at"), "pack")]
    dealt = spark.read.schema("pack binary, g long").parquet(path).select(F.lit("dealt").alias("kind"), F.lit(0).cast("long").alias("at"), "pack", "g")

    def played(rounds: int, final: bool, schema: str) -> DataFrame:
        parts = []
        for g in range(similar.n):
            rows = reduce(DataFrame.unionByName, [*known, dealt.filter(F.col("g") == g).drop("g")])
            parts.append(rows.coalesce(1).mapInArrow(_of_part(g, similar, vocab, rounds, final), schema))
        return reduce(DataFrame.union, parts)

    for r in range(1, rounds + 1):
        totals = written(_summed(played(r, False, "at long, pack binary")), "totals")
        known.append(totals.select(F.lit(str(r)).alias("kind"), "at", "pack"))
    known.append(written(_listed(similar.words), "similar"))
    near = played(rounds, True, "src string, tgt string, count double, p double").select(F.lit("similar").alias("mode"), "src", "tgt", "count", "p")
    same = similar.exact.select(F.lit("exact").alias("mode"), F.col("tok").alias("src"), F.col("tok").alias("tgt"), "count", F.lit(1.0).alias("p"))
    return near.unionByName(same)
