"""Candidate words dealt into parts by the word of their mention, for rounds that move
no candidates.

A part holds all candidates of its mentions, so the normaliser of a mention is local,
and few parts share a pair of words. It is packed once: candidates as (mention, code, n,
first, open) arrays and the distinct pairs of words that the codes stand for. A round
sends the probability of each pair to the parts that have it and gets expected counts
per pair back; its cost in shuffles is the pairs, not the candidates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corefold.session import broadcast_if_small, cut_lineage, written

EPS = 1e-100
ROWS = 1 << 18  # candidates of a part, about
FEW = 1 << 13  # candidates below which a part is not worth a task
PACKED = "g long, pack binary"


def _numbers(column):
    """Codes of a column by the order of its values, nulls first, and the values."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    coded = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(order)


def _pack(rows):
    """The candidates of a part as one row; those of a mention with equal words are added up."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    columns = {name: rows.column(name) for name in rows.column_names}
    if "_c" in columns:  # a row per mention and list
        lists = columns.pop("_c").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        columns = {name: column.take(pc.list_parent_indices(lists)) for name, column in columns.items()}
        columns |= dict(zip(("tgt", "n", "first"), lists.flatten().flatten()))
    (d, docs), (j, js) = _numbers(columns["doc"]), _numbers(columns["j"])
    (m, modes), (s, srcs), (t, tgts) = (_numbers(columns[c]) for c in ("mode", "src", "tgt"))
    who, mention = np.unique(d * len(js) + j, return_inverse=True)
    what, code = np.unique((m * len(srcs) + s) * len(tgts) + t, return_inverse=True)
    is_open = columns["open"].to_numpy().astype(bool)
    first = columns["first"].cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()
    kept, at, row = np.unique((mention * len(what) + code) * 2 + is_open, return_index=True, return_inverse=True)
    lowest = np.full(len(kept), np.iinfo(np.int64).max)
    np.minimum.at(lowest, row, first)
    fields = {
        "doc": docs.take(pa.array(who // len(js))), "j": js.take(pa.array(who % len(js))),
        "mode": modes.take(pa.array(what // (len(srcs) * len(tgts)))), "src": srcs.take(pa.array(what // len(tgts) % len(srcs))),
        "tgt": tgts.take(pa.array(what % len(tgts))), "mention": pa.array(mention[at].astype(np.int32)), "code": pa.array(code[at].astype(np.int32)),
        "n": pa.array(np.bincount(row, columns["n"].to_numpy(), len(kept))), "first": pa.array(lowest), "open": pa.array(is_open[at]),
    }
    table = pa.table({name: pa.array([column.to_pylist()], pa.list_(column.type)) if len(column) == 0 else pa.ListArray.from_arrays([0, len(column)], column) for name, column in fields.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return pa.table({"g": [rows.column("g")[0].as_py()], "pack": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _unpack(pack: bytes) -> dict:
    import pyarrow as pa

    table = pa.ipc.open_stream(pack).read_all().combine_chunks()
    return {name: table.column(name).chunk(0).flatten() for name in table.column_names}


class Dealt:
    """``candidates`` as written (or to be made), ``parts`` (g, pack) by g, ``pairs`` (g, code, mode,
    src, tgt) of the packed ones."""

    def __init__(self, candidates: DataFrame, parts: DataFrame, pairs: DataFrame, n: int):
        self.candidates, self.parts, self.pairs, self.n = candidates, parts, pairs, n

    def _each(self, translation: DataFrame, fn, schema: str) -> DataFrame:
        """``fn(part's arrays, probability per code, weights of the candidates)`` -> arrays, for each part."""
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        known = self.pairs.join(translation.select("mode", "src", "tgt", "p"), ["mode", "src", "tgt"])
        sent = known.groupBy("g").agg(F.collect_list("code").alias("codes"), F.collect_list("p").alias("ps"))
        out = to_arrow_schema(StructType.fromDDL(schema))

        def run(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    part = _unpack(batch.column("pack")[at].as_py())
                    p = np.zeros(len(part["src"]))
                    codes = batch.column("codes")[at]
                    if codes.is_valid:
                        p[codes.values.to_numpy()] = batch.column("ps")[at].values.to_numpy(zero_copy_only=False)
                    w = np.where(part["open"].to_numpy(zero_copy_only=False), p[part["code"].to_numpy()], 0.0)
                    found = fn(part, w)
                    yield pa.RecordBatch.from_arrays([_as(found[f.name], f.type) for f in out], schema=out)

        def _as(column, kind):
            return column.cast(kind) if isinstance(column, pa.Array) else pa.array(column, kind)

        return self.parts.join(sent, "g", "left").select("pack", "codes", "ps").mapInArrow(run, schema)

    def _kinds(self) -> str:
        kinds = dict(self.candidates.dtypes)
        return f"doc {kinds['doc']}, j {kinds['j']}"

    def counts(self, translation: DataFrame) -> DataFrame:
        """mode, src, tgt, count: expected counts of the open candidates' pairs under the table."""
        import numpy as np
        import pyarrow as pa

        def expected(part, w):
            mention, code, n = (part[c].to_numpy() for c in ("mention", "code", "n"))
            total = np.bincount(mention, n * w, len(part["doc"]))
            count = np.bincount(code, n * w / np.maximum(total[mention], EPS), len(part["src"]))
            kept = pa.array(np.bincount(code, part["open"].to_numpy(zero_copy_only=False), len(count)) > 0)
            return {c: part[c].filter(kept) for c in ("mode", "src", "tgt")} | {"count": pa.array(count).filter(kept)}

        kinds = dict(self.candidates.dtypes)
        rows = self._each(translation, expected, f"mode string, src {kinds['src']}, tgt {kinds['tgt']}, count double")
        return rows.groupBy("mode", "src", "tgt").agg(F.sum("count").alias("count"))

    def log_likelihood(self, translation: DataFrame) -> DataFrame:
        """Sum over mentions of the log of the mean candidate probability, floored."""
        import numpy as np

        def sums(part, w):
            mention, n = part["mention"].to_numpy(), part["n"].to_numpy()
            total, size = (np.bincount(mention, x, len(part["doc"])) for x in (n * w, n))
            mean = np.divide(total, size, out=np.zeros(len(total)), where=size != 0)
            return {"log_likelihood": [float(np.log(np.maximum(mean, EPS)).sum())]}

        return self._each(translation, sums, "log_likelihood double").agg(F.sum("log_likelihood").alias("log_likelihood"))

    def best(self, translation: DataFrame) -> DataFrame:
        """doc, j, mode, tgt, first, w: the likeliest candidate of each mention; ties go to the
        lowest ``first``, then by name."""
        import numpy as np
        import pyarrow as pa

        def top(part, w):
            mention, code, first = (part[c].to_numpy() for c in ("mention", "code", "first"))
            order = np.lexsort((code, first, -w, mention))
            chosen = order[np.flatnonzero(np.diff(mention[order], prepend=-1))]
            pair, late = pa.array(code[chosen]), np.iinfo(np.int64).max
            return {
                "doc": part["doc"], "j": part["j"], "mode": part["mode"].take(pair), "tgt": part["tgt"].take(pair),
                "first": pa.array(first[chosen], mask=first[chosen] == late), "w": pa.array(w[chosen]),
            }

        kinds = dict(self.candidates.dtypes)
        return self._each(translation, top, f"{self._kinds()}, mode string, tgt {kinds['tgt']}, first long, w double")


def unlisted(candidates: DataFrame) -> DataFrame:
    """A row per candidate of ``_c``, a list of (tgt, n, first)."""
    return candidates.withColumn("_c", F.explode("_c")).select("*", "_c.*").drop("_c")


def deal(candidates: DataFrame, own: str = "tgt", rows: int = ROWS) -> Dealt:
    """Candidates (doc, j, mode, src, tgt, n, first, open) in parts of about ``rows``.

    ``own`` is the word that all candidates of a mention (doc, j) share. It decides the
    part; the mentions of a frequent word are spread over several. Should they differ in
    it, the least one stands for the mention. Candidates in lists (see ``unlisted``) bring it
    along as ``_own``; they travel as they are and are not written."""
    owned, listed_ = candidates, "_c" in candidates.columns
    if listed_:
        candidates = unlisted(candidates)
    else:
        owned = written(candidates.withColumn("_own", F.min(own).over(Window.partitionBy("doc", "j"))), "candidates")
    sizes = written(owned.groupBy("_own").agg(F.sum(F.size("_c") if listed_ else F.lit(1)).alias("_n")), "sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    n = max(1, math.ceil(total / rows), min(candidates.sparkSession.sparkContext.defaultParallelism, math.ceil(total / FEW)))
    size = max(1, min(rows, math.ceil(total / n)))
    frequent = sizes.filter(F.col("_n") * 2 > size).select("_own", F.ceil(F.col("_n") * 2 / size).alias("_k"))
    spread = F.pmod(F.xxhash64("doc", "j"), F.coalesce("_k", F.lit(1).cast("long")))
    placed = owned.join(broadcast_if_small(frequent), "_own", "left").withColumn("g", F.pmod(F.xxhash64("_own", spread), F.lit(n).cast("long")))
    columns = ["g", "doc", "j", "mode", "src", "open", *(["_c"] if listed_ else ["tgt", "n", "first"])]
    packed = written(placed.select(*columns).groupBy("g").applyInArrow(_pack, PACKED), "parts")
    parts = cut_lineage(packed.repartition(n, "g"))  # rounds meet them where they are
    kinds = dict(candidates.dtypes)
    schema = f"g long, code int, mode string, src {kinds['src']}, tgt {kinds['tgt']}"

    def listed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                part = _unpack(batch.column("pack")[at].as_py())
                size = len(part["src"])
                arrays = [pa.array(np.full(size, batch.column("g")[at].as_py())), pa.array(np.arange(size, dtype=np.int32)), part["mode"], part["src"], part["tgt"]]
                yield pa.RecordBatch.from_arrays(arrays, names=["g", "code", "mode", "src", "tgt"])

    return Dealt((candidates if listed_ else owned).drop("_own"), parts, written(parts.mapInArrow(listed, schema), "pairs"), n)
