"""Token-id files: frequency-ranked ids, byte-aligned, lengths in control bytes.

Ids are replaced by their rank of frequency in the corpus (ties by id), so frequent
ids take one byte. Each id takes one to four data bytes, little-endian; its length
less one is two bits of a control byte that serves four ids. Control and data bytes
of a document lie apart. The files hold documents in ascending order of key, in
parts that follow each other, with an index of the parts' sizes and the rank table.
They are written and read by Spark, so any store that Spark reaches will do.

Text is encoded per stretch between blanks, tabs and line ends, which no token of a
vocabulary that drops white space crosses; known stretches come from a bounded
table. Null and empty texts hold the end id only. Rows that share a key keep the
order of their bytes; null keys come first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corefold.llm import common
from corefold.session import fresh_path

#: Entries of each of a worker's two tables, some 100 MB; a full one is emptied.
CACHE = 1 << 19
CACHED_CHARS = 64
DOCUMENTS_PER_PART = 5_000


#: White space to ``str.split`` only, not to the vocabulary's pattern.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Encoder:
    """Stretches seen are kept. A new one that is letters, also in lower case, with at
    most one mark behind is put together from its word and its mark (a letter whose
    lower case ends in a combining mark would join the mark); new words are encoded many
    at a time, as every word closes with a token that ends in the vocabulary's suffix."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(self.size, bool)
        if suffix:
            self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.suffix = suffix
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.lowers = ids("AbC xY") == ids("abc xy")
        self.seen: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def _each(self, parts: list[str]) -> dict[str, bytes]:
        """Stretches of any kind, many in one text; a token's offset tells whose it is."""
        out: dict[str, bytes] = {}
        for i in range(0, len(parts), 1000):
            some = parts[i : i + 1000]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum([len(p) + 1 for p in some])
            owner = np.searchsorted(ends, [a for a, _ in got.offsets], side="right")
            raw, cuts = np.array(got.ids, "<u4").tobytes(), [0, *(np.searchsorted(owner, np.arange(len(some)), side="right") * 4).tolist()]
            out.update(zip(some, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        return out

    def _words(self, fresh: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for i in range(0, len(fresh), 1000):
            some = fresh[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some) or (len(ids) and ends[-1] != len(ids)):
                out |= self._each(some)
                continue
            raw, cuts = ids.tobytes(), [0, *(ends * 4).tolist()]
            out.update(zip(some, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        return out

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        plain: list[tuple[str, str, str]] = []
        other: list[str] = []
        for p in fresh:
            word, mark = (p[:-1], p[-1]) if p[-1] in ".,;:!?" else (p, "")
            if self.suffix and word.isalpha() and word.lower().isalpha() and len(word) <= CACHED_CHARS:
                plain.append((p, word.lower() if self.lowers and word.isascii() else word, mark))
            else:
                other.append(p)
        need = {w for _, w, _ in plain if w not in self.words} | {m for _, _, m in plain if m and m not in self.words}
        got = self._words([w for w in need if w.isalpha()]) | self._each([w for w in need if not w.isalpha()])
        self.words.update(got)
        out = self._each(other)
        for p, w, m in plain:
            out[p] = self.words[w] + self.words[m] if m else self.words[w]
        if len(self.words) > CACHE:
            self.words = {}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        parts = [t.split() if not _SEPARATORS.search(t) else t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        fresh = list(set().union(*parts).difference(self.seen))
        self.seen.update(self._learn(fresh))
        out = [b"".join(map(self.seen.__getitem__, p)) for p in parts]
        if len(self.seen) > CACHE:
            self.seen = {"": b""}
        else:
            for p in fresh:
                if len(p) > CACHED_CHARS:
                    del self.seen[p]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per process, with one thread: Spark runs the tasks side by side."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---- the coding

def pack(ids: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """Control and data bytes of each array of 32-bit numbers."""
    sizes = np.array([len(x) for x in ids], np.int64)
    if not sizes.sum():
        return [(b"", b"")] * len(ids)
    values = np.concatenate(ids).astype("<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    quads = (sizes + 3) // 4
    place = np.arange(len(values)) + np.repeat(np.cumsum(quads * 4 - sizes) - (quads * 4 - sizes), sizes)
    slots = np.zeros(int(quads.sum()) * 4, np.uint8)
    slots[place] = code
    slots = slots.reshape(-1, 4)
    control = (slots[:, 0] | slots[:, 1] << 2 | slots[:, 2] << 4 | slots[:, 3] << 6).astype(np.uint8).tobytes()
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()
    ends = np.cumsum(sizes)
    bytes_to = np.concatenate([[0], np.cumsum(code.astype(np.int64) + 1)])
    cuts = bytes_to[np.concatenate([[0], ends])].tolist()
    marks = np.concatenate([[0], np.cumsum(quads)]).tolist()
    return [(control[a:b], data[c:d]) for a, b, c, d in zip(marks, marks[1:], cuts, cuts[1:])]


#: Lengths of the four numbers of every control byte.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1
#: Kept bits of a number of that many bytes.
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(controls: list[bytes], datas: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    count = np.array(sizes, np.int64)
    if not count.sum():
        return [np.zeros(0, np.uint32)] * len(sizes)
    length = _LENGTHS[np.frombuffer(b"".join(controls), np.uint8)].ravel()
    spare = (count + 3) // 4 * 4 - count
    length = length[np.arange(int(count.sum())) + np.repeat(np.cumsum(spare) - spare, count)]
    data = np.frombuffer(b"".join([*datas, b"\0\0\0\0"]), np.uint8)
    at = np.cumsum(length) - length
    words = data[:-3].astype(np.uint32) | data[1:-2].astype(np.uint32) << 8 | data[2:-1].astype(np.uint32) << 16 | data[3:].astype(np.uint32) << 24
    return np.split(words[at] & _MASKS[length], np.cumsum(count)[:-1])


# ---- tables

@dataclass
class TokenFiles:
    """Folders of the parts, of the index and of the rank table."""

    parts: str
    index: str
    ranks: str


def tokenise(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids of two bytes each (four where the vocabulary needs them), written."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    wide = width_of(path, end_id)
    end = np.array([end_id], "<u4").tobytes()

    def run(b: dict[str, list]) -> dict[str, list]:
        own = encoder(path)
        return {"doc_id": b["doc_id"], "ids": [np.frombuffer(x + end, "<u4").astype(wide).tobytes() for x in own.encode([t or "" for t in b["text"]])]}

    return common.written(common.scan(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary"), "tokens")


def width_of(path: str, end_id: int) -> str:
    """Type of an id in the intermediate table."""
    return "<u2" if max(encoder(path).size, end_id) < 1 << 16 else "<u4"


def frequencies(tokens: DataFrame, width: str) -> DataFrame:
    """id, n: one row per id and partition before the shuffle."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in common.steps(batch):
                own = np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), width))
                if len(own) > len(total):
                    total = np.pad(total, (0, len(own) - len(total)))
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": used.astype(np.int64), "n": total[used]})

    return tokens.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> TokenFiles:
    """Tokenise once, count, then write the ranked ids in order of key. The rank
    table is bounded by the vocabulary; the index has one row per part."""
    spark = docs.sparkSession
    tokens = tokenise(docs, path, end_id, key, text)
    width = width_of(path, end_id)
    ranked = [r["id"] for r in frequencies(tokens, width).orderBy(F.desc("n"), "id").collect()]
    files = TokenFiles(*(fresh_path(spark, name) for name in ("token-parts", "token-index", "token-ranks")))
    spark.createDataFrame([(i, x) for i, x in enumerate(ranked)], "rank bigint, id bigint").coalesce(1).write.parquet(files.ranks)
    table = np.zeros(max(ranked, default=0) + 1, np.uint32)
    table[ranked] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(table)

    kind = dict(tokens.dtypes)["doc_id"]

    def encode(b: dict[str, list]) -> dict[str, list]:
        ids = [shared.value[np.frombuffer(x, width)] for x in b["ids"]]
        packed = pack(ids)
        return {"doc_id": b["doc_id"], "n_tokens": [len(x) for x in ids], "control": [c for c, _ in packed], "data": [d for _, d in packed]}

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens.count() // DOCUMENTS_PER_PART)
    # Ordered before they are packed: finding the ranges reads the table once more.
    order = ("doc_id", F.xxhash64("ids"))
    ordered = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    coded = common.scan(ordered, encode, f"doc_id {kind}, n_tokens bigint, control binary, data binary")

    def place(batches):
        start = 0
        for batch in batches:
            sizes = np.asarray(batch.column("n_tokens"), np.int64)
            ends = start + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - sizes)], names=[*batch.schema.names, "place"])
            start = int(ends[-1]) if len(ends) else start

    placed = coded.withColumn("part", F.spark_partition_id()).mapInArrow(place, f"doc_id {kind}, n_tokens bigint, control binary, data binary, part int, place bigint")
    placed.write.option("compression", "zstd").parquet(files.parts)
    sizes = spark.read.parquet(files.parts).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts = np.cumsum([0] + [r["n"] for r in sizes]).tolist()
    spark.createDataFrame([(r["part"], s, r["n"]) for r, s in zip(sizes, starts)], "part int, start bigint, n_tokens bigint").coalesce(1).write.parquet(files.index)
    return files


def read_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit) from the files."""
    ids = np.array([r["id"] for r in spark.read.parquet(files.ranks).orderBy("rank").collect()], "<u4")
    shared = spark.sparkContext.broadcast(ids)
    parts = spark.read.parquet(files.parts)

    def decode(b: dict[str, list]) -> dict[str, list]:
        got = unpack(b["control"], b["data"], b["n_tokens"])
        return {"part": b["part"], "doc_id": b["doc_id"], "place": b["place"], "n_tokens": b["n_tokens"], "ids": [shared.value[x].tobytes() for x in got]}

    rows = common.scan(parts, decode, f"part int, doc_id {dict(parts.dtypes)['doc_id']}, place bigint, n_tokens bigint, ids binary")
    index = spark.read.parquet(files.index).select("part", "start")
    return rows.join(index, "part").select("doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "ids")
