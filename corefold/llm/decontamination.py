"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of ASCII letters, digits and all characters beyond ASCII; ASCII
letters are lower-cased. Every window of SIZE item words (an item of fewer words:
all of them) is a pattern of the automaton, words apart by one blank, so questions
and answers are matched in one scan of the normalised text, whatever their number.
Word places of the normalised text lead back to offsets of the original.

The automaton is sent to the executors while the benchmark's windows take up to
BLOCK_BYTES; a larger benchmark is cut by item into blocks of that size, each with
a scan of its own, and hits of the blocks are joined per document.

Null and empty texts have no words and no hits. Items without words give no
pattern. Repeated rows are answered one by one, repeated items are all named.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefold.llm import common

SIZE = 13
BLOCK_BYTES = 32 << 20
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RUN = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words; every byte of a character beyond ASCII is a word byte."""
    return (text or "").encode().translate(_KEEP).split()


def windows(words: list[bytes], size: int = SIZE) -> list[list[bytes]]:
    if not words:
        return []
    return [words[i : i + size] for i in range(max(len(words) - size, 0) + 1)]


class Matcher:
    """Patterns as latin-1 strings of UTF-8 bytes, one blank around each word."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        owners: dict[str, set[str]] = {}
        lengths: dict[str, int] = {}
        for item, text in items:
            for window in windows(words_of(text), size):
                pattern = (b" " + b" ".join(window) + b" ").decode("latin-1")
                owners.setdefault(pattern, set()).add(item)
                lengths[pattern] = len(window)
        self.machine = ahocorasick.Automaton()
        for pattern, own in owners.items():
            self.machine.add_word(pattern, (lengths[pattern], own))
        if owners:
            self.machine.make_automaton()
        self.empty = not owners

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, word ranges that are hit (merged), items that occur."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), [], set()
        flat = b" " + b" ".join(words) + b" "
        hits = [(end, *found) for end, found in self.machine.iter(flat.decode("latin-1"))]
        if not hits:
            return len(words), [], set()
        blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        ranges: list[tuple[int, int]] = []
        for last, length in sorted((int(np.searchsorted(blanks, end)), length) for end, length, _ in hits):
            first = last - length
            while ranges and first <= ranges[-1][1]:
                first, last = min(first, ranges[-1][0]), max(last, ranges[-1][1])
                ranges.pop()
            ranges.append((first, last))
        return len(words), ranges, set().union(*(own for _, _, own in hits))


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Code points of the original text that the word ranges cover."""
    raw = text.encode()
    places = [m.span() for m in _RUN.finditer(raw.translate(_KEEP))]
    before = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)])
    return [{"start": int(before[places[a][0]]), "end": int(before[places[b - 1][1]])} for a, b in ranges]


_matchers: dict[tuple[str, int], Matcher] = {}


def _matcher(name: str, items: list[tuple[str, str]], size: int) -> Matcher:
    if (name, size) not in _matchers:
        _matchers.clear()
        _matchers[name, size] = Matcher(items, size)
    return _matchers[name, size]


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[list[tuple[str, str]]]:
    """The items in blocks whose patterns take at most BLOCK_BYTES."""
    rows = benchmark.filter(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") * SIZE)).first()[0] or 0
    count = total // BLOCK_BYTES + 1
    if count == 1:
        return [[(r["item"], r["text"]) for r in rows.collect()]]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)))
    return [[(r["item"], r["text"]) for r in dealt.filter(F.col("block") == i).collect()] for i in range(count)]


_HITS = "n_words bigint, ranges array<struct<first:int,last:int>>, items array<string>"


def _scan(rows: DataFrame, items: list[tuple[str, str]], size: int, names: list[str]) -> DataFrame:
    name = hashlib.sha256(repr(items).encode()).hexdigest()
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(b: dict[str, list]) -> dict[str, list]:
        own = _matcher(name, shared.value, size)
        got = [own.scan(t) for t in b["__text"]]
        out = {c: b[c] for c in names}
        return {**out, "n_words": [n for n, _, _ in got], "ranges": [[{"first": a, "last": z} for a, z in r] for _, r, _ in got], "items": [sorted(i) for _, _, i in got]}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return common.scan(rows, run, f"{kinds}, {_HITS}")


def find(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", with_key: bool = False) -> DataFrame:
    """doc_id, n_words, ranges (words that are hit, merged), items, n_hit; one row
    per input row. ``with_key`` adds k1, k2, the row key of key and text."""
    rows = docs.select(*common.row_key(key, text), F.col(key).alias("doc_id"), F.col(text).alias("__text"))
    blocks = _blocks(benchmark, item, item_text)
    if len(blocks) == 1:
        got = _scan(rows, blocks[0], size, ["k1", "k2", "doc_id"]) if with_key else _scan(rows.drop("k1", "k2"), blocks[0], size, ["doc_id"])
    else:
        base = common.written(_scan(rows, blocks[0], size, ["k1", "k2", "doc_id"]), "hits")
        once = rows.dropDuplicates(["k1", "k2"])
        for block in blocks[1:]:
            more = _scan(once, block, size, ["k1", "k2"]).filter(F.size("items") > 0).select("k1", "k2", F.col("ranges").alias("r"), F.col("items").alias("i"))
            merged = base.join(more, ["k1", "k2"], "left")
            merged = merged.withColumn("ranges", F.coalesce(F.concat("ranges", "r"), "ranges")).withColumn("items", F.coalesce(F.array_sort(F.array_union("items", "i")), "items"))
            base = common.written(merged.select("k1", "k2", "doc_id", "n_words", "ranges", "items"), "hits")
        got = base if with_key else base.drop("k1", "k2")
    # Ranges of one block are apart; of several they may overlap: take what each adds.
    hit = F.expr(
        "aggregate(array_sort(ranges), struct(0 AS n, 0 AS seen), (a, r) -> struct("
        "a.n + greatest(r.last - greatest(r.first, a.seen), 0) AS n, greatest(a.seen, r.last) AS seen), a -> cast(a.n AS bigint))"
    )
    return got.withColumn("n_hit", hit)


def contaminated() -> F.Column:
    """At least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
