"""Personal data: fixed patterns, and terms that give a protected value away.

Protected values are the e-mail addresses, IP addresses, card and phone numbers
found by pattern. Terms are the words of three letters or digits and more, in lower
case, outside the protected spans. A value's context is the whole document that
holds it. Over the corpus, with documents as the unit, n(e) counts those with value
e, n(e, t) those with value e and term t, n(t) those with the word t anywhere. The
share of the information of e that t discloses is

    log(n(e, t) * N / (n(e) * n(t))) / log(N / n(e)),

pointwise mutual information over self-information; it reaches 1 where every
document with t holds e. Wherever a term stands, in documents without the value as
well, it is removed from REMOVE up and generalised to its kind of word from
GENERALISE up, by the largest share of any value; both need SUPPORT documents. Exact
copies are one document, so copying a text reveals nothing.

Null text counts as empty: no spans, empty output. Repeated rows are answered one
by one. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import collections
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefold.llm import common
from corefold.llm.vectors import arrow_map

SUPPORT = 3
GENERALISE, REMOVE = 0.85, 0.95
KINDS = ("email", "ip", "card", "phone")

# The patterns of the contract, each written so that a failing start costs no
# second look: matches can begin only where the run of their first class begins.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W_]{3,}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) by start, then kind."""
    out, done = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < m.start():
            done = m.end()
            out.append((start, done, 0, text[start:done].lower()))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), m.end(), 1, ".".join(p or "0" for p in parts)))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NO_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), m.end(), 2, digits))
        for m in _PHONE.finditer(text) if "+" in text else ():
            digits = _NO_DIGIT.sub("", m[0])
            if 9 <= len(digits) <= 15:
                out.append((m.start(), m.end(), 3, digits))
    out.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k], v) for a, b, k, v in out]


def words_outside(text: str, spans: list[tuple[int, int, str, str]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words that touch none of the spans."""
    out, edges, at, reach = [], sorted((a, b) for a, b, _, _ in spans), 0, 0
    for w in _WORD.finditer(text):
        while at < len(edges) and edges[at][0] < w.end():
            reach = max(reach, edges[at][1])
            at += 1
        if w.start() >= reach:
            out.append((w[0].lower(), w.start(), w.end()))
    return out


def shape(term: str) -> str:
    """What a term is generalised to: the kind of word it is."""
    return "<number>" if term.isdigit() else "<code>" if any(c.isdigit() for c in term) else "<word>"


_SPAN = "struct<start:int,end:int,kind:string,value:string>"


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2, copy, doc_id, spans of each row; written, without the text."""
    rows = docs.select(*common.row_key(key, text), F.xxhash64(text).alias("copy"), F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(b: dict[str, list]) -> dict[str, list]:
        spans = [base_spans(t) for t in b["text"]]
        return {
            **{c: b[c] for c in ("k1", "k2", "copy", "doc_id")},
            "spans": [[dict(zip(("start", "end", "kind", "value"), s)) for s in own] for own in spans],
        }

    kind = dict(rows.dtypes)["doc_id"]
    return common.written(common.scan(rows, run, f"k1 bigint, k2 bigint, copy bigint, doc_id {kind}, spans array<{_SPAN}>"), "private")


def _filter(terms: DataFrame) -> common.HashFilter:
    return common.HashFilter(terms.select(F.crc32(F.col("term").cast("binary")).alias("h")))


def _passing(words: list[str], bits: np.ndarray) -> list[int]:
    hashes = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.int64, len(words))
    return np.flatnonzero(common.HashFilter.test(bits, hashes)).tolist()


def _low(column: str) -> F.Column:
    return F.col(column).bitwiseAND(F.lit(0x7FFFFFFF))


FLUSH = 1 << 18  # terms that a task counts before it gives them away


def term_counts(docs: DataFrame, seen: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """term, n_term: documents (copies once) with each of the given terms. A hashed
    filter of fixed size drops other words. Texts that stand once are counted inside
    the task; only those of which a second hashed filter says that they may have copies
    (``seen``: copy) are told apart by rows of (copy, term)."""
    shared = _filter(terms).shared
    copied = seen.groupBy("copy").agg(F.count("*").alias("n")).filter("n > 1").select(_low("copy").alias("h"))
    twice = common.HashFilter(copied.distinct()).shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: collections.Counter = collections.Counter()
        for batch in batches:
            for part in common.steps(batch):
                copies, words = [], []
                own_low = np.asarray(part.column(1), np.int64)
                several = common.HashFilter.test(twice.value, own_low)
                done: set[int] = set()
                for copy, again, t in zip(part.column(0).to_pylist(), several.tolist(), part.column(2).to_pylist()):
                    if again and copy in done:
                        continue
                    own = list({w.lower() for w in set(_WORD.findall(t))})
                    kept = [own[i] for i in _passing(own, shared.value)] if own else []
                    if again:
                        done.add(copy)
                        copies += [copy] * len(kept)
                        words += kept
                    else:
                        counts.update(kept)
                if copies:
                    yield {"copy": copies, "term": words, "n": [0] * len(copies)}
                if len(counts) > FLUSH:
                    yield {"copy": [None] * len(counts), "term": list(counts), "n": list(counts.values())}
                    counts.clear()
        if counts:
            yield {"copy": [None] * len(counts), "term": list(counts), "n": list(counts.values())}

    rows = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("copy"), F.col(text).alias("text")).select("copy", _low("copy").alias("low"), "text")
    got = arrow_map(rows, run, "copy bigint, term string, n bigint")
    each = got.groupBy("copy", "term").agg(F.sum("n").alias("n"))  # n is 0 for a copy, however often it stands
    counted = each.groupBy("term").agg(F.sum(F.when(F.col("copy").isNull(), F.col("n")).otherwise(1)).alias("n_term"))
    return counted.join(terms, "term", "left_semi")


def _terms_beside(docs: DataFrame, copies: common.HashFilter, terms: common.HashFilter | None = None, text: str = "text") -> DataFrame:
    """copy, term of the documents that pass the first filter, with the terms that
    pass the second."""
    held, wanted = copies.shared, terms and terms.shared

    def run(b: dict[str, list]) -> dict[str, list]:
        copies, words = [], []
        for i in np.flatnonzero(common.HashFilter.test(held.value, np.array(b["low"], np.int64))).tolist():
            t = b["text"][i]
            own = list({w for w, _, _ in words_outside(t, base_spans(t))})
            if wanted is not None and own:
                own = [own[j] for j in _passing(own, wanted.value)]
            copies += [b["copy"][i]] * len(own)
            words += own
        return {"copy": copies, "term": words}

    rows = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("copy"), F.col(text).alias("text")).withColumn("low", _low("copy"))
    return common.scan(rows, run, "copy bigint, term string")


def disclosing(docs: DataFrame, seen: DataFrame, text: str = "text") -> DataFrame:
    """value, term, ratio of all pairs from GENERALISE up."""
    total = float(max(docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("copy")).agg(F.countDistinct("copy")).first()[0], 1))
    values = seen.filter(F.size("spans") > 0).select("copy", F.explode(F.expr("array_distinct(transform(spans, s -> concat(s.kind, ':', s.value)))")).alias("value")).distinct()
    n_value = values.groupBy("value").agg(F.count("*").alias("n_value")).filter(F.col("n_value") >= SUPPORT)
    values = common.written(values.join(n_value, "value"), "values")
    copies = common.HashFilter(values.select(_low("copy").alias("h")).distinct())
    # n(e, t) is at most n(e), so a share of GENERALISE needs an n(t) up to this bound.
    most = F.pow(F.col("n_value"), F.lit(GENERALISE)) * total ** (1 - GENERALISE) * (1 + 1e-9)
    several = _terms_beside(docs, copies, text=text).groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT).select("term")
    several = common.written(several, "terms-beside")
    n_term = term_counts(docs, seen, several, text).crossJoin(F.broadcast(values.agg(F.max(most).alias("most")))).filter(F.col("n_term") <= F.col("most")).drop("most")
    n_term = common.written(n_term, "term-counts")
    beside = _terms_beside(docs, copies, _filter(n_term), text).join(n_term, "term").distinct()
    both = values.join(beside, "copy").filter(F.col("n_term") <= most)
    both = both.groupBy("value", "term").agg(F.count("*").alias("n_both"), F.first("n_value").alias("n_value"), F.first("n_term").alias("n_term")).filter(F.col("n_both") >= SUPPORT)
    known = F.log(F.lit(total) / F.col("n_value"))
    shared = F.log(F.col("n_both") * F.lit(total) / (F.col("n_value") * F.col("n_term")))
    return both.select("value", "term", F.when(known > 0, shared / known).otherwise(0.0).alias("ratio")).filter(F.col("ratio") >= GENERALISE)


def occurrences(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2, terms (start, end, ratio of every occurrence, in order) of the rows
    that hold one of the given terms outside a span. ``terms``: term, ratio."""
    wanted = _filter(terms).shared

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("k1", "k2", "term", "start", "end")}
        for k1, k2, t in zip(b["k1"], b["k2"], b["text"]):
            own = list({w.lower() for w in set(_WORD.findall(t))})
            kept = {own[i] for i in _passing(own, wanted.value)} if own else ()
            for term, a, z in words_outside(t, base_spans(t)) if kept else ():
                if term in kept:
                    for c, v in zip(out, (k1, k2, term, a, z)):
                        out[c].append(v)
        return out

    rows = docs.filter(F.col(text).isNotNull()).select(*common.row_key(key, text), F.col(text).alias("text"))
    got = common.scan(rows, run, "k1 bigint, k2 bigint, term string, start int, end int").join(terms, "term")
    return got.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end", "ratio"))).alias("terms"))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, base (spans by pattern), terms (start, end, ratio of disclosing
    terms) and, unless ``with_text`` is false, the sanitised text."""
    seen = found(docs, key, text)
    terms = common.written(disclosing(docs, seen, text).groupBy("term").agg(F.max("ratio").alias("ratio")), "disclosing")
    bad = occurrences(docs, terms, key, text)
    both = seen.join(bad, ["k1", "k2"], "left").select("k1", "k2", "doc_id", F.col("spans").alias("base"), F.coalesce("terms", F.expr("array()")).alias("terms"))
    if not with_text:
        return both.drop("k1", "k2")
    rows = docs.select(*common.row_key(key, text), F.col(text).alias("text")).dropDuplicates(["k1", "k2"])
    both = both.join(rows, ["k1", "k2"])

    def run(b: dict[str, list]) -> dict[str, list]:
        out = []
        for t, base, terms in zip(b["text"], b["base"], b["terms"]):
            edits = [(s["start"], s["end"], f"<{s['kind']}>") for s in base]
            edits += [(s["start"], s["end"], "" if s["ratio"] >= REMOVE else shape(t[s["start"] : s["end"]])) for s in terms]
            at, parts = 0, []
            for a, e, new in sorted(edits):
                if a >= at:
                    parts += [t[at:a], new]
                at = max(at, e)
            out.append("".join([*parts, (t or "")[at:]]))
        return {"doc_id": b["doc_id"], "base": b["base"], "terms": b["terms"], "text": out}

    kind = dict(both.dtypes)
    return common.scan(both, run, f"doc_id {kind['doc_id']}, base {kind['base']}, terms {kind['terms']}, text string")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, hash of the base spans and the list of all spans."""
    base = F.expr("transform(base, s -> concat_ws(':', s.kind, s.start, s.end))")
    rank = "CASE s.kind WHEN 'email' THEN 0 WHEN 'ip' THEN 1 WHEN 'card' THEN 2 WHEN 'phone' THEN 3 ELSE 4 END"
    every = F.expr(f"array_sort(concat(transform(base, s -> struct(s.start AS start, {rank} AS rank, s.end AS end, s.kind AS kind)), transform(terms, s -> struct(s.start AS start, 4 AS rank, s.end AS end, 'term' AS kind))))")
    return found.withColumn("every", every).select(
        "doc_id", *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.expr("concat_ws(',', transform(every, s -> concat_ws(':', s.kind, s.start, s.end)))").alias("spans"),
    )
