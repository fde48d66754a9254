"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; everything but letters becomes one blank per character.
All n-grams of one to three characters that start with a letter, or with a blank
before a letter, are hashed to BUCKETS. Counts per language and bucket, smoothed,
become a matrix of log-probabilities (languages x buckets), which is broadcast:
its size follows from BUCKETS and the number of languages, not from the rows.
Batches are scored in numpy by gathering matrix entries at the n-grams that occur
and adding them up per text.

Training rows: all labelled ones up to about MAX_PER_LANGUAGE per language; above
that, rows are taken by a hash of key and text, so that the sample is the same in
every run. A null or letterless text is ``und`` with score 0; a table without
labelled rows gives ``und`` everywhere. Equal texts get equal answers.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefold.llm import common

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_PER_LANGUAGE = 10_000
MAX_MATRIX_BYTES = 256 << 20
TRAIN_PARTITIONS = 24
PIECE = 1 << 20
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_fold: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> itself for letters, blank otherwise; built once per process."""
    global _fold
    if _fold is None:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        places = np.array([i for i in range(sys.maxunicode + 1) if chr(i).isalpha()], np.uint32)
        table[places] = places
        _fold = table
    return _fold


def hashed_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts (orders x positions; BUCKETS where a
    position counts for nothing) and each text's first position."""
    ends = np.cumsum([len(t) + 4 for t in texts])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    joined = "".join(f" {t.lower() if t.isascii() else _lower(t)}   " for t in texts)
    points = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    after = np.append(points[1:], np.uint32(32))
    counts = (points != 32) | (after != 32)
    out = np.empty((len(ORDERS), len(points)), np.int32)
    key = np.zeros(len(points), np.uint32)
    shifted = points
    for row, n in enumerate(ORDERS):
        key = key * np.uint32(0x01000193) + shifted * _FACTORS[row]
        mixed = key ^ (key >> np.uint32(15))
        out[row] = np.where(counts, (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(17), BUCKETS)
        shifted = np.append(shifted[1:], np.uint32(32))
    return out, starts


def _lower(text: str) -> str:
    """Lower case, one code point for one, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x (BUCKETS + 1); the last entry is zero


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Counts on the executors, one row per (language, bucket) and partition of
    the sample; the driver receives languages x BUCKETS sums."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key, text).alias("pick"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if len(languages) * (BUCKETS + 1) * 4 > MAX_MATRIX_BYTES:
        raise ValueError(f"{len(languages)} languages need more than {MAX_MATRIX_BYTES} bytes of model")
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS + 1), np.float32))
    share = F.lit(1.0)
    for name, n in sizes.items():
        if n > MAX_PER_LANGUAGE:
            share = F.when(F.col("lang") == name, F.lit(MAX_PER_LANGUAGE / n)).otherwise(share)
    sample = rows.filter(F.pmod("pick", F.lit(1_000_003)) < share * 1_000_003).repartition(TRAIN_PARTITIONS, "pick").select("lang", "text")

    def count(batches):
        import pyarrow as pa

        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in common.steps(batch):
                langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for name in set(langs):
                    grams, _ = hashed_ngrams([t for own, t in zip(langs, texts) if own == name])
                    totals[name] = totals.get(name, 0) + np.bincount(grams.ravel(), minlength=BUCKETS + 1)[:BUCKETS]
        for name, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(used), "bucket": used.astype(np.int32), "n": total[used].astype(np.int64)})

    counts = np.zeros((len(languages), BUCKETS))
    for name, bucket, n in sample.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n")).collect():
        counts[languages.index(name), bucket] = n
    smooth = counts + 0.5
    log_prob = np.concatenate([np.log(smooth / smooth.sum(1, keepdims=True)), np.zeros((len(languages), 1))], 1)
    totals = np.array([sizes[x] for x in languages], float)
    return Model(languages, np.log(totals / totals.sum()), log_prob.astype(np.float32))


def score(model: Model, texts: list[str]) -> np.ndarray:
    """Posterior of each language for each text."""
    grams, starts = hashed_ngrams(texts)
    logs = np.empty((len(texts), len(model.languages)))
    for i, row in enumerate(model.log_prob):
        logs[:, i] = sum(np.add.reduceat(row[g], starts, dtype=np.float64) for g in grams) + model.log_prior[i]
    logs = np.exp(logs - logs.max(1, keepdims=True))
    return logs / logs.sum(1, keepdims=True)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score, which take the place of the
    caller's columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").rlike(r"\p{L}").alias("__letters"))

    def run(b: dict[str, list]) -> dict[str, list]:
        learned = shared.value
        able = [i for i, (t, ok) in enumerate(zip(b[text], b["__letters"])) if t is not None and ok and learned.languages]
        pred, best = ["und"] * len(b[text]), [0.0] * len(b[text])
        if able:
            posterior = score(learned, [b[text][i] for i in able])
            for i, j, p in zip(able, posterior.argmax(1).tolist(), posterior.max(1).tolist()):
                pred[i], best[i] = learned.languages[j], p
        return {**{c: b[c] for c in names}, "lang_pred": pred, "score": best}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[F.col(f"`{c}`") for c in names]).schema) + ", lang_pred string, score double"
    return common.scan(rows, run, schema, common.FEW_CHARS)


def held_out(key: str = "doc_id") -> F.Column:
    """crc32 of the key as text leaves 0 modulo 5; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
