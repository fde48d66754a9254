"""Near-equal lines by an edit-distance join on segments, with SQL functions only.

Lines are compared trimmed and in lower case, from MIN_CHARS characters up; shorter
ones always stay. Equal lines are one class. Classes within EDITS edits of each
other are linked: a line is cut into EDITS + 1 segments, one of which any line
within reach must contain unchanged, at a place that length and segment restrict
(multi-match-aware selection). Segments and selected substrings meet as hashes of
(length, segment, substring); letter counts sift the meetings; a banded bit-parallel
automaton of EDITS + 1 rows decides on the whole lines.

A line occurrence is kept if it is the first of its class (by doc_id and place) and
no linked class begins earlier. Null texts stay null, blank lines stay. Rows equal
in key and text are one document and are answered alike; null keys come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corefold.llm import common

EDITS = 2
MIN_CHARS = 16
#: Shared keys and their classes are sent to all executors up to this number, joined beyond.
BROADCAST_ROWS = 1_000_000
#: Frequent letters whose counts sift; any characters give right results.
COUNTED = ("etnaor", "ishdlu")
_CLASS = ["h1", "h2"]


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (hash of key and text), place, line and class (h1, h2)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("place", "raw"))
    rows = rows.select("doc_id", "row", "place", F.lower(F.btrim("raw", F.lit(" \t\r"))).alias("line")).filter(F.length("line") >= MIN_CHARS)
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def one_byte(line: str = "line") -> Column:
    """The line with one byte per character, so that places are offsets: Latin-1,
    anything else a question mark. Equal parts stay equal; edits do not grow."""
    return F.encode(F.regexp_replace(line, "[^\\x00-\\xFF]", "?"), "ISO-8859-1")


def segment_keys(size: str = "size", raw: str = "raw", edits: int = EDITS) -> tuple[Column, Column]:
    """Two arrays of keys: the segments of the line, which are also what it looks for
    in lines of its own length, and the substrings it looks for besides, in lines of
    its length and of up to ``edits`` less."""
    own, other = [], []
    for less in range(edits + 1):
        for i in range(edits + 1):
            first = F.expr(f"cast(({size} - {less}) * {i} div {edits + 1} AS int)")
            width = F.expr(f"cast(({size} - {less}) * {i + 1} div {edits + 1} AS int)") - first
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                key = F.xxhash64(F.lit(i), F.col(size) - less, F.substring(F.col(raw), first + 1 + shift, width))
                (other if less or shift else own).append(key)
    return F.array(*own), F.array(*other)


def letter_counts(line: str = "line") -> Column:
    """One long per group of six letters, ten bits a count."""
    size = F.octet_length(line)

    def packed(letters: str) -> Column:
        counts = [(size - F.octet_length(F.replace(F.col(line), F.lit(c), F.lit("")))) % 1024 for c in letters]
        return reduce(lambda a, b: a + b, [F.shiftleft(c.cast("long"), 10 * i) for i, c in enumerate(counts)])

    return F.array(*[packed(letters) for letters in COUNTED])


def _counts_near(a: Column, b: Column, edits: int) -> Column:
    """At most ``edits`` letters more on either side; never false for lines within reach."""

    def count(packed: Column, i: int) -> Column:
        return F.shiftright(packed, 10 * i).bitwiseAND(F.lit(1023))

    diffs = [F.pmod(count(F.get(a, F.lit(g)), i) - count(F.get(b, F.lit(g)), i) + 512, F.lit(1024)) - 512 for g, letters in enumerate(COUNTED) for i in range(len(letters))]
    more = reduce(lambda x, y: x + y, [F.greatest(d, F.lit(0)) for d in diffs])
    less = reduce(lambda x, y: x + y, [F.greatest(-d, F.lit(0)) for d in diffs])
    return (more <= edits) & (less <= edits)


def within(a: str, b: str, edits: int = EDITS) -> Column:
    """Whether two lines are within ``edits`` edits. Row e of the automaton holds, as
    bits, the diagonals (-edits to edits) reached with e edits; each character of b
    moves all of them at once."""
    mask = F.lit((1 << (2 * edits + 1)) - 1).cast("long")
    start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << edits).cast("long").alias(f"r{e}") for e in range(edits + 1)])

    def rows(state: Column, match: Column) -> Column:
        out: list[Column] = []
        for e in range(edits + 1):
            row = state[f"r{e}"].bitwiseAND(match)
            if e:
                before = state[f"r{e - 1}"]
                row = row.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(out[e - 1], 1))
            out.append(row.bitwiseAND(mask))
        return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(out)])

    def run(lines: Column) -> Column:
        left, right = lines["a"], lines["b"]

        def match(j: Column) -> Column:
            same = [F.when(F.get(left, j + d) == F.get(right, j), F.lit(1 << (d + edits))).otherwise(F.lit(0)).cast("long") for d in range(-edits, edits + 1)]
            return reduce(lambda x, y: x + y, same)

        # One-element arrays bind a value that would else be computed at every use.
        places = F.sequence(F.lit(0), F.size(right) - 1)
        end = F.aggregate(places, start, lambda state, j: F.element_at(F.transform(F.array(match(j)), lambda m: rows(state, m)), 1))
        reached = F.pow(F.lit(2.0), F.size(left) - F.size(right) + edits).cast("long")
        return end[f"r{edits}"].bitwiseAND(reached) != 0

    def chars(line: str) -> Column:
        return F.filter(F.split(F.col(line), ""), lambda c: c != "")

    both = F.array(F.struct(chars(a).alias("a"), chars(b).alias("b")))
    return (F.abs(F.length(a) - F.length(b)) <= edits) & F.element_at(F.transform(both, run), 1)


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast hint for a written table of at most BROADCAST_ROWS rows of one long."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def classes_of(lines: DataFrame) -> DataFrame:
    """One row per class, written: h1, h2, first (occurrence) and line."""
    first = F.min(F.struct("doc_id", "row", "place"))
    return common.written(lines.groupBy(*_CLASS).agg(first.alias("first"), F.first("line").alias("line")), "line-classes")


def links(lines: DataFrame, edits: int = EDITS, classes: DataFrame | None = None) -> DataFrame:
    """Pairs of classes within reach: h1, h2, g1, g2 with their first occurrences
    (first, other_first). ``classes`` are those of the lines, where they are written already."""
    c = F.col
    classes = classes_of(lines) if classes is None else classes
    own, other = segment_keys(edits=edits)
    shaped = classes.select("h1", F.length("line").alias("size"), one_byte().alias("raw")).select("h1", "size", own.alias("own"), other.alias("other"))
    # One narrow row per key. The sign of ``mark`` tells segments from substrings, its value is the line's length.
    keyed = shaped.select("h1", "size", F.explode(F.concat(F.transform("own", lambda k: F.struct(k.alias("key"), F.lit(1).alias("sign"))), F.transform("other", lambda k: F.struct(k.alias("key"), F.lit(-1).alias("sign"))))).alias("k"))
    keyed = keyed.select("h1", c("k.key").alias("key"), (c("size") * c("k.sign")).alias("mark"))
    # Keys of several classes, then their rows only: few lines share a segment.
    shared = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("mark").alias("top")).filter("low < high AND top > 0").select("key")
    shared = _small(common.written(shared, "line-keys"))
    met = common.written(keyed.join(shared, "key").distinct(), "line-meetings")
    wanted = _small(common.written(met.select("h1").distinct(), "line-candidates"))
    texts = common.written(classes.join(wanted, "h1", "left_semi").withColumn("counts", letter_counts()), "line-texts")
    sifted = met.join(texts.select("h1", "counts"), "h1")
    a, b = sifted.alias("a"), sifted.alias("b")
    longer = F.abs(c("b.mark")) - c("a.mark")  # out of range where a is no segment
    meets = longer.between(0, edits) & ((longer > 0) | (c("b.h1") > c("a.h1"))) & _counts_near(c("a.counts"), c("b.counts"), edits)
    met = a.join(b, (c("a.key") == c("b.key")) & meets).select(c("a.h1").alias("h1"), c("b.h1").alias("g1")).distinct()
    partner = texts.select(c("h1").alias("g1"), c("h2").alias("g2"), c("first").alias("other_first"), c("line").alias("other"))
    both = met.join(texts, "h1").join(partner, "g1").filter(within("line", "other", edits))
    return common.written(both.select("h1", "h2", "g1", "g2", "first", "other_first"), "line-links")


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """One row per line of MIN_CHARS characters or more: doc_id, row, place, its
    class's first occurrence, n_links (classes linked with its class), kept."""
    lines = common.written(lines_of(docs, key, text), "lines")
    firsts = classes_of(lines)
    linked = links(lines, edits, firsts)
    both = linked.unionByName(linked.select(F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("other_first").alias("first"), F.col("first").alias("other_first")))
    near = both.groupBy(*_CLASS).agg(F.count("*").alias("n_links"), F.min("other_first").alias("earliest"))
    places = lines.select("doc_id", "row", "place", *_CLASS)
    classes = firsts.select(*_CLASS, "first").join(near, _CLASS, "left")
    own = F.struct("doc_id", "row", "place")
    kept = (own == F.col("first")) & (F.col("earliest").isNull() | (F.col("first") < F.col("earliest")))
    return places.join(classes, _CLASS).select(
        "doc_id", "row", "place", F.col("first.doc_id").alias("first_doc"), F.col("first.place").alias("first_place"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"),
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """The documents with later duplicates of lines taken out; all rows stay."""
    gone = occurrences(docs, key, text, edits).filter(~F.col("kept")).groupBy(F.col("row").alias("__row")).agg(F.collect_set("place").alias("__gone"))
    rows = docs.withColumn("__row", F.xxhash64(key, text)).join(gone, "__row", "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return rows.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left)).select(*docs.columns)
