"""Line dedup: later copies of runs of lines are deleted, found by hashes of windows; winnowing is a prefilter.

A line is what stands between line feeds, without blanks around it; lines without anything else are passed over and kept.
Of every ``window`` consecutive lines the one with the smallest hash (the last of equals) is a fingerprint; a line of
``long_words`` words or more is a window of its own. So every repeated run of ``window`` lines, and every repeated long line, has a
fingerprint that is repeated, too. All windows are stored; those whose fingerprint occurs once cannot repeat and are left
out, which saves work and does not change the result. Of the others, windows with equal hashes are copies. The first in
order of document and place stays, others are deleted; a window that overlaps the first within its document stays. As every
window is looked at, longer runs go as a whole, with nothing joined pairwise.

With ``run_words`` every run of fewer than ``window`` lines that has so many words together is a window of its own, too; the
registered query takes five words. A run all of whose lines lie in shorter such runs inside it is not stored: if it repeats, so do
these, and its lines go with them. So a document of ordinary lines stores one row per line. Without ``run_words`` repeats of one
or two lines stay unless a line is long.

Documents are ordered by id, then by a hash of the text; null ids come first. Rows that are equal in id and text count as
one document and get the same result. A null text stays null, an empty one empty. Columns other than the id and text are
passed through, whatever their names; only n_lines and n_removed are replaced. Very long texts and lines are taken whole: their
windows are rows of their own. An empty table stays empty.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from metricloom.llm.tables import settle, unused

WINDOW = 3
LONG_WORDS = 50
BLANKS = " \t\n\x0b\f\r"


def numbered(text: Column, long_words: int, run_words: int | None = None) -> Column:
    """Lines that count, as struct(h, long); with ``run_words`` also n, their words."""

    def one(line: Column) -> Column:
        # so many words take so many characters at least; only such lines are split
        least = F.char_length(line) >= 2 * long_words - 1
        many = F.when(least, F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) >= long_words).otherwise(F.lit(False))
        counted = [] if run_words is None else [F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).alias("n")]
        return F.struct(F.xxhash64(line).alias("h"), many.alias("long"), *counted)

    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)))
    return F.transform(F.filter(lines, lambda x: x != ""), one)


def window_hashes(lines: Column, window: int) -> Column:
    """Hash of the ``window`` lines that begin at each place, in order."""
    starts = F.sequence(F.lit(0), F.size(lines) - window)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(lines, i + j)["h"] for j in range(window)]))
    return F.when(F.size(lines) >= window, hashed).otherwise(F.array().cast("array<bigint>"))


def fingerprint_places(lines: Column, window: int) -> Column:
    """Per window, the place of its fingerprint: the smallest line hash, the last of equals."""
    starts = F.sequence(F.lit(0), F.size(lines) - window)

    def minimum(start: Column) -> Column:
        inside = [F.struct(F.get(lines, start + j)["h"].alias("h"), (-start - j).alias("back")) for j in range(window)]
        return -F.least(*inside)["back"]

    chosen = F.transform(starts, minimum) if window > 1 else starts
    return F.when(F.size(lines) >= window, chosen).otherwise(F.array().cast("array<int>"))


def uncovered(lines: Column, start: Column, size: int, run_words: int) -> Column:
    """Whether a line of the run lies in no shorter run inside it that has ``run_words`` words or more."""
    n = [F.get(lines, start + j)["n"] for j in range(size)]
    bare = []
    for j in range(size):
        # the longest shorter runs that hold the line have the most words
        spans = [range(a, a + size - 1) for a in (0, 1) if size > 1 and a <= j < a + size - 1]
        held = [sum((n[i] for i in span), F.lit(0)) >= run_words for span in spans]
        bare.append(~reduce(or_, held) if held else F.lit(True))
    return reduce(or_, bare)


def short_runs(lines: Column, size: int, run_words: int) -> Column:
    """The runs of ``size`` lines that have ``run_words`` words or more together, as windows of their own."""
    starts = F.when(F.size(lines) >= size, F.sequence(F.lit(0), F.size(lines) - size)).otherwise(F.array().cast("array<int>"))
    enough = F.filter(
        starts,
        lambda i: (sum(F.get(lines, i + j)["n"] for j in range(size)) >= run_words) & uncovered(lines, i, size, run_words),
    )

    def run(start: Column) -> Column:
        hash = F.xxhash64(*[F.get(lines, start + j)["h"] for j in range(size)], F.lit("long"))
        return F.struct(
            start.alias("start"), F.lit(size).alias("size"), F.xxhash64(hash, F.lit(size)).alias("mark"),
            hash.alias("hash"), F.lit(True).alias("new"),
        )

    return F.transform(enough, run)


def seeds(docs: DataFrame, window: int, long_words: int, run_words: int | None = None) -> DataFrame:
    """A row per window of every document: doc_id, h (text), start, size, mark (hash of the fingerprint), hash, and whether
    it is the first window of its fingerprint."""
    rows = docs.select("doc_id", "h", numbered(F.col("text"), long_words, run_words).alias("lines"))
    rows = rows.withColumns({
        "hashes": window_hashes(F.col("lines"), window),
        "places": fingerprint_places(F.col("lines"), window),
    })
    runs = F.transform(
        F.col("hashes"),
        lambda hash, i: F.struct(
            i.alias("start"),
            F.lit(window).alias("size"),
            F.xxhash64(F.get("lines", F.get("places", i))["h"], F.lit(window)).alias("mark"),
            hash.alias("hash"),
            (F.get("places", i) != F.coalesce(F.get("places", i - 1), F.lit(-1))).alias("new"),
        ),
    )
    if run_words is not None:
        runs = F.filter(runs, lambda r: uncovered(F.col("lines"), r["start"], window, run_words))
    singles = F.transform(
        F.filter(F.transform("lines", lambda s, i: F.struct(i.alias("i"), s["h"].alias("h"), s["long"].alias("long"))), lambda s: s["long"]),
        lambda s: F.struct(
            s["i"].alias("start"),
            F.lit(1).alias("size"),
            F.xxhash64(s["h"], F.lit(1)).alias("mark"),
            F.xxhash64(s["h"], F.lit("long")).alias("hash"),
            F.lit(True).alias("new"),
        ),
    )
    if run_words is None:
        return rows.select("doc_id", "h", F.inline(F.concat(runs, singles)))
    short = [short_runs(F.col("lines"), size, run_words) for size in range(1, window)]
    singles = [singles] if run_words > long_words else []  # otherwise long lines are among the short runs
    return rows.select("doc_id", "h", F.inline(F.concat(runs, *singles, *short)))


def repeats(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS, run_words: int | None = None) -> DataFrame:
    """Windows that repeat an earlier one: doc_id, h, start, size.

    A window's first place is a minimum, summed up before the shuffle; joined back, a frequent window's rows are split by
    the adaptive skew join, as the other side has one row per window.
    """
    every = settle(seeds(docs, window, long_words, run_words), "line-windows")
    # a fingerprint that occurs once cannot be part of a repeated run
    marks = every.filter("new").groupBy("mark").agg(F.count("*").alias("times")).filter("times > 1").select("mark")
    place = F.struct("doc_id", "h", "start")
    some = every.join(marks, "mark", "left_semi")
    first = some.groupBy("hash", "size").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    first = first.filter("times > 1").drop("times")
    later = some.join(first, ["hash", "size"])
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h"))
    apart = F.col("first.start") + F.col("size") <= F.col("start")
    return later.filter(~same | apart).select("doc_id", "h", "start", "size")


def drop_repeats(
    docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS, run_words: int | None = None
) -> DataFrame:
    """``docs`` with later copies of runs deleted from ``text``, n_lines (that count) and n_removed."""
    mark = unused(docs, "n_lines", "n_removed")
    keyed = docs.withColumn(f"{mark}h", F.xxhash64("text"))
    rows = keyed.select("doc_id", F.col(f"{mark}h").alias("h"), F.col("text")).filter("text is not null")
    found = repeats(rows, window, long_words, run_words)
    gone = found.select("doc_id", "h", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("i"))
    gone = gone.groupBy(F.col("doc_id").alias(f"{mark}id"), F.col("h").alias(f"{mark}hash")).agg(F.collect_set("i").alias(f"{mark}gone"))
    same = keyed["doc_id"].eqNullSafe(gone[f"{mark}id"]) & (keyed[f"{mark}h"] == gone[f"{mark}hash"])
    joined = keyed.join(gone, same, "left").withColumn(f"{mark}lines", F.split("text", "\n", -1))
    full = F.transform(f"{mark}lines", lambda x, i: F.when(F.trim(x, F.lit(BLANKS)) != "", i))
    joined = joined.withColumn(f"{mark}full", F.filter(full, lambda i: i.isNotNull()))
    joined = joined.withColumn(f"{mark}removed", F.transform(f"{mark}gone", lambda i: F.get(f"{mark}full", i)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(f"{mark}lines") - 1), F.col(f"{mark}removed"))
    text = F.array_join(F.transform(kept, lambda i: F.get(f"{mark}lines", i)), "\n")
    joined = joined.withColumns({
        "n_lines": F.coalesce(F.array_size(f"{mark}full"), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.array_size(f"{mark}removed"), F.lit(0)).cast("long"),
        "text": F.when(F.col(f"{mark}removed").isNull(), F.col("text")).otherwise(text),
    })
    return joined.drop(f"{mark}h", f"{mark}id", f"{mark}hash", f"{mark}gone", f"{mark}lines", f"{mark}full", f"{mark}removed")
