"""Benchmark decontamination with a positional inverted index over the corpus.

``build_index`` stores, per document and term, the positions of the term; ``phrase_matches`` finds benchmark windows in it.
A window's rarest terms are looked up first: each posting, moved by the term's place in the item, names a place where the
item would begin (its diagonal). Only diagonals on which as many rare terms meet as a window needs are intersected with
the postings of all the item's terms; runs of matched words as long as a window are exact phrase matches.
``proximity_matches`` returns items whose rare terms meet within a few places of a diagonal without being an exact match.

Only terms of the benchmark are indexed. The benchmark is taken in blocks of at most about ``block_words`` words, so the
vocabulary sent to the tasks is bounded; every block sees all documents. Postings are one row per term and document: a
frequent term is spread over all its documents, and it is only looked up where nothing in a window is rarer.

Inputs: null and empty texts have no words. Repeated rows and ids are documents of their own. Repeated items with one id
count once; items without words or id match nothing that is counted (words of an item without id still count as hit).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from metricloom.llm.tables import settle, unused

WINDOW = 10
RARE = 3
SLOP = 4
#: Lower-cases A-Z and turns every other ASCII character that is not a digit or small letter into a blank.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


def items_of(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """Items with their words and a block number, and the number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[w.decode() for w in split(t)] for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(words, pa.list_(pa.string()))], ["item", "item_id", "words"]
            )

    rows = benchmark.select(
        F.monotonically_increasing_id().alias("item"),
        F.col("item_id").cast("string"),
        F.col("text").cast("string"),
    )
    rows = settle(rows.mapInArrow(run, "item bigint, item_id string, words array<string>"), "items")
    total = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    return rows.filter("size(words) > 0").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), blocks


def numbered(docs: DataFrame) -> DataFrame:
    """A number for every row; it is only used once stored."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text")
    )


def build_index(rows: DataFrame, terms: list[str]) -> DataFrame:
    """The stored index of numbered rows: row, doc_id, term (place in ``terms``), positions; term -1 has the number of words instead."""
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast({w.encode(): i for i, w in enumerate(terms)})
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            docs_of, term_of, ends, places, at = [], [], [], [], 0
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                words = split(text)
                ids = np.fromiter((number(w, -1) for w in words), np.int32, len(words))
                spots = np.flatnonzero(ids >= 0).astype(np.int32)
                order = np.argsort(ids[spots], kind="stable")
                spots = spots[order]
                terms_here, first = np.unique(ids[spots], return_index=True)
                docs_of.append(np.full(len(terms_here) + 1, i))
                term_of += [[-1], terms_here]
                ends += [[at + 1], at + 1 + np.append(first[1:], len(spots))[: len(terms_here)]]
                places += [[len(words)], spots]
                at += 1 + len(spots)
            rows = pa.array(np.concatenate(docs_of))
            offsets = np.concatenate([[0], *ends]).astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(places).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(np.concatenate(term_of).astype(np.int32)),
                    positions,
                ],
                ["row", "doc_id", "term", "positions"],
            )

    index = rows.mapInArrow(run, f"row bigint, doc_id {kind}, term int, positions array<int>")
    return settle(index, "postings")


def item_terms(items: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """Every word of every item: item, item_id, n (words of the item), ipos, term, and the term's frequency."""
    seen = index.filter("term >= 0").groupBy("term").agg(F.sum(F.size("positions")).alias("frequency"))
    words = items.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("ipos", "word"))
    return words.join(terms, "word").join(seen, "term").drop("word")


def rare_terms(words: DataFrame, window: int, rare: int) -> DataFrame:
    """The rarest words of every window, once per place in the item; windows with a word the corpus lacks have none."""
    first = F.greatest(F.lit(0), F.col("ipos") - (window - 1))
    last = F.least(F.col("ipos"), F.greatest(F.lit(0), F.col("n") - window))
    spans = words.withColumn("start", F.explode(F.sequence(first, last)))
    size = F.least("n", F.lit(window))
    by = Window.partitionBy("item", "start")
    spans = spans.withColumn("there", F.count("*").over(by)).filter(F.col("there") == size)
    place = F.row_number().over(by.orderBy("frequency", "ipos"))
    picked = spans.withColumn("place", place).filter(F.col("place") <= rare)
    return picked.select("item", "ipos", "term", F.least("n", F.lit(rare)).alias("need")).distinct()


def meetings(anchors: DataFrame, index: DataFrame) -> DataFrame:
    """Postings of the rare terms, moved by their place in the item: row, item, ipos, diagonal, need."""
    found = anchors.join(index.filter("term >= 0"), "term")
    found = found.select("row", "item", "ipos", "need", F.explode("positions").alias("position"))
    return found.select("row", "item", "ipos", "need", (F.col("position") - F.col("ipos")).alias("diagonal"))


def phrase_matches(words: DataFrame, anchors: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """Exact runs of a window's length or more: row, item, item_id, start, length (in words of the document)."""
    met = meetings(anchors, index).groupBy("row", "item", "diagonal").agg(F.count("*").alias("met"), F.max("need").alias("need"))
    places = settle(met.filter("met >= need").select("row", "item", "diagonal"), "diagonals")
    wanted = places.join(words.select("item", "item_id", "n", "ipos", "term"), "item")
    wanted = wanted.withColumn("position", F.col("diagonal") + F.col("ipos"))
    there = index.filter("term >= 0").join(places.select("row").distinct(), "row", "left_semi")
    there = there.select("row", "term", F.explode("positions").alias("position"))
    matched = wanted.join(there, ["row", "term", "position"])
    line = Window.partitionBy("row", "item", "diagonal").orderBy("ipos")
    runs = matched.withColumn("run", F.col("ipos") - F.row_number().over(line))
    runs = runs.groupBy("row", "item", "item_id", "n", "diagonal", "run").agg(
        F.min("position").alias("start"), F.count("*").alias("length")
    )
    return runs.filter(F.col("length") >= F.least("n", F.lit(window))).select("row", "item", "item_id", "start", "length")


def proximity_matches(anchors: DataFrame, index: DataFrame, slop: int = SLOP) -> DataFrame:
    """Items whose rare terms come together in a document, in places up to ``slop`` off: row, item, start.

    Counts the different rare terms on diagonals up to ``slop`` apart; as many as a window needs make a match, unless they
    lie on one diagonal only. Diagonals are first counted in overlapping bands, so few are ever sorted.
    """
    met = meetings(anchors, index)
    band = F.floor(F.col("diagonal") / (slop + 1))
    banded = met.withColumn("band", F.explode(F.array(band, band - 1)))
    dense = banded.groupBy("row", "item", "band").agg(F.count("*").alias("met"), F.max("need").alias("need"))
    dense = dense.filter("met >= need").select("row", "item", "band")
    near = banded.join(dense, ["row", "item", "band"]).select("row", "item", "ipos", "diagonal", "need").distinct()
    span = Window.partitionBy("row", "item").orderBy("diagonal").rangeBetween(0, slop)
    near = near.withColumns({
        "terms": F.size(F.collect_set("ipos").over(span)),
        "last": F.max("diagonal").over(span),
    })
    return near.filter("terms >= need and last > diagonal").groupBy("row", "item").agg(F.min("diagonal").alias("start"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rare: int = RARE, block_words: int = 500_000
) -> DataFrame:
    """Per row of ``docs``: row, doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), and n_near, the items that only
    come near."""
    items, blocks = items_of(benchmark, block_words)
    base, found, near = None, [], []
    rows = numbered(docs)
    if blocks > 1:  # another scan may number the rows differently, so all blocks read the same stored numbers
        rows = settle(rows, "numbered")
    for block in range(blocks):
        mine = items.filter(F.col("block") == block)
        vocabulary = sorted(r[0] for r in mine.select(F.explode("words")).distinct().toLocalIterator())
        index = build_index(rows, vocabulary)
        if base is None:
            base = index.filter("term = -1").select("row", "doc_id", F.element_at("positions", 1).cast("long").alias("n_words"))
        numbers = docs.sparkSession.createDataFrame(list(enumerate(vocabulary)), "term int, word string")
        words = settle(item_terms(mine, numbers, index), "item-terms")
        anchors = rare_terms(words, window, rare)
        found.append(phrase_matches(words, anchors, index, window))
        near.append(proximity_matches(anchors, index))
    matches = settle(reduce(DataFrame.union, found), "matches")
    words_hit = matches.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length").cast("int") - 1)).alias("at"))
    hit = words_hit.distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = matches.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    only = reduce(DataFrame.union, near).join(matches, ["row", "item"], "left_anti")
    only = only.groupBy("row").agg(F.count("*").alias("n_near"))
    every = base.join(hit, "row", "left").join(named, "row", "left").join(only, "row", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return every.select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep_unnamed: bool = True) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; of rows that share an id only those with such a text go.

    Rows without an id are kept; with ``keep_unnamed`` false they go as well, told apart by a hash of their text. All columns
    pass, whatever their names.
    """
    mark = unused(docs)
    h, bad_id, bad_h = f"{mark}h", f"{mark}bad", f"{mark}bad_h"
    keyed = docs.withColumn(h, F.xxhash64(F.col("text").cast("string")))
    name = F.struct("doc_id", F.col(h).alias("h")).alias("doc_id")
    bad = contamination(keyed.select(name, "text"), benchmark, window).filter("n_hit > 0")
    bad = bad.select(F.col("doc_id.doc_id").alias(bad_id), F.col("doc_id.h").alias(bad_h)).distinct()
    named = bad.filter(F.col(bad_id).isNotNull()) if keep_unnamed else bad
    same = keyed["doc_id"].eqNullSafe(named[bad_id]) & (keyed[h] == named[bad_h])
    return keyed.join(named, same, "left_anti").drop(h)
