"""Document fingerprints: the k smallest hashes of a text's word shingles (bottom-k sketch).

The sketch of a union is the k smallest of the united sketches, so sketches of parts merge exactly. Of two sketches, the
share of their union's k smallest hashes that both have estimates the resemblance of the shingle sets; the k-th smallest
hash estimates their number, and both together the containment. With k or fewer shingles all of these are exact.

Words are lower-cased and split at blanks; a shingle is ``SHINGLE`` words, a shorter text is one shingle; texts without
words have an empty sketch. Inputs: a null text counts as empty; equal texts have equal sketches; rows that are equal
in id and text count as one document of the sequence, each row is returned. Null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from metricloom.llm.ranks import running_sum

SHINGLE = 5
K = 64
#: Hashes are signed longs; this many values there are.
SPAN = 2.0**64


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of the shingles, repeats included; words are hashed once, a shingle is hashed from its words' hashes."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(h) - (shingle - 1))
        return F.transform(places, lambda i: F.xxhash64(*[F.try_element_at(h, i + j) for j in range(shingle)]))

    def either(h: Column) -> Column:
        short = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
        return F.when(F.size(h) >= shingle, shingles(h)).otherwise(short)

    # transform over one element names the array of word hashes, so it is made once
    return F.flatten(F.transform(F.array(hashes), either))


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The k smallest different shingle hashes, ascending."""
    return smallest(shingle_hashes(F.coalesce(text, F.lit("")), shingle), k)


def smallest(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the texts' united shingles."""
    return smallest(F.concat(a, b), k)


def merge_rows(rows: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch per group of rows that have one: a hash is kept if it is among the group's k smallest.

    Hashes are ranked in 64 parts of a group first, each of which keeps k, then what is left of the group.
    """
    hashes = rows.select(*by, F.explode(column).alias("h")).distinct()
    part = Window.partitionBy(*by, F.pmod(F.xxhash64("h"), F.lit(64))).orderBy("h")
    for ranked in (part, Window.partitionBy(*by).orderBy("h")):
        hashes = hashes.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k).drop("_rank")
    return hashes.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1; two empty sketches are alike."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact below k."""
    reached = (F.element_at(a, -1).cast("double") + F.lit(SPAN / 2)) / F.lit(SPAN)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / reached)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a is contained in anything."""
    likeness, union = resemblance(a, b, k), merge(a, b, k)
    share = likeness * distinct_shingles(union, k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def digits(a: Column) -> Column:
    """The sketch as text: 16 hex digits per hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


#: Stands for a missing id among the join keys; as an id it counts as missing.
MISSING = -(2**63)


def keyed(docs: DataFrame) -> DataFrame:
    """id, h and text: the join keys and what they stand for."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MISSING)).alias("id"), text)
    return rows.withColumn("h", F.xxhash64("text"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Documents in ascending id: keys of each and of its predecessor (the last one's is the first), and the predecessor's
    length. Only keys and lengths are ordered."""
    narrow = rows.select("id", "h", F.char_length("text").alias("n")).distinct()
    placed = running_sum(narrow, [], ["id", "h"], F.lit(1).cast("long"), "place")
    last = narrow.count() - 1
    after = F.when(F.col("place") == F.lit(last), F.lit(0)).otherwise(F.col("place") + 1)
    before = placed.select(
        F.col("id").alias("prev_id"), F.col("h").alias("prev_h"), F.col("n").alias("prev_n"), after.alias("place")
    )
    return placed.select("id", "h", "place").join(before, "place").drop("place")


def edited_likeness(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Sketches of every text and of its edited text, whose second half is the beginning of the next document.

    The texts are shuffled once, by document (both joins read the same exchange); what the next document has to give is cut to the length needed before it
    moves to its predecessor, together with its sketch.
    """
    rows = keyed(docs)
    named = rows.join(neighbours(rows), ["id", "h"])
    # rows that are equal in id and text give once; the join has sorted them
    place = F.row_number().over(Window.partitionBy("id", "h").orderBy("id"))
    gives = named.withColumn("_place", place).filter("_place = 1").select(
        F.col("prev_id").alias("id"),
        F.col("prev_h").alias("h"),
        F.left("text", F.floor(F.col("prev_n") / 2).cast("int")).alias("tail"),
        sketch(F.col("text"), k, shingle).alias("next_sketch"),
    )
    n = F.char_length("text")
    joined = rows.join(gives, ["id", "h"]).select(
        F.when(F.col("id") != MISSING, F.col("id")).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        "text",
        F.concat(F.left("text", n - F.floor(n / 2).cast("int")), "tail").alias("edited"),
        "next_sketch",
    )
    made = joined.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text"), k, shingle).alias("own"),
        sketch(F.col("edited"), k, shingle).alias("other"),
        "next_sketch",
    )
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digits(F.col("own")).alias("fingerprint"),
        digits(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_sketch"), k).alias("near_next"),
    )
