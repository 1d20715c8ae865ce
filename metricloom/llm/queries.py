"""Registered queries over the corpus tables: one per operator, with its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metricloom.llm import (
    decontaminate, line_dedup, mixing, partenum, periodic, pii, pu, quality, ranked, shard_tree, simhash, sketches, toxicity, warc,
)
from metricloom.llm.tables import scratch, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash components over 4-word shingles, linked at 4 bits or fewer."""
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=4, max_bits=4)


@query
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item."""
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE["op3_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
phrases AS (
  SELECT DISTINCT item_id, least(n, 10) AS size, array_to_string(w[s:s + least(n, 10) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, greatest(n - 9, 1))) AS s FROM b)),
spans AS (
  SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s
        FROM d, (SELECT DISTINCT size FROM phrases))),
hits AS (SELECT doc_id, item_id, s, size FROM spans JOIN phrases USING (size, phrase)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _scored(scores: DataFrame, parts: int, held: int) -> DataFrame:
    held_out = F.coalesce(pu.remainder("doc_id", parts) == held, F.lit(False))
    predicted = (F.col("score") >= pu.CUT).cast("int")
    return scores.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text, learned from three quarters of the labels."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels.filter(pu.remainder("doc_id", 4) != 2))
    return _scored(toxicity.score(docs, model), 4, 2)


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every text, learned from four fifths of the labels."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.train(docs, labels.filter(pu.remainder("doc_id", 5) != 0))
    return _scored(quality.score(docs, model), 5, 0)


@query
def op6_shard_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Eight shards by descending the weighted hash tree, and the shard of each row if a ninth were added."""
    tree = shard_tree.even_tree(8)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = shard_tree.descend(rows, ["doc_id"], shard_tree.grow(tree, 8)).withColumnRenamed("shard", "grown_shard")
    rows = shard_tree.descend(rows, ["doc_id"], tree)
    rows = shard_tree.add_slots(rows, ["doc_id", "text_crc32", "size"])
    law = F.lit("key").alias("law")
    return rows.select("doc_id", "size", "text_crc32", law, "shard", "slot", "grown_shard", "region", "rack")


@query
def op8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of each document."""
    rows = mixing.copies(mixing.sized(table(spark, folder, "documents")))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return rows.select("doc_id", "size", "source_size", "target", taken, "copies")


ORACLE["op8_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 3 AS most,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM sized GROUP BY source),
shares AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS share
  FROM totals
  WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
    least(most, weight * coalesce((SELECT max(share) FROM shares WHERE most / weight >= share), 0)) AS target FROM shares),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix 17 ' || coalesce(s.source, '(null)')), 1, 5))::BIGINT::DOUBLE / 1048576 AS moved,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5(s.doc_id::VARCHAR)) - 1 AS place
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (floor((place + 1) * rate + moved) - floor(place * rate + moved))::BIGINT AS copies,
  (floor((place + 1) * rate + moved) - floor(place * rate + moved))::BIGINT * size::BIGINT AS taken
FROM placed
"""


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that repeat an earlier run of three lines or of five words."""
    found = line_dedup.drop_repeats(table(spark, folder, "documents").select("doc_id", "text"), run_words=5)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE["op1_line_dedup"] = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, i, lines[i] AS line, trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x
  FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM docs)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM lines WHERE x <> ''),
runs AS (
  SELECT doc_id, p, 3 AS size, x || chr(10) || lead(x, 1) OVER w || chr(10) || lead(x, 2) OVER w AS run
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY p)
  UNION ALL
  SELECT doc_id, p, 2, CASE WHEN n + lead(n) OVER w >= 5 THEN x || chr(10) || lead(x) OVER w END
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY p)
  UNION ALL
  SELECT doc_id, p, 1, x FROM numbered WHERE n >= 5),
placed AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(p) OVER w AS first_p FROM runs WHERE run IS NOT NULL
  WINDOW w AS (PARTITION BY size, run ORDER BY doc_id, p)),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + size - 1)) AS p FROM placed
  WHERE first_doc <> doc_id OR first_p + size <= p),
dropped AS (SELECT doc_id, i FROM numbered JOIN gone USING (doc_id, p)),
texts AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM lines ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM numbered GROUP BY doc_id),
losses AS (SELECT doc_id, count(*) AS n FROM dropped GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, coalesce(l.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS text_sha256
FROM docs d LEFT JOIN texts t USING (doc_id) LEFT JOIN counts c USING (doc_id) LEFT JOIN losses l USING (doc_id)
"""


@query
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as WARC files and read back."""
    path = scratch(spark, "warc")
    warc.write(table(spark, folder, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op7_warc"] = r"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digests AS (SELECT *, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS last FROM payloads)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM digests
"""


@query
def op9_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Bottom-k sketches of every text and its edited text, and their likeness."""
    return sketches.edited_likeness(table(spark, folder, "documents"))


@query
def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text: counts per kind, all spans, and the score of each."""
    found = pii.find_spans(table(spark, folder, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.size("spans").cast("long").alias("n_spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _made_periodic(docs: DataFrame) -> DataFrame:
    """The contract's texts: of every tenth document, told by a hash of its id, the words from some place on repeat."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce((hashed % 10 == 0) & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    parts = docs.select("doc_id", "text", F.floor(hashed / 10).alias("g"), F.when(chosen, words).alias("words"))
    a = F.col("g") % F.size("words")
    parts = parts.withColumn("a", F.when(F.col("words").isNotNull(), a))
    period = F.expr("1 + (size(words) - a) div (3 + g % 8)")
    parts = parts.withColumn("p", F.when(F.col("words").isNotNull(), period))
    moved = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.expr("a") + (i - F.col("a")) % F.col("p"))))
    return parts.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(moved, " ")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words: how many, the longest, digests of all and of the text without repetitions."""
    found = periodic.find_runs(_made_periodic(table(spark, folder, "documents")))
    # longest first, then the smallest start, then the smallest period
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))
    found = found.withColumn("best", F.array_min(order))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    length, period = -F.col("best.shorter"), F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE["op11_ranked_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item, item_id, unnest(w) AS term FROM i),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
tallies AS (
  SELECT row, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT row, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY ALL),
held AS (SELECT * FROM tallies WHERE term IN (SELECT term FROM asked)),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM held, totals GROUP BY term, n_docs),
scores AS (
  SELECT item, item_id, row, doc_id,
    sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), totals GROUP BY item, item_id, row, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op12_partenum(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return partenum.near_sets(table(spark, folder, "documents"), words=5, percent=80)
