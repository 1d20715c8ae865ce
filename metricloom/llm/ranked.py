"""Ranked lexical search over bit-sliced Bloom signatures of the documents.

``build_index`` gives every document a Bloom signature of its terms and stores the signatures of many documents as slices: one
bitmap over the documents per signature bit. A term is entered once for each of ``LEVELS`` that its occurrences reach, so
the bitmaps of a term, a few slices ANDed, overestimate which documents hold it, and how often. ``search`` adds up, per query
and document, what the weights of the terms and the highest occurrences that their bitmaps allow can give at most: an
upper bound of the score. The ten documents of the largest bounds are scored exactly; the tenth score is a threshold, and
every document whose bound does not fall below it is scored exactly, too. Only those that provably cannot be among the ten are left out.

Signatures are as long as their documents need: documents share a block with others of about as many entries, and a block
has so many documents that its slices take about ``BLOCK_BITS``. Queries come in blocks of about ``block_words`` words, so what
tasks are sent is bounded; every block sees all documents. A document is told by its id and a hash of its text.

Inputs: null and empty texts have no terms and are never found. Rows that repeat an id or a whole row are documents of
their own, ids may be null (these come first among equal scores) and of any orderable type. Equal queries (id and text) are one
query, others of one id are queries of their own; queries without terms find nothing. Very long texts get longer signatures.
Only the columns used are read, whatever others are called. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from metricloom.llm.decontaminate import split
from metricloom.llm.tables import settle

#: Occurrences from which a term is entered once more.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64)
BITS, HASHES, BLOCK_BITS = 12, 4, 1 << 21
#: Terms a task counts, or whose hashes it remembers, before it writes them out or forgets them.
HELD = 200_000
BLOCK_WORDS = 200_000
TOP = 10


def mixed(hashes: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """Hashes of the entries (term, level)."""
    with np.errstate(over="ignore"):
        h = (hashes + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def places(entries: np.ndarray, bits: int) -> np.ndarray:
    """The ``HASHES`` slices of each entry, of ``bits`` slices."""
    low, high = entries & np.uint64(0xFFFFFFFF), entries >> np.uint64(32)
    steps = np.arange(HASHES, dtype=np.uint64)[:, None]
    return ((((low + steps * (high | np.uint64(1))) & np.uint64(0xFFFFFFFF)) * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)


def sliced(signatures: list[np.ndarray], bits: int) -> bytes:
    """Slices of the documents of a block: bit d of slice r is set if r is one of document d's places."""
    wide = np.zeros((bits, -(-len(signatures) // 8) * 8), np.uint8)
    for document, rows in enumerate(signatures):
        wide[rows, document] = 1
    return np.packbits(wide, axis=1).tobytes()


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index: blocks (ids, hashes, sizes, bits, slices), and rows (term, df) that counts of each term add up from."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}  # documents of each size that wait for a full block
        counts, known, id_type = Counter(), {}, None

        def rows(columns: dict, n: int) -> pa.RecordBatch:
            types = {
                "ids": pa.list_(id_type), "hashes": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "bits": pa.int32(),
                "slices": pa.binary(), "term": pa.string(), "df": pa.int64(),
            }
            filled = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()]
            return pa.RecordBatch.from_arrays(filled, list(types))

        def block(size: int) -> pa.RecordBatch:
            ids, hashes, sizes, signatures = zip(*held.pop(size))
            bits = BITS << size
            columns = {"ids": [list(ids)], "hashes": [list(hashes)], "sizes": [list(sizes)], "bits": [bits]}
            return rows({**columns, "slices": [sliced(signatures, bits)]}, 1)

        def terms() -> pa.RecordBatch:
            found = rows({"term": [t.decode() for t in counts], "df": list(counts.values())}, len(counts))
            counts.clear()
            return found

        for batch in batches:
            id_type = batch.column(0).type
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for id_, hash_, text in zip(ids, hashes, batch.column(1).cast(pa.binary())):
                words = split(text.as_py())
                if not words:
                    continue
                tally = Counter(words)
                counts.update(tally.keys())
                if len(known) > HELD:
                    known.clear()
                for term in tally:
                    if term not in known:
                        known[term] = xxhash.xxh64_intdigest(term)
                digests = np.array([known[t] for t in tally], np.uint64)
                tf = np.array(list(tally.values()))
                reached = [(digests[tf >= level], level) for level in LEVELS if level == 1 or (tf >= level).any()]
                entries = np.concatenate([mixed(h, level) for h, level in reached])
                size = int(len(entries) - 1).bit_length()
                held.setdefault(size, []).append((id_, hash_, len(words), places(entries, BITS << size).reshape(-1)))
                if len(held[size]) >= max(8, BLOCK_BITS // (BITS << size) // 8 * 8):
                    yield block(size)
                if len(counts) > HELD:
                    yield terms()
        for size in list(held):
            yield block(size)
        if counts:
            yield terms()

    fields = f"ids array<{kind}>, hashes array<bigint>, sizes array<bigint>, bits int, slices binary, term string, df bigint"
    text = F.col("text").cast("string")
    return settle(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(run, fields), "signatures")


class Queries:
    """A bounded block of queries: their terms, weights, and what a document of a length can get for a term."""

    def __init__(self, terms: dict[str, int], queries: dict[int, list[str]], documents: int, words: int):
        self.documents, self.words = documents, words
        self.numbers = np.array(sorted(queries), np.int64)
        vocabulary = sorted({t for asked in queries.values() for t in asked if t in terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        self.weights = {t.encode(): terms[t] for t in vocabulary}
        self.asked = {n: [t.encode() for t in asked if t in terms] for n, asked in queries.items()}
        self.digests = np.array([xxhash.xxh64_intdigest(t.encode()) for t in vocabulary], np.uint64)
        pairs = [(i, place[t], terms[t]) for i, n in enumerate(self.numbers.tolist()) for t in queries[n] if t in place]
        self.query, self.term, self.weight = np.array(pairs, np.int64).reshape(-1, 3).T

    def norm(self, size):
        return 25 + 75 * size * self.documents // self.words

    def gain(self, times: int | None, norm: np.ndarray) -> np.ndarray:
        """What a weight of one gives for so many occurrences; for None, what any number gives at most."""
        return np.full_like(norm, 1_000_000) if times is None else 1_000_000_000 * times // (1000 * times + 8 * norm)

    def bounds(self, bits: int, slices: bytes, sizes: np.ndarray) -> np.ndarray:
        """Upper bound of the score per query and document of a block."""
        n = len(sizes)
        table = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        norm, total = self.norm(sizes), np.zeros((len(self.numbers), n), np.int64)
        alive, present = np.arange(len(self.digests)), np.full((len(self.digests), table.shape[1]), 255, np.uint8)
        before = np.zeros(n, np.int64)
        for level, following in zip(LEVELS, [*LEVELS[1:], None]):
            rows = places(mixed(self.digests[alive], level), bits)
            for row in rows:
                present &= table[row]
            some = present.any(axis=1)
            alive, present = alive[some], present[some]
            if not len(alive):
                break
            where = np.full(len(self.digests), -1)
            where[alive] = np.arange(len(alive))
            mine = np.flatnonzero(where[self.term] >= 0)
            if not len(mine):
                break
            held = np.unpackbits(present, axis=1, count=n)
            first = np.flatnonzero(np.append(True, np.diff(self.query[mine]) > 0))
            weighted = held[where[self.term[mine]]] * self.weight[mine, None]
            sums = np.add.reduceat(weighted, first, axis=0)
            most = self.gain(None if following is None else following - 1, norm)
            total[self.query[mine][first]] += sums * (most - before)
            before = most
        return total

    def score(self, number: int, tally: Counter, size: int) -> int:
        """Exact score of a document."""
        norm = self.norm(size)
        held = ((self.weights[t], tally[t]) for t in self.asked[number] if t in tally)
        return sum(w * (1_000_000_000 * tf // (1000 * tf + 8 * norm)) for w, tf in held)


def _top(rows: DataFrame, by: str, *then: str) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc(by), *then)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


def best_bounds(blocks: DataFrame, asked: Queries, kind: str) -> DataFrame:
    """query, id, h, bound: the documents of the largest bounds, ``TOP`` per query and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(asked.numbers)
        bound, hashes, ids = np.zeros((n, TOP), np.int64), np.zeros((n, TOP), np.int64), np.full((n, TOP), None, object)
        id_type = pa.null()
        for batch in batches:
            id_type = batch.column(0).type.value_type
            for row in batch.to_pylist():
                found = asked.bounds(row["bits"], row["slices"], np.array(row["sizes"], np.int64))
                least = bound.min(axis=1)
                names = np.empty(len(row["ids"]), object)
                names[:] = row["ids"]
                for q in np.flatnonzero(found.max(axis=1) > least).tolist():
                    new = np.flatnonzero(found[q] > least[q])
                    every = np.concatenate([bound[q], found[q, new]])
                    best = np.argsort(-every, kind="stable")[:TOP]
                    bound[q] = every[best]
                    hashes[q] = np.concatenate([hashes[q], np.array(row["hashes"], np.int64)[new]])[best]
                    ids[q] = np.concatenate([ids[q], names[new]])[best]
        q, place = np.nonzero(bound)
        columns = [asked.numbers[q], pa.array(ids[q, place].tolist(), id_type), hashes[q, place], bound[q, place]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "id", "h", "bound"])

    return blocks.mapInArrow(run, f"query bigint, id {kind}, h bigint, bound bigint")


def survivors(blocks: DataFrame, asked: Queries, least: dict[int, int], kind: str) -> DataFrame:
    """query, id, h: all documents whose bound reaches the query's least score."""
    limit = np.array([max(1, least.get(n, 0)) for n in asked.numbers.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.column(0).type.value_type
            for row in batch.to_pylist():
                found = asked.bounds(row["bits"], row["slices"], np.array(row["sizes"], np.int64))
                q, place = np.nonzero(found >= limit[:, None])
                ids = pa.array(row["ids"], id_type).take(pa.array(place))
                columns = [pa.array(asked.numbers[q]), ids, pa.array(row["hashes"], pa.int64()).take(pa.array(place))]
                yield pa.RecordBatch.from_arrays(columns, ["query", "id", "h"])

    return blocks.mapInArrow(run, f"query bigint, id {kind}, h bigint")


def exact(docs: DataFrame, found: DataFrame, asked: Queries) -> DataFrame:
    """query, doc_id, score of the documents found, each row of ``docs`` on its own; scores above 0 only.

    A document's queries are gathered (at most one block of them) and meet its text once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = settle(found.groupBy("id", "h").agg(F.collect_set("query").alias("queries")), "survivors")
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("own"))
    same = rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["own"] == wanted["h"])
    rows = rows.join(wanted, same).select("doc_id", "text", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, scores, place = [], [], []
            texts, queries = batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()
            for i, (text, mine) in enumerate(zip(texts, queries)):
                words = split(text.as_py())
                tally = Counter(words)
                for number in mine:
                    if score := asked.score(number, tally, len(words)):
                        numbers.append(number), scores.append(score), place.append(i)
            columns = [pa.array(numbers, pa.int64()), batch.column(0).take(pa.array(place, pa.int64())), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    return rows.mapInArrow(run, f"query bigint, doc_id {kind}, score bigint")


def queries_of(items: DataFrame) -> DataFrame:
    """Stored queries with terms: query (a number), item_id, terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [[t.decode() for t in split(text.as_py())] for text in batch.column(2).cast(pa.binary())]
            columns = [*batch.columns[:2], pa.array(terms, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["query", "item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    rows = rows.select(F.monotonically_increasing_id().alias("query"), "item_id", "text")
    return settle(rows.mapInArrow(run, f"query bigint, item_id {kind}, terms array<string>").filter("size(terms) > 0"), "queries")


def search(docs: DataFrame, items: DataFrame, index: DataFrame | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``TOP`` best documents of every item, equal scores by id.

    ``index`` is what ``build_index(docs)`` gave; by default it is built here.
    """
    index = build_index(docs) if index is None else index
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = index.filter("term is null").select("ids", "hashes", "sizes", "bits", "slices")
    sizes = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b)
    documents, words = blocks.agg(F.sum(F.size("sizes")), F.sum(sizes)).first()
    queries = queries_of(items)
    parts = max(1, -(-(queries.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_words))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)))
    ranked = None
    for part in range(parts if documents else 0):
        mine = queries.filter(F.col("part") == part)
        known = {r.query: r.terms for r in mine.select("query", "terms").collect()}  # about block_words words
        terms = index.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
        terms = terms.join(mine.select(F.explode("terms").alias("term")).distinct(), "term")
        weight = F.floor(1000 * F.ln(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1)))
        asked = Queries({r.term: r.w for r in terms.select("term", weight.alias("w")).collect()}, known, documents, words)
        if not len(asked.query):
            continue
        first = exact(docs, _top(best_bounds(blocks, asked, kind), "bound", "id").select("query", "id", "h"), asked)
        least = _top(first, "score").groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        least = {r.query: r.least for r in least.collect() if r.n == TOP}
        found = _top(exact(docs, survivors(blocks, asked, least, kind), asked), "score", "doc_id")
        ranked = found if ranked is None else ranked.unionByName(found)
    if ranked is None:
        empty = docs.select(F.lit(0).cast("bigint").alias("query"), "doc_id", F.lit(0).cast("bigint").alias("score"))
        ranked = empty.withColumn("rank", F.lit(0)).filter("false")
    return ranked.join(queries, "query").select("item_id", "rank", "doc_id", "score")
