"""SimHash near-duplicates: word-shingle fingerprints, linked when few bits differ, checked through pivot distance tables.

Two fingerprints can differ in at most ``max_bits`` bits only if their distances to every reference fingerprint
(pivot) differ by at most that much (triangle inequality). The table of these distances is precomputed, pairs
with a larger coordinate difference are discarded, and the survivors are verified bit by bit. The pivots alone
would leave every pair to be looked at, so pairs are only formed between fingerprints that agree on enough bit
bands: of ``bands`` bands at most ``max_bits`` can hold a difference, so linked fingerprints agree on at least
``bands - max_bits`` of them. No link is lost by either step.

Inputs: null and empty texts have fingerprint 0 and link like any other. Repeated rows keep a row each. A null id
is never the smallest id; a component of null ids only has a null ``component_id``. Columns other than the id and the
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from metricloom.llm.components import stars
from metricloom.llm.tables import settle, unused

SEED = 42
MASK = (1 << 64) - 1
#: Shingles whose bits are counted at once; bounds the memory that a very long text needs.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64-bit SimHash of the lower-cased words of a UTF-8 text, as an unsigned number."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, and only ASCII blanks separate
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(ends) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK])]
        octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id`` and ``bits``, the fingerprint as a signed long, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            bits = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["doc_id", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, bits bigint")


def references(pivots: int) -> list[int]:
    """Reference fingerprints, made by rule so that every task and run has the same."""
    return [xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(pivots)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivot_table(bits: Column, pivots: int) -> list[Column]:
    """Distances to the references, eight packed in a long (a distance needs 7 bits)."""
    packed = []
    for first in range(0, pivots, 8):
        parts = [
            F.shiftleft(F.bit_count(bits.bitwiseXOR(F.lit(signed(r)))).cast("long"), 8 * i)
            for i, r in enumerate(references(pivots)[first : first + 8])
        ]
        total = parts[0]
        for part in parts[1:]:
            total = total.bitwiseOR(part)
        packed.append(total.alias(f"pivots{first // 8}"))
    return packed


def band_keys(bits: Column, bands: int, max_bits: int) -> Column:
    """A key per choice of ``bands - max_bits`` bands; linked fingerprints share at least one."""
    cuts = [64 * i // bands for i in range(bands + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for i, chosen in enumerate(combinations(masks, bands - max_bits)):
        keys.append(F.xxhash64(F.lit(i), bits.bitwiseAND(F.lit(signed(sum(chosen))))))
    return F.array(*keys)


def linked(bits: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of the pairs (a, b) differ in at most ``max_bits`` bits."""
    left = np.arange(len(a))
    for pivot in range(table.shape[1]):
        column = table[:, pivot]
        left = left[np.abs(column[a[left]] - column[b[left]]) <= max_bits]
    return left[np.bitwise_count(bits[a[left]] ^ bits[b[left]]) <= max_bits]


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows the same label, the smallest row number of those that reach each other."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        high = np.maximum(labels[a], labels[b])
        apart = low < high
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(labels, high[apart], low[apart])
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def link_buckets(bucket: np.ndarray, bits: np.ndarray, table: np.ndarray, max_bits: int) -> np.ndarray:
    """For each row the first row of its bucket that it is linked with, directly or over others.

    Rows come sorted by bucket. Pairs are made a bounded number at a time.
    """
    labels = np.arange(len(bits))
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(starts[1:], len(bits))
    sizes = ends - starts
    small = sizes <= 64
    last = np.repeat(np.where(small, ends, 0), sizes)  # rows of large buckets have no partner here
    rows, step = np.flatnonzero(last > 0), 1
    while len(rows := rows[rows + step < last[rows]]):
        found = linked(bits, table, rows, rows + step, max_bits)
        join_labels(labels, rows[found], rows[found] + step)
        step += 1
    for start, end in zip(starts[~small], ends[~small]):
        order = start + np.argsort(table[start:end, 0], kind="stable")
        first = table[order, 0]
        for i in range(0, len(order), 256):
            mine = order[i : i + 256]
            # sorted by the first coordinate: partners end where it has grown by more than the limit
            until = np.searchsorted(first, first[min(i + 256, len(order)) - 1] + max_bits, "right")
            a, b = np.repeat(mine, until - i), np.tile(order[i:until], len(mine))
            found = linked(bits, table, a, b, max_bits)
            a, b = a[found], b[found]
            join_labels(labels, np.minimum(a, b), np.maximum(a, b))
    return labels


def bucket_links(rows: DataFrame, pivots: int, max_bits: int) -> DataFrame:
    """Links (``a`` > ``b``) that connect what is linked in each bucket; at most one per row.

    ``rows`` has bucket, part, bits and the packed pivot columns, all rows of a bucket in one partition, sorted.
    """
    packed = (pivots + 7) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def found(columns: list[np.ndarray]) -> pa.RecordBatch:
            ids, bits = columns[0], columns[2].view(np.uint64)
            fresh = np.append(True, (ids[1:] != ids[:-1]) | (columns[1][1:] != columns[1][:-1]))
            table = np.stack(columns[3:], axis=1).view(np.uint8)[:, :pivots].astype(np.int16)
            labels = link_buckets(np.cumsum(fresh), bits, table, max_bits)
            apart = np.flatnonzero(columns[2] != columns[2][labels])
            one, two = columns[2][apart], columns[2][labels[apart]]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two))], ["a", "b"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns)]
            same = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            cut = len(same) - int(same.sum())  # the last bucket may go on in the next batch
            if cut:
                yield found([np.ascontiguousarray(c[:cut]) for c in columns])
            rest = [np.ascontiguousarray(c[cut:]) for c in columns]
        if rest is not None and len(rest[0]):
            yield found(rest)

    names = [f"pivots{i}" for i in range(packed)]
    return rows.select("bucket", "part", "bits", *names).mapInArrow(run, "a bigint, b bigint")


def links(
    prints: DataFrame, max_bits: int = 4, bands: int = 7, pivots: int = 16, bucket_rows: int = 2048
) -> DataFrame:
    """Links between different fingerprints (column ``bits``, distinct), enough to connect all that are linked.

    A bucket is one band key. A bucket of more than ``bucket_rows`` rows is dealt into chunks, and every two chunks
    meet in a task of their own, so no task holds more than two chunks and every pair still meets.

    Sizes of buckets are joined by a merge: Spark does not count the rows that ``explode`` adds, would send them to the driver and
    broadcast them, and does not go back on that when it sees how many they are, since a merge has one exchange more.
    """
    if not max_bits < bands <= 64:
        raise ValueError("bands must be more than max_bits and at most 64")
    keyed = prints.select("bits", F.explode(band_keys(F.col("bits"), bands, max_bits)).alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    rows = keyed.join(sizes.hint("merge"), "bucket").withColumn("chunks", F.ceil(F.col("n") / bucket_rows).cast("int"))
    chunk = F.pmod(F.xxhash64("bits", F.lit("chunk")), F.col("chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: i != F.col("chunk"))
    met = F.transform(others, lambda i: F.least(i, F.col("chunk")).cast("long") * F.col("chunks") + F.greatest(i, F.col("chunk")))
    part = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(met))
    rows = rows.withColumn("chunk", chunk).select("bucket", part.alias("part"), "bits")
    rows = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "bits")
    rows = rows.select("bucket", "part", "bits", *pivot_table(F.col("bits"), pivots))
    return bucket_links(rows, pivots, max_bits).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, bands: int = 7, pivots: int = 16) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the smallest id that links reach.

    Tables of a row per document or link are joined by merges: files of numbers are many times smaller than a broadcast of them.
    """
    rows = settle(fingerprints(docs, shingle), "simhash")
    groups = settle(rows.groupBy("bits").agg(F.min("doc_id").alias("first")), "simhash-groups")
    roots = stars(links(groups, max_bits, bands, pivots)).select(F.col("node").alias("bits"), "root")
    known = groups.join(roots.hint("merge"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    named = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(named, "root").select("bits", "component_id")
    text = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return rows.join(known.hint("merge"), "bits").select("doc_id", text.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, keep_unnamed: bool = True) -> DataFrame:
    """One row of each component: the one with the smallest id; of repeated ids within it, one of the smallest text hash.

    Rows that share an id but not the text are told apart by the text's hash. Rows without an id are kept, since nothing
    names them; with ``keep_unnamed`` false they are told apart by the hash as well, and go unless their component has no row
    with an id (then one stays). All columns pass, whatever their names.
    """
    mark = unused(docs)
    h, own, own_h = f"{mark}h", f"{mark}own", f"{mark}own_h"
    keyed = docs.withColumn(h, F.xxhash64(F.col("text").cast("string")))
    named = F.col("doc_id").isNotNull()
    name = F.struct((~named).alias("unnamed"), "doc_id", F.col(h).alias("h"))
    name = F.when(named, name) if keep_unnamed else name
    found = near_duplicates(keyed.select(name.alias("doc_id"), "text"), shingle, max_bits)
    keep = found.filter(F.col("doc_id") == F.col("component_id"))
    keep = keep.select(F.col("doc_id.doc_id").alias(own), F.col("doc_id.h").alias(own_h)).distinct()
    same = keyed["doc_id"].eqNullSafe(keep[own]) & (keyed[h] == keep[own_h])
    kept = keyed.join(keep, same, "left_semi").dropDuplicates(["doc_id", h]).drop(h)
    return kept.unionByName(docs.filter(~named)) if keep_unnamed else kept
