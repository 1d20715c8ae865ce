"""N-gram Jaccard join: sets of word shingles, linked when 100 * intersection >= ``percent`` * union, by PartEnum signatures.

Sizes are cut into bands so that a set's possible partners are in its own band or the next. Within two neighbouring bands
linked sets differ in at most ``k`` shingles. The domain of shingles is dealt into first-level parts, of which one must hold at most
one difference, and each of them into three; so one of the three pairs of these thirds is equal. A set's signatures are
its shingles in every such pair (hashed); sets that link share at least one.

Some parts more than needed are made, so that linked sets agree in several; in return a set gives no signature without shingles,
unless more of its parts are that thin. (If either set of a link is not thin, one of the parts they agree in has shingles
in all its pairs; if both are, they give all signatures.) Equal texts are one node, named by a 64-bit hash; texts whose hashes happen to
be equal are found and named by another one. A task signs a text once.

Buckets of equal signatures give candidates. A bucket's nodes are first held against its first node, and what is linked is
brought together; afterwards only nodes of different components meet, and every such pair of a bucket is looked at, in one of the
buckets that hold the same nodes. A sketch (parities of classes of shingles, which cannot differ in more places than the sets) discards
most pairs where they meet, before they become rows; the others are verified on whole texts. So no link between components is lost, and a large group of copies never makes all its pairs.

Words are what stands between ASCII blanks, lower-cased in A-Z. Sets are held as 64-bit hashes of shingles.

Inputs: null and texts without words have an empty set, link with nothing and are their own component. Repeated rows and ids
keep a row each; a null id is never the smallest, and a component of null ids only has a null id. Very long texts make more
signatures. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from metricloom.llm.components import stars
from metricloom.llm.tables import settle

WORDS, PERCENT = 5, 80
#: Hashes of words, or of texts, that a task remembers.
HELD = 200_000
#: Rows of a bucket, or partners of a node, that meet in one task.
CHUNK = 2048
#: Bytes of a sketch that go with a node into its buckets; of longer ones only the 512 parities do.
CARRIED = 2116
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(33))


class Shingles:
    """Sets of shingle hashes; remembers the hashes of words."""

    def __init__(self, words: int):
        self.words, self.known = words, {}
        self.factors = [np.uint64(xxhash.xxh64_intdigest(f"factor {i}") | 1) for i in range(words)]

    def of(self, text: bytes | None) -> np.ndarray:
        """Sorted hashes of the distinct shingles."""
        tokens = (text or b"").lower().split()  # bytes: only A-Z change, and only ASCII blanks separate
        if not tokens:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > HELD:
            known.clear()
        for token in set(tokens):
            if token not in known:
                known[token] = xxhash.xxh64_intdigest(token)
        hashes = np.array([known[token] for token in tokens], np.uint64)
        n = max(1, len(hashes) - self.words + 1)
        total = np.full(n, min(len(hashes), self.words), np.uint64)
        for i, factor in enumerate(self.factors[: len(hashes)]):
            total += hashes[i : i + n] * factor
        return np.unique(mixed(total))


def band_ends(largest: int, percent: int) -> list[int]:
    """Largest size of each band: what links with a size of one band is in it or in the next."""
    ends = [1]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, ends[-1] * 100 // percent))
    return ends


def most_different(size: int, percent: int) -> int:
    """In how many shingles two linked sets can differ whose smaller has at most ``size``."""
    return (100 - percent) * (size + size * 100 // percent) // (100 + percent)


def band_signatures(shingles: np.ndarray, band: int, differences: int) -> np.ndarray:
    """Signatures of a set for one pair of neighbouring bands."""
    salt = np.uint64((band * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    if not differences:
        return mixed(shingles.sum(keepdims=True) + salt)
    parts = differences // 2 + 1
    spare = 0 if parts < 6 else parts // 16 + 1
    cells = 3 * (parts + spare)
    cell = (((shingles >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)  # rises with the hash
    counts = np.bincount(cell, minlength=cells)
    ends = np.cumsum(counts)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shingles)))
    third = (sums[ends] - sums[ends - counts]).reshape(-1, 3)
    number = counts.reshape(-1, 3)
    pairs, held = third.sum(axis=1, keepdims=True) - third, number.sum(axis=1, keepdims=True) - number
    tags = np.arange(cells, dtype=np.uint64).reshape(-1, 3) * MIX[1] + salt
    found = mixed(mixed(pairs + tags) + salt)
    thin = (held == 0).any(axis=1).sum()
    return found.reshape(-1) if thin > spare else found[held > 0]


def signatures(shingles: np.ndarray, ends: list[int], percent: int) -> np.ndarray:
    """All signatures of a set: for its band with the next, and for the band before with its own."""
    band = int(np.searchsorted(ends, len(shingles)))
    roles = [(b, most_different(ends[b], percent)) for b in (band, band - 1) if b >= 0]
    return np.concatenate([band_signatures(shingles, b, k) for b, k in roles])


def sketch(shingles: np.ndarray) -> bytes:
    """Size of a set, the parities of 512 classes of its shingles, and for larger sets those of twice as many classes as shingles."""
    classes = 512
    while classes < 2 * len(shingles):
        classes *= 2
    odd = np.packbits((np.bincount((shingles & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1).astype(np.uint8))
    fine = odd.tobytes() if classes > 512 else b""
    return len(shingles).to_bytes(4, "big") + np.bitwise_xor.reduce(odd.reshape(-1, 64), axis=0).tobytes() + fine


def unpacked(stats: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and the 512 parities (eight longs) of sketches."""
    raw = np.frombuffer(b"".join([s[:68] for s in stats.to_pylist()]), np.uint8).reshape(-1, 68)
    return np.ascontiguousarray(raw[:, :4]).view(">i4")[:, 0].astype(np.int64), np.ascontiguousarray(raw[:, 4:]).view(np.uint64)


def apart_at_least(a: bytes, b: bytes) -> int:
    """In how many shingles two sets differ at least, by their finer parities."""
    one, two = (np.frombuffer(s, np.uint64, offset=68) if len(s) > 68 else np.frombuffer(s, np.uint64, offset=4) for s in (a, b))
    if len(one) > len(two):
        one, two = two, one
    while len(two) > len(one):  # half as many classes: classes i and i + half become one
        two = two[: len(two) // 2] ^ two[len(two) // 2 :]
    return int(np.bitwise_count(one ^ two).sum())


def possible(sizes: tuple[np.ndarray, np.ndarray], parities: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Which pairs can link by their sizes and 512 parities."""
    a, b = sizes
    fits = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    apart = np.bitwise_count(parities[0] ^ parities[1]).sum(axis=1, dtype=np.int64)
    return fits & ((100 + percent) * apart <= (100 - percent) * (a + b))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    place = np.searchsorted(large, small)
    same = int((large[np.minimum(place, len(large) - 1)] == small).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def signed(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """A row (sig, node) per signature of each text, and one row per node, under a hash of it, with its sketch in ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, ends, done = Shingles(words), band_ends(1, percent), set()

        def rows(sigs: list[np.ndarray], nodes: list[int], stats: list[bytes]) -> Iterator[pa.RecordBatch]:
            sizes = [len(s) for s in sigs]
            own = mixed(np.array(nodes, np.int64).view(np.uint64))
            many = np.repeat(np.array(nodes, np.int64), sizes)
            found = np.concatenate([*sigs, own]).view(np.int64)
            column = pa.concat_arrays([pa.nulls(len(many), pa.binary()), pa.array(stats, pa.binary())])
            columns = [pa.array(found), pa.array(np.concatenate([many, np.array(nodes, np.int64)])), column]
            yield pa.RecordBatch.from_arrays(columns, ["sig", "node", "stats"])

        for batch in batches:
            held: tuple[list, list, list] = ([], [], [])
            waiting = 0
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if node in done:
                    continue
                if len(done) > HELD:
                    done.clear()
                done.add(node)
                mine = shingles.of(text.as_py())
                if len(mine) > ends[-1]:
                    ends = band_ends(2 * len(mine), percent)
                held[0].append(signatures(mine, ends, percent) if len(mine) else mine)
                held[1].append(node)
                held[2].append(sketch(mine))
                waiting += len(held[0][-1])
                if waiting > 500_000:
                    yield from rows(*held)
                    held, waiting = ([], [], []), 0
            if held[1]:
                yield from rows(*held)

    return texts.select("node", "text").mapInArrow(run, "sig bigint, node bigint, stats binary")


def buckets(rows: DataFrame) -> DataFrame:
    """Rows of the sketches, and of signatures that several nodes have: with ``first``, the smallest node of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int, bool] | None = None  # signature, node, first node, whether the row is still to be written

        for batch in batches:
            own = batch.filter(batch.column(2).is_valid())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([*own.columns, pa.nulls(own.num_rows, pa.int64())], ["sig", "node", "stats", "first"])
            rest = batch.filter(batch.column(2).is_null())
            sig, node = rest.column(0).to_numpy(), rest.column(1).to_numpy()
            if last is not None:
                sig, node = np.append(last[0], sig), np.append(last[1], node)
            if not len(sig):
                continue
            fresh = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
            open_ = last is None or last[3]
            sig, node = sig[fresh], node[fresh]
            begins = np.append(True, sig[1:] != sig[:-1])
            first = node[np.maximum.accumulate(np.where(begins, np.arange(len(sig)), 0))]
            if last is not None:
                first = np.where(np.cumsum(begins) == 1, last[2], first)
            several = ~begins
            several[:-1] |= ~begins[1:]
            if not open_:
                several[0] = False  # written with the batch before
            last = (sig[-1], node[-1], first[-1], bool(begins[-1]) and (len(sig) > 1 or open_))
            keep = np.flatnonzero(several)
            columns = [pa.array(sig[keep]), pa.array(node[keep]), pa.nulls(len(keep), pa.binary()), pa.array(first[keep])]
            yield pa.RecordBatch.from_arrays(columns, ["sig", "node", "stats", "first"])

    ordered = rows.repartition("sig").sortWithinPartitions("sig", "node")
    return ordered.mapInArrow(run, "sig bigint, node bigint, stats binary, first bigint")


def likely(pairs: DataFrame, stats: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches do not rule out."""
    one, two = (stats.select(F.col("node").alias(n), F.col("stats").alias(f"stats_{n}")) for n in "ab")
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "stats_a", "stats_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes, parities = zip(unpacked(batch.column(2)), unpacked(batch.column(3)))
                fits = possible(sizes, parities, percent)
                for i in np.flatnonzero(fits).tolist():
                    apart = apart_at_least(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                    fits[i] = (100 + percent) * apart <= (100 - percent) * (sizes[0][i] + sizes[1][i])
                kept = batch.filter(pa.array(fits))
                yield pa.RecordBatch.from_arrays(kept.columns[:2], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def crossing(rows: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a < b) of one bucket (sig, part) whose nodes have different roots; rows come with their sketches, sorted."""

    def distinct(node: np.ndarray, sketches: list[bytes], sizes: np.ndarray, ones: list[np.ndarray], twos: list[np.ndarray]) -> pa.RecordBatch:
        """Pairs without repetition, as those that are alike meet in many buckets, that the finer parities do not rule out."""
        one, two = np.concatenate(ones), np.concatenate(twos)
        a, b = np.minimum(node[one], node[two]), np.maximum(node[one], node[two])
        order = np.lexsort((b, a))
        a, b, one, two = a[order], b[order], one[order], two[order]
        at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        most = ((100 - percent) * (sizes[one[at]] + sizes[two[at]])).tolist()
        apart = [(100 + percent) * apart_at_least(sketches[i], sketches[j]) for i, j in zip(one[at].tolist(), two[at].tolist())]
        kept = at[[x <= y for x, y in zip(apart, most)]]
        return pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], ["a", "b"])

    def pairs(group: np.ndarray, node: np.ndarray, root: np.ndarray, stats: pa.Array) -> Iterator[pa.RecordBatch]:
        sizes, parities = unpacked(stats)
        sketches = stats.to_pylist()
        ends = np.searchsorted(group, group, "right")
        at, step, ones, twos, waiting = np.arange(len(group)), 1, [], [], 0
        while len(at := at[at + step < ends[at]]):
            other = at + step
            apart = root[at] != root[other]
            one, two = at[apart], other[apart]
            fits = possible((sizes[one], sizes[two]), (parities[one], parities[two]), percent)
            ones.append(one[fits])
            twos.append(two[fits])
            waiting, step = waiting + len(ones[-1]), step + 1
            if waiting > 1_000_000:
                yield distinct(node, sketches, sizes, ones, twos)
                ones, twos, waiting = [], [], 0
        if waiting:
            yield distinct(node, sketches, sizes, ones, twos)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            columns = [table.column(i).to_numpy() for i in range(4)]
            group = np.cumsum(np.append(False, (np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)))
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last bucket may go on
            rest = table.slice(cut)
            if cut:
                yield from pairs(group[:cut], columns[2][:cut], columns[3][:cut], table.column(4).slice(0, cut))
        if rest is not None and rest.num_rows:
            zero = np.zeros(rest.num_rows, np.int64)
            yield from pairs(zero, rest.column(2).to_numpy(), rest.column(3).to_numpy(), rest.column(4))

    return rows.select("sig", "part", "node", "root", "stats").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, least: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a > b, as ``stars`` takes them) among pairs (a < b), on whole texts.

    The text of a node is that of one document (``least``: node and smallest id). A node's partners come to its text; many
    partners are dealt to several tasks, each of which gets the text.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(least, "node")
    asked = settle(asked.select(F.col("node").alias("own"), "least"), "set-asked")
    texts = docs.join(asked, (docs["node"] == asked["own"]) & docs["doc_id"].eqNullSafe(asked["least"]))
    texts = settle(texts.select("node", "text").dropDuplicates(["node"]), "set-texts")
    loads = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    dealt = pairs.join(loads, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    owners = loads.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    owners = owners.join(texts, owners["a"] == texts["node"]).select("a", "part", F.lit(None).cast("bigint").alias("b"), "text")
    partners = dealt.join(texts, dealt["b"] == texts["node"]).select("a", "part", "b", "text")
    rows = owners.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, mine = Shingles(words), np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for owner, partner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                theirs = shingles.of(text.as_py())
                if partner is None:
                    mine = theirs
                elif linked(mine, theirs, percent):
                    a.append(partner), b.append(owner)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("a", "b", "text").mapInArrow(run, "a bigint, b bigint")


def open_buckets(shared: DataFrame, roots: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows of buckets whose nodes are not all in one component, cut in parts so that every two chunks of a bucket meet.

    Of buckets that hold the same nodes, as those of two similar sets mostly do, one is taken.
    """
    rows = shared.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
    mixed_up = rows.groupBy("sig").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("held"), F.bit_xor(F.xxhash64(F.lit("held"), "node")).alias("held_too"))
    mixed_up = mixed_up.filter("least < most").groupBy("n", "held", "held_too").agg(F.min("sig").alias("sig")).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    carried = F.when(F.octet_length("stats") <= CARRIED, F.col("stats")).otherwise(F.substring("stats", 1, 68)).alias("stats")
    rows = rows.join(mixed_up.select("sig", "chunks"), "sig").join(stats.select("node", carried), "node")
    chunk = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: i != F.col("chunk"))
    met = F.transform(others, lambda i: F.least(i, F.col("chunk")).cast("long") * F.col("chunks") + F.greatest(i, F.col("chunk")))
    part = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(met))
    rows = rows.withColumn("chunk", chunk).select("sig", part.alias("part"), "node", "root", "stats")
    return rows.repartition("sig", "part").sortWithinPartitions("sig", "part", "node")


def near_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (size of the set) and component_id, the smallest id that links reach."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"))
    first, second = F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")
    twice = keyed.groupBy(first.alias("h")).agg(F.min(second).alias("least"), F.max(second).alias("most")).filter("least < most")
    twice = [r.h for r in twice.select("h").toLocalIterator()]  # different texts of one hash: none, but for chance
    keyed = keyed.withColumn("node", F.when(first.isin(twice), second).otherwise(first) if twice else first)
    rows = settle(keyed.select("doc_id", "node"), "set-rows")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"))

    found = settle(buckets(signed(keyed, words, percent)), "set-buckets")
    stats = found.filter("stats is not null").groupBy("node").agg(F.first("stats").alias("stats"))
    stats = settle(stats, "set-sketches")
    shared = found.filter("first is not null").select("sig", "node", "first")
    pairs = shared.filter("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    pairs = settle(likely(pairs, stats, percent), "set-pairs")
    links = settle(verified(pairs, keyed, nodes, words, percent).distinct(), "set-links")
    crossed = settle(crossing(open_buckets(shared, stars(links), stats), percent).distinct(), "set-crossed")
    crossed = settle(likely(crossed.join(pairs, ["a", "b"], "left_anti"), stats, percent), "set-crossing")
    links = links.unionByName(verified(crossed, keyed, nodes, words, percent).distinct())

    roots = stars(links).select("node", "root")
    size = F.conv(F.hex(F.substring("stats", 1, 4)), 16, 10).cast("bigint")
    known = nodes.join(stats.select("node", size.alias("n_shingles")), "node").join(roots, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    component = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(component, "root").select(F.col("node").alias("own"), "n_shingles", "component")
    whole = rows.join(known, rows["node"] == known["own"])
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"))
