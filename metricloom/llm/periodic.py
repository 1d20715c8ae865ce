"""Periodic runs of words: maximal stretches that repeat with a period, found over suffix trees.

Words are what stands between ASCII blanks. A run is a stretch of words with smallest period ``q`` and a length of at least
``max(6, 4 q)`` that can't be made longer on either side. Every run holds a Lyndon root: for one of the two
alphabetical orders, the longest Lyndon word that begins somewhere in the run is as long as the period. So the candidates
are two per word. Each is extended to the right by the longest common extension of its two ends, read off the suffix tree of the
document, and to the left by that of the reversed document. Trees are built by Ukkonen's algorithm; a common extension is the
string depth of the lowest common ancestor, a range minimum over the Euler tour, which blocks and a sparse table answer in
constant time, for all candidates at once.

Inside a run every three consecutive words occur three times or more. What lies outside stretches of such words is cut away before
the trees are built, a sign of its own in its place; most prose has nothing left.

Inputs: a null text has no words, no runs and stays null; an empty one stays empty. Repeated rows get equal results. Null and
repeated ids are kept as they are. All other columns are passed over, whatever their names. Whole texts are read: a task
holds the trees of one document at a time, about 600 bytes for each word left after the cut. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST, TIMES = 6, 4
#: Entries of the Euler tour that share one entry of the sparse table.
BLOCK = 32


class SuffixTree:
    """Suffix tree of a sequence of numbers above 0; its end is a 0, which sorts before everything.

    Node 0 is the root. ``first`` and ``last`` bound the label of the edge into a node.
    """

    def __init__(self, symbols: list[int]):
        self.text = text = [*symbols, 0]
        self.width = width = max(text) + 1
        self.first, self.last, self.child = [0], [0], {}
        first, last, child, link, end = self.first, self.last, self.child, [0], len(text)
        node, edge, done, waiting = 0, 0, 0, 0  # where the next suffix goes on, and how many suffixes wait
        for place, symbol in enumerate(text):
            waiting, fresh = waiting + 1, 0
            while waiting:
                if not done:
                    edge = place
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(first)
                    first.append(place), last.append(end), link.append(0)
                    if fresh:
                        link[fresh], fresh = node, 0
                else:
                    span = min(last[below], place + 1) - first[below]
                    if done >= span:
                        edge, done, node = edge + span, done - span, below
                        continue
                    middle = first[below] + done
                    if text[middle] == symbol:
                        if fresh and node:
                            link[fresh] = node
                        done += 1
                        break
                    split = len(first)
                    first += [first[below], place]
                    last += [middle, end]
                    link += [0, 0]
                    child[key] = split
                    child[split * width + symbol] = split + 1
                    child[split * width + text[middle]] = below
                    first[below] = middle
                    if fresh:
                        link[fresh] = split
                    fresh = split
                waiting -= 1
                if node:
                    node = link[node]
                elif done:
                    done, edge = done - 1, place - waiting + 1

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
        """Euler tour as string depths, the place of each suffix in it, the suffixes in order; and for each suffix that others
        begin with, how many suffixes come up to the last of these."""
        keys = np.sort(np.fromiter(self.child, np.int64, len(self.child)))
        parents, nodes = (keys // self.width).tolist(), [self.child[key] for key in keys.tolist()]
        eldest, sibling, parent = [0] * len(self.first), [0] * len(self.first), [0] * len(self.first)
        for node, above in zip(reversed(nodes), reversed(parents)):
            sibling[node], eldest[above], parent[node] = eldest[above], node, above
        spans = (np.array(self.last) - np.array(self.first)).tolist()
        n, depths, at, order, until = len(self.text), [0], [0] * len(self.text), [], {}
        begun = [-1] * len(self.first)  # the suffix that ends at a node
        deep, node = [0] * len(self.first), 0
        while True:
            if below := eldest[node]:
                deep[below] = depth = deep[node] + spans[below]
                node = below
                depths.append(depth)
                continue
            suffix = n - deep[node]
            at[suffix] = len(depths) - 1
            order.append(suffix)
            if spans[node] == 1 and self.first[node] == n - 1:
                begun[parent[node]] = suffix
            while node and not sibling[node]:
                node = parent[node]
                depths.append(deep[node])
                if begun[node] >= 0:
                    until[begun[node]] = len(order)
            if not node:
                break
            above = parent[node]
            depths.append(deep[above])
            node = sibling[node]
            deep[node] = depth = deep[above] + spans[node]
            depths.append(depth)
        return np.array(depths, np.int64), np.array(at, np.int64), np.array(order, np.int64), until


class Extensions:
    """Longest common extensions of suffixes: minima over the Euler tour of their tree."""

    def __init__(self, depths: np.ndarray, at: np.ndarray):
        blocks = -(-len(depths) // BLOCK)
        self.at, self.grid = at, np.full((blocks, BLOCK), np.iinfo(np.int64).max)
        self.grid.flat[: len(depths)] = depths
        self.heads = np.minimum.accumulate(self.grid, axis=1)
        self.tails = np.minimum.accumulate(self.grid[:, ::-1], axis=1)[:, ::-1]
        self.table = [self.heads[:, -1]]
        while (step := 1 << (len(self.table) - 1)) * 2 <= blocks:
            upper = self.table[-1]
            self.table.append(np.minimum(upper[:-step], upper[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes at ``a`` and ``b``, which differ."""
        low, high = np.minimum(self.at[a], self.at[b]), np.maximum(self.at[a], self.at[b])
        block, other = low // BLOCK, high // BLOCK
        found = np.minimum(self.tails[block, low % BLOCK], self.heads[other, high % BLOCK])
        between = other - block - 1
        for level, row in enumerate(self.table):
            mine = np.flatnonzero((between >> level) == 1)
            left, right = block[mine] + 1, other[mine] - (1 << level)
            found[mine] = np.minimum(found[mine], np.minimum(row[left], row[right]))
        same = np.flatnonzero(block == other)
        if len(same):
            inside = np.full(len(same), np.iinfo(np.int64).max)
            start, stop, flat = low[same], high[same], self.grid.reshape(-1)
            for step in range(BLOCK):
                inside = np.minimum(inside, flat[np.minimum(start + step, stop)])
            found[same] = inside
        return found


def next_smaller(rank: list[int]) -> list[int]:
    """Per suffix the next one that sorts before it: there its longest Lyndon word ends."""
    ends, open_ = [0] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            ends[open_.pop()] = i
        open_.append(i)
    return ends


def tree_runs(symbols: list[int]) -> np.ndarray:
    """Runs (start, length, period) of a sequence of numbers above 0, by start, then period."""
    n = len(symbols)
    depths, at, order, until = SuffixTree(symbols).tour()
    forward = Extensions(depths, at)
    backward = Extensions(*SuffixTree(symbols[::-1]).tour()[:2])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.arange(n + 1)
    # the other alphabet turns the order round, but what others begin with still comes before these
    shorter = np.fromiter(until, np.int64, len(until))
    key, turned = n - rank, np.empty(n + 1, np.int64)
    key[shorter] = n + 1 - np.fromiter(until.values(), np.int64, len(until))
    whole = np.ones(n + 1, np.int64)
    whole[shorter] = 0
    turned[np.lexsort((-np.arange(n + 1), whole, key))] = np.arange(n + 1)
    starts, stops = [], []
    for ranks in (rank, turned):
        starts.append(np.arange(n))
        stops.append(np.array(next_smaller(ranks.tolist())[:n], np.int64))
    i, j = np.concatenate(starts), np.concatenate(stops)
    i, j = i[j < n], j[j < n]
    period = j - i
    # suffix n - x of the reversal is what stands before x, read backwards
    left = np.where(i > 0, backward(n - i, n - j), 0)
    length = left + period + forward(i, j)
    keep = length >= np.maximum(LEAST, TIMES * period)
    found = np.stack([i - left, length, period], axis=1)[keep]
    found = np.unique(found[:, [0, 2, 1]], axis=0)
    return found[:, [0, 2, 1]]


def repeated(ids: np.ndarray) -> np.ndarray:
    """Which words lie in stretches in which every three consecutive words occur three times or more."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    triples = (mixed[:-2] * np.uint64(3) ^ (mixed[1:-1] >> np.uint64(7))) * np.uint64(0xD6E8FEB86659FD93) + mixed[2:]
    _, which, times = np.unique(triples, return_inverse=True, return_counts=True)
    often = np.flatnonzero(times[which] >= 3)
    inside = np.zeros(len(ids), bool)
    for shift in range(3):
        inside[often + shift] = True
    return inside


def runs(words: list[bytes]) -> np.ndarray:
    """Runs (start, length, period) of a document, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    if len(words) < LEAST:
        return none
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(word, len(known) + 1) for word in words], np.int64)
    inside = repeated(ids)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    begins, stops = edges[::2], edges[1::2]
    long = stops - begins >= LEAST
    begins, stops = begins[long], stops[long]
    if not len(begins):
        return none
    symbols, places = [], []
    for sign, (begin, stop) in enumerate(zip(begins.tolist(), stops.tolist()), len(known) + 1):
        symbols += [*ids[begin:stop].tolist(), sign]
        places += [np.arange(begin, stop + 1)]
    # few numbers keep the tree's keys small
    _, small = np.unique(np.array(symbols), return_inverse=True)
    found = tree_runs((small + 1).tolist())
    found[:, 0] = np.concatenate(places)[found[:, 0]]
    return found


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words without those that any run repeats, joined by blanks."""
    if not len(found):
        return b" ".join(words)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, found[:, 0] + found[:, 2], 1)
    np.add.at(marks, found[:, 0] + found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(marks)[:-1] == 0)
    return b" ".join([words[i] for i in kept.tolist()])


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def find_runs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, ``runs`` (struct of start, length and period, by start, then period), and ``collapsed``, the text
    without what its runs repeat, words joined by one blank."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sizes, parts, texts = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()):
                text = text.as_py()
                words = (text or b"").split()
                found = runs(words)
                counts.append(len(words))
                sizes.append(sizes[-1] + len(found))
                parts.append(found)
                texts.append(None if text is None else collapsed(words, found))
            every = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
            fields = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], fields=list(run_type.value_type))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), fields),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")
