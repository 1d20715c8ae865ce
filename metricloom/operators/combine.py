"""User-defined mergeable aggregates: create, add, merge, extract.

A combiner's accumulators are filled in Arrow batches before the exchange, so a task sends one accumulator per key however many
rows the key has (and never holds more than ``held`` of them); after it they are merged in the order of keys, one at a time.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from metricloom.operators.windows import extract
from metricloom.schemas import WINDOW

#: Accumulators that a task holds before it sends them on.
HELD = 50_000


class Combiner(ABC):
    """An aggregate of the user's own. ``merge`` must be associative and commutative; ``output`` is the DDL of what ``extract`` gives."""

    output: str

    @abstractmethod
    def create(self) -> Any:
        """An empty accumulator; any object that can be pickled."""

    @abstractmethod
    def add(self, accumulator: Any, rows: pa.RecordBatch) -> Any:
        """The accumulator with the rows of one key out of one batch."""

    @abstractmethod
    def merge(self, one: Any, other: Any) -> Any:
        """Both accumulators as one."""

    @abstractmethod
    def extract(self, accumulator: Any) -> tuple:
        """The result, one value per field of ``output``."""


def _groups(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of a batch by key (the first ``keys`` columns; nulls are a key)."""
    codes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns[:keys]:
        encoded = column.dictionary_encode(null_encoding="encode")
        codes = codes * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    ordered = batch.take(pa.array(order))
    cuts = np.flatnonzero(np.diff(codes[order], prepend=-1, append=codes.max(initial=0) + 1))
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield tuple(c[begin].as_py() for c in ordered.columns[:keys]), ordered.slice(begin, end - begin)


def combine(rows: DataFrame, keys: list[str], columns: list[str], combiner: Combiner, held: int = HELD) -> DataFrame:
    """One row per key: the keys and what the combiner extracts. ``columns`` are what its ``add`` gets to see.

    Without keys there is one row, if there are any rows.
    """
    kinds = dict(rows.dtypes)
    key_ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    n = len(keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_now: dict[tuple, Any] = {}
        types: list[pa.DataType] = []

        def sent() -> pa.RecordBatch:
            parts = [pa.array([key[i] for key in held_now], types[i]) for i in range(n)]
            states = pa.array([pickle.dumps(a) for a in held_now.values()], pa.binary())
            held_now.clear()
            return pa.RecordBatch.from_arrays([*parts, states], [*keys, "_state"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [c.type for c in batch.columns[:n]]
            for key, mine in _groups(batch, n):
                accumulator = held_now[key] if key in held_now else combiner.create()
                held_now[key] = combiner.add(accumulator, mine.select(columns))
            if len(held_now) >= held:
                yield sent()
        if held_now:
            yield sent()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[tuple, Any] | None = None

        def done(rows_: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows_], f.type) for i, f in enumerate(schema)], schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([*[batch.schema.field(i) for i in range(n)], *result_type])
            finished = []
            key_columns = [c.to_pylist() for c in batch.columns[:n]]
            for i, state in enumerate(batch.column(n).to_pylist()):
                key, accumulator = tuple(c[i] for c in key_columns), pickle.loads(state)
                if now is not None and now[0] == key:
                    now = key, combiner.merge(now[1], accumulator)
                else:
                    if now is not None:
                        finished.append((*now[0], *combiner.extract(now[1])))
                    now = key, accumulator
            if finished:
                yield done(finished, schema)
        if now is not None:
            yield done([(*now[0], *combiner.extract(now[1]))], schema)

    result_type = list(to_arrow_schema(StructType.fromDDL(combiner.output)))
    states = rows.select(*keys, *[c for c in columns if c not in keys]).mapInArrow(partial, ", ".join(filter(None, [key_ddl, "_state binary"])))
    if keys:
        states = states.repartition(*keys).sortWithinPartitions(*keys)
    else:
        states = states.coalesce(1)
    return states.mapInArrow(merged, ", ".join(filter(None, [key_ddl, combiner.output])))


def combine_windows(
    anomalies: DataFrame, combiner: Combiner, columns: list[str], window: str = WINDOW, time_col: str = "collected_at"
) -> DataFrame:
    """The combiner per fleet and tumbling window, as ``fleet_windows`` has its count and mean.

    Anomalies without a fleet are dropped; ``columns`` are columns of the anomalies, or ``cpu``.
    """
    kept = [c for c in columns if c in anomalies.columns and c not in ("fleet_id", "agent_id", "cpu")]
    start = F.window("event_time", window)["start"].alias("window_start")
    rows = extract(anomalies, time_col, kept).select("fleet_id", start, "agent_id", "cpu", *kept)
    return combine(rows, ["fleet_id", "window_start"], columns, combiner)


class TopLabel(Combiner):
    """The value of a label under which the most CPU was used, its share, and how many values there were.

    CPU is added up in millionths of a percent, so the answer does not depend on the order; ties go to the smallest value.
    """

    output = "top_label string, cpu_share double, labels bigint"

    def __init__(self, label: str):
        self.label = label

    def create(self) -> dict:
        return {}

    def add(self, accumulator: dict, rows: pa.RecordBatch) -> dict:
        labels = rows.column(rows.schema.get_field_index(self.label)).to_pylist()
        used = np.rint(np.nan_to_num(rows.column(rows.schema.get_field_index("cpu")).to_numpy(zero_copy_only=False)) * 1e6)
        for label, cpu in zip(labels, used.astype(np.int64).tolist()):
            accumulator[label] = accumulator.get(label, 0) + cpu
        return accumulator

    def merge(self, one: dict, other: dict) -> dict:
        for label, cpu in other.items():
            one[label] = one.get(label, 0) + cpu
        return one

    def extract(self, accumulator: dict) -> tuple:
        top = min(accumulator, key=lambda label: (-accumulator[label], label is not None, label or ""))
        total = sum(accumulator.values())
        return top, accumulator[top] / total if total else None, len(accumulator)
