"""Python operators that add columns to a frame, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._text import slices


def add_columns(df: DataFrame, text: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], list]], drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds the columns of ``schema``; ``make()`` runs once a task and gives a function from a slice to their arrays.

    Input columns of the same names give way to the new ones; those in ``drop`` are left out. No shuffle.
    """
    new = T.StructType.fromDDL(schema)
    gone = {x.lower() for x in (*new.names, *drop)}
    keep = [f.name for f in df.schema if f.name.lower() not in gone]
    out = T.StructType([df.schema[c] for c in keep] + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or make()
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + f(part), names=out.names)

    return df.mapInArrow(run, out)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The bytes of its strings."""
    own = column(batch, name)
    return own.cast(pa.large_binary() if pa.types.is_large_string(own.type) else pa.binary()).to_pylist()


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """Its strings, null as empty."""
    return [x or "" for x in column(batch, name).to_pylist()]


def grouped(df: DataFrame, keys: list[str], schema: str, fold: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], order: list[str] | None = None) -> DataFrame:
    """Rows dealt by ``keys``, sorted (within a key by ``order``), and folded one key at a time; keys must bound their groups."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(zip(*(column(batch, k).to_pylist() for k in keys), strict=True))
            at = 0
            for i in range(1, len(rows) + 1):
                if i == len(rows) or rows[i] != rows[at]:
                    if held and rows[at] != last:
                        yield from fold(held)
                        held = []
                    held.append(batch.slice(at, i - at))
                    last = rows[at]
                    at = i
        if held:
            yield from fold(held)

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, out)
