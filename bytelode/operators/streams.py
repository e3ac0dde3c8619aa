"""Streams as tables: members, headers, lists and checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.options import CodecError

#: Of what crosses to Python and back at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
MEMBER_SCHEMA = "member int, form string, name string, comment string, mtime long, comp_len long, raw_len long, check long, reduced double, error string"


def _fields(number: int, m: codec.Member | None, error: str | None) -> dict:
    if m is None:
        return {"member": number, "error": error}
    return {"member": m.number, "form": m.form, "name": m.name, "comment": m.comment, "mtime": m.mtime, "comp_len": m.comp_len, "raw_len": len(m.raw), "check": m.check, "reduced": codec.reduced(len(m.raw), m.comp_len)}


def member_rows(data: bytes) -> list[dict]:
    """The fields of each member; the last has the error if the stream breaks off there."""
    out: list[dict] = []
    try:
        for m in codec.members(data):
            out.append(_fields(m.number, m, None))
    except CodecError as e:
        out.append(_fields(len(out), None, str(e)))
    return out


def small_batches(spark: SparkSession) -> None:
    """Rows that cross to Python at once: few, and few bytes, so that a worker holds little besides one long value."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def explode_rows(df: DataFrame, keys: list[str], columns: list[str], schema: str, f) -> DataFrame:
    """Rows that ``f`` makes of the columns of each row, with its keys; narrow. No rows where the first column is null.

    They leave in batches as they are made, so that what a value decodes to is never held as a whole.
    """
    small_batches(df.sparkSession)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [x.strip().split()[0] for x in schema.split(",")]
    arrow = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [arrow[x.strip().split()[1]] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            values = batch.columns[len(keys) :]
            at, rows, used = [], [], 0

            def made():
                return pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(at)) for k in range(len(keys))] + [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=[*keys, *names])

            for i in range(batch.num_rows):
                if not values[0][i].is_valid:
                    continue
                for row in f(*(v[i].as_py() for v in values)):
                    at.append(i)
                    rows.append(row)
                    used += sum(len(x) for x in row.values() if isinstance(x, bytes))
                    if used >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield made()
                        at, rows, used = [], [], 0
            if rows:
                yield made()

    return df.select(*keys, *columns).mapInArrow(run, f"{kinds}, {schema}")


def explode_bytes(df: DataFrame, keys: list[str], content: str, schema: str, f) -> DataFrame:
    """Rows that ``f`` makes of each value, with the keys of its row; narrow. Null values have no rows."""
    return explode_rows(df, keys, [content], schema, f)


def list_members(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row for each member of each stream."""
    return explode_bytes(df, keys, content, MEMBER_SCHEMA, member_rows)


def output_names(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``output``, the name of the decoded file."""
    from ..functions.paths import strip_suffix

    return df.withColumn("output", strip_suffix(F.col(path)))
