"""Small helpers of this subpackage."""

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What a word is split at: the bytes of `[\x20\x09-\x0D]`, which is what bytes.split() splits at.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def per_worker(key: tuple, build: Callable[[], object]):
    """What `build` makes, once per Python worker. Functions travel by value, so their modules hold nothing there."""
    held = sys.modules.setdefault("_basketry_worker", types.ModuleType("_basketry_worker")).__dict__
    if key not in held:
        held[key] = build()
    return held[key]


def map_rows(df: DataFrame, columns: list[str], schema: str, work: Callable[[list], list],
             weight: int = 4_000_000, raw: bool = False) -> DataFrame:
    """`work` on slices of the named columns, given as lists (arrays if `raw`); its lists or arrays become the
    columns of `schema`.

    A slice ends once the texts and byte strings in it have `weight` characters, so that memory is
    bounded by that and the longest single row, however many rows a batch has.
    """
    narrow = df.select(*columns)
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, weight):
                out = work(part.columns if raw else [c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)

    return narrow.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, weight: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """`batch` in parts that end once the texts, byte strings and lists in them have `weight` characters or items."""
    start, size = 0, 0
    lengths = _sizes(batch)
    for i, n in enumerate(lengths):
        size += n
        if size >= weight or i == len(lengths) - 1:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _sizes(batch: pa.RecordBatch) -> list[int]:
    import pyarrow.compute as pc

    total = [1] * batch.num_rows
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        elif pa.types.is_list(column.type):
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
        else:
            continue
        total = [a + b for a, b in zip(total, sizes)]
    return total
