"""What the operators share: Arrow-batched passes over whole texts, with bounded slices inside a task."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that one Arrow batch may hold, and characters that one call of a text function gets (one text at least).
BATCH_ROWS, SLICE_CHARS = 1000, 2_000_000


def slices(texts: list[str | int | None]) -> Iterator[tuple[int, int]]:
    """Cut a batch where its texts, or their lengths, reach SLICE_CHARS, so that a task's scratch memory has a bound."""
    start = size = 0
    for i, text in enumerate(texts):
        n = text if isinstance(text, int) else len(text or "")
        if i > start and size + n > SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def release() -> None:
    """Give memory that a task no longer needs back to the system; Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most in this session: what a Python worker holds at once has a bound."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def map_texts(df: DataFrame, keep: list[str], text_col: str, make: Callable[[], Callable[[list], dict]], added: T.StructType, multi: str | None = None) -> DataFrame:
    """Add columns computed from a whole text, one output row for each input row.

    ``make()`` runs once in each task and returns the function from a list of texts to lists by column name. With
    ``multi`` that column holds, for each text, how many output rows it has, and the other lists are as long as their sum.
    A kept column with the name of an added one gives way to it.
    """
    made_names = {f.name.lower() for f in added.fields}
    keep = [c for c in keep if c.lower() not in made_names]
    df = df.select(*keep, *([] if text_col in keep else [text_col]))
    limit_batches(df.sparkSession)
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + list(added.fields))
    n_keep, at, names = len(keep), df.columns.index(text_col), [f.name for f in added.fields]

    def run(batches):
        call, out = make(), to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in slices(texts):
                got = call(texts[a:b])
                kept = [batch.column(i).slice(a, b - a) for i in range(n_keep)]
                if multi is not None:
                    index = pa.array([i for i, n in enumerate(got[multi]) for _ in range(n)], pa.int64())
                    kept = [c.take(index) for c in kept]
                made = [x if isinstance(x, pa.Array) else pa.array(x, out.field(n_keep + i).type) for i, x in enumerate(got[n] for n in names)]
                if len(made[0]):
                    yield pa.RecordBatch.from_arrays([*kept, *made], schema=out)
        release()

    return df.mapInArrow(run, schema)
