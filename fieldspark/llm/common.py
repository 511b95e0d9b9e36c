"""Text and batch helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
# ASCII capitals become small letters, nothing else changes.
CASE = bytes.maketrans(UPPER, LOWER)
# As CASE, and every other ASCII character that is no letter or digit becomes a space.
ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).translate(CASE))

# Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def spaced_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of anything but space, tab, and the line and page breaks 0A-0D."""
    return text.translate(CASE).split()


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.translate(ALNUM).split()


def utf8(column: str) -> Column:
    """The text as UTF-8 bytes, empty for null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores after it until no column has it."""
    while name in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Texts reach Python in batches of bounded size, whatever their length: a row count alone lets a batch grow with its texts.

    The setting stays in the session; a smaller one that is there already is kept.
    """
    kept = spark.conf.get(BATCH_SETTING).removesuffix("b")
    if not kept.isdigit() or int(kept) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system: the worker process goes on to other stages, beside other workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def append(
    df: DataFrame,
    text: str,
    fields: str,
    open_batch: Callable[[], Callable[[list[bytes]], list[list]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add computed columns to a frame, batch by batch, without a shuffle.

    ``open_batch`` runs once per task and returns a function from the UTF-8 texts
    of a batch to one list per new field. Columns of the frame whose name equals
    a new field are replaced.
    """
    bounded_batches(df.sparkSession)
    new = T._parse_datatype_string(fields)
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    # A text that stays is read where it is; any other goes along in a column of its own.
    stays = text in kept and df.schema[text].dataType == T.StringType()
    hidden = text if stays else fresh("text", kept)
    source = df.select(*[F.col(f"`{c}`") for c in kept], *([] if stays else [utf8(f"`{text}`").alias(hidden)]))
    schema = T.StructType([source.schema[c] for c in kept] + list(new.fields))
    arrow = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = open_batch()
        for batch in batches:
            texts = batch.column(batch.schema.names.index(hidden)).cast(pa.binary()).fill_null(b"")
            columns = work(texts.to_pylist())
            made = [pa.array(values, field.type) for values, field in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(kept)] + made, names=kept + arrow.names)
        del work
        release()

    return source.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return simple[kind.simpleString()]
