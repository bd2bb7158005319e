"""What the corpus operators share: checked inputs, cut lineage, and byte-level tokens in NumPy."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from scenewatch.operators.graph import cut, shared_dir

__all__ = ["cut", "shared_dir"]

#: Words are maximal runs of anything but these characters.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"


def need(df: DataFrame, *names: str) -> DataFrame:
    """df with just these columns; a missing one is an error that names it."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    return df.select(*names)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: for what is read more than once, by few of its columns.

    The table goes when the application ends, or by removed().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def until_exit(spark: SparkSession, path: str) -> None:
    """Has the folder deleted when the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def removed(table: DataFrame) -> None:
    """Deletes the folder of a table of written(), once nothing that is still to be computed reads it."""
    spark = table.sparkSession
    if files := table.inputFiles():
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def whole(docs: DataFrame, *names: str) -> DataFrame:
    """Columns in names, and `_doc` with all columns of docs, so that none of them can clash with one made on the way."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *names)


def whole_id(docs: DataFrame) -> Column:
    """doc_id as a long; a type of other than whole numbers is an error, since its values would silently become null."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise ValueError(f"doc_id must be a whole number, not {kind.simpleString()}")
    return F.col("doc_id").cast("long")


def words(text: Column) -> Column:
    """The array of words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents kept out of all learning; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def byte_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of an Arrow string column: (first row, end row, their bytes, row offsets within them).

    A run holds at most `most` bytes unless a single row is longer. Null rows are empty.
    """
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, stop, raw[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at]
        at = stop


def given_back() -> None:
    """Has this process give the memory that it has freed back to the system: Python workers live on beside Spark between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown as longer texts come."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.inverse = pow(self.BASE, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.array([1] + [b] * (size - 1), np.uint64)) for b in (self.BASE, self.inverse))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def tokens(data: np.ndarray, rows: np.ndarray, gap: np.ndarray, same: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of some rows' bytes: (start, end, row, 64-bit hash). Bytes with gap[b] part them, same[b] folds them.

    The hash is the polynomial of the folded bytes: a difference of prefix sums, divided by the power at the start.
    With `most`, it is that of a token's first `most` bytes.
    """
    gaps = gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[rows] = True
    inside = ~gaps
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    starts = np.flatnonzero(inside & (first[:-1] | np.concatenate([[True], gaps[:-1]])))
    ends = np.flatnonzero(inside & (first[1:] | np.concatenate([gaps[1:], [True]]))) + 1
    up, down = POWERS.to(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((same[data].astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    row = np.searchsorted(rows, starts, side="right") - 1
    upto = ends if most is None else np.minimum(ends, starts + most)
    return starts, ends, row, mixed((prefix[upto] - prefix[starts]) * down[starts])


def fold_tables(parts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(gap, same) for tokens(): the bytes in parts part tokens, A-Z count as a-z."""
    gap, same = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    gap[list(parts)] = True
    same[65:91] += 32
    return gap, same


SPACE_BYTES = bytes([32, 9, 10, 11, 12, 13])


def token_hash(word: str) -> int:
    """The hash that tokens() gives to this word alone."""
    data = np.frombuffer(word.encode(), np.uint8)
    gap, same = fold_tables(b"")
    return int(tokens(data, np.array([0, len(data)]), gap, same)[3][0])
