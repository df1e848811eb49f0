"""Helpers shared by the training-data operators.

A *word* is a maximal run of characters other than space and U+0009..U+000D; ``bytes.split()``
on UTF-8 text gives exactly these words.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcube.session import scratch_dir

SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]"
#: A broadcast side is never larger than this many rows of a few longs each.
BROADCAST_ROWS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` under the shared checkpoint folder and read it back (cuts lineage, survives lost executors)."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a *written* table only after counting it; a larger one is left to a shuffle join."""
    return F.broadcast(df) if df.count() <= max_rows else df


def small_table(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast a *written* table of strings, numbers and lists only after adding up its size in bytes (as text)."""
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 64)).first()[0]
    return F.broadcast(df) if (size or 0) <= max_bytes else df


def words_col(text):
    """Array of the words of a text column (null text: empty array)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def membership_bits(keys: DataFrame, column: str, log_bits: int = 26) -> np.ndarray:
    """Bitmap of 2**log_bits bits (8 MB by default, whatever the input) with two bits set per key.

    A one-sided prefilter: a key that is not in `keys` may pass, a key in `keys` always does.
    Only the fixed-size bitmap reaches the driver, never the keys.
    """
    k = F.col(column)
    bit = F.explode(F.array(k.bitwiseAND(F.lit((1 << log_bits) - 1)),
                            F.shiftrightunsigned(k, 64 - log_bits)))
    rows = (keys.select(bit.alias("b"))
            .groupBy(F.shiftright("b", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("v")))
    table = rows.toArrow()
    out = np.zeros(1 << (log_bits - 6), dtype=np.uint64)
    out[table["w"].to_numpy()] = table["v"].to_numpy().view(np.uint64)
    return out


def may_contain(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Vectorised test of uint64 keys against `membership_bits`."""
    log_bits = int(len(bits)).bit_length() - 1 + 6
    a = keys & np.uint64((1 << log_bits) - 1)
    b = keys >> np.uint64(64 - log_bits)
    one, six, low = np.uint64(1), np.uint64(6), np.uint64(63)
    return (((bits[a >> six] >> (a & low)) & (bits[b >> six] >> (b & low)) & one) == one)


def mix64(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective), for hashes whose low bits are weak."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(value) -> list[bytes]:
    """Words of an Arrow string scalar as UTF-8 bytes (null: none)."""
    return value.as_buffer().to_pybytes().split() if value.is_valid else []


def as_long(x: np.ndarray):
    """uint64 array as an Arrow array of signed longs (same bits)."""
    import pyarrow as pa
    return pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))


def in_batches(rows, names: list[str], limit: int = 100_000):
    """Concatenate tuples of Arrow arrays (one tuple per text) into record batches of about `limit` rows."""
    import pyarrow as pa

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names=names)
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[0])
        if n >= limit:
            yield batch(held)
            held, n = [], 0
    if held:
        yield batch(held)


#: Stands for a null id wherever ids are compared: it comes before all others.
NULL_ID = -(1 << 63)


def id_key(col):
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID))


def replace_text(rows: DataFrame, schema_columns: list[str], text_col: str, new_text, row_col: str = "_row") -> DataFrame:
    """Columns of the struct `row_col` with another text; a column n_chars follows the text."""
    out = []
    for c in schema_columns:
        value = F.col(row_col)[c]
        if c == text_col:
            value = new_text
        elif c == "n_chars":
            value = F.length(new_text).cast("long")
        out.append(value.alias(c))
    return rows.select(*out)
