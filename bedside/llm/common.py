"""Session settings, word rules and hashes that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedside.sources import tables

#: Bytes that end a word of the "alphanumeric or beyond ASCII" rule become a space, A-Z become a-z.
_FOLD = bytes(ord(" ") if not (chr(b).isalnum() and b < 128 or b >= 128) else b + 32 if 65 <= b <= 90 else b
              for b in range(256))


def prepare(spark: SparkSession) -> None:
    """The library's settings, and small Arrow batches: texts may be long."""
    tables.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def folded_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_FOLD).split()


def is_null_or(text: str | None) -> bytes:
    """UTF-8 of a text, empty for null."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a bijection), so that their order is unrelated to their making."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, seed: int = 0, bound: int = 300_000) -> None:
        super().__init__()
        import xxhash
        self._hash, self._seed, self._bound = xxhash.xxh3_64_intdigest, seed, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._bound:
            self.clear()
        h = self[word] = self._hash(word, self._seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Rolling:
    """Hashes of every run of k words, from word hashes, modulo 2^64. ``base`` is odd, hence invertible."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            m = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, b in (("_up", self.base), ("_down", self.inverse)):
                    steps = np.full(m, b, dtype=np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def runs(self, hashes: np.ndarray, k: int) -> np.ndarray:
        n = len(hashes)
        if n < k:
            return np.empty(0, dtype=np.uint64)
        self._powers(n)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self._up[:n], dtype=np.uint64)])
            return mix((total[k:] - total[:-k]) * self._down[:n - k + 1])

    def spans(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the words from each start to before each end."""
        n = len(hashes)
        self._powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self._up[:n], dtype=np.uint64)])
            return mix((total[ends] - total[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))


def buffered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Joins small batches up to ``size`` bytes of ``column``; a larger row stands alone."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.column(column).nbytes
        if held_bytes >= size:
            yield pa.concat_batches(held)
            held, held_bytes = [], 0
    if held:
        yield pa.concat_batches(held)


def sha256_hex(column) -> F.Column:
    return F.sha2(column, 256)


def packed(df: DataFrame, keep: list[str], **columns: str) -> DataFrame:
    """Kept columns as one struct ``_row`` beside renamed ones: no name of the input can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
                     *[F.col(f"`{c}`").alias(new) for new, c in columns.items()])


def with_fields(df: DataFrame, ddl: str):
    """Schema of ``df`` followed by the fields of ``ddl``."""
    from pyspark.sql.types import StructType
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
