"""What the operators of this subpackage share: stored intermediates, Arrow batches of text, hashes.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D; on UTF-8 that is what ``bytes.split()``
gives, so a text is never decoded just to find its words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.store import materialise, new_path, shared_dir  # noqa: F401

ROOT = str(Path(__file__).resolve().parents[2])
#: Text bytes that are worked on at once inside a task; only a single longer text exceeds it.
BLOCK_BYTES = 1 << 20
#: Rows of an Arrow batch, so that a Python worker holds a few MB of usual texts.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20
#: What a table may have at most to be broadcast, as counted by ``is_small``.
BROADCAST_BYTES = 32 << 20


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised table that nothing reads any more."""
    spark, folders = df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def prepare(spark: SparkSession) -> None:
    """Session settings for tasks in Python, which stay set: small Arrow batches, and workers that can import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")  # small stages, few files
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")


def is_small(stored: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table, counted in rows and the bytes of their strings and arrays, may be broadcast."""
    wide = {"string": F.octet_length, "binary": F.octet_length}
    sizes = [F.coalesce(wide[kind](c), F.lit(0)) if kind in wide else 16 * F.greatest(F.size(c), F.lit(0)) if kind.startswith("array") else F.lit(16) for c, kind in stored.dtypes]
    row = stored.agg(F.sum(sum(sizes, F.lit(16)).cast("long"))).first()
    return (row[0] or 0) <= most_bytes


def broadcast_if_small(stored: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(stored) if is_small(stored, most_bytes) else stored


def sized_semi_join(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (or, left_anti, is not): broadcast if small, shuffled beyond."""
    wanted = broadcast_if_small(ids.select(F.col(key).alias("__wanted")).distinct())
    return df.join(wanted, df[key].eqNullSafe(wanted["__wanted"]), how)


def vocabulary(name: str) -> str:
    """A vocabulary file's path: a bare name is looked up where this is called, in the task that opens it."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole_characters(raw[at[0] : at[-1]], at - at[0])


def whole_characters(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, with U+FFFD for what is no UTF-8 (a string column can hold any bytes)."""
    begins = at[:-1][at[:-1] < at[1:]]
    try:
        if not ((raw[begins] & 0xC0) == 0x80).any():
            str(memoryview(raw), "utf-8")
            return raw, at
    except UnicodeDecodeError:
        pass
    texts = [t.decode("utf-8", "replace").encode() for t in texts_of(raw, at)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices of about ``most`` text bytes: (slice, bytes, offsets)."""
    for batch in batches:
        raw, at = utf8(batch.column(text))
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first), raw[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


def texts_of(raw: np.ndarray, at: np.ndarray) -> list[bytes]:
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


#: Odd multipliers of the hashes below (fixed values).
GOLDEN, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and one past the last) of all words; none spans two texts."""
    word = np.zeros(len(raw) + 2, bool)
    np.logical_not(SPACE[raw], out=word[1:-1])
    start, end = word[1:] & ~word[:-1], word[:-1] & ~word[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    both = inner[word[inner] & word[inner + 1]]
    start[both] = end[both] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, at)


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of ``size`` words, its text) where no window spans two texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = mix64(h * GOLDEN + words[j : j + n])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    inside = np.arange(n) + size <= first[text + 1]
    return np.where(inside, h, np.uint64(0)), np.where(inside, text, -1)
