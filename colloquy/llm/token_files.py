"""Token ids in binary files: frequency-ranked, variable-length bytes, control bytes apart.

A file holds blocks. A block has the documents' ids and token counts, a stream of control bytes (two
bits for each token: its code's length less one, four tokens a byte) and a stream of codes: the rank
of the token's id by corpus frequency, in 1 to 4 little-endian bytes. Frequent ids take one byte.
Blocks are rows of Parquet files, so that Spark's committer writes them whole or not at all on any
store, and any Parquet reader gets the streams. ``ranks`` beside them maps ranks back to ids.

Order: documents are range-partitioned and sorted by id once, as token bytes; each task writes one
shard in order with running offsets, and shard totals (one row a shard) give the global offsets.

Encoding remembers distinct words: the tokenizer drops white space and never joins across it, so a
text's ids are its words' ids one after another. Words of letters with ASCII punctuation behind them
are remembered in two parts, which the tokenizer's pattern also keeps apart.

Defined cases: a null or empty text is the end id alone; null ids come first, rows with one id are
ordered by their tokens; other columns are ignored; an empty table gives empty files.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from colloquy.llm.common import blocks, materialise, new_path, prepare, texts_of, vocabulary
from colloquy.llm.memo import MOST, Lists, Memo, held

#: Tokens of a block, unless one document has more.
BLOCK_TOKENS = 1 << 18
#: ASCII punctuation that the pattern joins to runs apart from letters; the apostrophe is special there.
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that are given to the tokenizer in one text.
TOGETHER = 64
#: The query's vocabulary.
TOKENIZER = "word_bpe_49k.json"
#: Ids between the two passes: 16 bits where they suffice, else 32.
NARROW, WIDE = np.dtype("<u2"), np.dtype("<u4")


class Encoder:
    """Ids of whole texts, by way of their distinct words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(path))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.ids = NARROW if len(self.ends_word) <= 1 << 16 else WIDE
        self.forget()

    def forget(self) -> None:
        self.words, self.lists, self.known = Memo(), Lists(self.ids), {}

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's begin and the end)."""
        if self.words.full() or len(self.known) > MOST:
            self.forget()
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        rows = self.words.rows([w for words in split for w in words])
        if self.words.new:
            self.lists.extend(self.ids_of(self.words.new))
            self.words.new.clear()
        ids, at = self.lists.gather(rows)
        return ids, at[np.concatenate([[0], np.cumsum(counts)])]

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word."""
        known, cores, tails, missing = self.known, [], [], {}
        for word in words:
            core = word.rstrip(PUNCTUATION)
            text = core.decode()
            if text.isalpha() and "Σ" not in text:
                text, tail = text.lower(), word[len(core) :].decode()
            else:
                text, tail = word.decode(), ""
            cores.append(text)
            tails.append(tail)
            if text not in known:
                missing[text] = None
            if tail not in known:
                missing[tail] = None
        single = [m for m in missing if m.isalpha()]
        for i in range(0, len(single), TOGETHER):
            self.learn(single[i : i + TOGETHER])
        for half in missing:
            if half not in known:
                known[half] = np.array(self.tokenizer.encode(half, add_special_tokens=False).ids, self.ids).tobytes()
        return [known[a] + known[b] for a, b in zip(cores, tails, strict=True)]

    def learn(self, words: list[str]) -> None:
        """Ids of words of letters, encoded in one text and cut after each token that ends a word."""
        [code] = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(code.ids, self.ids)
        ends = (np.flatnonzero(self.ends_word[ids]) + 1) * self.ids.itemsize
        if len(ends) == len(words):
            packed = ids.tobytes()
            self.known.update(zip(words, map(packed.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))


def id_type(tokenizer: str, end_id: int) -> np.dtype:
    return NARROW if max(Encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else WIDE


def encode_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __ids): the ids of each whole text and the end id, as little-endian unsigned integers (see ``id_type``)."""
    prepare(docs.sparkSession)
    dtype = id_type(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(f"ids {tokenizer}", lambda: Encoder(tokenizer))
        for rows, raw, at in blocks(batches, "__text"):
            ids, bounds = encoder.encode(texts_of(raw, at))
            out = [np.append(ids[a:b], dtype.type(end_id)).astype(dtype).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("__id"), pa.array(out, pa.binary())], ["__id", "__ids"])

    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return picked.mapInArrow(run, f"__id {docs.schema[id_col].dataType.simpleString()}, __ids binary")


def token_counts(tokens: DataFrame, dtype: np.dtype = NARROW) -> DataFrame:
    """(token, n) over all documents; each task sends a row for each id it has seen."""

    def run(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            raw, _ = _binary(batch.column("__ids"))
            here = np.bincount(np.frombuffer(raw, dtype))
            if len(here) > len(seen):
                here[: len(seen)] += seen
                seen = here
            else:
                seen[: len(here)] += here
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seen[ids], pa.int64())], ["token", "n"])

    return tokens.select("__ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, code bytes) of ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    two = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    two[: len(ranks)] = size - 1
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


#: By control byte: the lengths of its four codes. By length: what a code's four bytes are masked with.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(control: bytes, codes: bytes, n: int) -> np.ndarray:
    """The ranks again, by table lookup of the lengths and one gather."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(codes + b"\0\0\0", np.uint8).astype(np.uint32)
    at = np.cumsum(size, dtype=np.int64) - size
    return (raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16 | raw[at + 3] << 24) & MASKS[size]


def write_token_files(tokens: DataFrame, path: str, dtype: np.dtype = NARROW) -> None:
    """Write the blocks and the rank table of ``tokens`` (__id, __ids of ``dtype``) under ``path``, in ascending id order."""
    spark = tokens.sparkSession
    rank = Window.orderBy(F.desc("n"), "token")  # over the vocabulary, at most one row an id
    token_counts(tokens, dtype).select("token", (F.row_number().over(rank) - 1).alias("rank")).coalesce(1).write.parquet(f"{path}/ranks")
    table = rank_table(spark, path)
    to_rank = np.zeros(int(table.max(initial=0)) + 1, np.uint32)
    to_rank[table] = np.arange(len(table), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(to_rank)  # 4 bytes for each id of the vocabulary
    kind = tokens.schema["__id"].dataType.simpleString()

    def run(batches):
        shard, number, start, ranks_of = TaskContext.get().partitionId(), 0, 0, shared.value

        def block(parts):
            nonlocal number, start
            ids, sizes, raw = zip(*parts, strict=True)
            flat = np.frombuffer(b"".join(raw), dtype)
            control, codes = pack(ranks_of[flat])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.concat_arrays(ids), pa.array(np.concatenate(sizes), pa.int64()))]
            row = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), *lists, pa.array([control], pa.binary()), pa.array([codes], pa.binary())]
            number, start = number + 1, start + len(flat)
            return pa.RecordBatch.from_arrays(row, ["shard", "block", "start", "ids", "sizes", "control", "codes"])

        parts, held = [], 0
        for batch in batches:
            raw, at = _binary(batch.column("__ids"))
            sizes, first = np.diff(at) // dtype.itemsize, 0
            while first < len(sizes):  # as many of the batch's documents as the block has room for
                room = np.searchsorted(np.cumsum(sizes[first:]), BLOCK_TOKENS - held, "right")
                last = first + max(int(room), int(not parts))
                if last > first:
                    parts.append((batch.column("__id").slice(first, last - first), sizes[first:last], raw[at[first] : at[last]].tobytes()))
                    held += int(sizes[first:last].sum())
                if last < len(sizes):
                    yield block(parts)
                    parts, held = [], 0
                first = last
        if parts:
            yield block(parts)

    schema = f"shard int, block int, start long, ids array<{kind}>, sizes array<long>, control binary, codes binary"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(n, F.asc_nulls_first("__id")).sortWithinPartitions(F.asc_nulls_first("__id"), "__ids")
    ordered.mapInArrow(run, schema).write.parquet(f"{path}/blocks")


def rank_table(spark: SparkSession, path: str) -> np.ndarray:
    """Ids in the order of their ranks: at most one for each id of the vocabulary."""
    return np.array([r.token for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.int64)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(__id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    shared = spark.sparkContext.broadcast(rank_table(spark, path).astype("<u4"))
    stored = spark.read.parquet(f"{path}/blocks")
    kind: DataType = stored.schema["ids"].dataType.elementType

    def run(batches):
        to_id = shared.value
        for batch in batches:
            for k in range(len(batch)):
                own, sizes = batch.column("ids")[k].values, batch.column("sizes")[k].values.to_numpy()
                ids = to_id[unpack(batch.column("control")[k].as_py(), batch.column("codes")[k].as_py(), int(sizes.sum()))]
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                shard = np.full(len(sizes), batch.column("shard")[k].as_py(), np.int32)
                columns = [own.cast(to_arrow_type(kind)), pa.array(shard), pa.array(batch.column("start")[k].as_py() + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["__id", "shard", "within", "n_tokens", "ids_crc32"])

    prepare(spark)
    docs = stored.mapInArrow(run, f"__id {kind.simpleString()}, shard int, within long, n_tokens long, ids_crc32 long")
    totals = stored.select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a shard
    base = totals.select("shard", before.alias("base"))
    return docs.join(F.broadcast(base), "shard").select("__id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    """One row per document, from the files read back: doc_id, start, n_tokens, ids_crc32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "token-files")
    write_token_files(materialise(encode_tokens(docs, TOKENIZER, 1), "tokens"), path, id_type(TOKENIZER, 1))
    return read_token_files(spark, path).withColumnRenamed("__id", "doc_id")
