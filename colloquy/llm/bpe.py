"""Byte-level BPE by a pair occurrence index.

New pretokens of a task's block of texts are laid out in one linked array. An index maps each rank to
all positions where its pair begins. Active ranks are applied in ascending order, each at all its
positions from left to right; a merge looks at the two pairs it makes with its neighbours and adds
their positions to the lists of their ranks. Positions whose pair has gone since are passed over when
their rank comes up. Pretokens never join, so the result is that of merging each on its own.

Distinct pretokens are merged once and remembered by the worker, within a bound.

Defined cases: a null or empty text has no ids and decodes to an empty text; special tokens' strings in
a text become their ids, as the tokenizers library does by default; bytes that are no UTF-8 are U+FFFD first; other columns are ignored; rows
with one id are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import blocks, prepare, texts_of, vocabulary
from colloquy.llm.memo import Lists, Memo, held

#: How byte-level tokenizers split text: contractions, letters, numbers, other marks, white space.
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: White space with what follows it: no pretoken crosses the end of such a piece.
PIECES = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")
#: A text without these and without a space at its end has a single space wherever a space is.
UNUSUAL = [b"  ", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
#: ASCII punctuation but the apostrophe: behind letters it is a pretoken of its own.
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The query's vocabulary.
TOKENIZER = "byte_bpe_50k.json"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: itself, or the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]
#: Pieces of a kind that a worker remembers with their ids; beyond it starts afresh.
HELD = 250_000


class Bpe:
    def __init__(self, path: str):
        with open(vocabulary(path), encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile(b"(" + b"|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + b")")
        self.byte_ids = np.array([vocab[c] for c in letters])
        self.ranks: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
        self.byte_ranks = np.array([[self.ranks.get(int(a) << 32 | int(b), -1) for b in self.byte_ids] for a in self.byte_ids])
        byte = {c: bytes([b]) for b, c in enumerate(letters)}
        self.table = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.table[i] = b"".join(byte[c] for c in token)
        for token, i in self.added.items():
            self.table[i] = token
        self.decimal = [b"%d" % i for i in range(len(self.table))]
        self.forget()

    def forget(self) -> None:
        self.spaced, self.raw, self.known = Memo(), Memo(), {}
        self.lists = {id(self.spaced): Lists(np.uint32), id(self.raw): Lists(np.uint32)}
        self.text = {id(self.spaced): [], id(self.raw): []}

    def merge(self, pretokens: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(packed ids, ids in decimal joined by commas) of each pretoken, by the pair occurrence index over all of them."""
        raw = np.frombuffer(b"".join(pretokens), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pretokens), np.int64, len(pretokens)))
        if not len(raw):
            return []
        linked, following = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        linked[ends - 1] = following[np.append(0, ends[:-1])] = -1
        pairs = np.where(linked[:-1] >= 0, self.byte_ranks[raw[:-1], raw[1:]], -1)
        at = np.flatnonzero(pairs >= 0)
        at = at[np.argsort(pairs[at], kind="stable")]
        active, cuts = np.unique(pairs[at], return_index=True)
        where = {r: p.tolist() for r, p in zip(active.tolist(), np.split(at, cuts[1:]), strict=True)} if len(at) else {}
        active = active.tolist()  # ascending, so it is a heap
        symbols, after, before = self.byte_ids[raw].tolist(), linked.tolist(), following.tolist()
        rank_of, merges = self.ranks.get, self.merges
        while active:
            rank = heappop(active)
            left, right, whole = merges[rank]
            for i in sorted(where.pop(rank)):
                j = after[i]
                if symbols[i] != left or j < 0 or symbols[j] != right:
                    continue
                symbols[i], symbols[j] = whole, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    if (r := rank_of(whole << 32 | symbols[k])) is not None:
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            heappush(active, r)
                if (h := before[i]) >= 0 and (r := rank_of(symbols[h] << 32 | whole)) is not None:
                    if r in where:
                        where[r].append(h)
                    else:
                        where[r] = [h]
                        heappush(active, r)
        left_over = np.array(symbols)
        alive = left_over >= 0
        ids = left_over[alive].astype(np.uint32)
        ends = np.cumsum(alive)[ends - 1].tolist()
        packed, decimal, out, a = ids.tobytes(), list(map(self.decimal.__getitem__, ids.tolist())), [], 0
        for b in ends:
            out.append((packed[4 * a : 4 * b], b",".join(decimal[a:b])))
            a = b
        return out

    def learn(self, memo: Memo, lead: str) -> None:
        """Ids of the memo's new pieces, each with ``lead`` before it."""
        known, cut, missing = self.known, [], {}
        for piece in memo.new:
            core = piece.rstrip(PUNCTUATION)
            text = core.decode()
            if text.isalpha():
                pieces = [lead + text, piece[len(core) :].decode()] if len(core) < len(piece) else [lead + text]
            else:
                pieces = PRETOKENS.findall(lead + piece.decode())
            cut.append(pieces)
            for p in pieces:
                if p not in known:
                    missing[p] = None
        known.update(zip(missing, self.merge([p.encode() for p in missing]), strict=True))
        self.lists[id(memo)].extend([b"".join([known[p][0] for p in pieces]) for pieces in cut])
        self.text[id(memo)].extend([b",".join([known[p][1] for p in pieces]) for pieces in cut])
        memo.new.clear()

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, bytes]]:
        """(ids, the ids in decimal joined by commas) of each text."""
        if self.spaced.full(HELD) or self.raw.full(HELD) or len(self.known) > HELD:
            self.forget()
        plan = []
        for text in texts:
            parts = self.split_added.split(text) if any(a in text for a in self.added) else [text]
            plan.append([self._rows(p) if k % 2 == 0 else self.added[p] for k, p in enumerate(parts)])
        self.learn(self.raw, "")
        self.learn(self.spaced, " ")
        return [self._join(parts) for parts in plan]

    def _rows(self, text: bytes) -> tuple[list[int], Memo, list[int]]:
        """Rows of the raw pieces, then of those that a space leads."""
        if not text:
            return [], self.spaced, []
        if text.endswith(b" ") or any(u in text for u in UNUSUAL):
            return [self.raw[p.encode()] for p in PIECES.findall(text.decode())], self.spaced, []
        head, *rest = text.split(b" ")
        return [self.raw[head]] if head else [], self.spaced, list(map(self.spaced.__getitem__, rest))

    def _join(self, parts: list) -> tuple[np.ndarray, bytes]:
        ids, texts = [], []
        for part in parts:
            if isinstance(part, int):
                ids.append(np.array([part], np.uint32))
                texts.append(b"%d" % part)
                continue
            raw, _, spaced = part
            for memo, rows in ((self.raw, raw), (self.spaced, spaced)):
                if rows:
                    ids.append(self.lists[id(memo)].gather(np.array(rows))[0])
                    text = self.text[id(memo)]
                    texts.append(b",".join([text[r] for r in rows]))
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), b",".join(texts)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def bpe_codes(docs: DataFrame, tokenizer: str, columns: str, make, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``make(bpe, texts)`` gives a list for each column of ``columns`` (a DDL string) after __id."""
    prepare(docs.sparkSession)
    schema = f"__id {docs.schema[id_col].dataType.simpleString()}, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(f"bpe {tokenizer}", lambda: Bpe(tokenizer))
        for rows, raw, at in blocks(batches, "__text"):
            made = make(bpe, texts_of(raw, at))
            yield pa.RecordBatch.from_arrays([rows.column("__id"), *made.values()], ["__id", *made])

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, ids array<int>) of each text."""
    return bpe_codes(docs, tokenizer, "ids array<int>", lambda bpe, texts: {"ids": pa.array([ids.astype(np.int32) for ids, _ in bpe.encode(texts)], pa.list_(pa.int32()))}, id_col, text_col)


def bpe_decode(codes: DataFrame, tokenizer: str, id_col: str = "__id", ids_col: str = "ids") -> DataFrame:
    """(__id, text) of ids."""
    prepare(codes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(f"bpe {tokenizer}", lambda: Bpe(tokenizer))
        for batch in batches:
            texts = [bpe.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(texts, pa.string())], ["__id", "text"])

    picked = codes.select(F.col(id_col).alias("__id"), F.col(ids_col).alias("ids"))
    return picked.mapInArrow(run, f"__id {codes.schema[id_col].dataType.simpleString()}, text string")


def _digests(bpe: Bpe, texts: list[bytes]) -> dict[str, pa.Array]:
    n, ids_sha, text_sha = [], [], []
    for ids, decimal in bpe.encode(texts):
        n.append(len(ids))
        ids_sha.append(hashlib.sha256(decimal).hexdigest())
        text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
    return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}


def bpe_digests(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, and decoded again from the ids, in one pass."""
    made = bpe_codes(docs, tokenizer, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)
    return made.withColumnRenamed("__id", "doc_id")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER)
