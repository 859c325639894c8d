"""Token counts under a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton over the vocabulary finds every piece that ends at each character of a word;
dynamic programming carries the best score and its number of pieces to each end. Ties go as in the
tokenizers library: candidates for an end are taken by ascending start, longest piece first, and only a
better score replaces one; a character that is no piece costs the lowest score less 10, and runs of such
become one unknown piece, or one piece a byte where the vocabulary has all byte pieces.

Text becomes words as in that library's Metaspace: spaces turn to U+2581, one stands before the text
unless one is there, and pieces never cross into the next one. Distinct words are counted once by a
worker and remembered within a bound.

The box has no unigram vocabulary of its own; the query takes the pieces and scores of the public
32k piece file as one, just as they stand in it. The path is a parameter.

Defined cases: a null or empty text has no tokens; other columns are ignored; rows with one id are
counted each; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import blocks, prepare, texts_of, vocabulary
from colloquy.llm.memo import Memo, held

MARK = "▁"
#: What an unknown character costs below the lowest score (a fixed value of the library).
UNKNOWN_PENALTY = 10.0


def read_pieces(path: str) -> tuple[list[tuple[str, float]], int]:
    """((piece, score) by id, id of the unknown piece) of a piece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(path))
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.forget()

    def forget(self) -> None:
        self.words, self.counts = Memo(), np.zeros(0, np.int64)

    def count(self, word: str) -> int:
        """Pieces of the best path through ``word``."""
        best, pieces, open_run = array("d", [0.0]), array("q", [0]), bytearray(1)
        matches = self.matches.iter(word)
        match = next(matches, None)
        for end in range(1, len(word) + 1):
            here = []
            while match is not None and match[0] == end - 1:
                here.append(match[1])
                match = next(matches, None)
            top, single = None, False
            for size, score in sorted(here, reverse=True):  # by ascending start
                single |= size == 1
                score += best[end - size]
                if top is None or score > top[0]:
                    top = score, pieces[end - size] + 1, 0
            if not single:
                score = self.unknown + best[end - 1]
                if top is None or score > top[0]:
                    width = len(word[end - 1].encode()) if self.bytes else int(not open_run[end - 1])
                    top = score, pieces[end - 1] + width, 1
            best.append(top[0])
            pieces.append(top[1])
            open_run.append(top[2])
        return pieces[-1]

    def counts_of(self, texts: list[bytes]) -> list[int]:
        if self.words.full():
            self.forget()
        rows, sizes = [], []
        for text in texts:
            words = text.replace(MARK.encode(), b" ").split(b" ") if text else []
            if len(words) > 1 and not words[0]:
                words = words[1:]
            sizes.append(len(words))
            rows.append(self.words.rows(words))
        if self.words.new:
            self.counts = np.concatenate([self.counts, np.fromiter((self.count(MARK + w.decode()) for w in self.words.new), np.int64)])
            self.words.new.clear()
        return [int(self.counts[r].sum()) for r in rows]


def token_counts(docs: DataFrame, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of each whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(f"counts {pieces}", lambda: UnigramCounter(read_pieces(pieces)[0]))
        for rows, raw, at in blocks(batches, "__text"):
            yield pa.RecordBatch.from_arrays([rows.column("__id"), pa.array(counter.counts_of(texts_of(raw, at)), pa.int64())], ["__id", "n_tokens"])

    made = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return made.mapInArrow(run, f"__id {docs.schema[id_col].dataType.simpleString()}, n_tokens long").withColumnRenamed("__id", id_col)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_tokens."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "piece_bpe_32k.model")
