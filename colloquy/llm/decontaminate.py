"""Benchmark decontamination by templates, so that re-parameterised questions are caught as well.

Words are lower-cased, bared of the marks around them, and made canonical: numbers, units and names
become typed placeholders, and their values go to slots. Windows of ``WINDOW`` words are hashed on both sides in two
forms: typed, of canonical words, and plain, of the words themselves without regard to case, so that a verbatim item is
found in any writing. A bit table of the benchmark's hashes (``BITS_EACH`` bits a window, in powers of two from
``LEAST_BITS`` to ``MOST_BITS``) lets tasks pass over nearly all document windows; the rest is joined with the benchmark's
windows by hash and compared by template. Windows of a document and an item on one diagonal are one alignment. It counts
where it covers the item or ``COVER`` of its words: by windows with the item's own words or slot values, whatever stands
beside them, or by all its windows where each slot value of the item has one value in the document throughout
(two of the item's may have become the same).

A name is a capitalised word inside a sentence; sentences begin at a text's or line's start and after
one of . ! ? : at a word's end. Words that are only marks are no words here. An item's capitalised first word
may stand inside a sentence of a document: its first typed window is there as a word and as a name, the latter for the same word only.

Defined cases: a null or empty text matches nothing; an item with fewer than ``WINDOW`` words is one window; one with fewer
than ``SHORTEST`` can't be told from chance inside a text and is matched, plain, where it is a whole line; items without words, null items
and ids are left out of the benchmark, a null document id is never matched; rows with one id are one document; an empty
benchmark matches nothing; other columns are untouched. Beyond MOST_BITS / BITS_EACH windows the bit table lets more pass, which costs time but no match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from colloquy.llm.common import blocks, is_small, materialise, prepare, texts_of, window_hashes
from colloquy.llm.memo import MOST_WORDS, Memo, held

WINDOW, COVER, SHORTEST = 8, 13, 5
#: Bits of the table: for each benchmark window, and in all (powers of two; a full table takes 32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 1024, 1 << 23, 1 << 28
#: Units of measure, time and money that become a placeholder (fixed values).
UNITS = set("""mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs
pound pounds ton tons ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days
week weeks month months year years mph kmh percent degree degrees dollar dollars cent cents euro euros usd eur gbp""".split())
NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*(?:st|nd|rd|th)?[%$€£]?")
NUMBER_WITH_UNIT = re.compile(r"(\d[\d.,]*)([a-z]+)")
NUMBER_WORDS = set("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
PLACEHOLDERS = {"number": "<number>", "unit": "<unit>", "name": "<name>"}
#: Marks that may stand around a word.
AROUND = "!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~"
LINE_START = b"\x01"
PLAIN, NAME_IF_INSIDE, SLOT, NOTHING = 0, 1, 2, 3


def canonical(word: str) -> tuple[str, int, str]:
    """(canonical form, kind, plain form) of a word: kind NAME_IF_INSIDE is a name unless it begins a sentence."""
    bare = word.strip(AROUND)
    if not bare.isalpha():
        bare = word.strip("".join(c for c in word if not c.isalnum() and c not in "$€£%")) or word
        if not any(c.isalnum() for c in bare):
            return "", NOTHING, ""
        low = bare.lower()
        with_unit = NUMBER_WITH_UNIT.fullmatch(low)
        if NUMBER.fullmatch(low) or (with_unit and with_unit[2] in UNITS):
            return PLACEHOLDERS["number"], SLOT, low
        low = "".join(c for c in low if c.isalnum() or c in "'-")
    else:
        low = bare.lower()
    plain = low.casefold()
    if low in NUMBER_WORDS:
        return PLACEHOLDERS["number"], SLOT, plain
    if low in UNITS:
        return PLACEHOLDERS["unit"], SLOT, plain
    return low, NAME_IF_INSIDE if bare[:1].isupper() and bare[1:] == low[1:] and len(bare) > 1 else PLAIN, plain


class Scan:
    """The words of a block of texts that count: their bytes, hashes of both forms, slots, lines, and each text's first."""

    def __init__(self, words: list[bytes], typed: np.ndarray, plain: np.ndarray, slot: np.ndarray, line: np.ndarray, first: np.ndarray):
        self.words, self.typed, self.plain, self.slot, self.line, self.first = words, typed, plain, slot, line, first

    def whole_lines(self, size: int) -> np.ndarray:
        """Which windows of ``size`` words are a line."""
        n = len(self.line) - size + 1
        if n <= 0:
            return np.zeros(0, bool)
        begins, ends = np.ones(len(self.line), bool), np.ones(len(self.line), bool)
        begins[1:] = ends[:-1] = self.line[1:] != self.line[:-1]
        return begins[:n] & ends[size - 1 :] & (self.line[:n] == self.line[size - 1 :])


class Canon:
    """Hashes and kinds of distinct words, remembered by the worker."""

    def __init__(self):
        self.name = np.uint64(xxh64_intdigest(PLACEHOLDERS["name"]))
        self.forget()

    def forget(self) -> None:
        self.words, self.code, self.plain = Memo(), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.kind, self.stop = np.zeros(0, np.int8), np.zeros(0, bool)

    def scan(self, texts: list[bytes]) -> Scan:
        split = [(b"\x01 " + t.replace(b"\n", b" \x01 ")).split() for t in texts]
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
        words = [w for own in split for w in own]
        rows = self.words.rows(words)
        if new := self.words.new:
            made = [canonical(w.decode()) if w != LINE_START else ("", NOTHING, "") for w in new]
            self.code = np.concatenate([self.code, np.fromiter((xxh64_intdigest(m[0]) for m in made), np.uint64, len(made))])
            self.plain = np.concatenate([self.plain, np.fromiter((xxh64_intdigest(m[2], 1) for m in made), np.uint64, len(made))])
            self.kind = np.concatenate([self.kind, np.fromiter((m[1] for m in made), np.int8, len(made))])
            self.stop = np.concatenate([self.stop, np.fromiter((w == LINE_START or w[-1] in b".!?:" for w in new), bool, len(new))])
            new.clear()
        kind, begins = self.kind[rows], np.ones(len(rows), bool)
        begins[1:] = self.stop[rows[:-1]]
        name = (kind == NAME_IF_INSIDE) & ~begins
        at = np.flatnonzero(kind != NOTHING)
        marks = np.fromiter((w == LINE_START for w in words), bool, len(words)) if len(words) else np.zeros(0, bool)
        return Scan([words[i] for i in at.tolist()], np.where(name, self.name, self.code[rows])[at], self.plain[rows][at], (name | (kind == SLOT))[at], np.cumsum(marks)[at], np.searchsorted(at, first))


TYPED, VERBATIM = "typed", "plain"
NAMES = ["__id", "length", "size", "pos", "form", "h", "template", "slots", "exact"]


def rows_at(scan: Scan, canon: Canon, size: int, p: int, h: int, form: str, item: bool) -> list[tuple]:
    """(form, h, template, slots, exact) of the window at word ``p``; of an item's first typed one, both ways to read its first word."""
    own, slot = [w.decode() for w in scan.words[p : p + size]], scan.slot[p : p + size].tolist()
    forms = [canonical(w) for w in own]
    if form == VERBATIM:
        return [(form, h, " ".join(f[2] for f in forms), [], False)]
    template = [PLACEHOLDERS["name"] if s and f[1] == NAME_IF_INSIDE else f[0] for f, s in zip(forms, slot, strict=True)]
    values = [w.strip(AROUND).lower() for w, s in zip(own, slot, strict=True) if s]
    out = [(form, h, " ".join(template), values, False)]
    if item and forms[0][1] == NAME_IF_INSIDE:
        other = scan.typed[p : p + size].copy()
        other[0] = xxh64_intdigest(forms[0][0]) if slot[0] else canon.name
        again = int(window_hashes(other, np.array([0, size]), size)[0].view(np.int64)[0])
        template[0] = forms[0][0] if slot[0] else PLACEHOLDERS["name"]
        values = values[1:] if slot[0] else [own[0].strip(AROUND).lower(), *values]
        out.append((form, again, " ".join(template), values, not slot[0]))
    return out


def windows(table: DataFrame, lengths: list[int] | None, bits: np.ndarray | None) -> DataFrame:
    """(__id, length, size, pos, form, h, template, slots, exact) of the windows of ``table`` (__id, __text); null texts are empty.

    Without ``lengths``: benchmark items, windows of WINDOW words or the whole shorter item; where an item begins
    with a capitalised word, its first window in both forms, ``exact`` where that word is then a slot that must be the same.
    With them: documents, windows of those lengths that ``bits`` lets through.
    """
    prepare(table.sparkSession)
    shared = table.sparkSession.sparkContext.broadcast(bits) if bits is not None else None
    kind = table.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = held("canon", Canon)
        layout, table_of = None, shared.value if shared else None
        mask = np.uint64(8 * len(table_of) - 1) if shared else None
        for part, raw, at in blocks(batches, "__text"):
            if canon.words.full(MOST_WORDS):
                canon.forget()
            layout = layout or pa.schema([("__id", part.schema.field("__id").type), ("length", pa.int64()), ("size", pa.int32()), ("pos", pa.int64()), ("form", pa.string()), ("h", pa.int64()), ("template", pa.string()), ("slots", pa.list_(pa.string())), ("exact", pa.bool_())])
            out = []
            scan = canon.scan(texts_of(raw, at))
            counts = np.diff(scan.first)
            for size in lengths if lengths is not None else sorted({int(c) for c in np.minimum(counts, WINDOW)} - {0}):
                for form, codes in ((TYPED, scan.typed), (VERBATIM, scan.plain)):
                    if form == TYPED and size < SHORTEST:
                        continue
                    h, text = window_hashes(codes, scan.first, size)
                    if shared is None:
                        found = np.flatnonzero((text >= 0) & (np.minimum(counts, WINDOW)[text] == size))
                    else:
                        bit = h & mask
                        found = np.flatnonzero((table_of[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & (text >= 0) & (size >= SHORTEST or scan.whole_lines(size)))
                    for p, k in zip(found.tolist(), text[found].tolist(), strict=True):
                        row = (part.column("__id")[k].as_py(), int(counts[k]), size, p - int(scan.first[k]))
                        out += [(*row, *x) for x in rows_at(scan, canon, size, p, int(h[p : p + 1].view(np.int64)[0]), form, shared is None and p == scan.first[k])]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in out], schema=layout)

    return table.select("__id", "__text").mapInArrow(run, f"__id {kind}, length long, size int, pos long, form string, h long, template string, slots array<string>, exact boolean")


def bit_table(items: DataFrame) -> np.ndarray:
    """The bits of the items' window hashes, BITS_EACH for each; at most MOST_BITS / 64 rows come to the driver."""
    wanted = max(LEAST_BITS, BITS_EACH * items.count())
    n = min(MOST_BITS, 1 << (wanted - 1).bit_length())
    bit = items.select(F.col("h").bitwiseAND(F.lit(n - 1)).alias("bit"))
    words = bit.groupBy(F.expr("shiftright(bit, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS INT)))").alias("v")).toArrow()
    out = np.zeros(n >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("v").to_numpy()
    return out.view(np.uint8)


def alignments(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(__id, __item, covered, item_words): alignments that show a copy of the item or of its template."""
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("__id"), F.col(item_text_col).alias("__text"))
    items = materialise(windows(items, None, None), "item-windows")
    lengths = [r["size"] for r in items.select("size").distinct().orderBy("size").collect()]  # WINDOW at most
    named = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = materialise(windows(named, lengths, bit_table(items)) if lengths else windows(named.limit(0), [], None), "hits")
    known = items.select(F.col("__id").alias("__item"), F.col("length").alias("item_words"), F.col("pos").alias("item_pos"), "size", "form", "h", "template", F.col("slots").alias("item_slots"), "exact")
    if is_small(items):
        known = F.broadcast(known)
    both = found.drop("exact").join(known, ["h", "size", "form", "template"]).filter("NOT exact OR slots[0] = item_slots[0]").withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    both = materialise(both.withColumn("same", F.col("slots") == F.col("item_slots")), "aligned")
    line = ["__id", "__item", "item_words", "diagonal"]
    slots = both.select(*line, F.explode(F.arrays_zip(F.col("item_slots").alias("x"), F.col("slots").alias("y"))).alias("s")).select(*line, "s.*").distinct()
    odd = slots.groupBy(*line, "x").count().filter("count > 1").select(*line).distinct().withColumn("odd", F.lit(True))
    both = both.groupBy(*line, "pos", "size").agg(F.max("same").alias("same"))
    earlier = Window.partitionBy(*line).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    new = lambda at: F.least(F.col("size"), F.coalesce(F.col("pos") - F.last(at, True).over(earlier), F.col("size")))
    steps = both.select(*line, new(F.col("pos")).alias("new"), F.when(F.col("same"), new(F.when(F.col("same"), F.col("pos")))).otherwise(0).alias("copied"))
    covered = steps.groupBy(*line).agg(F.sum("new").alias("covered"), F.sum("copied").alias("copied"))
    need = F.least(F.col("item_words"), F.lit(COVER))
    enough = covered.filter(F.col("covered") >= need).join(odd, line, "left").filter(F.col("odd").isNull() | (F.col("copied") >= need))
    return enough.select("__id", "__item", F.when(F.col("odd"), F.col("copied")).otherwise(F.col("covered")).alias("covered"), "item_words")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, items, covered): documents with benchmark items, their ids in order, and the longest cover in words."""
    hits = alignments(docs, benchmark, id_col, text_col)
    return materialise(hits.groupBy("__id").agg(F.array_sort(F.collect_set("__item")).alias("items"), F.max("covered").alias("covered")), "contaminated")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, contaminated, items (ids of the benchmark), covered (words)."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    hits = contaminated(docs, benchmark)
    out = docs.select("doc_id").join(hits, F.col("doc_id") == F.col("__id"), "left")
    return out.select("doc_id", F.col("__id").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("covered", F.lit(0)).cast("long").alias("covered"))
