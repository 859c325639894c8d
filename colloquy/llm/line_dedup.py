"""Line dedup, in DataFrame functions alone.

Lines are exploded and normalised, hashed, and counted by distinct documents; keys held by enough
documents lose their lines everywhere but in the largest id that holds them; what stays is put
together again by position.

Only hashes, ids and positions are shuffled for counting (36 bytes a line). A hot line is counted in
two steps, by (key, document) and then by key with partial sums. Keys that meet in one place otherwise, for finding the
lines that go, are split by ``marked``: no more than 2**20 keys can each have more than a 2**20th of the lines, so these
are broadcast, and the rest is joined by key. Keys are 128 bits.

Rows travel with all their columns in one struct, so no name can clash. Texts that lose lines are found by a join on
(id, hash of the text); where the table of what goes is small it is broadcast and texts are not shuffled.

Defined cases: a null or empty text is one empty line, which never counts; a null id is one document,
smaller than all others, and loses common lines like them; rows with the same id count as one document,
each with its own text; the same id and text twice give two equal rows; other columns, of any name, are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import broadcast_if_small, materialise, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: Keys that are broadcast at most (40 bytes each).
HEAVY = 1 << 20


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def marked(lines: DataFrame, common: DataFrame) -> DataFrame:
    """``lines`` with the ``__last`` of their key, where it is one of the keys in ``common`` (stored: __h, __g, __docs, __last)."""
    keys, total = ["__h", "__g"], lines.count()
    own = lines.dtypes[0][1] in ("bigint", "int", "smallint", "tinyint")  # ids of a fixed size
    if own and common.count() <= HEAVY:
        return lines.join(F.broadcast(common.drop("__docs")), keys)
    heavy = broadcast_if_small(common.filter(F.col("__docs") * HEAVY >= total))
    light = common.filter(F.col("__docs") * HEAVY < total).drop("__docs")
    return lines.join(heavy.drop("__docs"), keys).unionByName(lines.join(light, keys))


def dropped_positions(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(__id, __tk, __drop): positions, ascending from 0, of the lines that go, for texts that lose any."""
    text = text_or_empty(text_col)
    lines = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__tk"), F.posexplode(F.split(text, "\n", -1)).alias("__pos", "__line"))
    lines = lines.filter(F.octet_length("__line") >= min_chars).withColumn("__key", line_key(F.col("__line"))).filter(F.char_length("__key") >= min_chars)
    lines = materialise(lines.select("__id", "__tk", "__pos", F.xxhash64("__key").alias("__h"), F.xxhash64(F.lit("second"), "__key").alias("__g")), "lines")
    once = lines.groupBy("__h", "__g", "__id").count()
    common = once.groupBy("__h", "__g").agg(F.count(F.lit(1)).alias("__docs"), F.max("__id").alias("__last"))
    common = materialise(common.filter(F.col("__docs") >= min_docs), "common-lines")
    gone = marked(lines, common).filter(~F.col("__id").eqNullSafe(F.col("__last")))
    return materialise(gone.groupBy("__id", "__tk").agg(F.array_sort(F.collect_set("__pos")).alias("__drop")), "lines-that-go")


def without_lines(text: Column, drop: Column) -> Column:
    """``text`` without the lines at the ascending positions ``drop``: the runs between them, joined again."""
    lines = F.split(text, "\n", -1)
    starts = F.concat(F.array(F.lit(0)), F.transform(drop, lambda p: p + 1))
    ends = F.concat(drop, F.array(F.size(lines)))
    runs = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.slice(lines, r["s"] + 1, r["e"] - r["s"]))
    return F.array_join(F.flatten(runs), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(row, n_lines, n_dropped): all rows of ``docs`` as one struct, with common lines taken out of the text."""
    gone = broadcast_if_small(dropped_positions(docs, id_col, text_col, min_chars, min_docs))
    quoted = f"`{text_col}`"
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("key"), text_or_empty(text_col).alias("body"))
    rows = rows.join(gone, F.col("key").eqNullSafe(F.col("__id")) & (F.xxhash64("body") == F.col("__tk")), "left")
    kept = F.when(F.col("__drop").isNull(), F.col("body")).otherwise(without_lines(F.col("body"), F.col("__drop")))
    n_lines = F.char_length("body") - F.char_length(F.replace("body", F.lit("\n"), F.lit(""))) + 1
    return rows.select(F.col("row").withField(quoted, kept).alias("row"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("row.text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
common AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.pos, l.line, (c.k IS NOT NULL AND l.doc_id <> c.last) AS gone FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
