"""Fill-in-the-middle by counted-quantifier patterns, in DataFrame functions alone.

``regexp_count`` gives the number n of units of a text. Two cuts a <= b among n + 1 places come from a hash of the id, and
one pattern a row, ``unit{a}`` and ``unit{b-a}`` as possessive groups and the rest, captures prefix, middle and suffix in
one match, whose groups ``regexp_replace`` puts in the order of the row's form. Possessive groups are matched by a
loop, without going back and without a stack frame a unit, so a text of any number of lines is cut. Nothing is shuffled.

Units must tile a text: matched left to right they leave nothing out. A text that contains one of the three marks is
left plain, so an output is told apart into its parts at the marks alone.

Defined cases: a null or empty text is plain, with no units; bytes that are no UTF-8 become U+FFFD; a null id counts as an empty
one; rows that share an id are cut by the same hash, each in its own text; other columns, of any name, are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import text_or_empty

#: A line with its end, or the last one without.
LINE = r"(?:[^\n]*+\n|[^\n]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What the match's groups (1 prefix, 2 middle, 3 suffix) become (fixed values).
ORDERS = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}


def draws(key: Column, seed: int, many: int = 4) -> list[Column]:
    """The first 32-bit numbers of the SHA-256 of ``seed:key``, at most eight."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(many)]


def cut_pattern(unit: str, first: Column, second: Column) -> Column:
    """A pattern for a whole text whose groups are its first units, the next ones, and what is left."""
    return F.concat(F.lit(rf"\A({unit}{{"), first.cast("string"), F.lit(rf"}}+)({unit}{{"), second.cast("string"), F.lit(r"}+)((?s:.*))\z"))


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = 7, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """(row, n, form, output): all rows of ``docs`` as one struct, the number of units, and the text in its form: plain, psm or spm."""
    text = F.make_valid_utf8(text_or_empty(text_col))
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"), F.regexp_count(text, F.lit(unit)).cast("long").alias("n"), *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col(id_col), seed), 1)])
    plain = (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE)) | (F.col("h3") % 100 >= percent)
    places = F.col("n") + 1
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("row", "text", "n", form.alias("form"), (F.col("h1") % places).alias("x"), (F.col("h2") % places).alias("y"))
    low = F.least("x", "y")
    order = F.when(F.col("form") == "spm", ORDERS["spm"]).otherwise(ORDERS["psm"])
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", cut_pattern(unit, low, F.greatest("x", "y") - low), order))
    return rows.select("row", "n", "form", output.alias("output"))


def with_parts(made: DataFrame) -> DataFrame:
    """``made`` (form, output and more) with prefix, middle, suffix (null where plain) and the text they came from, from form and output alone."""
    part = F.col("__part")
    rows = made.withColumn("__part", F.when(F.col("form") != "plain", F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)))
    spm = F.col("form") == "spm"
    rows = rows.withColumns({"prefix": F.when(spm, part[2]).otherwise(part[1]), "suffix": F.when(spm, part[1]).otherwise(part[2]), "middle": part[3]}).drop("__part")
    return rows.withColumn("restored", F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat("prefix", "middle", "suffix")))


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = with_parts(fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    sizes = [F.char_length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return made.select("row.doc_id", "n", "form", *sizes, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
cuts AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM lines),
parts AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS p,
         coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS m, coalesce(array_to_string(u[greatest(x, y) + 1:], ''), '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""
