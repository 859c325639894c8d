"""Known names in texts become pseudonyms, the same one for a person wherever any of their names stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.sources.store import broadcast_if_small, materialise

#: A word, with apostrophes inside; all between two words is one piece too.
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
PIECES = rf"{WORD}|(?:(?!{WORD}).)+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def pseudonym(entity: Column, salt: str) -> Column:
    """What stands for a person: without the salt it can't be traced by hashing ids."""
    return F.concat(F.lit("person-"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), entity.cast("string")), 256), 1, 10))


def known_names(names: DataFrame, entity: str, name: str, salt: str) -> DataFrame:
    """(first, size, phrase, stands): each name's first word, number of words, words and pseudonym; a name of two people has that of the smaller id."""
    rows = names.select(F.col(entity).alias("e"), words_of(F.col(name)).alias("w")).filter("e IS NOT NULL AND size(w) > 0")
    rows = rows.groupBy(F.array_join("w", " ").alias("phrase")).agg(F.min("e").alias("e"), F.first("w").alias("w"))
    return materialise(rows.select(F.col("w")[0].alias("first"), F.size("w").alias("size"), "phrase", pseudonym(F.col("e"), salt).alias("stands")), "names")


def mask_names(df: DataFrame, names: DataFrame, text: str = "text", entity: str = "seller_id", name: str = "name", salt: str = "") -> DataFrame:
    """``df`` with known names in ``text`` replaced, from left to right, of names that begin at one word the longest.

    Names are met as whole words in any letters' case and with anything between their words. The names are walked as a trie, a join a level: words that
    begin no name are dropped at the first join, and what is left meets a name only by all its words. Tables of names are broadcast where they are small, joined beyond.
    Only the texts that hold a name are put together anew. A null text stays null; names without a word and null people are left out; equal rows stay as many; other columns are untouched.
    """
    known = known_names(names, entity, name, salt)
    longest = known.agg(F.max("size")).first()[0]
    if not longest:
        return df
    firsts = broadcast_if_small(materialise(known.groupBy("first").agg(F.array_sort(F.collect_set("size")).alias("sizes")), "first-words"))
    phrases = broadcast_if_small(known.drop("first"))
    texts = df.select(F.col(text).alias("t")).filter("t IS NOT NULL").distinct().withColumn("w", words_of(F.col("t")))
    texts = materialise(texts.filter("size(w) > 0").select(digest("t").alias("h"), "w"), "name-words")
    places = texts.select("h", F.explode(F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("first"), F.slice("w", i + 1, longest).alias("ahead")))).alias("x")).select("h", "x.*")
    begun = places.join(firsts, "first").withColumn("size", F.explode("sizes")).filter(F.size("ahead") >= F.col("size"))
    begun = begun.select("h", "at", "size", F.array_join(F.slice("ahead", 1, F.col("size")), " ").alias("phrase"))
    met = begun.join(phrases, ["phrase", "size"])
    longest_first = F.array_sort(F.collect_list(F.struct("at", (-F.col("size")).alias("less"), "stands")))  # no more than the text's words times name lengths
    met = materialise(met.groupBy("h").agg(longest_first.alias("__found")), "names-met")
    out = df.withColumn("__h", digest(text)).join(broadcast_if_small(met).withColumnRenamed("h", "__met"), F.col("__h") == F.col("__met"), "left")
    return replaced(out, text, "__found").select(*df.columns)


def digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def replaced(df: DataFrame, text: str, found: str) -> DataFrame:
    """``df`` with the words of each name in ``found`` (sorted by place; null: none) replaced in ``text``, unless an earlier name has taken them.

    The pieces of a text and the walk over its names are columns of their own, since Spark makes what stands inside a lambda anew for each item.
    """
    some, pieces, lead = F.col(found).isNotNull(), F.col("__pieces"), F.col("__lead")
    df = df.withColumn("__pieces", F.when(some, F.regexp_extract_all(F.col(text), F.lit(rf"(?s){PIECES}"), F.lit(0))))
    df = df.withColumn("__lead", F.when(F.get(pieces, F.lit(0)).rlike(rf"^{WORD}"), 0).otherwise(1))  # words and what is between them take turns
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("next"))

    def step(done: Column, one: Column) -> Column:
        at = one["at"] * 2 + lead
        text_before = F.array_join(F.slice(pieces, done["next"] + 1, F.greatest(at - done["next"], F.lit(0))), "")
        taken = F.struct(F.concat(done["out"], text_before, one["stands"]).alias("out"), (at - 2 * one["less"] - 1).alias("next"))
        return F.when(at >= done["next"], taken).otherwise(done)

    df = df.withColumn("__end", F.aggregate(found, start, step))
    end = F.col("__end")
    return df.withColumn(text, F.when(some, F.concat(end["out"], F.array_join(F.slice(pieces, end["next"] + 1, F.size(pieces)), ""))).otherwise(F.col(text)))
