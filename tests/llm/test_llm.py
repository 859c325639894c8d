"""The ten operators and the pipeline: against plain versions, SQL, the tokenizers library and planted cases."""

import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from colloquy.llm import bpe, chat, common, cotraining, decontaminate, language_id, line_dedup, near_dedup, quality_rules, registry, token_counts, token_files
from tests.llm import brute

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
#: Columns whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, label int, key string, rank int, kept boolean, count long"
LONG = " ".join(f"word{i % 997} Tail{i * i % 8191}." for i in range(60_000))
TEXTS = [
    None, "", " ", "\n\n", "a", "one two", "ONE  two", "İstanbul ΟΔΟΣ Straße ﬁn 数字 ١٢٣ é", "tabs\tand\x0bmore\x0c\r\nlines   x  y ", "<|endoftext|> a<|endoftext|><|startoftext|>", "don't we'll I'M 'S ''s 3rd 12,5% --- ...",
    "\U0001f600\U0001f600 \U0001f468‍\U0001f469 ok \x00\x1f\x85  end", "▁▁ a▁b ▁", "the same line that is shared by all\nother A\n  THE same line that is Shared by all\t\nlast", "the same line that is shared by all\nB", "the same line that is shared by all\n\nC\n", LONG, LONG + " end", "x" * 30_000,
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 1, "k", 1, True, 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def base(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def rows(base):
    return base + [(10_000 + k, t) for k, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def marks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


# 1
def test_token_files(spark, docs, rows, empty):
    def through(df):
        path = common.new_path(spark, "test-files")
        token_files.write_token_files(token_files.encode_tokens(df, P.path("word_bpe_49k.json"), 1), path)
        return token_files.read_token_files(spark, path)

    assert got(through(docs), "__id", "start", "n_tokens", "ids_crc32") == brute.token_files(rows, library("word_bpe_49k.json"))
    assert through(empty).count() == 0
    for kind in ("smallint", "date", "string", "decimal(9,0)"):
        ids = spark.range(5).select(F.expr("date_add(date'2020-01-01', cast(id AS int))" if kind == "date" else f"cast(id AS {kind})").alias("doc_id"), F.lit("a b").alias("text"))
        assert sorted((r.start, r.n_tokens) for r in through(ids).collect()) == [(3 * k, 3) for k in range(5)]
    twice = through(frame(spark, [(None, "a"), (1, "b c"), (1, "b c"), (1, "b")])).collect()
    assert sorted((r.start, r.n_tokens) for r in twice) == [(0, 2), (2, 2), (4, 3), (7, 3)]


def test_wide_ids_and_small_blocks(spark, docs, rows, monkeypatch):
    """The 32-bit way, and blocks smaller than documents, give the same."""
    monkeypatch.setattr(token_files, "id_type", lambda tokenizer, end_id: token_files.WIDE)
    path = common.new_path(spark, "test-wide")
    token_files.write_token_files(token_files.encode_tokens(docs, "word_bpe_49k.json", 1), path, token_files.WIDE)
    assert got(token_files.read_token_files(spark, path), "__id", "start", "n_tokens", "ids_crc32") == brute.token_files(rows, library("word_bpe_49k.json"))
    big = spark.createDataFrame([(1, bytearray((70_000).to_bytes(4, "little") * 3)), (2, bytearray((99).to_bytes(4, "little")))], "__id long, __ids binary")
    path = common.new_path(spark, "test-wide")
    token_files.write_token_files(big, path, token_files.WIDE)
    assert token_files.rank_table(spark, path).tolist() == [70_000, 99]
    assert got(token_files.read_token_files(spark, path), "__id", "start", "n_tokens", "ids_crc32") == [(1, 0, 3, zlib.crc32((70_000).to_bytes(4, "little") * 3)), (2, 3, 1, zlib.crc32((99).to_bytes(4, "little")))]


def test_codes_round_trip():
    import numpy as np

    ranks = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    control, codes = token_files.pack(ranks)
    assert len(control) == 3 and len(codes) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4 + 1
    assert (token_files.unpack(control, codes, len(ranks)) == ranks).all()


# 2
def test_language_id(spark, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in table.collect()}
    more = table.select("doc_id", "text", "lang").union(spark.createDataFrame([(-1, None, "en"), (-2, "12 ... 3", "en"), (-3, "", None), (None, "hello there", "en")], "doc_id long, text string, lang string"))
    out = language_id.identify(more).collect()
    assert len(out) == len(lang) + 4
    by = {r.doc_id: r for r in out}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    assert [by[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and by[None].lang_pred != "und"
    held = [r for r in out if r.held_out and r.doc_id >= 0 and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert language_id.identify(empty).count() == 0
    unknown = language_id.identify(frame(spark, [(1, "hello")]).withColumn("lang", F.lit(None).cast("string"))).first()
    assert unknown.lang_pred == "und"


def test_language_is_calibrated_on_held_out_rows(spark):
    """Log loss of the rows held out, and how far scores are from the share that is right."""
    import math

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 30")
    lang = {r.doc_id: r.lang for r in table.collect()}
    held = [(r.score, r.lang_pred == lang[r.doc_id]) for r in language_id.identify(table).collect() if r.held_out]
    loss = sum(-math.log(max(s if right else 1 - s, 1e-9)) for s, right in held) / len(held)
    assert loss < 0.15 and max(s for s, _ in held) < 1
    assert abs(sum(s for s, _ in held) / len(held) - sum(right for _, right in held) / len(held)) < 0.05


def test_many_languages_and_rare_letters(spark):
    """More languages than rows of the sample: each is learned; the last letters of Unicode are letters; ties and repeated rows."""
    many = 2500
    rows = spark.range(many).select(F.col("id").alias("doc_id"), F.concat(F.lit("zz "), F.col("id").cast("string")).alias("lang"), F.concat(F.lit("abc "), F.translate(F.col("id").cast("string"), "0123456789", "qwertyuiop")).alias("text"))
    rows = rows.union(spark.createDataFrame([(many, None, chr(0x31350)), (many + 1, None, LONG), (many + 1, None, LONG), (many + 2, None, chr(0x2EBF0) * 3)], "doc_id long, lang string, text string"))
    out = {r.doc_id: r for r in language_id.identify(rows).collect()}
    assert len(out) == many + 3 and "und" not in {r.lang_pred for r in out.values()}
    assert all(0 < r.score <= 1 for r in out.values())


# 3
ITEMS = [(1, "A train leaves Boston at 60 miles per hour and reaches the old station after 3 hours, how far did it travel"), (2, "too short"), (None, "x y z w v u t s"), (3, None), (4, "five words are quite enough")]


def test_decontamination(spark, empty):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    filler = "Nothing of note was said on that day by anyone in the room. "
    cases = {
        1: ITEMS[0][1], 2: f"{filler}{ITEMS[0][1].upper()} {filler}", 3: filler + ITEMS[0][1].replace("Boston", "Chicago").replace("60", "75").replace("3 hours", "4 hours"),
        4: f"{filler} Five words, are quite enough!", 5: filler * 20, 6: None, 7: "", 8: "not too short", 9: "A train leaves Boston at 60 miles", 10: LONG + " " + ITEMS[0][1],
    }
    hits = decontaminate.contaminated(frame(spark, [*cases.items(), (1, ITEMS[0][1]), (None, ITEMS[0][1])]), benchmark)
    assert got(hits, "__id", "items") == [(1, [1]), (2, [1]), (3, [1]), (4, [4]), (10, [1])]
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(frame(spark, list(cases.items())), benchmark.limit(0)).count() == 0


def test_slots_must_agree(spark):
    benchmark = spark.createDataFrame([(1, "if 5 apples cost 8 coins then what do 5 apples and 8 pears cost in all there")], "item_id long, text string")
    same = "if 6 apples cost 9 coins then what do 6 apples and 9 pears cost in all there"
    odd = "if 6 apples cost 9 coins then what do 7 apples and 9 pears cost in all there"
    assert got(decontaminate.contaminated(frame(spark, [(1, same), (2, odd)]), benchmark), "__id") == [(1,)]


def test_a_changed_slot_beside_a_copy_rejects_nothing(spark):
    text = "in one day the crew of that old ship could load every crate and barrel left on the long wooden pier before the next day began"
    sums = "if 5 apples cost 8 coins then what do 5 apples and 8 pears cost in all there"
    benchmark = spark.createDataFrame([(1, text), (2, sums)], "item_id long, text string")
    cases = [(1, text.replace("next day", "next week")), (2, sums.replace("5", "6").replace("8", "6")), (3, sums.replace("do 5", "do 7"))]
    hits = decontaminate.contaminated(frame(spark, cases), benchmark)
    assert got(hits, "__id", "items", "covered") == [(1, [1], 24), (2, [2], 18), (3, [2], 17)]


def test_a_short_item_is_found_inside_a_sentence(spark):
    benchmark = spark.createDataFrame([(1, "What is the capital of France?"), (2, "- Name the first king of all Norway and Sweden, please")], "item_id long, text string")
    cases = [
        (1, "- What is the capital of France?"), (2, "1) What is the capital of France?"), (3, "They asked (What is the capital of France?) twice"), (4, "Yes. What is the capital of France?"),
        (5, "and what is the capital of France?"), (6, "they say Paris is the capital of France, of course"), (7, "Well. Name the first king of all Norway and Sweden, please"), (8, "he said Name the first king of all Norway and Sweden, please"),
        (9, "We asked: - What is the capital of Spain?"),
    ]
    hits = decontaminate.contaminated(frame(spark, cases), benchmark)
    assert got(hits, "__id", "items") == [(1, [1]), (2, [1]), (3, [1]), (4, [1]), (5, [1]), (7, [2]), (8, [2]), (9, [1])]


def test_a_verbatim_item_is_found_in_any_writing(spark):
    """Names in every window: only their case, or the marks around them, differ."""
    text = "Ask whether Anna met Boris near Calais before Denis saw Elena leave Florence with Georg and Hannah for Innsbruck"
    benchmark = spark.createDataFrame([(1, text), (2, "What is 2+2?"), (3, "Straße nach Köln über Bonn")], "item_id long, text string")
    cases = [(1, text.lower()), (2, text.upper()), (3, f"- {text.title()}!"), (4, "so: what is 2+2? no"), (5, "well\nWHAT is 2+2\nfour"), (6, "STRASSE NACH KÖLN ÜBER BONN"), (7, text.replace("Boris", "boring").replace("Elena", "elephants"))]
    hits = decontaminate.contaminated(frame(spark, cases), benchmark)
    assert got(hits, "__id", "items") == [(1, [1]), (2, [1]), (3, [1]), (5, [2]), (6, [3])]


def test_decontamination_matches_the_plain_version(spark, base):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()] + [(90, "If Tom has 5 apples and Ann gives Tom 7 more apples how many has Tom got"), (91, "Yes or no?"), (92, ""), (93, None), (90, "the same id with other words in it for once")]
    draw, texts = random.Random(4), []
    for k in range(60):
        own = draw.choice(items[:41])[1].split()
        for _ in range(draw.randrange(4)):
            own[draw.randrange(len(own))] = draw.choice(["7", "Tom", "tom", "miles", "x"])
        lead = draw.choice(["", "he said ", "- ", "1) "])
        texts.append((20_000 + k, draw.choice([f"{lead}{' '.join(own)} and so on", " ".join(own).upper(), f"one\n{lead}{' '.join(own[: draw.randrange(1, len(own))])}\nYes or NO\nend"])))
    rows = base + texts + [(texts[0][0], "again"), (None, items[0][1])]
    hits = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    want = brute.contaminated(rows, items, decontaminate.canonical)
    assert {r["__id"]: (r["items"], r.covered) for r in hits.collect()} == want and len(want) > 30


def test_whole_items_in_texts_are_found(spark):
    import re

    plain = lambda t: " ".join(re.findall(r"[a-z0-9]+", (t or "").lower()))
    table, benchmark = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = [plain(r.text) for r in benchmark.collect()]
    holds = {r.doc_id for r in table.collect() if any(f" {i} " in f" {plain(r.text)} " for i in items if len(i.split()) >= 8)}
    hits = {r[0] for r in decontaminate.contaminated(table, benchmark).select("__id").collect()}
    assert holds <= hits and len(hits) <= len(holds) + 0.02 * table.count()


# 4
def test_quality_rules(spark, docs, rows, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").union(marks(spark, [(None, 1), (0, None), (-9, 0)]))
    out = quality_rules.judged(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r["__id"]: r for r in out}
    for i, text in rows:
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rules(text), i
        assert not (r.base_failed and r.kept)
    kept = quality_rules.kept_only(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in by if by[i].kept)
    assert all(r.kept != r.base_failed for r in quality_rules.judged(docs, marks(spark, [])).collect())
    assert quality_rules.judged(empty, labels).count() == 0


def test_isolation_forest_isolates():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = np.append(rng.normal(0, 1, 500), 9.0)
    forest = [quality_rules.grow(rows, (rows.min(), rows.max()), rng)]
    score = quality_rules.anomalies(forest, rows[:, None])[:, 0]
    assert score.argmax() == 500 and 0 < score.min() and score.max() < 1
    assert quality_rules.anomalies([quality_rules.grow(np.ones(5), (1.0, 1.0), rng)], np.ones((3, 1))).shape == (3, 1)


def test_a_rare_kind_of_junk_is_split_on(spark):
    """One document in 200,000 has its marks; the sample lacks it, the forest still reaches as far."""
    import numpy as np

    usual = {"word_length": 5.0, "symbol_rate": 0.0, "mark_rate": 0.0, "line_share": 0.0, "repeat_share": 0.0, "double_share": 0.0, "upper_share": 0.02}
    columns = [F.when(F.col("id") == 7, 0.9).otherwise(0.0).alias(r) if r == "mark_rate" else F.lit(v).alias(r) for r, v in usual.items()]
    stats = spark.range(200000).select(F.col("id").alias("__id"), *columns, *(F.col("id").alias(c) for c in quality_rules.COUNTS), F.lit(False).alias("base_failed"))
    forest = quality_rules.forest_of(stats)
    at = quality_rules.RULES.index("mark_rate")
    low, high = quality_rules.anomalies(forest, np.array([list(usual.values()), [0.9 if r == "mark_rate" else v for r, v in usual.items()]]))[:, at]
    assert high > low + 0.3


def test_thresholds_follow_the_labels(spark):
    """A statistic is held against labelled rows, and a second one only with what the first leaves."""
    rows = [(k % 10 != 0, [0.9 if k % 10 == 0 else 0.4, 0.9 if k % 10 == 0 or k % 7 == 0 else 0.4, *[0.4] * 5]) for k in range(400)]
    limits = quality_rules.thresholds(spark.createDataFrame(rows, "__good boolean, scores array<double>"))
    assert 0.4 < limits[0] <= 0.9 and not [x for x in limits[1:] if x < 1]


#: Two different words of 1,024 letters whose running polynomial hashes agree in every base modulo 2**64.
ABBA = ["".join("ab"[(i.bit_count() + flip) % 2] for i in range(1024)) for flip in (0, 1)]


def test_words_alike_to_a_polynomial_are_told_apart(spark):
    tail = " and ".join(["one", "two", "three", "four", "five", "six", "seven"])
    pairs = frame(spark, [(1, f"{ABBA[0]} {tail}"), (2, f"{ABBA[1]} {tail}"), (3, "\n".join(ABBA) + " " + tail), (4, f"{ABBA[0]} " * 3), (5, f"{ABBA[1]} " * 3)])
    want = brute.near([(r.doc_id, r.text) for r in pairs.collect()], 2)
    assert got(near_dedup.near_duplicates(pairs, 2), "__id", "n_shingles", "component_id", "kept") == want and want[4][2] == 5
    out = {r["__id"]: r for r in quality_rules.judged(pairs, marks(spark, [])).collect()}
    for r in pairs.collect():
        assert (out[r.doc_id].n_words, out[r.doc_id].n_dup_lines, out[r.doc_id].n_repeat_words) == tuple(brute.rules(r.text)[k] for k in (0, 3, 4))


# 5
def test_bpe(spark, docs, rows, empty):
    out = bpe.bpe_digests(docs, P.path("byte_bpe_50k.json"))
    assert got(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.bpe(rows, library("byte_bpe_50k.json"))
    codes = bpe.bpe_encode(docs, P.path("byte_bpe_50k.json"))
    assert got(bpe.bpe_decode(codes, P.path("byte_bpe_50k.json")), "__id", "text") == sorted((i, t or "") for i, t in rows)
    assert bpe.bpe_digests(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert bpe.bpe_digests(frame(spark, [(1, "a"), (1, "a"), (None, None)]), P.path("byte_bpe_50k.json")).count() == 3


def test_bytes_that_are_no_text(spark):
    """Invalid UTF-8 in a string column: U+FFFD in its place, in every operator."""
    odd = spark.createDataFrame([(1, bytearray(b"ab \xff\xfe cd")), (2, bytearray(b"end \xc3")), (3, bytearray(b"\xa9 begin of another text"))], "doc_id long, b binary").select("doc_id", F.expr("cast(b AS string)").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    want = [(1, "ab \ufffd\ufffd cd"), (2, "end \ufffd"), (3, "\ufffd begin of another text")]
    assert got(bpe.bpe_digests(odd), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.bpe(want, library("byte_bpe_50k.json"))
    assert got(token_counts.token_counts(odd, "piece_bpe_32k.model"), "doc_id") == [(1,), (2,), (3,)]
    assert {r["__id"]: r.n_words for r in quality_rules.counted(odd).collect()} == {1: 3, 2: 2, 3: 5}
    assert language_id.identify(odd).count() == 3
    path = common.new_path(spark, "test-odd")
    token_files.write_token_files(token_files.encode_tokens(odd, "word_bpe_49k.json", 1), path)
    assert got(token_files.read_token_files(spark, path), "__id", "start", "n_tokens", "ids_crc32") == brute.token_files(want, library("word_bpe_49k.json"))


# 6
@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, docs, rows, size, empty):
    assert got(near_dedup.near_duplicates(docs, size), "__id", "n_shingles", "component_id", "kept") == brute.near(rows, size)
    assert near_dedup.near_duplicates(empty, size).count() == 0


def test_components_take_links_by_name(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (9, 7)], "b long, a long")
    assert {tuple(r) for r in near_dedup.components(links).select("node", "label").collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}


def test_clusters_equal_components(spark):
    draw = random.Random(12)
    ties = [(a, draw.randrange(a)) for a in (draw.randrange(1, 400) for _ in range(260))] + [(500, 1), (500, 2), (501, 2), (501, 499)]
    df = spark.createDataFrame(ties, "a long, b long").distinct()
    assert got(near_dedup.clusters(df), "node", "label") == got(near_dedup.components(df), "node", "label")


def test_near_duplicates_of_an_absent_text(spark):
    """A group whose members are tied by chains or only look alike: the bounds may not lose a link."""
    draw, text = random.Random(5), [f"w{k}" for k in range(120)]
    own = []
    for i in range(160):
        copy = list(text)
        for _ in range(draw.choice([1, 2, 3, 4, 5, 6, 8])):
            k = draw.randrange(len(copy))
            copy[k : k + 1] = draw.choice([[], [f"u{draw.randrange(40)}"], [copy[k], f"v{i}"]])
        own.append((i, " ".join(copy)))
    want = brute.near(own, 2)
    assert 5 < len({c for *_, c, _ in want}) < 160
    assert got(near_dedup.near_duplicates(frame(spark, own), 2), "__id", "n_shingles", "component_id", "kept") == want


def test_near_duplicates_repeated_ids(spark):
    out = near_dedup.near_duplicates(frame(spark, [(2, "a b c d e f g"), (2, "a b"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, None)]), 2)
    assert sorted((str(r["__id"]), str(r.component_id), r.kept) for r in out.collect()) == [("1", "1", True), ("2", "1", False), ("2", "1", False), ("None", "None", True), ("None", "None", True)]


# 7
def test_token_counts(spark, docs, rows, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unknown = token_counts.read_pieces(P.path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(pieces, unknown, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    out = token_counts.token_counts(docs, P.path("piece_bpe_32k.model"))
    assert got(out, "doc_id", "n_tokens") == sorted((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    again = token_counts.token_counts(frame(spark, [(None, "a b"), (1, "a b"), (1, "a b"), (1, None)]), "piece_bpe_32k.model")
    assert sorted((str(r.doc_id), r.n_tokens) for r in again.collect()) == [("1", 0), ("1", 2), ("1", 2), ("None", 2)]
    assert token_counts.token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0


# 8
def test_chat_matches_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    out = registry.QUERIES["op8_chat"](spark, SF)
    want = con.sql(registry.ORACLES["op8_chat"])
    assert got(out, *want.columns) == sorted(want.fetchall())
    odd = [(1, 0, "user", None), (1, 1, "assistant", "<|end|>\n<|user|>\n&lt;&amp;"), (1, 2, "a|b<|>&bar;", "x"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, None, None, None), (3, 5, "assistant", "\U0001f600é")]
    spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    key = lambda rows: sorted(rows, key=str)
    assert key(tuple(r) for r in registry.QUERIES["op8_chat"](spark, str(tmp_path)).select(*want.columns).collect()) == key(con.sql(registry.ORACLES["op8_chat"]).fetchall())


def test_chat_folds_events(spark):
    e = [
        (1, 1, 0, "delta", "user", "hel"), (1, 2, 0, "delta", "user", "lo"), (1, 3, 1, "delta", "assistant", "bad"), (1, 4, 2, "delta", "user", "gone"), (1, 5, 1, "regenerate", "assistant", "go"), (1, 6, 1, "delta", "assistant", "od"),
        (1, 7, 3, "delta", "user", "new"), (2, 1, 0, "delta", "user", "a"), (2, 2, 0, "edit", "user", "b"), (2, 3, 0, "delta", "user", None), (2, 4, 0, "delta", "user", "c"),
    ]
    random.Random(3).shuffle(e)
    out = chat.fold_events(spark.createDataFrame(e, "conv long, seq long, message long, kind string, role string, text string"))
    assert got(out, "conv", "pos", "role", "text") == [(1, 0, "user", "hello"), (1, 1, "assistant", "good"), (1, 2, "user", "new"), (2, 0, "user", "bc")]


def test_chat_folds_any_log_as_the_plain_fold(spark):
    """Random logs with redeliveries, ties, events without numbers, null texts and roles, and an edit and a delta of one number."""
    draw, e = random.Random(9), []
    for conv in [None, *range(40)]:
        for seq in range(draw.randrange(1, 30)):
            own = (conv, draw.choice([seq, seq, seq, None]), draw.choice([None, 0, 1, 2, 3]), draw.choice(["delta"] * 6 + ["edit", "regenerate", None]), draw.choice(["user", "assistant", None]), draw.choice([f"t{seq} ", "", None]))
            e += [own] * draw.choice([1, 1, 2])
            if draw.random() < 0.1 and own[1] is not None:
                e.append((*own[:3], "edit", "user", "same number"))
    want = brute.fold(e)
    draw.shuffle(e)
    out = chat.fold_events(spark.createDataFrame(e, "conv long, seq long, message long, kind string, role string, text string"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)
    assert len(want) > 60
    assert chat.fold_events(spark.createDataFrame([], "conv long, seq long, message long, kind string, role string, text string")).count() == 0


def test_chat_log_of_turns(spark):
    """The log has every kind of event, and a very long text, ties, null turns and other columns of like names come back whole."""
    rows = [(1, k, "user" if k % 2 else "assistant", f"text {k} of some length", "x") for k in range(9)] + [(2, 1, None, LONG, "y"), (3, 0, "user", "b", "x"), (3, 0, "user", "a", "x"), (3, 0, "user", "a", "x"), (3, None, "user", "n", "x"), (3, 1, "assistant", "z", "x"), (None, 1 << 60, "user", "far", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string").withColumns({c: F.lit("k") for c in ("kind", "message", "conv", "pos")})
    log = chat.as_events(table)
    assert {r.kind for r in log.select("kind").collect()} == {"delta", "edit", "regenerate"}
    assert log.filter("seq IS NOT NULL").count() > log.filter("seq IS NOT NULL").select("conv", "seq").distinct().count()
    back = sorted(((r.conv, r.pos, r.role, r.text) for r in chat.fold_events(log).collect()), key=str)
    want, at = [], {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3])):
        want.append((conv, at.setdefault(conv, 0), role or "", text))
        at[conv] += 1
    assert back == sorted(want, key=str)


# 9
def test_line_dedup(spark, docs, rows, empty):
    want = brute.line_dedup(rows)
    out = line_dedup.line_dedup(docs)
    assert got(out, "row.doc_id", "n_lines", "n_dropped", "row.text") == sorted((i, *x) for i, x in want.items())
    assert out.select("row.*").columns == docs.columns
    assert line_dedup.line_dedup(empty).count() == 0
    line = "a line of more than twenty letters"
    again = line_dedup.line_dedup(frame(spark, [(None, line), (1, line), (1, f"x\n{line}"), (2, line), (2, line)]))
    assert sorted(r.row.text for r in again.collect()) == ["", "", line, line, "x"]


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = "a line of more than twenty letters"
    names = ["__drop", "__text", "__n_lines", "__id", "__tk", "row", "key", "body", "n_lines", "a.b"]
    rows = spark.createDataFrame([(i, f"{line}\n{i}", *[f"{n}{i}" for n in names]) for i in range(4)], ["doc_id", "text", *names])
    out = line_dedup.line_dedup(rows).select("row.*")
    assert out.columns == rows.columns
    assert sorted(tuple(r) for r in out.collect()) == [(i, f"{line}\n{i}" if i == 3 else str(i), *[f"{n}{i}" for n in names]) for i in range(4)]


def test_hot_and_other_lines_are_found_alike(spark, docs, monkeypatch):
    want = got(line_dedup.line_dedup(docs), "row.doc_id", "n_dropped", "row.text")
    monkeypatch.setattr(line_dedup, "HEAVY", 4)
    assert got(line_dedup.line_dedup(docs), "row.doc_id", "n_dropped", "row.text") == want


def test_line_dedup_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(registry.ORACLES["op9_line_dedup"])
    assert got(registry.QUERIES["op9_line_dedup"](spark, SF), *want.columns) == sorted(want.fetchall())


# 10
def test_cotraining(spark, empty):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in cotraining.classified(table, labels).collect()}
    assert len(out) == table.count() and all(0 <= r.score <= 1 for r in out.values())
    known = [(r.quality, out[r.doc_id].score) for r in labels.collect()]
    good, bad = [s for q, s in known if q == 1], [s for q, s in known if q == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.75 * len(good) * len(bad)
    odd = frame(spark, [(k, t) for k, t in enumerate(TEXTS)] + [(None, "x"), (1, ""), (1, "")]).withColumn("source", F.when(F.col("doc_id") > 3, "s"))
    assert {(r.score, r.kept) for r in cotraining.classified(odd, marks(spark, [(1, 1), (None, 0)])).collect()} == {(0.5, True)}
    assert cotraining.classified(odd, marks(spark, [(1, 1), (2, 0), (3, None), (5, 1), (6, 0)])).count() == len(TEXTS) + 3
    assert cotraining.classified(empty, marks(spark, [])).count() == 0


# pipeline
def test_pipeline_stages(spark, rows, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "decontaminate", "encode"]
    judged = {r["__id"] for r in quality_rules.judged(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
    texts = dict(rows)
    now, kept = docs, {i: texts[i] for i in judged}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = common.new_path(spark, f"test-{name}")
        stage(spark, now, SF).write.parquet(path)
        now = spark.read.parquet(path)
        if name == "lines":
            kept = {i: t for i, (_, _, t) in brute.line_dedup(kept.items()).items()}
        if name == "near":
            kept = {i: kept[i] for i, _, _, first in brute.near(kept.items(), 2) if first}
        if name == "decontaminate":
            hits = {r[0] for r in decontaminate.contaminated(frame(spark, kept.items()), spark.read.parquet(f"{SF}/benchmark.parquet")).select("__id").collect()}
            kept = {i: t for i, t in kept.items() if i not in hits}
        assert now.columns == docs.columns
        assert got(now, "doc_id", "text", "n_chars") == sorted((i, t, len(t or "")) for i, t in kept.items()), name
    assert got(corpus_pipeline.STAGES[-1][1](spark, now, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.bpe(kept.items(), library("byte_bpe_50k.json"))


def test_pipeline_on_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_repeated_ids_and_nothing_to_learn_from(spark, tmp_path):
    """Without labels and benchmark; rows of one id stay or go together, a null id stays, further columns pass."""
    one, other = (" ".join(f"{w}{k}" for k in range(40)) for w in ("first", "second"))
    rows = [(1, one), (1, one), (1, "short"), (2, f"{one} more"), (2, f"{one} more"), (None, one), (3, other), (4, None), (5, "")]
    docs = frame(spark, rows).withColumns({c: F.lit(c) for c in ("__id", "row", "body", "shingles")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns
    want = [(1, one), (1, one), (3, other), (None, one)]
    assert sorted(((r.doc_id, r.text) for r in now.collect()), key=str) == sorted(want, key=str)
    out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(brute.bpe(want[:3], library("byte_bpe_50k.json")) + brute.bpe(want[3:], library("byte_bpe_50k.json")), key=str)


def test_registered():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and all(isinstance(s, str) for s in registry.ORACLES.values())
    assert {k.split("_")[0] for k in registry.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert {*registry.QUERIES, "pipeline"} <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())
