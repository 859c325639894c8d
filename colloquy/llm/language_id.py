"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become lower-case letters with one space for anything between them; n-grams of 1 to 3 characters
are hashed to ``FEATURES`` columns. Document frequencies cover all rows that may be learned from, in one
pass; each task sends one row for each feature it has seen. Weights come from follow-the-regularised-
leader (FTRL-proximal) with elastic-net penalties over a hash sample of those rows: the first rows by hash of each
language, ``SAMPLE`` rows in all, or one of each language where there are more. A quarter of the sample is set aside to fit
the temperature, by log loss against smoothed targets, so that a model without an error there doesn't become certain.

A prediction is the mean of its n-grams' weights, so a whole text, however long, takes one gather and sum. With many
languages the columns become fewer (``CELLS`` weights, and LEAST_FEATURES columns at least), and languages are summed in slices.

Defined cases: a null text or one without letters is ``und`` with score 0; null languages are not learned
from; without rows to learn from every text is ``und``; a null id is not held out and not learned from;
ties go to the language that sorts first; rows with one id are judged each; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import GOLDEN, blocks, broadcast_if_small, materialise, mix64, prepare
from colloquy.llm.quality_rules import LEADS, per_text

FEATURES, ORDERS = 1 << 15, (1, 2, 3)
#: Weights at most, unless there are over CELLS / LEAST_FEATURES languages; languages that are summed at once.
CELLS, LEAST_FEATURES, SLICE = 1 << 23, 1 << 10, 16
#: Rows that the classifier is fitted on, or one a language if these are more.
SAMPLE = 2048
#: FTRL: learning rate and its offset, L1 and L2 penalties; passes; what mean TF-IDF values are multiplied by.
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.3, 1.0, 0.02, 0.001, 3, 30.0
_tables: dict[str, np.ndarray] = {}


def letters_table() -> np.ndarray:
    """Each code point's lower-case letter, or a space for what is no letter."""
    if "letters" not in _tables:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            if (c := chr(i)).isalpha():
                table[i] = ord(low) if len(low := c.lower()) == 1 else i
        _tables["letters"] = table
    return _tables["letters"]


def characters(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters and single spaces of all texts, where each text's begin and the end)."""
    points = letters_table()[np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    sizes = per_text(LEADS[raw], at)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    keep[begins[:-1][begins[:-1] < len(points)]] = True
    return points[keep], np.concatenate([[0], np.cumsum(per_text(keep, begins))])


def ngrams(points: np.ndarray, at: np.ndarray, bits: int = 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (feature of each n-gram, one of 2**bits; where each text's begin and the end)."""
    wide = points.astype(np.uint64)
    for n in ORDERS:
        many = len(points) - n + 1
        if many <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(at), np.int64)
            continue
        h = np.full(many, n, np.uint64)
        for j in range(n):
            h = h * GOLDEN + wide[j : j + many]
        sizes = np.maximum(np.diff(at) - n + 1, 0)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.repeat(at[:-1] - ends[:-1], sizes) + np.arange(ends[-1])
        yield (mix64(h[inside]) >> np.uint64(64 - bits)).astype(np.int64), ends


def has_letters(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    return per_text(points != 32, at) > 0


def document_frequencies(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """(documents with each feature, documents) over the whole of ``docs`` (__text)."""
    features = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(features + 1, np.int64), np.zeros(features, bool)
        for _, raw, at in blocks(batches, "__text"):
            orders = list(ngrams(*characters(raw, at), bits))
            for k in range(len(at) - 1):
                for h, ends in orders:
                    seen[h[ends[k] : ends[k + 1]]] = True
                total[:-1] += seen
                seen[:] = False
            total[-1] += len(at) - 1
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], ["feature", "n"])

    out = np.zeros(features + 1, np.int64)
    for r in docs.select("__text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r.feature] = r.n
    return out[:-1], int(out[-1])


def sampled(docs: DataFrame, most: int) -> DataFrame:
    """The ids of the first rows by hash of each language, about as many of each: ``most`` in all, or one of each.

    Languages are counted and ranked as rows of tables; a language's rows beyond its share are passed over before they are ranked.
    """
    keys = docs.select("__lang", "__id", F.xxhash64("__id", F.lit("sample")).alias("order"))
    sizes = materialise(keys.groupBy("__lang").agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("least")), "languages")
    each = max(1, most // max(sizes.count(), 1))
    share = (F.least(F.lit(1.0), 2.0 * each / F.col("n") + 16.0 / F.col("n")) * (1 << 30)).cast("long")
    near = keys.join(broadcast_if_small(sizes), "__lang").filter((F.pmod("order", F.lit(1 << 30)) < share) | (F.col("order") == F.col("least")))
    first = F.row_number().over(Window.partitionBy("__lang").orderBy("order", "__id"))
    return materialise(near.withColumn("k", first).filter(F.col("k") <= each).select("__lang", "__id").distinct(), "language-sample")


def counted(docs: DataFrame, drawn: DataFrame, bits: int) -> list:
    """(__id, __lang, features, counts) of the rows drawn, one an id and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in blocks(batches, "__text"):
            orders = list(ngrams(*characters(raw, at), bits))
            for k in range(len(at) - 1):
                found, counts = np.unique(np.concatenate([h[e[k] : e[k + 1]] for h, e in orders]), return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_pydict({"__id": rows.column("__id").slice(k, 1), "__lang": rows.column("__lang").slice(k, 1), "features": pa.array([found.astype(np.int32)]), "counts": pa.array([counts.astype(np.int32)])})

    wanted = broadcast_if_small(drawn.select(F.col("__lang").alias("l"), F.col("__id").alias("i")))
    own = docs.join(wanted, (F.col("__lang") == F.col("l")) & (F.col("__id") == F.col("i")), "left_semi")
    kind = docs.schema["__id"].dataType.simpleString()
    made = own.mapInArrow(run, f"__id {kind}, __lang string, features array<int>, counts array<int>")
    one = made.groupBy("__id", "__lang").agg(F.min(F.struct("features", "counts")).alias("x")).select("__id", "__lang", "x.*")
    return one.orderBy(F.xxhash64("__id"), "__id", "__lang").collect()


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, features: int) -> np.ndarray:
    """Weights (features + 1 for the constant, classes) after ``EPOCHS`` passes of FTRL-proximal."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(z, n):
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for index, x, label in rows:
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[index] = zi + g - step * w
            n[index] = ni + g * g
    return weights(z, n)


def log_loss(logits: np.ndarray, labels: np.ndarray, temperature: float = 1.0, smooth: float = 0.0) -> float:
    """Mean log loss; ``smooth`` of each target is shared out among the other classes."""
    p = np.log(np.maximum(softmax(logits / temperature), 1e-300))
    right = p[np.arange(len(labels)), labels]
    others = (p.sum(1) - right) / max(p.shape[1] - 1, 1)
    return float(-((1 - smooth) * right + smooth * others).mean())


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """What to divide logits by, for the least log loss against targets that allow for one error more than were seen."""
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(50), 300))
    smooth = 1 / (len(labels) + 2)
    return float(grid[int(np.argmin([log_loss(logits, labels, t, smooth) for t in grid]))])


def fit(learn: DataFrame) -> tuple[list[str], np.ndarray] | None:
    """(languages, calibrated weights by feature and the constant's) from ``learn`` (__id, __text, __lang)."""
    drawn = sampled(learn, SAMPLE)
    many = drawn.select("__lang").distinct().count()
    if not many:
        return None
    features = max(LEAST_FEATURES, min(FEATURES, 1 << (CELLS // many).bit_length() - 1))
    bits = features.bit_length() - 1
    got = counted(learn, drawn, bits)
    langs = sorted({r["__lang"] for r in got})
    if not langs:
        return None
    df, n = document_frequencies(learn, bits)
    idf = np.log((1 + n) / (1 + df)) + 1
    number, rows = {lang: k for k, lang in enumerate(langs)}, []
    for r in got:
        index, tf = np.array(r.features), np.array(r.counts, float)
        x = np.append(tf / tf.sum() * idf[index] * SCALE, 1.0)
        rows.append((np.append(index, features), x, number[r["__lang"]]))
    apart = rows[3::4] if len(rows) >= max(8, 8 * len(langs)) else []  # rare languages keep all their rows
    weights = ftrl([r for k, r in enumerate(rows) if k % 4 != 3 or not apart], len(langs), features)
    logits = np.array([x @ weights[i] for i, x, _ in apart]).reshape(len(apart), len(langs))
    weights = weights / fit_temperature(logits, np.array([y for *_, y in apart], int))
    weights[:-1] *= (idf * SCALE)[:, None]
    return langs, weights.astype(np.float32)


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """__id, lang_pred, score of each row of ``docs`` (__id, __text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS floats, or LEAST_FEATURES a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights = shared.value or ([], np.zeros((FEATURES + 1, 0), np.float32))
        bits = (len(weights) - 1).bit_length() - 1
        names = np.array([*langs, "und"], object)
        for rows, raw, at in blocks(batches, "__text"):
            points, ends = characters(raw, at)
            sums, total = np.zeros((len(at) - 1, len(langs))), np.zeros(len(at) - 1)
            for h, own in ngrams(points, ends, bits):
                full = np.flatnonzero(np.diff(own))
                for a in range(0, len(langs) if len(full) else 0, SLICE):
                    sums[full, a : a + SLICE] += np.add.reduceat(weights[h, a : a + SLICE], own[:-1][full], axis=0, dtype=np.float64)
                total += np.diff(own)
            best, score = np.full(len(total), len(langs)), np.zeros(len(total))
            known = has_letters(points, ends)
            if langs and known.any():
                p = softmax(sums[known] / total[known, None] + weights[-1])
                best[known], score[known] = p.argmax(1), p.max(1)
            yield pa.RecordBatch.from_arrays([rows.column("__id"), pa.array(names[best], pa.string()), pa.array(score)], ["__id", "lang_pred", "score"])

    return docs.select("__id", "__text").mapInArrow(run, f"__id {docs.schema['__id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score of each document; held-out rows are never learned from."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
    learn = rows.filter(F.col("__id").isNotNull() & F.col("__lang").isNotNull() & F.col("__text").isNotNull() & ~held_out("__id"))
    return predicted(rows, fit(learn)).select(F.col("__id").alias(id_col), held_out("__id").alias("held_out"), "lang_pred", "score")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
