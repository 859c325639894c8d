"""A quality classifier by co-training two views of a document.

The text view sees the text's bytes alone: shares of hashed byte trigrams. The page view sees metadata alone:
source, language (or what columns are named) and the power of two of the length. Each is a naive Bayes model, whose
weights follow from counts of fixed size, so every pass over the corpus adds to it whatever it is sure of.

Both start from labelled rows. In each round both views score the whole corpus, and each teaches the other the unlabelled documents that it is
surest of: of each class the share ``TAUGHT``, in proportion to the classes, with all that score as the last of these; where it begins is read from a
histogram over all rows. What is taught weighs as much as the view is sure of it (its calibrated balanced odds, in ``LEVELS`` steps; a labelled row is one of full weight), so a view that
knows little teaches, and does little harm. Labelled rows set aside calibrate each view (Platt), and a view that has learned something takes it on only if its loss on these rows falls; without that a view
that knows little would spoil the other. It ends when neither view has learned anything. A document's log odds are those of both views
less the prior's, which both contain. The threshold for ``kept`` is the score that best separates all labelled rows,
over a histogram, at ``GOOD_COST`` (see quality_rules).

Bounds: at most ``LABELLED`` labelled ids for fitting, drawn by hash, two fifths of them for calibration. All else
covers all rows, and no pass shuffles texts. Metadata values are hashed to ``PAGE`` weights: of k values, one shares its weight
with another with a chance of k / PAGE at most. Counts are integers, so results don't depend on how rows are dealt out.

Defined cases: null texts and values are empty ones; labels that are null or without a document are left out,
and a document with several labels has the lowest; without both classes among the labels every score is 0.5 and
all are kept; where no row is unlabelled, each view is trained plainly; an empty text has an undecided text view; rows with
one id are scored each, and are each counted with its label; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import blocks, materialise, prepare
from colloquy.llm.quality_rules import BINS, GOOD_COST, best_threshold

LABELLED, ROUNDS, TAUGHT = 4096, 3, 0.05
#: Steps of a pseudo-label's weight; bins of the balanced log odds, and where they end.
LEVELS, ODDS_BINS, ODDS_END = 64, 1600, 8.0
#: Weights of the views: hashed trigrams, hashed metadata values.
TRIGRAMS, PAGE = 1 << 13, 1 << 18
#: Trigram shares are counted in these units, so that their sums are exact.
UNITS = 1 << 24
#: Odd multipliers of the trigram hash (fixed values).
TRI = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def trigrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte trigram, where each text's begin and the end)."""
    wide = raw.astype(np.uint32)
    n = max(len(raw) - 2, 0)
    h = wide[:n] * TRI[0] + wide[1 : n + 1] * TRI[1] + wide[2 : n + 2] * TRI[2]
    h ^= h >> np.uint32(15)
    h *= TRI[0]
    sizes = np.maximum(np.diff(at) - 2, 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.repeat(at[:-1] - ends[:-1], sizes) + np.arange(ends[-1])
    return (h[inside] >> np.uint32(32 - 13)).astype(np.int64), ends


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(scores: np.ndarray, y: np.ndarray, balanced: bool = False) -> tuple[float, float]:
    """Slope and constant that turn scores to log odds, by log loss; the slope is not negative. Balanced: both classes weigh the same."""
    if not len(y) or y.min() == y.max():
        return 0.0, 0.0
    n = np.array([(y <= 0.5).sum(), (y > 0.5).sum()], float)
    target = np.where(y > 0.5, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.where(y > 0.5, n.sum() / 2 / n[1], n.sum() / 2 / n[0]) if balanced else np.ones(len(y))
    scale = max(float(np.abs(scores).max()), 1e-9)
    s, at = scores / scale, np.zeros(2)
    for _ in range(500):
        p = sigmoid(at[0] * s + at[1])
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(h * s * s).sum() + 1e-6, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * s).sum(), g.sum()])
        at -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    if at[0] > 0:
        return at[0] / scale, at[1]
    prior = 0.5 if balanced else float(target.mean())
    return 0.0, float(np.log(prior / (1 - prior)))


def rows_of(docs: DataFrame, id_col: str, text_col: str, page_cols: tuple[str, ...], size_col: str) -> DataFrame:
    """(__id, __text, __page): the page view as an array of weights' numbers, one for each metadata column."""
    here = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in page_cols if c in docs.columns}
    size = F.col(size_col).cast("double") if size_col in docs.columns else F.char_length(text_col).cast("double")
    here["length"] = F.floor(F.log2(1 + F.greatest(F.coalesce(size, F.lit(0.0)), F.lit(0.0)))).cast("string")
    number: list[Column] = [F.pmod(F.xxhash64(F.lit(name), value), F.lit(PAGE)).cast("int") for name, value in here.items()]
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.array(*number).alias("__page"))


class Model:
    """Weights of both views and their calibrations (slope, constant): for being sure, and for the final odds."""

    def __init__(self, text: np.ndarray, page: np.ndarray):
        self.text, self.page = text, page
        self.sure = self.odds = ((0.0, 0.0), (0.0, 0.0))
        self.prior = 0.0
        #: By view, the bins from which on (up, or down) its documents are taught to the other, as good and as bad ones.
        self.good_from, self.bad_to = [ODDS_BINS, ODDS_BINS], [-1, -1]
        #: By view, the log loss of its calibrated odds on the rows set aside.
        self.loss = [np.inf, np.inf]
        #: By round, what the text view and the page view have taught: (good, bad).
        self.taught: list[list[tuple[int, int]]] = []

    def scores(self, h: np.ndarray, ends: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores of the text view (mean weight of the trigrams) and of the page view (sum of its weights)."""
        sizes, text = np.diff(ends), np.zeros(len(ends) - 1)
        full = np.flatnonzero(sizes)
        if len(full):
            text[full] = np.add.reduceat(self.text[h], ends[:-1][full]) / sizes[full]
        return text, self.page[page].sum(1)

    @staticmethod
    def of(counts: np.ndarray) -> "Model":
        """From counts (label, feature): trigram shares, metadata values, and at the end the documents of each view."""
        made = []
        for part, n, usual, whole in ((counts[:, :TRIGRAMS], counts[:, -2] * (UNITS // LEVELS), UNITS / TRIGRAMS, UNITS), (counts[:, TRIGRAMS:-2], counts[:, -1], LEVELS, 2 * LEVELS)):
            share = (part + usual) / (n + whole)[:, None]
            made.append(np.log(share[1]) - np.log(share[0]))
        return Model(*made)

    def said(self, h: np.ndarray, ends: np.ndarray, page: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By view, (label, weight) of each document: -1 and 0 where the view does not teach it."""
        out = []
        for k, (score, (a, b)) in enumerate(zip(self.scores(h, ends, page), self.sure, strict=True)):
            odds = score * a + b
            bins = odds_bins(odds)
            label = np.where((bins >= self.good_from[k]) & (odds > 0), 1, np.where((bins <= self.bad_to[k]) & (odds < 0), 0, -1))
            weight = np.where(label >= 0, np.rint(LEVELS * np.abs(2 * sigmoid(odds) - 1)), 0).astype(np.int64)
            out.append((np.where(weight > 0, label, -1), weight))
        return out


def odds_bins(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((odds + ODDS_END) * (ODDS_BINS / (2 * ODDS_END))), 0, ODDS_BINS - 1).astype(np.int64)


def set_limits(model: Model, rows: DataFrame, share_good: float) -> None:
    """Where each view's surest documents begin, from a histogram over all unlabelled ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now = np.zeros(2 * ODDS_BINS, np.int64), shared.value
        for part, raw, at in blocks(batches, "__text"):
            for k, (score, (a, b)) in enumerate(zip(now.scores(*trigrams(raw, at), page_rows(part)), now.sure, strict=True)):
                total += np.bincount(k * ODDS_BINS + odds_bins(score * a + b), minlength=2 * ODDS_BINS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], ["bin", "n"])

    histogram = np.zeros(2 * ODDS_BINS, np.int64)
    for r in rows.filter("__good IS NULL").select("__text", "__page").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # two histograms
        histogram[r["bin"]] = r["n"]
    for k, own in enumerate(histogram.reshape(2, -1)):
        most = TAUGHT * own.sum()
        above, below = np.cumsum(own[::-1])[::-1], np.cumsum(own)
        model.good_from[k] = int(np.flatnonzero(above >= most * share_good).max(initial=0)) if most else ODDS_BINS
        model.bad_to[k] = int(np.flatnonzero(below >= most * (1 - share_good)).min(initial=ODDS_BINS)) if most else -1


def page_rows(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("__page")
    return column.flatten().to_numpy().reshape(len(batch), -1)


def counted(rows: DataFrame, model: Model | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(counts (see Model.of) over ``rows`` (rows_of, and __good: 1, 0, null for unlabelled ones, which ``model`` judges), what each view taught)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # TRIGRAMS + PAGE weights
    width = TRIGRAMS + PAGE + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now = np.zeros((2, width + 2), np.int64), shared.value
        for part, raw, at in blocks(batches, "__text"):
            h, ends = trigrams(raw, at)
            page = page_rows(part)
            good = part.column("__good").fill_null(-1).to_numpy().astype(np.int64)
            full = np.where(good >= 0, LEVELS, 0)
            learns = [(good, full), (good, full)]
            if now is not None:
                said = now.said(h, ends, page)
                learns = [(np.where(good >= 0, good, label), np.where(good >= 0, full, weight)) for label, weight in reversed(said)]  # each view learns what the other says
                for k, (label, _) in enumerate(said):
                    for x in (0, 1):
                        total[x, width + k] += ((label == x) & (good < 0)).sum()
            sizes = np.diff(ends)
            for k, (label, weight) in enumerate(learns):
                for x in (0, 1):
                    took = np.flatnonzero(label == x)
                    total[x, width - 2 + k] += weight[took].sum()
                    if k:
                        total[x, TRIGRAMS : width - 2] += np.bincount(page[took].reshape(-1), np.repeat(weight[took], page.shape[1]), PAGE).astype(np.int64)
                    elif len(took):
                        inside = np.repeat(label == x, sizes)
                        units = np.repeat(np.rint(UNITS // LEVELS * weight / np.maximum(sizes, 1)), sizes)
                        total[x, :TRIGRAMS] += np.bincount(h[inside], units[inside], TRIGRAMS).astype(np.int64)
        label, feature = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int64()), pa.array(feature, pa.int64()), pa.array(total[label, feature])], ["label", "feature", "n"])

    out = np.zeros((2, width + 2), np.int64)
    got = rows.select("__text", "__page", "__good").mapInArrow(run, "label long, feature long, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("label").to_numpy(), got.column("feature").to_numpy()] = got.column("n").to_numpy()
    return out[:, :width], [(int(good), int(bad)) for bad, good in out[:, width:].T]


def raw_scores(rows: DataFrame, model: Model) -> DataFrame:
    """(__id, text, page): raw scores of both views."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in blocks(batches, "__text"):
            text, page = shared.value.scores(*trigrams(raw, at), page_rows(part))
            yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(text), pa.array(page)], ["__id", "text", "page"])

    return rows.select("__id", "__text", "__page").mapInArrow(run, f"__id {rows.schema['__id'].dataType.simpleString()}, text double, page double")


def drawn(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the distinct ids, by hash."""
    n = ids.count()
    share = int(min(1.0, 1.5 * most / max(n, 1)) * (1 << 30))
    order = F.xxhash64("__id", F.lit("draw"))
    return ids.filter(F.pmod(order, F.lit(1 << 30)) <= share).orderBy(order, "__id").limit(most)


def calibrate(model: Model, apart: DataFrame) -> None:
    """Fit the model's calibrations on the rows set aside: one mean score an id, LABELLED ids at most."""
    got = raw_scores(apart, model).join(apart.select("__id", "__good").distinct(), "__id").groupBy("__id", "__good").agg(F.avg("text").alias("text"), F.avg("page").alias("page")).orderBy("__id").collect()
    y = np.array([r["__good"] for r in got], float)
    views = [np.array([r[c] for r in got], float) for c in ("text", "page")]
    model.sure = tuple(platt(s, y, True) for s in views)
    model.odds = tuple(platt(s, y) for s in views)
    share = (y.sum() + 1) / (len(y) + 2)
    model.prior = float(np.log(share / (1 - share)))
    model.loss = [float(np.mean(np.logaddexp(0, np.where(y > 0.5, -1, 1) * (s * a + b)))) for s, (a, b) in zip(views, model.odds, strict=True)]


def better(now: Model, new: Model) -> Model:
    """Of each view the one with the smaller loss, with its calibration; ``now`` itself where both are its own."""
    if new.loss[0] >= now.loss[0] and new.loss[1] >= now.loss[1]:
        return now
    from_new = [b < a for a, b in zip(now.loss, new.loss, strict=True)]
    pick = lambda a, b: tuple(y if new_one else x for x, y, new_one in zip(a, b, from_new, strict=True))
    out = Model(*pick((now.text, now.page), (new.text, new.page)))
    out.sure, out.odds, out.loss, out.prior = pick(now.sure, new.sure), pick(now.odds, new.odds), list(pick(now.loss, new.loss)), now.prior
    return out


def fit(rows: DataFrame, marks: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """The calibrated model after ``rounds`` rounds, from ``rows`` (see rows_of) and ``marks`` (__id, good)."""
    ids = rows.select("__id").filter("__id IS NOT NULL").distinct()
    few = materialise(drawn(marks.join(ids, "__id", "left_semi"), LABELLED), "labelled")
    if few.agg(F.count_distinct("good").alias("n")).first()["n"] < 2:
        return None
    label = F.broadcast(few.select(F.col("__id").alias("__marked"), F.col("good").alias("__good"), (F.pmod(F.xxhash64("__id", F.lit("apart")), F.lit(5)) >= 3).alias("__apart")))  # LABELLED ids at most
    same = F.col("__id") == F.col("__marked")
    known = materialise(rows.join(label, same).drop("__marked"), "labelled-rows")
    teach, apart = known.filter("NOT __apart"), known.filter("__apart")
    if min(t.agg(F.count_distinct("__good").alias("n")).first()["n"] for t in (teach, apart)) < 2:
        teach = apart = known
    everything = rows.join(label, same, "left").filter("__apart IS NULL OR NOT __apart") if apart is not known else rows.join(label, same, "left")
    model = Model.of(counted(teach, None)[0])
    calibrate(model, apart)
    share_good = float(few.agg(F.avg("good")).first()[0])
    taught = []
    for _ in range(rounds):
        set_limits(model, everything, share_good)
        counts, said = counted(everything, model)
        taught.append(said)
        new, last = Model.of(counts), model
        calibrate(new, apart)
        model = better(model, new)
        if model is last:
            break
    model.taught = taught
    return model


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", page_cols: tuple[str, ...] = ("source", "lang"), size_col: str = "n_chars") -> DataFrame:
    """id, text_score, page_score, score, kept of each document."""
    spark = docs.sparkSession
    prepare(spark)
    rows = rows_of(docs, id_col, text_col, page_cols, size_col)
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.min(label_col) == 1).cast("int").alias("good"))
    model = fit(rows, marks)
    if model is None:
        half = F.lit(0.5)
        return rows.select(F.col("__id").alias(id_col), half.alias("text_score"), half.alias("page_score"), half.alias("score"), F.lit(True).alias("kept"))
    odds = [F.col(c) * F.lit(float(a)) + F.lit(float(b)) for c, (a, b) in zip(("text", "page"), model.odds, strict=True)]
    chance = lambda x: 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0))))
    scored = raw_scores(rows, model).select("__id", chance(odds[0]).alias("text_score"), chance(odds[1]).alias("page_score"), chance(odds[0] + odds[1] - F.lit(model.prior)).alias("score"))
    scored = materialise(scored, "scores")
    bins = np.zeros((2, BINS), np.int64)
    risk = F.least(F.floor((1 - F.col("score")) * BINS), F.lit(BINS - 1)).cast("int")
    for r in scored.join(marks, "__id").groupBy(risk.alias("bin"), "good").count().collect():
        bins[r["good"], r["bin"]] = r["count"]
    _, limit = best_threshold(bins[1], bins[0], GOOD_COST)
    return scored.select(F.col("__id").alias(id_col), "text_score", "page_score", "score", (risk / BINS < F.lit(limit)).alias("kept"))


def op10_cotraining(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, text_score, page_score, score, kept."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classified(docs, labels)
