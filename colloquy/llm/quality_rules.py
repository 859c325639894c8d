"""Quality rules: counts by fixed rules, then an isolation forest over the rule statistics themselves.

Counts are made in one pass over the texts and stored (one narrow row a document); words, windows and lines
are compared as they are, not by hash alone. The forest has ``TREES`` trees for each statistic, each splitting
``TREE_ROWS`` values at random places; a document's score in a statistic falls with its mean path length. Trees
are grown on a hash sample of at most ``SAMPLE`` rows and, every one, on the ends of the statistic over all documents,
so they reach as far at every size of the corpus. Each statistic's threshold is the score that best separates bad
from good among *all* labelled rows, found on a histogram of scores, where a share of good ones lost counts
``GOOD_COST`` times as much as the same share of bad ones kept; statistics are taken in the order of what they gain
beside those before, and one that gains nothing rejects nothing.

Defined cases: a null or empty text has no words and fails the base rules; without both good and bad
labels the forest rejects nothing; labels that are null or have no document are left out; rows with one
id, or none, are judged each, and each counts for a label of that id; ties between thresholds keep more documents;
other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import GOLDEN, SPACE, blocks, materialise, mix64, prepare, texts_of, window_hashes
from colloquy.llm.memo import MOST_WORDS, Memo, held

#: The forest's bounds: rows of the sample, trees a statistic, rows a tree, and levels (log2 of the latter).
SAMPLE, TREES, TREE_ROWS, LEVELS = 8192, 64, 256, 8
BINS, GOOD_COST = 2000, 5.0
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
UPPER = np.isin(np.arange(256), list(range(65, 91)))
LETTER = UPPER | np.isin(np.arange(256), list(range(97, 123)))
MARKS = np.isin(np.arange(256), list(b"!?"))
#: Code points begin at bytes that are no UTF-8 continuation.
LEADS = (np.arange(256) & 0xC0) != 0x80
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_doubled"]


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def repeat_words(words: np.ndarray, first: np.ndarray, size: int = 5) -> np.ndarray:
    """Words of each text in windows of ``size`` words (here numbers, one a distinct word) that its text has twice or more."""
    windows, text = window_hashes(words.astype(np.uint64), first, size)
    at = np.flatnonzero(text >= 0)
    keys = mix64(windows[at] + text[at].astype(np.uint64) * GOLDEN)
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    x, y = at[same], at[same + 1]
    equal = text[x] == text[y]
    for j in range(size):
        equal &= words[x + j] == words[y + j]
    again = np.zeros(len(windows), bool)
    if equal.all():
        again[x] = again[y] = True
    else:  # two windows share a hash: compare the windows themselves
        seen: dict[tuple, int] = {}
        for i in at.tolist():
            j = seen.setdefault((int(text[i]), *words[i : i + size].tolist()), i)
            if j != i:
                again[i] = again[j] = True
    covered = np.zeros(len(words), bool)
    for j in range(size):
        covered[j : j + len(again)] |= again
    return per_text(covered, first)


def doubled_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text that equal the word before them."""
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][first[:-1] < len(words)]] = False
    return per_text(same, first)


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(lines that have a word, those of them equal to an earlier line) of each text."""
    full = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n, distinct = (np.fromiter(x, np.int64, len(texts)) for x in (map(len, full), (len(set(x)) for x in full)))
    return n, n - distinct


def rule_counts(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    texts = texts_of(raw, at)
    split = [t.split() for t in texts]
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
    known = held("rules", Memo)
    if known.full(MOST_WORDS):
        known.forget()
    words = known.rows([w for own in split for w in own])
    known.new.clear()
    solid = ~SPACE[raw]
    lines, dup = lines_of(texts)
    return {
        "n_words": np.diff(first),
        "word_chars": per_text(solid & LEADS[raw], at),
        "n_symbols": per_text(SYMBOLS[raw], at),
        "n_dup_lines": dup,
        "n_repeat_words": repeat_words(words, first),
        "n_lines": lines,
        "n_upper": per_text(UPPER[raw], at),
        "n_letters": per_text(LETTER[raw], at),
        "n_marks": per_text(MARKS[raw], at),
        "n_doubled": doubled_words(words, first),
    }


#: The rule statistics, which are the forest's features: letters a word, symbols and !? marks a word; shares of repeated
#: lines, of words in repeated windows, of words that double the one before, of capital letters.
RULES = ["word_length", "symbol_rate", "mark_rate", "line_share", "repeat_share", "double_share", "upper_share"]


def statistics(counts: dict[str, np.ndarray]) -> np.ndarray:
    """A row of RULES for each text, as they are; lengths over 40 and rates over 4 count as these."""
    words, lines, letters = (np.maximum(counts[k], 1).astype(float) for k in ("n_words", "n_lines", "n_letters"))
    rates = [np.minimum(counts["word_chars"] / words, 40), *(np.minimum(counts[k] / words, 4) for k in ("n_symbols", "n_marks"))]
    shares = [counts["n_dup_lines"] / lines, counts["n_repeat_words"] / words, counts["n_doubled"] / words, counts["n_upper"] / letters]
    return np.stack([*rates, *shares], 1)


def grow(values: np.ndarray, reach: tuple[float, float], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, mean path between them, one more) of TREES random trees over one statistic.

    A tree splits TREE_ROWS of ``values`` and the two ends of the corpus (``reach``) at random places. As it
    looks at one number, it is a step function; so is the mean of all of them.
    """
    steps = []
    for _ in range(TREES):
        own = np.sort(np.concatenate([values[rng.permutation(len(values))[:TREE_ROWS]], reach]))
        cuts, paths, todo = [], [], [(0, len(own), 0)]
        while todo:  # depth first, left before right, so cuts and paths come out in order
            low, high, depth = todo.pop()
            if depth < 0:
                cuts.append(low)
            elif depth == LEVELS or own[low] == own[high - 1]:
                paths.append(depth + usual_path(high - low))
            else:
                cut = rng.uniform(own[low], own[high - 1])
                middle = min(max(int(np.searchsorted(own, cut, "right")), low + 1), high - 1)
                todo += [(middle, high, depth + 1), (cut, 0, -1), (low, middle, depth + 1)]
        steps.append((np.array(cuts), np.array(paths)))
    edges = np.unique(np.concatenate([c for c, _ in steps]))
    inside = np.concatenate([[-np.inf], edges])  # an interval takes the values above its edge, up to the next
    return edges, np.mean([p[np.searchsorted(c, inside, "right")] for c, p in steps], 0)


def usual_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def anomalies(forest: list[tuple[np.ndarray, np.ndarray]] | None, rows: np.ndarray) -> np.ndarray:
    """A score from 0 to 1 for each text and statistic; the shorter the mean path, the higher."""
    if forest is None:
        return np.zeros(rows.shape)
    paths = np.stack([p[np.searchsorted(edges, rows[:, k], "left")] for k, (edges, p) in enumerate(forest)], 1)
    return 2.0 ** (-paths / max(usual_path(TREE_ROWS), 1.0))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id and the rule counts of each whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in blocks(batches, "__text"):
            counts = rule_counts(raw, at)
            yield pa.RecordBatch.from_arrays([rows.column("__id"), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], ["__id", *COUNTS])

    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return picked.mapInArrow(run, f"__id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def best_threshold(good: np.ndarray, bad: np.ndarray, cost: float = 1.0, of: tuple[int, int] | None = None) -> tuple[float, float]:
    """(gain, edge): the bin edge at and above which documents go, for most of (share of bad - cost * share of good) there.

    Shares are of all good and bad rows ``of`` which these are left; without any gain the edge is infinite.
    """
    n_good, n_bad = of or (int(good.sum()), int(bad.sum()))
    if not n_good or not n_bad:
        return 0.0, np.inf
    above = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0)
    gain = above(bad) / n_bad - cost * above(good) / n_good
    best = int(np.flatnonzero(gain == gain.max())[-1])
    return (float(gain[best]), best / BINS) if gain[best] > 0 else (0.0, np.inf)


def forest_of(stats: DataFrame) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """The forest over the rows of ``stats`` that pass the base rules: at most SAMPLE by hash, and the ends of all."""
    rows = stats.filter("NOT base_failed")
    ends = [f(r).alias(f"{n}_{r}") for r in RULES for n, f in (("low", F.min), ("high", F.max))]
    n = rows.agg(F.count(F.lit(1)).alias("n"), *ends).first()
    if not n["n"]:
        return None
    share, order = min(1.0, 0.9 * SAMPLE / n["n"]), F.xxhash64("__id", *COUNTS)
    drawn = rows.filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("__id", *COUNTS).limit(SAMPLE).select(*RULES).toPandas()
    rng = np.random.default_rng(7)
    return [grow(drawn[r].to_numpy(float), (n[f"low_{r}"], n[f"high_{r}"]), rng) for r in RULES]


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, list | None, np.ndarray]:
    """(__id, counts, base_failed and the scores of each document; the forest; the score of each statistic from which documents go)."""
    spark = docs.sparkSession
    stats = counted(docs, id_col, text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = statistics({c: batch.column(c).to_numpy() for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in made.T)], [*batch.schema.names, *RULES])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields)
    stats = materialise(stats.mapInArrow(measure, f"{kinds}, " + ", ".join(f"{r} double" for r in RULES)).withColumn("base_failed", base_failed()), "rule-counts")
    forest = forest_of(stats)
    shared = spark.sparkContext.broadcast(forest)  # TREES * TREE_ROWS steps a statistic at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = anomalies(shared.value, np.stack([batch.column(r).to_numpy() for r in RULES], 1))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(scores.reshape(-1)), len(RULES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "scores"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields)
    scored = materialise(stats.mapInArrow(run, f"{kinds}, scores array<double>"), "scored")
    marks = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__marked"), (F.col(label_col) == 1).alias("__good"))
    known = materialise(scored.filter("NOT base_failed").join(marks, F.col("__id") == F.col("__marked")).select("__good", "scores"), "known")
    return scored, forest, thresholds(known)


def thresholds(known: DataFrame) -> np.ndarray:
    """The score of each statistic from which documents go, from all labelled rows (__good, scores).

    The statistic that gains most comes first; the next ones count only what it leaves, until none gains.
    """
    limits, total = np.full(len(RULES), np.inf), None
    while True:
        left = known.filter(~odd(limits)).select("__good", F.posexplode("scores").alias("rule", "score"))
        bins = np.zeros((len(RULES), 2, BINS), np.int64)
        for r in left.groupBy("rule", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), "__good").count().collect():
            bins[r["rule"], int(r["__good"]), r["bin"]] = r["count"]
        total = total or (int(bins[0, 1].sum()), int(bins[0, 0].sum()))
        found = [best_threshold(b[1], b[0], GOOD_COST, total) if limits[k] == np.inf else (0.0, np.inf) for k, b in enumerate(bins)]
        gain, k = max((g, -k) for k, (g, _) in enumerate(found))
        if gain <= 0:
            return limits
        limits[-k] = found[-k][1]


def odd(limits: np.ndarray) -> Column:
    """Whether a document's scores reach any threshold."""
    reached = [F.col("scores")[k] >= F.lit(float(x)) for k, x in enumerate(limits) if np.isfinite(x)]
    return reduce(lambda a, b: a | b, reached, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """__id, the counts, base_failed, anomaly (the largest score against its threshold; 1 and more is rejected), kept of each document."""
    scored, _, limits = fitted(docs, labels, id_col, text_col, label_col)
    against = [F.col("scores")[k] / F.lit(float(x)) for k, x in enumerate(limits) if np.isfinite(x)]
    worst = F.greatest(F.lit(0.0), *against) if against else F.lit(0.0)
    return scored.withColumn("anomaly", worst).withColumn("kept", ~F.col("base_failed") & ~odd(limits)).drop("scores", *RULES)


def kept_only(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are; texts are counted again rather than shuffled."""
    _, forest, limits = fitted(docs, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in blocks(batches, text_col):
            counts = rule_counts(raw, at)
            bad = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
            yield rows.filter(pa.array(~bad & ~(anomalies(shared.value, statistics(counts)) >= limits).any(1)))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, the contract's counts, base_failed, kept, and the anomaly."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"]
    return judged(docs, labels).select(F.col("__id").alias("doc_id"), *columns)
