"""Toxicity: Levenshtein automata on a lexicon trie, and context windows that tell quotation from abuse.

Lexicon. Terms are words that texts labelled toxic hold clearly more often than others: the lower end of a confidence
interval of the log odds, over distinct labelled texts, is a term's weight.

Matching. The terms are a trie. A word is read once by the product of the trie and the Levenshtein automata of all terms: a
state is a set of (trie node, errors so far), made when a text first leads there, and a whole block of words steps through the
table of states at once. A term of four to seven letters allows one error, a longer one two; a word matches the term with the fewest errors.

Context. A match is a mention, not a use, if it stands between quotation marks of its line that lie in its window, or if the window
has more words of report (said, called, the word, ...) than of address (you, ...). A window is ``WINDOW`` words to each side.

Score. Weights of distinct terms, by number of errors and use or mention, and their density enter a logistic regression, fitted on scores
made with lexicons of other folds, with class weights so that it speaks for all labelled rows.

Fitting takes at most ``SAMPLE`` labelled texts of each class, drawn by hash; class sizes are those of all labelled rows, and every
text is scored whole.

Defined cases: a null or empty text, or one without matches, has the score of no matches; without texts of both classes to learn from, all have
the smoothed share of the toxic ones (0.5 without any); labels that are null, held out or without a document are left out; rows with one id are scored each and
each learns the label of that id; equal texts count once, as toxic if one is; a null id is neither held out nor learned from; bytes that are no UTF-8 become U+FFFD; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import blocks, materialise, prepare
from colloquy.llm.memo import held

#: The fit's bounds: labelled texts of a class, terms, and the least number of toxic texts that hold a term.
SAMPLE, TERMS, SUPPORT = 4096, 1024, 3
#: How sure a term must be (standard deviations, and the log odds left after them).
SURE, ODDS = 2.0, 0.7
FOLDS, WINDOW, LONGEST = 4, 8, 40
#: States of the automaton that a worker holds; beyond it starts afresh.
MOST_STATES = 100_000
RIDGE = 1.0
#: Marks that stand for letters inside a word, quotation marks, and words around a mention or an address (fixed values).
INNER = "*@$'’"
QUOTES = '"“”„«»'
REPORT = "said says say saying called calls call calling named quote quoted quotes wrote writes word words term terms phrase slur insult insults reported according sagte sagt nannte genannt wort wörter zitat schrieb dit disait appelé mot mots terme citation écrit dijo dice llamó palabra palabras término cita escribió".split()
ADDRESS = "you your yours youre u ur yourself du dich dir dein deine ihr euch tu toi te ton ta tes vous votre tú ti tus usted ustedes eres".split()
FEATURES = 8
#: Kinds of matches are uses with 0, 1 and 2 errors, and mentions; what each counts beside an exact use, before the fit has seen how far it can be trusted.
MENTION = 3
DISCOUNTS = np.array([1.0, 0.8, 0.6, 1.0])


def character_table() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case form of each code point; 1 for letters and digits, 2 for marks inside words, else 0)."""
    low, kind = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.int8)
    for i in range(0x110000):
        if (c := chr(i)).isalnum():
            kind[i] = 1
            if len(x := c.lower()) == 1:
                low[i] = ord(x)
    kind[[ord(c) for c in INNER]] = 2
    return low, kind


_tables: list = []


@dataclass
class Words:
    """The words of several texts: lower-case code points, each word's start and end, each text's first word and one past the last, ends of lines and quotation marks."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    lines: np.ndarray
    quotes: np.ndarray

    def strings(self, which: np.ndarray) -> list[str]:
        whole = self.points.tobytes()
        return [whole[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]


def words_of(raw: np.ndarray, at: np.ndarray) -> Words:
    """Words are runs of letters, digits and marks for letters, without such marks at their ends."""
    if not _tables:
        _tables.extend(character_table())
    low, kind = _tables
    apart = np.insert(raw, at[1:-1], 10)  # so that no word or line spans two texts
    points = np.frombuffer(apart.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((apart & 0xC0) != 0x80)])
    begins = leads[at[:-1] + np.arange(len(at) - 1)]
    kinds = kind[points]
    word = np.zeros(len(points) + 2, bool)
    word[1:-1] = kinds > 0
    runs, stops = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    solid = np.flatnonzero(kinds == 1)
    if len(solid):
        a, b = np.searchsorted(solid, runs), np.searchsorted(solid, stops)
        some = a < b
        runs, stops = solid[a[some]], solid[b[some] - 1] + 1
    else:
        runs = stops = np.zeros(0, np.int64)
    quotes = np.flatnonzero(np.isin(points, [ord(c) for c in QUOTES]))
    return Words(low[points], runs, stops, np.append(np.searchsorted(runs, begins), len(runs)), np.flatnonzero(points == 10), quotes)


def errors_allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 8 else 2


class Automaton:
    """All Levenshtein automata of ``terms`` at once, as a table of states that grows with what it reads."""

    def __init__(self, terms: list[str], fuzzy: bool = True):
        self.allowed = [errors_allowed(len(t)) if fuzzy else 0 for t in terms]
        self.children: list[dict[int, int]] = [{}]
        self.term, self.reach = [-1], [0]
        self.letters = {ord(c): n for n, c in enumerate(sorted({c for t in terms for c in t}), 1)}
        for n, t in enumerate(terms):
            node = 0
            self.reach[0] = max(self.reach[0], self.allowed[n])
            for c in t:
                symbol = self.letters[ord(c)]
                if symbol not in self.children[node]:
                    self.children[node][symbol] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.reach.append(0)
                node = self.children[node][symbol]
                self.reach[node] = max(self.reach[node], self.allowed[n])
            self.term[node] = n
        self.known = np.array(sorted(self.letters), np.uint32)
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {(): 0}
        self.sets: list[tuple] = [()]
        self.table = np.full((1 << 10, len(self.letters) + 1), -1, np.int32)
        self.table[0] = 0
        self.best, self.errors = np.full(1 << 10, -1, np.int32), np.full(1 << 10, -1, np.int8)
        self.start = self.state({0: 0})

    def state(self, items: dict[int, int]) -> int:
        """The number of the state with these nodes (their fewest errors), after leaving out letters of terms where errors allow."""
        todo = list(items)
        while todo:
            node = todo.pop()
            e = items[node] + 1
            for child in self.children[node].values():
                if e <= self.reach[child] and e < items.get(child, 9):
                    items[child] = e
                    todo.append(child)
        key = tuple(sorted(items.items()))
        n = self.states.get(key)
        if n is None:
            n = self.states[key] = len(self.sets)
            self.sets.append(key)
            if n == len(self.table):
                grown = np.full((2 * n, self.table.shape[1]), -1, np.int32)
                grown[:n] = self.table
                self.table = grown
                self.best, self.errors = np.append(self.best, np.full(n, -1, np.int32)), np.append(self.errors, np.full(n, -1, np.int8))
            ends = [(e, self.term[node]) for node, e in key if self.term[node] >= 0 and e <= self.allowed[self.term[node]]]
            if ends:
                self.errors[n], self.best[n] = min(ends)
        return n

    def step(self, state: int, symbol: int) -> int:
        items: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e < self.reach[node] and e + 1 < items.get(node, 9):
                items[node] = e + 1  # a letter too many
            for letter, child in self.children[node].items():
                cost = e if letter == symbol else e + 1
                if cost <= self.reach[child] and cost < items.get(child, 9):
                    items[child] = cost
        return self.state(items)

    def match(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word the term with the fewest errors (of equal ones the first), or -1, and the errors."""
        if len(self.sets) > MOST_STATES:
            self.reset()
        at = np.minimum(np.searchsorted(self.known, words.points), max(len(self.known) - 1, 0))
        symbols = np.where(self.known[at] == words.points, at + 1, 0) if len(self.known) else np.zeros(len(words.points), np.int64)
        term, errors = np.full(len(words.starts), -1, np.int32), np.full(len(words.starts), -1, np.int8)
        live, place = np.arange(len(words.starts)), words.starts.copy()
        state = np.full(len(live), self.start, np.int32)
        while len(live):
            symbol = symbols[place]
            after = self.table[state, symbol]
            if len(new := np.flatnonzero(after < 0)):
                pairs, back = np.unique(state[new].astype(np.int64) * self.table.shape[1] + symbol[new], return_inverse=True)
                made = np.array([self.step(int(p) // self.table.shape[1], int(p) % self.table.shape[1]) for p in pairs], np.int32)
                self.table[pairs // self.table.shape[1], pairs % self.table.shape[1]] = made
                after[new] = made[back]
            place = place + 1
            ended = place >= words.ends[live]
            done = live[ended]
            term[done], errors[done] = self.best[after[ended]], self.errors[after[ended]]
            more = ~ended & (after != 0)
            live, place, state = live[more], place[more], after[more]
        return term, errors


def mentions(words: Words, hits: np.ndarray, cues: np.ndarray) -> np.ndarray:
    """Whether each of the words ``hits`` is quoted or spoken about; ``cues`` is 1 for words of report, -1 for words of address."""
    text = np.searchsorted(words.first, hits, "right") - 1
    low, high = np.maximum(hits - WINDOW, words.first[text]), np.minimum(hits + WINDOW + 1, words.first[text + 1])
    sums = np.concatenate([[0], np.cumsum(cues)])
    spoken_about = sums[high] - sums[low] > 0
    if not len(words.quotes):
        return spoken_about
    line = np.searchsorted(words.lines, words.starts[hits])
    begins = np.where(line > 0, words.lines[np.maximum(line - 1, 0)] if len(words.lines) else 0, -1)
    before = np.searchsorted(words.quotes, words.starts[hits])
    odd = (before - np.searchsorted(words.quotes, begins)) % 2 == 1
    opening = words.quotes[np.maximum(before - 1, 0)]
    closing = words.quotes[np.minimum(before, len(words.quotes) - 1)]
    closed = (before < len(words.quotes)) & (np.searchsorted(words.lines, closing) == line) & (closing >= words.ends[hits])
    near = (opening >= words.starts[low] - 1) & (closing <= words.ends[high - 1])
    return spoken_about | (odd & closed & near)


class Scorer:
    """Matches of a lexicon in blocks of texts, as features."""

    def __init__(self, terms: list[str], weights: np.ndarray):
        self.lexicon, self.weights = Automaton(terms), np.asarray(weights, np.float64)
        self.cues = Automaton([*REPORT, *ADDRESS], fuzzy=False)
        self.sides = np.array([1] * len(REPORT) + [-1] * len(ADDRESS) + [0], np.int64)

    def features(self, words: Words) -> np.ndarray:
        """For each text the logs of summed weights of distinct terms, their number, and all matches a hundred words (uses, with errors at a discount); how much
        of each is due to matches with errors, and of the weights to those with two; and the weights of mentions.
        """
        n = len(words.first) - 1
        out = np.zeros((n, FEATURES))
        if not len(self.weights) or not len(words.starts):
            return out
        term, errors = self.lexicon.match(words)
        hits = np.flatnonzero(term >= 0)
        if not len(hits):
            return out
        cues = self.sides[self.cues.match(words)[0]]
        kind = np.where(mentions(words, hits, cues), MENTION, errors[hits])
        text = np.searchsorted(words.first, hits, "right") - 1
        keys = np.unique((text * 4 + kind) * len(self.weights) + term[hits])  # a term counts once for each kind
        own, group = keys % len(self.weights), keys // len(self.weights)
        sums = np.zeros((3, n, 4))  # weights, distinct terms and matches, by kind
        np.add.at(sums[0], (group // 4, group % 4), self.weights[own])
        np.add.at(sums[1], (group // 4, group % 4), 1)
        np.add.at(sums[2], (text, kind), 1)
        sums[2] *= 100 / np.maximum(np.diff(words.first), 1)[:, None]
        sums *= DISCOUNTS
        with_errors = np.log1p(np.cumsum(sums, axis=2))[:, :, :3]  # exact ones, then those with up to 1 and 2 errors too
        out[:, :3] = with_errors[:, :, 2].T
        out[:, 3:6] = (with_errors[:, :, 2] - with_errors[:, :, 0]).T
        out[:, 6] = with_errors[0, :, 2] - with_errors[0, :, 1]
        out[:, 7] = np.log1p(sums[0, :, MENTION])
        return out


@dataclass
class Model:
    terms: list[str]
    weights: list[float]
    coefficients: list[float]
    share: float


def own_name(model: object) -> str:
    """What a worker remembers this model's automata by: another model, in a later job of the same worker, has another name."""
    return f"toxicity-{sha256(pickle.dumps(model)).hexdigest()}"


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drawn(known: DataFrame) -> DataFrame:
    """At most ``SAMPLE`` of the ids (__id, y) of each class, by hash."""
    order = F.xxhash64("__id", F.lit("toxicity"))
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    parts = []
    for y in (0, 1):
        share = int(min(1.0, 1.5 * SAMPLE / max(sizes.get(y, 0), 1)) * (1 << 30))
        parts.append(known.filter((F.col("y") == y) & (F.pmod(order, F.lit(1 << 30)) <= share)).orderBy(order, "__id").limit(SAMPLE))
    return parts[0].unionByName(parts[1])


def term_weights(held1: np.ndarray, held0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """The lower end of the log odds of a term that so many of the texts of each class hold; 0 for one that is no term."""
    a, b = held1 + 0.5, held0 + 0.5
    low = np.log(a / (n1 + 1)) - np.log(b / (n0 + 1)) - SURE * np.sqrt(1 / a + 1 / b)
    return np.where((held1 >= SUPPORT) & (low > ODDS), low, 0.0)


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, a0.., b0..): of toxic and other texts of each fold, how many hold the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in blocks(batches, "__text"):
            words = words_of(raw, at)
            fine = np.flatnonzero((words.ends - words.starts >= 3) & (words.ends - words.starts <= LONGEST))
            text = np.searchsorted(words.first, fine, "right") - 1
            pairs = sorted(set(zip(text.tolist(), words.strings(fine), strict=True)))
            y, fold = rows.column("y").to_pylist(), rows.column("fold").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([w for _, w in pairs], pa.string()), pa.array([y[t] for t, _ in pairs], pa.int32()), pa.array([fold[t] for t, _ in pairs], pa.int32())], ["word", "y", "fold"])

    pairs = sample.select("__text", "y", "fold").mapInArrow(run, "word string, y int, fold int")
    sums = [F.count_if((F.col("y") == y) & (F.col("fold") == f)).alias(f"{side}{f}") for side, y in (("a", 1), ("b", 0)) for f in range(FOLDS)]
    return pairs.groupBy("word").agg(*sums)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each halved until the loss falls; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, keep = np.zeros(x.shape[1]), np.array([RIDGE] * (x.shape[1] - 1) + [1e-6])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (keep * b * b).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (p - y)) + keep * beta)
        share, before = 1.0, loss(beta)
        while share > 1e-6 and loss(beta - share * step) > before:
            share /= 2
        beta = beta - share * step
        if np.abs(share * step).max() < 1e-8 or share <= 1e-6:
            break
    return beta


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """A model from the labels (__id, y) of ``rows`` (__id, __text) that are not held out."""
    known = labels.filter(F.col("__id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("__id"))).select("__id", F.col("y").cast("int").alias("y")).distinct()
    known = materialise(known.join(rows.select("__id").distinct(), "__id", "left_semi"), "toxic-labels")
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    none = Model([], [], [], (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1))
    if len(sizes) < 2:
        return none
    ids = materialise(drawn(known), "toxic-sample-ids")
    sample = rows.join(F.broadcast(ids), "__id").groupBy("__text").agg(F.max("y").alias("y"))  # 2 * SAMPLE ids
    sample = materialise(sample.withColumn("fold", F.pmod(F.xxhash64("__text"), F.lit(FOLDS)).cast("int")).repartition(16), "toxic-sample")
    per_fold = {(r.y, r.fold): r["count"] for r in sample.groupBy("y", "fold").count().collect()}
    n1, n0 = (np.array([per_fold.get((y, f), 0) for f in range(FOLDS)], np.float64) for y in (1, 0))
    counts = word_counts(sample)
    a, b = (sum((F.col(f"{side}{f}") for f in range(FOLDS)), F.lit(0)) for side in "ab")
    low = F.log((a + 0.5) / F.lit(n1.sum() + 1)) - F.log((b + 0.5) / F.lit(n0.sum() + 1)) - SURE * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    found = counts.withColumn("low", low).filter((a >= SUPPORT) & (F.col("low") > ODDS)).orderBy(F.desc("low"), "word").limit(TERMS).collect()
    words = [r.word for r in found]
    held1, held0 = (np.array([[r[f"{side}{f}"] for f in range(FOLDS)] for r in found], np.float64).reshape(-1, FOLDS) for side in "ab")
    lexicons = []
    for f in range(FOLDS):
        weights = term_weights(held1.sum(1) - held1[:, f], held0.sum(1) - held0[:, f], n1.sum() - n1[f], n0.sum() - n0[f])
        lexicons.append(([w for w, x in zip(words, weights, strict=True) if x > 0], weights[weights > 0]))

    name = own_name(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = held(name, lambda: [Scorer(*own) for own in lexicons])
        for part, raw, at in blocks(batches, "__text"):
            read, fold = words_of(raw, at), part.column("fold").to_numpy()
            x = np.zeros((len(part), FEATURES))
            for f in range(FOLDS):
                if (fold == f).any():
                    x[fold == f] = scorers[f].features(read)[fold == f]
            yield pa.RecordBatch.from_arrays([part.column("y"), *[pa.array(c) for c in x.T]], ["y", *(f"x{k}" for k in range(FEATURES))])

    table = sample.select("__text", "y", "fold").mapInArrow(run, "y int, " + ", ".join(f"x{k} double" for k in range(FEATURES))).toPandas()  # 2 * SAMPLE rows
    y = table["y"].to_numpy()
    if len(set(y)) < 2:
        return none
    weight = np.where(y == 1, sizes[1] / max((y == 1).sum(), 1), sizes[0] / max((y == 0).sum(), 1))
    weight = weight * len(y) / weight.sum()
    beta = logistic(table.drop(columns="y").to_numpy(), y, weight)
    weights = term_weights(held1.sum(1), held0.sum(1), n1.sum(), n0.sum())
    return Model([w for w, x in zip(words, weights, strict=True) if x > 0], weights[weights > 0].tolist(), beta.tolist(), none.share)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """(__id, score) of each row of ``rows`` (__id, __text)."""
    name = own_name(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(name, lambda: Scorer(model.terms, np.array(model.weights)))
        for part, raw, at in blocks(batches, "__text"):
            if model.coefficients:
                x = scorer.features(words_of(raw, at)) @ np.array(model.coefficients[:-1]) + model.coefficients[-1]
                p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            else:
                p = np.full(len(part), model.share)
            yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(p, pa.float64())], ["__id", "score"])

    return rows.select("__id", "__text").mapInArrow(run, f"__id {rows.schema['__id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: float = 0.7) -> DataFrame:
    """id, held_out, score, predicted of each row of ``docs``; rows held out are never learned from."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    model = fit(rows, labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("y")))
    score = F.col("score")
    return scored(rows, model).select(F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), "score", (score >= limit).cast("int").alias("predicted"))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return toxicity(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
