"""Toxicity scores from a lexicon trie met by Levenshtein automata, with context windows.

The lexicon is learned from labelled training rows: words and word beginnings that toxic documents hold
far more often than clean ones. Its terms form a trie. The product of the trie with a Levenshtein
automaton (any term within one edit) is made deterministic as words are read, so a word costs one table
step per letter and most words leave the automaton after a few. Letters around a single digit or sign are read as one word too. A hit counts as quoted if its window of
words has quotation marks on both sides of it or a word of saying before a mark; a logistic model over counts of
exact, misspelled and quoted hits, and their share of the words, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..plans.session import spread
from .near_dedup import shingle_sets
from .store import Tables, named
from .words import mix, pieces

#: Labelled rows that the lexicon and the weights are fitted on at most (lowest hashes first); bounds what is broadcast and collected.
SAMPLE = 16_000
#: Beginnings in the lexicon at most, and whole words.
TERMS = 400
#: A term needs so much evidence, documents times relative entropy against the share of toxic ones: about 1 in 20 that any of a million unrelated ones passes.
EVIDENCE = 17.0
#: Least hashes of runs of words that sampled texts must share to count as copies; texts as alike as 0.85 share them with a chance of 0.6.
ALIKE = 3
#: Code points of the beginnings that may become terms.
SHORTEST, LONGEST = 4, 10
#: Words on either side of a hit that are looked at for quotation.
WINDOW = 8
#: A document is rejected from this score on.
THRESHOLD = 0.3
#: Words kept ready by a worker, and the longest kept: they bound what is held.
READY, READY_LETTERS = 200_000, 64
#: Terms that a worker counts before it sends them on.
COUNTED = 50_000
_LETTERS = re.compile(r"[^\W\d_]+")
_QUOTES = frozenset("\"“”«»„‟")
#: Words of saying; a hit after one of them and a quotation mark is reported speech.
_SAYING = frozenset("said says wrote writes called quoted quote reported sagte schrieb nannte dijo escribió llamó dit écrit appelé".split())
FEATURES = 6


class LexiconAutomaton:
    """Words against all terms at once: bit 1 for a term as (the beginning of) the word, bit 2 for a term one edit away from the whole word.

    The terms in ``words`` are whole words and no beginnings. A state is a set of (trie node, edits); its transitions are worked out when first taken.
    """

    def __init__(self, terms: Iterable[str], least_fuzzy: int = 5, words: Iterable[str] = ()) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.depth, self.ends, self.wholes = [0], [False], [False]
        begins = set(terms)
        for term in sorted(begins | set(words)):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.ends.append(False)
                    self.wholes.append(False)
                node = self.children[node][c]
            self.ends[node], self.wholes[node] = term in begins, True
        self.least_fuzzy = least_fuzzy
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.exact: list[bool] = []
        self.whole: list[bool] = []
        self.fuzzy: list[bool] = []
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, pairs: set) -> frozenset:
        """With the states that leave out one letter of a term."""
        return frozenset(pairs | {(child, 1) for node, edits in pairs if not edits for child in self.children[node].values()})

    def _number(self, pairs: frozenset) -> int:
        if pairs not in self.numbers:
            self.numbers[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.steps.append({})
            self.exact.append(any(not e and self.ends[n] for n, e in pairs))
            self.whole.append(any(not e and self.wholes[n] for n, e in pairs))
            self.fuzzy.append(any(e and self.wholes[n] and self.depth[n] >= self.least_fuzzy for n, e in pairs))
        return self.numbers[pairs]

    def _step(self, state: int, c: str) -> int:
        after = set()
        for node, edits in self.sets[state]:
            child = self.children[node].get(c)
            if child is not None:
                after.add((child, edits))
            if not edits:
                after.add((node, 1))
                after.update((other, 1) for other in self.children[node].values())
        self.steps[state][c] = number = self._number(self._closed(after))
        return number

    def match(self, word: str) -> int:
        state = self.start
        for c in word:
            following = self.steps[state].get(c)
            state = self._step(state, c) if following is None else following
            if self.exact[state]:
                return 1
            if not self.sets[state]:
                return 0
        return 1 if self.whole[state] else 2 if self.fuzzy[state] else 0


class Scorer:
    def __init__(self, terms: list[str], weights: list[float] | None = None, words: list[str] = ()) -> None:
        self.automaton = LexiconAutomaton(terms, words=words)
        self.weights = weights
        self.ready: dict[str, int] = {}

    def _code(self, run: str) -> int:
        code, run_ = 0, run.lower()
        parts = [m.span() for m in _LETTERS.finditer(run_)]
        for a, b in parts:
            code |= self.automaton.match(run_[a:b])
        if not code & 1:
            # A word one edit from a term, which is all letters, has one other character at most.
            for (a, b), (c, d) in zip(parts, parts[1:]):
                if c == b + 1:
                    code |= self.automaton.match(run_[a:d])
        if len(run) <= READY_LETTERS:
            if len(self.ready) >= READY:
                self.ready.clear()
            self.ready[run] = code
        return code

    def features(self, text: str) -> list[float]:
        """log counts of exact, misspelled, quoted exact and quoted misspelled hits; hits by words; distinct hit words."""
        ready, code = self.ready, self._code
        runs = text.split()
        codes = [ready[r] if r in ready else code(r) for r in runs]
        hits = [k for k, c in enumerate(codes) if c]
        counts = [0, 0, 0, 0]
        for k in hits:
            kind = 0 if codes[k] & 1 else 1
            counts[kind + 2 * self._quoted(runs, k)] += 1
        n = sum(counts[:2])
        distinct = len({runs[k].lower() for k in hits})
        return [*map(math.log1p, counts), math.log1p(100.0 * n / max(len(runs), 1)), math.log1p(distinct)]

    @staticmethod
    def _quoted(runs: list[str], k: int) -> bool:
        before, after = runs[max(0, k - WINDOW) : k], runs[k + 1 : k + 1 + WINDOW]
        own = runs[k]
        left = any(c in _QUOTES for r in before for c in r) or own[:1] in _QUOTES
        right = any(c in _QUOTES for r in after for c in r) or any(c in _QUOTES for c in own[-2:])
        said = any(r.strip(",:").lower() in _SAYING for r in before)
        return left and (right or said)

    def score(self, text: str) -> float:
        z = self.weights[-1] + sum(w * x for w, x in zip(self.weights, self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, toxic, text) with a mark that texts share whose ``ALIKE`` least hashes of runs of five words, over the whole text, are the same."""
    for batch in pieces(batches, 2, 1 << 20):
        sets, counts = shingle_sets(batch.column(2))
        marks, some = np.zeros(len(counts), np.uint64), np.flatnonzero(counts)
        if len(some):
            at = (np.cumsum(counts) - counts)[some]
            for k in range(1, ALIKE + 1):
                marks[some] = mix(marks[some] + np.minimum.reduceat(mix(sets ^ np.uint64(k)), at))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks.view(np.int64))], names=["_id", "_toxic", "text", "_same"])


def _beginnings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, whole, toxic, n): documents of each label that hold a whole word or a beginning; ``COUNTED`` are held at once."""
    counts: dict[tuple[bool, int], Counter] = {}

    def out():
        for (whole, toxic), own in counts.items():
            terms, numbers = pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())
            own.clear()
            yield pa.RecordBatch.from_arrays([terms, pa.array([whole] * len(terms), pa.bool_()), pa.array([toxic] * len(terms), pa.int32()), numbers], names=["term", "whole", "toxic", "n"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            words = set(_LETTERS.findall((text.as_py() or "").lower()))
            counts.setdefault((False, toxic), Counter()).update({w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)})
            counts.setdefault((True, toxic), Counter()).update(words)
            if sum(map(len, counts.values())) > COUNTED:
                yield from out()
    yield from out()


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int, most: int = TERMS) -> list[str]:
    """Terms by (documents) x (log odds), longer ones first among equals; what a chosen beginning covers, or extends, is left out."""
    scored = []
    for term, a, b in rows:
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        scored.append((-a * odds, -len(term), term))
    chosen: list[str] = []
    for _, _, term in sorted(scored):
        if len(chosen) < most and not any(term.startswith(t) or t.startswith(term) for t in chosen):
            chosen.append(term)
    return chosen


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.05) -> list[float]:
    """Logistic regression by Newton steps; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = ridge * np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[list[str], list[float], list[str]]:
    """(beginnings, weights, whole words) from at most ``sample`` labelled rows that aren't held out, with one text each."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).distinct().orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(sample)
    rows = [(r[0], int(r[1] != 0)) for r in chosen.collect()]
    tables = Tables(docs.sparkSession, "toxicity")
    # At most ``sample`` pairs of numbers, so the broadcast is bounded; the texts of those rows alone are kept.
    wanted = docs.sparkSession.createDataFrame(rows, chosen.schema)
    # Of sampled texts that share the least hashes of all their runs of five words (copies, mostly) one is fitted on, so that their words don't count as many documents; of texts of one id, one.
    met = docs.select(F.col(id_col).alias("_at"), F.col(text_col).alias("text")).join(F.broadcast(wanted), F.col("_at") == F.col("_id")).select("_id", "_toxic", "text")
    form = StructType([*met.schema.fields, StructField("_same", LongType())])
    texts = met.mapInArrow(_marked, form).groupBy("_same", "_toxic").agg(F.min(F.struct("_id", "text")).alias("one")).select("_toxic", "one.*")
    texts = tables.keep(texts.groupBy("_id", "_toxic").agg(F.min("text").alias("text")).select("text", "_toxic"))
    parted = texts.agg(F.sum("_toxic"), F.count(F.lit(1))).first()
    toxic, clean = parted[0] or 0, parted[1] - (parted[0] or 0)
    if not toxic or not clean:
        return [], [0.0] * FEATURES + [-30.0 if not toxic else 30.0], []
    counted = texts.mapInArrow(_beginnings, "term string, whole boolean, toxic int, n long").groupBy("term", "whole").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    share = toxic / (toxic + clean)
    evidence = F.col("a") * F.log(F.col("a") / (F.col("a") + F.col("b")) / share) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (F.col("a") + F.col("b")) / (1 - share))).otherwise(0.0)
    strong = tables.keep(counted.where((F.col("a") > 0) & (odds > 2) & (evidence >= EVIDENCE)))
    order = [(F.col("a") * odds).desc(), F.length("term").desc(), "term"]
    best = strong.where("NOT whole").orderBy(*order).limit(20 * TERMS)
    terms = choose_terms([(r.term, r.a, r.b) for r in best.collect()], toxic, clean)
    # Whole words that a beginning covers are kept: only the whole is one edit from its misspellings.
    words = [r.term for r in strong.where("whole").orderBy(*order).limit(TERMS).collect()]
    tables.drop(strong)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, words=words)
        for batch in batches:
            x = [scorer.features(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    measured = texts.mapInArrow(measure, "x array<double>, y int").collect()
    tables.drop(texts)
    return terms, fit_weights(np.array([r[0] for r in measured]), np.array([float(r[1] != 0) for r in measured])), words


def scorer_of(model: tuple[list[str], list[float], list[str]]):
    """A function of a text column that gives its scores: only texts go to Python, and only scores come back. Null texts are empty."""
    terms, weights, words = model

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(terms, weights, words)
        for batch in batches:
            yield pa.array([scorer.score(t.as_py() or "") for t in batch], pa.float64())

    return F.arrow_udf(run, DoubleType())


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Texts of any length are scored whole, repeated rows each; ties of equal evidence go to the longer term, then by code points; other columns are ignored, whatever their names; rows with a null id aren't used for fitting and aren't held out unless the empty text's remainder is 2;
    with no labels of both kinds the score is constant; no rows give no rows.
    """
    bare = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    scored = bare.select("id", scorer_of(fit(bare, labels.select(named(id_col).alias("id"), "toxic"), "id"))("text").alias("score"))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; columns may have any names."""
    bare = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    score = scorer_of(fit(bare, labels.select(named(id_col).alias("id"), "toxic"), "id"))
    return docs.where(score(named(text_col)) < THRESHOLD)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
