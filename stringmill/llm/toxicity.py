"""Toxicity: a learned lexicon, misspellings by Levenshtein automata, scores in context.

The lexicon is learned from labelled documents: terms seen in enough different
contexts in toxic documents and almost never in others.  (Different
neighbours, not documents, are counted: a passage copied many times has one context.)  All terms form a trie.
The Levenshtein automata of all terms, intersected with that trie, are run as one
automaton over a word's letters; its deterministic states are made when a word first
needs them.  Each hit is weighed in its window of words: hits inside quotation marks
count apart from those outside, and hits close to one another add up.  A small
logistic model over these scores, fitted on the same labels, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bounds of the labelled documents that lexicon and model are learned from.
MAX_TOXIC, MAX_OTHER = 6_000, 12_000
MIN_CONTEXTS = 4
MIN_PRECISION = 0.8
#: A word near to a term is no misspelling if less than this share of its uses is toxic.
HARMLESS_SHARE = 0.5
#: Chance, over all candidates together, that a word of no meaning becomes a term.
CHANCE = 0.01
#: Words on either side of a hit that belong to its context.
WINDOW = 10
#: Edits allowed in a term, by its length: from 5 letters one, from 10 two.
EDITS = ((10, 2), (5, 1))
MAX_STATES = 100_000
MAX_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+", re.UNICODE)
_QUOTES = '"“”«»„'
_MARK_OR_WORD = re.compile(rf"([^\W_]+)|[{_QUOTES}\n]")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def allowed_edits(term: str) -> int:
    return next((k for n, k in EDITS if len(term) >= n), 0)


class Automaton:
    """All terms' Levenshtein automata, cut with the trie of the terms.

    A state is the set of (trie node, least edits so far).  ``match`` gives the term
    with the fewest edits (ties: the first term in order) and those edits, or None.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.most: list[int] = [0]  # edits that some term below the node allows
        self.terms = sorted(terms)
        for k, t in enumerate(self.terms):
            node, e = 0, allowed_edits(t)
            self.most[0] = max(self.most[0], e)
            for ch in t:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.most.append(0)
                node = nxt
                self.most[node] = max(self.most[node], e)
            self.term[node] = k
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.hit: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The state of these nodes and all that leaving out letters of terms reaches; -1 if there are none."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and nodes.get(child, 99) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= allowed_edits(self.terms[self.term[n]])]
            self.hit.append(min(ends) if ends else None)
        return self.ids[key]

    def _step(self, state: int, ch: str) -> int:
        nodes: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.most[node] and nodes.get(node, 99) > e:
                nodes[node] = e

        for node, e in self.sets[state]:
            put(node, e + 1)
            for letter, child in self.children[node].items():
                put(child, e if letter == ch else e + 1)
        return self._state(nodes)

    def match(self, word: str) -> tuple[str, int] | None:
        if len(self.sets) > MAX_STATES:
            self._reset()
        state, table = self.start, self.next
        for ch in word:
            nxt = table[state].get(ch)
            if nxt is None:
                nxt = table[state][ch] = self._step(state, ch)
            if nxt < 0:
                return None
            state = nxt
        got = self.hit[state]
        return None if got is None else (self.terms[got[1]], got[0])


#: Scores of a text in context; ``FEATURES`` names them.
FEATURES = ("exact", "exact_kinds", "exact_dense", "near", "near_dense", "quoted", "quoted_near")


@dataclass
class Lexicon:
    """Terms with weights, and words near to a term that good documents use as well."""

    weights: dict[str, float]
    harmless: frozenset[str] = frozenset()
    automaton: Automaton | None = None
    known: dict[str, tuple[float, int] | None] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "harmless": self.harmless, "automaton": None, "known": {}}

    def look_up(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the term that the word is or misspells."""
        if word in self.weights:
            return self.weights[word], 0
        if word in self.harmless or len(word) < 4:
            return None
        self.automaton = self.automaton or Automaton(list(self.weights))
        got = self.automaton.match(word)
        return None if got is None else (self.weights[got[0]], got[1])

    def features(self, text: str | None) -> list[float]:
        known = self.known
        if len(known) > MAX_WORDS:
            known.clear()
        text = (text or "").lower()  # words and quotation marks are both found here, since lower case may be longer
        words = _WORD.findall(text)
        new = set(words).difference(known)
        for w in new:
            known[w] = self.look_up(w)
        out = [0.0] * len(FEATURES)
        hits = [(k, known[w], w) for k, w in enumerate(words) if known[w] is not None]
        if not hits:
            return out
        inside = self._quoted(text, [k for k, _, _ in hits])
        for kind, exact in ((0, True), (3, False)):
            own = [(k, h[0]) for (k, h, _), q in zip(hits, inside) if (h[1] == 0) == exact and not q]
            out[kind] = sum(w for _, w in own)
            dense, low = 0.0, 0
            total = 0.0
            for k, w in own:
                total += w
                while own[low][0] < k - 2 * WINDOW:
                    total -= own[low][1]
                    low += 1
                dense = max(dense, total)
            out[2 if exact else 4] = dense
        out[1] = float(len({w for (_, h, w), q in zip(hits, inside) if h[1] == 0 and not q}))
        for (_, h, _), q in zip(hits, inside):
            if q:
                out[5 if h[1] == 0 else 6] += h[0]
        return [math.log1p(v) for v in out]

    def _quoted(self, text: str, at: list[int]) -> list[bool]:
        """Whether the words of these ascending numbers stand between quotation marks of one line of a lower-case text."""
        if not any(q in text for q in _QUOTES):
            return [False] * len(at)
        # In the order of the text: line ends, marks, and the words asked for.
        out, wanted, k, quoted, pending = [], iter([*at, -1]), 0, False, 0
        following = next(wanted)
        for m in _MARK_OR_WORD.finditer(text):
            if m[1]:
                if k == following:
                    out.append(False)  # quoted only if the mark before it is closed on this line
                    pending += quoted
                    following = next(wanted)
                k += 1
            elif m[0] == "\n":
                quoted, pending = False, 0
            elif quoted:
                out[len(out) - pending :] = [True] * pending
                quoted, pending = False, 0
            else:
                quoted = True
        return out


def _training(docs: DataFrame, labels: DataFrame, fold: int, held_fold: int) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """Labelled documents outside the held fold, a bounded number of each class; the toxic ones, the others; how many of the table one of each stands for."""
    own = (
        common.only(labels, "doc_id", "toxic").filter(~held_out(fold, held_fold) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    classes = [(own.filter((F.col("toxic") == 1) == toxic), most) for toxic, most in ((True, MAX_TOXIC), (False, MAX_OTHER))]
    chosen = [common.sample_by_hash(rows, "doc_id", most) for rows, most in classes]
    stands_for = tuple(max(1.0, rows.count() / most) for rows, most in classes)
    ids = chosen[0].union(chosen[1])
    # At most MAX_TOXIC + MAX_OTHER rows of two numbers: small by the bounds above.
    rows = common.only(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = common.materialize(rows, "toxicity-training")
    return rows, rows.filter("toxic = 1"), rows.filter("toxic = 0"), stands_for


def held_out(fold: int, held_fold: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == held_fold, F.lit(False))


def at_least(k: int, n: int, p: float) -> float:
    """P(at least k of n), exact."""
    if not 0 < p < 1:
        return 1.0 if p >= 1 or not k else 0.0
    log = math.lgamma(n + 1)
    return sum(math.exp(log - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))


def learn_lexicon(toxic: DataFrame, other: DataFrame, stands_for: tuple[float, float] = (1.0, 1.0)) -> Lexicon:
    """Terms with at least MIN_CONTEXTS contexts in toxic documents, few in others, and that by no chance.

    Precision and weight are those in the table: a use counts as the documents that
    its own stands for.  The chance is that of the sample, by its own share, since
    only documents that were read are evidence.
    """

    def contexts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            own = set()
            for text in batch.column(0).to_pylist():
                w = ["", *words_of(text or ""), ""]
                own.update(zip(w[1:], w, [False] * len(w)))
                own.update(zip(w, w[1:], [True] * len(w)))
            if own:
                word, other, after = zip(*own)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(other), pa.array(after)], ["word", "neighbour", "after"])

    sides = toxic.select("text").mapInArrow(contexts, "word string, neighbour string, after boolean").filter("word != ''").distinct().groupBy("word", "after").agg(F.count(F.lit(1)).alias("n"))
    # The fewer of the different words before it and after it.
    seen = common.materialize(sides.groupBy("word").agg(F.min("n").alias("n")).filter(F.col("n") >= MIN_CONTEXTS), "toxicity-candidates")

    def uses(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in rows:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text or ""))
            if len(counts) > MAX_WORDS:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    # All words are counted, and candidates are judged where their counts meet: none is left out for their number.
    used, within = (docs.select("text").mapInArrow(uses, "word string, n long").groupBy("word").agg(F.sum("n").alias(name)) for docs, name in ((other, "m"), (toxic, "t")))
    sizes, candidates = (toxic.count(), other.count()), seen.count()
    share = sizes[0] / max(1, sum(sizes))
    n, m = F.least("n", F.coalesce("t", F.lit(0))), F.coalesce("m", F.lit(0))
    likely = seen.join(within, "word", "left").join(used, "word", "left").select("word", n.alias("n"), m.alias("m"))
    a, b = F.col("n") * stands_for[0], F.col("m") * stands_for[1]
    likely = likely.filter((F.col("n") >= MIN_CONTEXTS) & (a >= MIN_PRECISION * (a + b)))

    def no_chance(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield batch.filter(pa.array([at_least(n, n + m, share) <= CHANCE / candidates for n, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], pa.bool_()))

    # The lexicon: words that the bounded sample uses in MIN_CONTEXTS contexts or more, and that pass both tests.
    terms = likely.mapInArrow(no_chance, likely.schema).collect()
    common.discard(seen)
    return Lexicon({r.word: math.log((r.n * stands_for[0] + 0.5) / (r.m * stands_for[1] + 0.5)) for r in sorted(terms)})


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def learn_harmless(toxic: DataFrame, other: DataFrame, lexicon: Lexicon, stands_for: tuple[float, float] = (1.0, 1.0)) -> Lexicon:
    """Words near to a term whose contexts are mostly those of other documents, several of them: no misspellings.

    A context is the word with the words before and after it, so copies count once;
    each counts as the documents that its own stands for.
    """
    shared = other.sparkSession.sparkContext.broadcast(lexicon)

    def near(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in rows:
            found = set()
            for text in batch.column(0).to_pylist():
                w = ["", *words_of(text or ""), ""]
                for before, x, after in zip(w, w[1:], w[2:]):
                    if x not in own.known:
                        own.known[x] = own.look_up(x)
                    got = own.known[x]
                    if got and got[1]:
                        found.add((x, before, after))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["word", "before", "after"])

    seen = None
    for k, docs in enumerate((toxic, other)):
        n = docs.select("text").mapInArrow(near, "word string, before string, after string").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        n = n.select("word", *[(F.col("n") if k == side else F.lit(0).cast("long")).alias(name) for side, name in enumerate(("t", "o"))])
        seen = n if seen is None else seen.union(n)
    both = seen.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    a, b = F.col("t") * stands_for[0], F.col("o") * stands_for[1]
    rows = both.filter((F.col("o") >= 2) & (a < HARMLESS_SHARE * (a + b)))
    # Few: words of the bounded sample within an edit or two of a term.
    return Lexicon(lexicon.weights, frozenset(r["word"] for r in rows.collect()))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, stands_for: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Newton's method with a small ridge; bias first.  Weights of hits are kept from being negative; rows count as those they stand for."""
    n = len(y)
    c = np.where(y > 0, *stands_for)
    bias = math.log((c[y > 0].sum() + 0.5) / (c[y <= 0].sum() + 0.5)) if n else 0.0
    c = c / max(c.sum(), 1e-300)
    w = np.zeros(x.shape[1] + 1)
    w[0] = bias
    if n < 20 or min(y.sum(), n - y.sum()) < 5:
        return w
    a = np.column_stack([np.ones(n), x])
    free = np.ones(len(w), bool)
    for _ in range(8):
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (c * (p - y)) + ridge * np.r_[0, w[1:]]
            h = (a * (c * p * (1 - p))[:, None]).T @ a + np.diag(np.r_[1e-9, np.full(len(w) - 1, ridge)])
            step = np.zeros(len(w))
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            w = w - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-7:
                break
        negative = free & (w < 0)
        negative[0] = False
        if not negative.any():
            break
        free &= ~negative
        w[negative] = 0
    return w


def score(docs: DataFrame, labels: DataFrame, *, fold: int = 5, held_fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic.  Learns only from
    labels of documents with crc32(doc_id as text) mod ``fold`` other than
    ``held_fold``, at most ``MAX_TOXIC`` toxic and ``MAX_OTHER`` other ones (those
    with the smallest hashes of doc_id), each counted as the documents it stands for.

    Null or empty text: no hits.  Null doc_id: scored, not held out, never
    labelled.  Repeated rows: each is scored; of rows that repeat a labelled doc_id
    the least text is learned from.  Several labels of one document: the highest
    counts.  No labels: every score is that of the prior, 0.5.  Empty table: no rows.
    Other columns are ignored.  Texts are read whole, a batch at a time.
    """
    spark = docs.sparkSession
    lexicon, w = learn(docs, labels, fold, held_fold)
    shared = spark.sparkContext.broadcast((lexicon, w))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = shared.value
        for batch in common.batches(rows):
            x = np.array([own.features(t) for t in batch.column(2).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = common.only(docs, "doc_id", "text").select("doc_id", held_out(fold, held_fold).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def learn(docs: DataFrame, labels: DataFrame, fold: int, held_fold: int) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights (bias first) from labelled documents."""
    spark = docs.sparkSession
    chosen, toxic, other, stands_for = _training(docs, labels, fold, held_fold)
    lexicon = learn_harmless(toxic, other, learn_lexicon(toxic, other, stands_for), stands_for)
    shared = spark.sparkContext.broadcast(lexicon)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x = list(zip(*(shared.value.features(t) for t in batch.column(1).to_pylist()))) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in x)], ["toxic", *FEATURES])

    both = toxic.union(other).select("toxic", "text").mapInArrow(run, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES))
    rows = np.array([list(map(float, r)) for r in both.collect()]).reshape(-1, len(FEATURES) + 1)
    common.discard(chosen)
    return lexicon, fit_logistic(rows[:, 1:], rows[:, 0], stands_for=stands_for)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is under 0.5; all their columns, none added.

    Null or empty texts have no hits and stay.  Repeated rows: each is judged.  A
    score of 0.5 goes, but with no terms learned (no labels, say) all rows stay.  Empty table: no rows.  Extra columns pass through, whatever
    their names.  What is learned, and from what, is as in ``score``.
    """
    spark = docs.sparkSession
    lexicon, w = learn(docs, labels, 5, 0)
    if not lexicon.weights:
        return docs
    shared = spark.sparkContext.broadcast((lexicon, w))
    at, names = common.place(docs, "text"), docs.columns
    common.bound_batches(spark)
    plain = common.numbered(docs)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = shared.value
        for batch in common.batches(rows):
            x = np.array([own.features(t) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(weights[0] + x @ weights[1:] < 0))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
