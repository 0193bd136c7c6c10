"""Toxicity from a lexicon learned of labels, matched through Levenshtein automata, and from the words' context.

Words, and beginnings that many different words share, whose documents are labelled toxic far more often than chance,
form the lexicon. It is kept as a trie; running a word through the Levenshtein automaton of all entries at once is
running it through the intersection of the two, and its states are built when a word first reaches them. So a word
costs a lookup a letter, and misspelled entries (one letter more, less or other) are found as such. Each find is seen
in its window: whether quotation marks or verbs of speech stand around it (a quotation) and how many more finds do
(abuse). A logistic model over these counts gives the score.

Learning uses a bounded sample of labelled rows (``SAMPLE`` of each class, by the hash of doc_id); its weights start
from and are held to a prior, so that few or one-sided labels still give a sensible model.

Edge cases: null and empty texts have no finds and get the score of such documents; rows without a label (null) are
not learned from, and of several labels of a document the largest counts; without any labels the lexicon is empty and
all documents get one low score. Rows that repeat are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows, materialize, table
from .textual import plain

#: Labelled rows of each class that are learned from at most: this bounds the lexicon, too.
SAMPLE = 10_000
#: Least toxic documents of a term, least log odds, and its other documents for each toxic one at most (of a stem: words).
LEAST, ODDS, OTHERS, STEM_OTHERS = 5, 3.0, 0.1, 0.03
#: Lengths of stems, different words that share one at least, letters of a word that may be misspelled at least.
STEMS, VARIED, FUZZY = (4, 5, 6), 5, 5
WINDOW = 10
#: Words of speech, and marks of quotation (fixed values).
SPEECH = frozenset(b"said says say quote quoted quotes quoting called wrote writes dit sagte dijo".split())
#: An apostrophe within a word is no mark.
QUOTES = re.compile(r"[\"“”„«»]|(?<!\w)[‘’]|[‘’](?!\w)")
#: Signs that stand for a letter, and what they become: a letter that no word has.
MASKED, LETTER = re.compile(r"(?<=[^\W\d_])[*@$#!](?=[^\W\d_])"), "\ue001"
#: The token of a quotation mark.
MARK = "\ue000"
#: Punctuation of all scripts ends a word.
PUNCTUATION = {i: " " for i in range(128, 0x10000) if unicodedata.category(chr(i))[0] == "P"}
#: Bias; then whether there are finds as written out of quotations; how many are as written, misspelled and quoted;
#: their share of all words; and the most in one window.
PRIOR = np.array([-4.0, 5.0, 1.0, 2.0, 0.5, 1.0, 0.5])


def tokens(text: str | None, marks: bool = False) -> list[bytes]:
    """The words of a text in lower case; a masked letter stays in its word. With ``marks``, each quotation mark is a
    token, too."""
    text = (text or "").replace(MARK, " ").replace(LETTER, " ")
    if marks:
        text = QUOTES.sub(f" {MARK} ", text)
    text = MASKED.sub(LETTER, text)
    return plain(text if text.isascii() else text.translate(PUNCTUATION)).split()


class Automaton:
    """All words within ``edits`` of an entry, and all that begin with a stem, as a lazily built automaton."""

    def __init__(self, words: list[str], stems: list[str], edits: int = 1, fuzzy: int = FUZZY) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.word: list[bool] = [False]
        self.stem: list[bool] = [False]
        self.room: list[int] = [0]  # edits that the entry which ends here may have
        self.most: list[int] = [0]  # and the entries below
        for term, ends in [(w, self.word) for w in words] + [(s, self.stem) for s in stems]:
            at = 0
            room = edits if ends is self.word and len(term) >= fuzzy else 0
            for c in term:
                self.most[at] = max(self.most[at], room)
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.word.append(False)
                    self.stem.append(False)
                    self.room.append(0)
                    self.most.append(0)
                at = self.child[at][c]
            self.most[at], self.room[at] = max(self.most[at], room), max(self.room[at], room)
            ends[at] = True
        self.reset()

    def reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.found: list[int] = []  # edits of the best entry that ends here, or -1
        self.start = self._state(frozenset({(0, 0)}))

    def _state(self, places: frozenset) -> int:
        """Number of the state of these (node, edits); an entry's letter may be missing from the word."""
        todo, all_ = list(places), set(places)
        while todo:
            node, e = todo.pop()
            if node >= 0 and e < self.most[node]:
                for n in self.child[node].values():
                    if (n, e + 1) not in all_ and e + 1 <= self.most[n]:
                        all_.add((n, e + 1))
                        todo.append((n, e + 1))
        closed = frozenset(all_)
        if (s := self.states.get(closed)) is None:
            s = self.states[closed] = len(self.sets)
            self.sets.append(closed)
            self.step.append({})
            ends = [e for n, e in closed if n < 0 or self.word[n] and e <= self.room[n] or self.stem[n] and e == 0]
            self.found.append(min(ends, default=-1))
        return s

    def _next(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if node < 0:
                out.add((-1, 0))
                continue
            if (n := self.child[node].get(c)) is not None:
                out.add((-1, 0) if self.stem[n] and e == 0 else (n, e))
            if e < self.most[node]:
                out.add((node, e + 1))  # a letter too many
                out.update((n, e + 1) for n in self.child[node].values() if e + 1 <= self.most[n])  # another letter
        s = self.step[state][c] = self._state(frozenset(out)) if out else -1
        return s

    def match(self, word: str) -> int:
        """Edits to the nearest entry, 0 for a stem, -1 if there is none."""
        if len(self.sets) > 100_000:
            self.reset()
        s = self.start
        for c in word:
            if (n := self.step[s].get(c)) is None:
                n = self._next(s, c)
            if n < 0:
                return -1
            s = n
        return self.found[s]


@dataclass
class Model:
    """Some thousand short strings and seven numbers: small enough to be sent with every task."""

    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    cleared: frozenset[str] = frozenset()  # like an entry, but harmless by the labels
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())


class Finder:
    most = 400_000

    def __init__(self, model: Model) -> None:
        self.automaton, self.cleared, self.known = Automaton(model.words, model.stems), model.cleared, {}

    def find(self, word: bytes) -> int:
        if (k := self.known.get(word)) is None:
            if len(self.known) > self.most:
                self.known.clear()
            w = word.decode("utf-8", "replace")
            k = self.known[word] = -1 if w in self.cleared else self.automaton.match(w)
        return k

    def features(self, text: str | None) -> list[float]:
        words = tokens(text)
        find = self.find
        hits = [(i, k) for i, w in enumerate(words) if (k := find(w)) >= 0]
        if not hits:
            return [1.0, 0, 0, 0, 0, 0, 0]
        quoted = self.quoted(text, words, hits)
        counts, nearby, first, last = [0, 0, 0], 0, 0, 0
        for (i, k), q in zip(hits, quoted, strict=True):
            counts[2 if q else min(k, 1)] += 1
            while hits[first][0] < i - WINDOW:
                first += 1
            while last < len(hits) and hits[last][0] <= i + WINDOW:
                last += 1
            nearby = max(nearby, last - first)
        return [1.0, float(counts[0] > 0), *(math.log1p(n) for n in counts), math.sqrt(len(hits) / len(words)), math.log(max(1, nearby))]

    @staticmethod
    def quoted(text: str, words: list[bytes], hits: list[tuple[int, int]]) -> list[bool]:
        """For each find, whether a quotation mark is on either side of it in its window, or a verb of speech before it."""
        speech = [any(w in SPEECH for w in words[max(0, i - WINDOW) : i]) for i, _ in hits]
        if not QUOTES.search(text):
            return speech
        # Marks end words like any punctuation, so there are the same words between them.
        mark = MARK.encode()
        marked = tokens(text, marks=True)
        places = [i for i, w in enumerate(marked) if w != mark]
        out = []
        for (i, _), s in zip(hits, speech, strict=True):
            at = places[i]
            before, after = marked[max(0, at - WINDOW) : at].count(mark), marked[at + 1 : at + 1 + WINDOW].count(mark)
            out.append(s or before % 2 == 1 and after > 0)
        return out


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled documents of each class, none of them held out."""
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = [labels.where(F.col("toxic") == c).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(most) for c in (0, 1)]
    # 2 * most rows of two numbers at most.
    return materialize(docs.select("doc_id", "text").join(F.broadcast(by_hash[0].unionByName(by_hash[1])), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")))


def lexicon(rows: DataFrame) -> Model:
    def make():  # noqa: ANN202
        def step(x: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"word": [], "toxic": []}
            for t, y in zip(x["text"], x["toxic"], strict=True):
                found = {w.decode("utf-8", "replace") for w in tokens(t)}
                out["word"] += found
                out["toxic"] += [y] * len(found)
            return out

        return step

    sizes = dict(rows.groupBy("toxic").count().collect())
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    words = map_rows(rows, make, "word string, toxic int")
    words = materialize(words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    telling = words.where((F.col("bad") >= LEAST) & (odds >= ODDS) & (F.col("good") <= OTHERS * F.col("bad")) & (F.length("word") > 2))
    entries = sorted(r.word for r in telling.select("word").collect())
    parts = words.select("word", "bad", "good", F.explode(F.array(*(F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEMS))).alias("stem"))
    parts = parts.where("stem is not null").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum((F.col("bad") > 0).cast("int")).alias("kinds"))
    parts = parts.where((F.col("bad") >= LEAST) & (odds >= ODDS) & (F.col("kinds") >= VARIED) & (F.col("good") <= STEM_OTHERS * F.col("bad")))
    stems: list[str] = []
    for s in sorted(sorted(r.stem for r in parts.select("stem").collect()), key=len):
        if not any(s.startswith(t) for t in stems):
            stems.append(s)
    entries = [w for w in entries if not any(w.startswith(s) for s in stems)]
    model = Model(entries, stems)

    def near():  # noqa: ANN202
        automaton = Automaton(entries, stems)
        return lambda x: {"word": [w for w in x["word"] if automaton.match(w) > 0]}

    # Of words like an entry, those that documents without a toxic label hold too: as many as the sample has at most.
    seen = words.where((F.col("good") > 0) & (odds < ODDS)).select("word")
    model.cleared = frozenset(r.word for r in map_rows(seen, near, "word string").collect()) if entries else frozenset()
    return model


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, hold: float = 0.2) -> np.ndarray:
    """Weights of the logistic model, by Newton's steps, with a normal prior."""
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w)), x.T @ (p - y) + hold * (w - prior))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model from the labelled rows that aren't held out. ``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    rows = sample(docs, labels, most)
    model = lexicon(rows)

    def make():  # noqa: ANN202
        finder = Finder(model)
        return lambda x: {"x": [finder.features(t) for t in x["text"]], "y": x["toxic"]}

    got = map_rows(rows, make, "x array<double>, y int").collect()  # 2 * most rows of seven numbers
    if got:
        model.weights = fit(np.array([r.x for r in got]), np.array([r.y for r in got], dtype=float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of all rows of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():  # noqa: ANN202
        finder, w = Finder(sent.value), sent.value.weights

        def step(x: dict[str, list]) -> dict[str, list]:
            z = np.clip(np.array([finder.features(t) for t in x["text"]]) @ w, -40, 40)
            return {"doc_id": x["doc_id"], "score": 1 / (1 + np.exp(-z))}

        return step

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, score double")


def predicted() -> Column:
    return (F.col("score") >= 0.7).cast("int")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, with all their columns, that aren't predicted toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder, w = Finder(sent.value), sent.value.weights
        for texts in batches:
            z = np.clip(np.array([finder.features(t) for t in texts]).reshape(-1, len(w)) @ w, -40, 40)
            yield pd.Series(1 / (1 + np.exp(-z)))

    return docs.where(run("text") < 0.7)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted().alias("predicted"))
