"""Language-model scoring by masked pseudo-likelihood.

A small network sees the two tokens on either side of a place and predicts the token there; a document's score is the
sum of these conditional log-probabilities over all its tokens, each masked in turn. Tokens are words. The network
predicts one of ``GROUPS * SIZE`` units in two steps, both from the context: the unit's group, and the unit in the
group. The most frequent words are a unit each, in groups of like frequency; all other words fall into ``SHARED`` units
by checksum, and exact counts over the corpus give the word in such a unit. Every unit has a vector for each place.

What is gathered covers all documents and grows with them: every word of the corpus is counted exactly, in a distributed
table that is joined with the words of the documents at scoring; only words that make up a share of ``COMMON`` or more
(so their number is bounded by the share) reach the driver and are sent. Texts are cut into words twice, to count them
and to write them as units; training and scoring read the units. Training is one pass over every document in ``ROUNDS``
shares by the hash of its id. In each round every task trains on its part from the same weights, and the results are
averaged by the number of tokens, piece by piece in a shuffle. Only the averages, of fixed size, reach the driver.
Which documents share a task follows the files of the input, so scores of another layout differ a little; a rerun over
the same files has the same tasks.

Edge cases: null and empty texts have no tokens, a log-probability of 0 and a null score; very long texts are scored
whole, in pieces of places; rows that repeat are scored each; a null doc_id is in the first share.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows, materialize, table
from .textual import plain

GROUPS, SIZE, SHARED, HIDDEN, SIDE = 64, 64, 256, 16, 2
WIDTH = 2 * SIDE
ROUNDS, BATCH, RATE = 4, 8192, 0.1
#: Sums of squares at the start: small, or words that are seldom in a batch hardly move.
FIRST = 1e-8
#: Share of all tokens from which a word is sent with the model, 100,000 words at most.
COMMON = 1e-5
#: Numbers of the network in a row of a shuffle, and tokens that are looked at together.
PIECE, TOKENS = 8192, 1 << 19
#: Logits stay below the limit of the exponential of single precision.
STEEP = 60.0


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of rows, in place, and their sums."""
    np.clip(z, -STEEP, STEEP, out=z)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def picked(z: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at ``here``."""
    z, sums = exponentials(z)
    return np.log(z[np.arange(len(here)), here] / sums)


def wrong(z: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Gradient of the mean loss of softmax rows by their logits."""
    z, sums = exponentials(z)
    z *= (1 / (sums * len(here)))[:, None]
    z[np.arange(len(here)), here] -= np.float32(1 / len(here))
    return z


class Network:
    """One table for each place of the window, summed and squashed; a softmax over groups and one in each group."""

    def __init__(self, groups: int = GROUPS, size: int = SIZE, hidden: int = HIDDEN, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.size = size
        self.tables = rng.normal(0, 0.1, (WIDTH, groups * size + 1, hidden)).astype(np.float32)
        self.inner = np.zeros(hidden, np.float32)
        self.group = rng.normal(0, 0.1, (hidden, groups)).astype(np.float32)
        self.group_bias = np.zeros(groups, np.float32)
        self.unit = rng.normal(0, 0.1, (groups, hidden, size)).astype(np.float32)
        self.unit_bias = np.zeros((groups, size), np.float32)

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.inner, self.group, self.group_bias, self.unit, self.unit_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for p in self.parts:
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.tables[0].take(around[0], axis=0)
        for i in range(1, WIDTH):
            h += self.tables[i].take(around[i], axis=0)
        h += self.inner
        return np.tanh(h, out=h)

    def inside(self, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Logits in the group of each row, for rows in the order of groups, and (group, first row, end)."""
        ends = (np.flatnonzero(np.diff(group)) + 1).tolist()
        runs = [(int(group[a]), a, b) for a, b in zip([0, *ends], [*ends, len(group)], strict=True)]
        z = self.unit_bias.take(group, axis=0)
        for c, a, b in runs:
            z[a:b] += h[a:b] @ self.unit[c]
        return z, runs

    def logs(self, around: np.ndarray, here: np.ndarray) -> np.ndarray:
        """Log-probability of the unit at each place, given the units around it (a row for each neighbour)."""
        order = np.argsort(here, kind="stable")
        h = self.hidden(around[:, order])
        group, unit = np.divmod(here[order], self.size)
        out = np.empty(len(here), np.float32)
        out[order] = picked(h @ self.group + self.group_bias, group) + picked(self.inside(h, group)[0], unit)
        return out

    def learn(self, around: np.ndarray, here: np.ndarray, square: list[np.ndarray], rate: float) -> None:
        """One step of Adagrad on the mean loss of a batch."""
        order = np.argsort(here, kind="stable")
        around = around[:, order]
        h = self.hidden(around)
        group, unit = np.divmod(here[order], self.size)
        z = wrong(h @ self.group + self.group_bias, group)
        back = z @ self.group.T
        y, runs = self.inside(h, group)
        y = wrong(y, unit)
        units, biases = np.zeros_like(self.unit), np.zeros_like(self.unit_bias)
        for c, a, b in runs:
            back[a:b] += y[a:b] @ self.unit[c].T
            units[c] = h[a:b].T @ y[a:b]
            biases[c] = y[a:b].sum(axis=0)
        back *= 1 - h * h
        grads = [back.sum(axis=0), h.T @ z, z.sum(axis=0), units, biases]
        for p, s, g in zip(self.parts[1:], square[1:], grads, strict=True):
            s += g * g
            p -= rate * g / (np.sqrt(s) + 1e-9)
        # Of the tables only the rows of units that are in the batch.
        for i in range(WIDTH):
            order = np.argsort(around[i], kind="stable")
            ids = around[i][order]
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            rows = ids[starts]
            g = np.add.reduceat(back.take(order, axis=0), starts, axis=0)
            s = square[0][i].take(rows, axis=0) + g * g
            square[0][i][rows] = s
            self.tables[i][rows] -= rate * g / (np.sqrt(s) + 1e-9)


def windows(docs: list[np.ndarray], edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Units around every token of the documents (``edge`` beyond their ends) and at it."""
    gap = np.full(SIDE, edge, dtype=np.uint16)
    run = np.concatenate([x for d in docs for x in (gap, d)] + [gap])
    lengths = np.array([len(d) for d in docs])
    at = np.arange(lengths.sum()) + np.repeat(SIDE * np.arange(1, len(docs) + 1), lengths)
    return np.stack([run[at + d] for d in range(-SIDE, SIDE + 1) if d]), run[at]


def heaps(docs: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The documents in turn, as many together as have ``TOKENS`` tokens (one at least)."""
    heap, n = [], 0
    for d in docs:
        if heap and n + len(d) > TOKENS:
            yield heap
            heap, n = [], 0
        heap.append(d)
        n += len(d)
    if heap:
        yield heap


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word is in all documents."""

    def make():  # noqa: ANN202
        def step(x: dict[str, list]) -> dict[str, list]:
            found = Counter(w for t in x["text"] for w in plain(t).split())
            return {"word": list(found), "n": list(found.values())}

        return step

    return materialize(map_rows(docs.select("text"), make, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


class Model:
    """The unit of any word, log-probabilities of common words in their units, and the network.

    ``words`` (word, n) are the counts of the corpus. Every word counts one more in its unit, and so does one word for
    all that aren't there; a word alone in its unit has it for sure."""

    def __init__(self, common: dict[bytes, int]) -> None:
        first = sorted(common, key=lambda w: (-common[w], w))[: GROUPS * SIZE - SHARED]
        self.alone = {w: i for i, w in enumerate(first)}
        self.network, self.edge = Network(), GROUPS * SIZE
        #: Log of the sum of counts of each shared unit.
        self.sums = np.zeros(SHARED)
        self.common: dict[bytes, float] = {}
        self.words: DataFrame | None = None

    def unit_of(self, word: bytes) -> int:
        if (u := self.alone.get(word)) is None:
            u = GROUPS * SIZE - SHARED + zlib.crc32(word) % SHARED
        return u


def counted(docs: DataFrame) -> Model:
    """An untrained model with the counts of the words of ``docs``."""
    words = word_counts(docs)
    total = words.agg(F.sum("n")).first()[0] or 0
    # 1 / COMMON words at most.
    common = {bytes(r.word): r.n for r in words.where(F.col("n") >= COMMON * total).collect()}
    model = Model(common)
    sums = np.ones(SHARED)
    for k, n in words.groupBy(F.pmod(F.crc32("word"), F.lit(SHARED))).agg(F.sum(F.col("n") + 1)).collect():
        sums[k] += n
    for w in model.alone:
        sums[zlib.crc32(w) % SHARED] -= common[w] + 1
    model.sums = np.log(sums)
    model.common = {w: 0.0 if w in model.alone else float(np.log(n + 1.0) - model.sums[zlib.crc32(w) % SHARED]) for w, n in common.items()}
    model.words = words
    return model


def encoded(docs: DataFrame, model: Model, rounds: int = 1) -> DataFrame:
    """Every row of ``docs`` with its words as units (16 bits each), the sum of its common words' log-probabilities in
    their units, and its other words and how often it has them. ``row`` numbers the rows, ``share`` deals them."""
    sent = docs.sparkSession.sparkContext.broadcast((model.alone, model.common))

    def make():  # noqa: ANN202
        alone, common = sent.value
        first = GROUPS * SIZE - SHARED

        def step(x: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"units": [], "log": [], "words": [], "times": []}
            for t in x.pop("text"):
                every = plain(t).split()
                found = Counter(every)
                unit = {w: alone[w] if w in alone else first + zlib.crc32(w) % SHARED for w in found}
                others = {w: n for w, n in found.items() if w not in common}
                out["units"].append(np.fromiter(map(unit.__getitem__, every), np.uint16, len(every)).tobytes())
                out["log"].append(sum(common[w] * n for w, n in found.items() if w in common))
                out["words"].append(list(others))
                out["times"].append(list(others.values()))
            return x | out

        return step

    share = F.coalesce(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(rounds)), F.lit(0)).cast("int")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", share.alias("share"), "text")
    return materialize(map_rows(rows, make, "row long, doc_id long, share int, units binary, log double, words array<binary>, times array<long>"), by="share")


def averaged(parts: DataFrame) -> DataFrame:
    """(i, x): the mean of pieces ``x`` (single precision) of the same ``i``, weighted by ``n``, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for i, x, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                s = sums.setdefault(i, [0.0, 0])
                s[0] = s[0] + np.frombuffer(x, np.float32).astype(np.float64) * n
                s[1] += n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([(s / n).astype(np.float32).tobytes() for s, n in sums.values()], pa.binary())], ["i", "x"])

    return parts.repartition("i").mapInArrow(run, "i int, x binary")


def fit(rows: DataFrame, model: Model, rounds: int = ROUNDS, rate: float = RATE) -> None:
    """Train the network of ``model`` on all rows of ``encoded`` with as many shares as rounds."""
    spark = rows.sparkSession
    bounded_batches(spark)
    square = np.full_like(model.network.flat(), FIRST)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((model.network.flat(), square, model.edge))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            flat, before, edge = sent.value
            net, done = Network().load(flat), 0
            squares = Network().load(before).parts
            for batch in batches:
                found = [np.frombuffer(u, np.uint16) for u in batch.column(0).to_pylist()]
                for heap in heaps([d for d in found if len(d)]):
                    around, here = windows(heap, edge)
                    order = np.random.default_rng(done).permutation(len(here))
                    for i in range(0, len(order), BATCH):
                        part = order[i : i + BATCH]
                        net.learn(around[:, part], here[part], squares, rate)
                    done += len(here)
            if done:
                every = np.concatenate([net.flat(), *(s.ravel() for s in squares)])
                pieces = [every[i : i + PIECE].tobytes() for i in range(0, len(every), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary()), pa.array([done] * len(pieces), pa.int64())], ["i", "x", "n"])

        got = averaged(rows.where(F.col("share") == r).select("units").mapInArrow(run, "i int, x binary, n long")).collect()
        if got:
            every = np.frombuffer(b"".join(bytes(x.x) for x in sorted(got, key=lambda x: x.i)), np.float32)
            model.network.load(every[: len(square)])
            square = every[len(square) :]
        sent.unpersist()


def train(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """A model from all of ``docs`` (doc_id, text)."""
    model = counted(docs)
    fit(encoded(docs, model, rounds), model, rounds, rate)
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``score`` of rows of ``encoded``."""
    sent = rows.sparkSession.sparkContext.broadcast((model.network, model.edge))

    def make():  # noqa: ANN202
        net, edge = sent.value

        def step(x: dict[str, list]) -> dict[str, list]:
            docs = [np.frombuffer(u, np.uint16) for u in x.pop("units")]
            sums: list[float] = []
            for heap in heaps(docs):
                ends = np.cumsum([0, *map(len, heap)])
                logs = np.zeros(ends[-1] + 1)
                if ends[-1]:
                    around, here = windows(heap, edge)
                    for i in range(0, len(here), BATCH):
                        part = slice(i, min(i + BATCH, len(here)))
                        logs[part] = net.logs(around[:, part], here[part])
                # One more zero at the end, where texts without tokens may begin.
                sums += np.where(np.diff(ends) > 0, np.add.reduceat(logs, ends[:-1]), 0.0).tolist()
            x["log"] = np.add(x["log"], sums)
            return x | {"n_tokens": [len(d) for d in docs]}

        return step

    own = map_rows(rows.select("row", "doc_id", "units", "log"), make, "row long, doc_id long, n_tokens long, log double")
    # A word that isn't common has less than a share of COMMON of these rows, copies of texts included.
    each = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    sums = F.element_at(F.array(*(F.lit(float(x)) for x in model.sums)), F.pmod(F.crc32("word"), F.lit(SHARED)).cast("int") + 1)
    rare = each.join(model.words, "word", "left").withColumn("x", F.col("times") * (F.log(F.coalesce("n", F.lit(0)) + 1.0) - sums))
    both = own.join(rare.groupBy("row").agg(F.sum("x").alias("rare")), "row", "left").withColumn("log_prob", F.col("log") + F.coalesce("rare", F.lit(0.0)))
    return both.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("score"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, log_prob, score) of all rows of ``docs``; the score is the mean log-probability of a token."""
    return scored(encoded(docs, model), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents are encoded once, for training and for scoring."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = counted(docs)
    rows = encoded(docs, model, ROUNDS)
    fit(rows, model)
    return scored(rows, model)
