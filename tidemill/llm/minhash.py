"""Near duplicates by Order MinHash, checked by banded alignment.

A document is the sequence of its shingles of five words, each labelled with how often it has occurred before. A
sketch holds the ``length`` smallest labelled shingles under one hash, in text order, so it is kept by edits in
proportion to how much of the sequence stays in place. Three sketches make a band, and documents that share any of
the 32 bands are candidates. Two documents are linked if the longest common subsequence of their shingle sequences
has ``common / (n + m - common) >= 0.8``; only diagonals that can still reach that are aligned. A pair at exactly
0.8 shares a band with a probability of 0.9999.

Copies (texts with the same words) form one class first and are compared once. Candidates then are linked by hubs of
buckets (``graph.link_buckets``), never as all pairs of a bucket.

Edge cases: null and empty texts, and those without a word, link with nothing, not even each other; a text of
fewer than five words is one shingle; documents with a null doc_id are returned but not compared. Rows that repeat a
doc_id are one document, and where their texts differ, the least text of the rows stands for it when pairs are
checked. Extra columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialize, semi, split_join, table
from .graph import link_buckets
from .textual import Numbers, mixed, plain, shingles

SHINGLE, SIMILARITY, LENGTH, ROWS, BANDS = 5, 0.8, 2, 3, 32


def labelled(x: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence numbers mixed in: the first stays, the second and later ones differ from it."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    again = s[1:] == s[:-1]
    if not again.any():
        return x
    starts = np.concatenate([[True], ~again])
    number = np.arange(len(s)) - np.maximum.accumulate(np.where(starts, np.arange(len(s)), 0))
    out = np.empty_like(x)
    out[order] = np.where(number > 0, mixed(s + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), s)
    return out


class Sketcher:
    def __init__(self, length: int = LENGTH, rows: int = ROWS, bands: int = BANDS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.length, self.rows, self.bands = length, rows, bands
        self.factors = rng.integers(1 << 62, size=rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(1 << 62, size=bands, dtype=np.uint64)

    def bands_of(self, x: np.ndarray) -> np.ndarray:
        """One number for each band of a document's labelled shingles."""
        picked = np.empty((len(self.factors), min(self.length, len(x))), dtype=np.int64)
        step = max(1, 1_000_000 // len(x))
        for i in range(0, len(self.factors), step):
            h = self.factors[i : i + step, None] * x[None, :]
            at = np.arange(len(h))
            for j in range(picked.shape[1]):
                picked[i : i + step, j] = least = h.argmin(1)
                h[at, least] = np.uint64(0xFFFFFFFFFFFFFFFF)
        picked.sort(axis=1)  # text order
        out = np.zeros(len(self.factors), dtype=np.uint64)
        for j in range(picked.shape[1]):
            out = mixed(out * np.uint64(31) + x[picked[:, j]])
        band = self.salts.copy()
        for r in range(self.rows):
            band = mixed(band + out[r :: self.rows])
        return band.view(np.int64)


def sketches(docs: DataFrame, shingle: int = SHINGLE, **how: int) -> DataFrame:
    """(doc_id, digest, n, bands): a digest of the words, the number of shingles and the bands (none without words)."""

    def make():  # noqa: ANN202
        numbers, sketcher = Numbers(), Sketcher(**how)

        def step(x: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": x["doc_id"], "digest": [], "n": [], "bands": []}
            for t in x["text"]:
                words = plain(t).split()
                s = shingles(numbers.of(words), shingle)
                out["digest"].append(xxhash.xxh3_128_digest(b" ".join(words)))
                out["n"].append(len(s))
                out["bands"].append(sketcher.bands_of(labelled(s)) if len(s) else None)
            return out

        return step

    return map_rows(docs, make, "doc_id long, digest binary, n long, bands array<long>")


def _prefixes(x: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any run comes: run(i, j) * powers[len - j] is the difference of two of them."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers[: len(x)], dtype=np.uint64)])


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Insertions and deletions between two sequences if ``most`` or fewer, else None.

    For each number of edits in turn, the furthest place on every diagonal of the band; the run of equal items from
    there is found by bisection over hashes of runs.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    powers = np.ones(max(n, m) + 1, dtype=np.uint64)
    powers[1:] = np.uint64(0x9E3779B97F4A7C15)
    powers = np.multiply.accumulate(powers)
    ha, hb = _prefixes(a, powers), _prefixes(b, powers)
    never = -(1 << 40)
    far = np.full(2 * most + 5, never, dtype=np.int64)
    zero = most + 2
    far[zero + 1] = 0
    top = 1 << max(1, max(n, m)).bit_length()
    for d in range(most + 1):
        k = np.arange(-d, d + 1, 2)
        x = np.maximum(far[zero + k + 1], far[zero + k - 1] + 1)
        y = x - k
        ok = (x >= 0) & (x <= n) & (y >= 0) & (y <= m)
        x, y, k2 = x[ok], y[ok], k[ok]
        far[zero + k] = never
        if not len(x):
            continue
        run, left, step = np.zeros_like(x), np.minimum(n - x, m - y), top
        shift = y - x
        while step:
            t = run + step
            fits = t <= left
            tt = np.where(fits, t, 0)
            da, db = ha[x + tt] - ha[x], hb[y + tt] - hb[y]
            same = np.where(shift >= 0, da * powers[np.maximum(shift, 0)] == db, da == db * powers[np.maximum(-shift, 0)])
            run = np.where(fits & same, t, run)
            step >>= 1
        x = x + run
        far[zero + k2] = x
        if ((x == n) & (x - k2 == m)).any():
            return d
    return None


def needed(n: int, m: int, least: float) -> int:
    """Common items that two sequences need for common / (n + m - common) >= ``least``."""
    return max(1, int(np.ceil(least * (n + m) / (1 + least) - 1e-9)))


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether common / (n + m - common) of two shingle sequences is ``least`` or more."""
    n, m = len(a), len(b)
    need = needed(n, m, least)
    if min(n, m) < need or len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < need:  # no order can do better
        return False
    return distance(a, b, n + m - 2 * need) is not None


class Shingles:
    """A Matcher: items that share too few labelled shingles for any order of them are left out at once."""

    def __init__(self, shingle: int = SHINGLE, least: float = SIMILARITY) -> None:
        self.shingle, self.least, self.numbers = shingle, least, Numbers()

    def item(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        s = shingles(self.numbers.of(plain(text).split()), self.shingle)
        return s, labelled(s)

    def items(self, texts: list[str]) -> list:
        return [self.item(t) for t in texts]

    def index(self, items: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s, _ in items], dtype=np.int64)
        every, owner = np.concatenate([x for _, x in items]), np.repeat(np.arange(len(items)), sizes)
        order = np.argsort(every, kind="stable")
        return every[order], owner[order], sizes

    def near(self, item: tuple, index: tuple) -> np.ndarray:
        every, owner, sizes = index
        low, high = np.searchsorted(every, item[1], "left"), np.searchsorted(every, item[1], "right")
        found = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(found.sum())
        common = np.bincount(owner[at], minlength=len(sizes))
        need = np.maximum(1, np.ceil(self.least * (len(item[0]) + sizes) / (1 + self.least) - 1e-9))
        good = np.flatnonzero(common >= need)
        return good[np.argsort(-common[good], kind="stable")]

    def same(self, a: tuple, b: tuple) -> bool:
        n, m = len(a[0]), len(b[0])
        return distance(a[0], b[0], n + m - 2 * needed(n, m, self.least)) is not None


def check_pairs(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Of pairs (a, b) of ids, those whose texts (id, text) are similar."""

    def make():  # noqa: ANN202
        numbers, kept = Numbers(), OrderedDict()

        def of(text: str) -> np.ndarray:
            if (s := kept.get(text)) is None:
                s = kept[text] = shingles(numbers.of(plain(text).split()), shingle)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return s

        def step(x: dict[str, list]) -> dict[str, list]:
            good = [i for i, (s, t) in enumerate(zip(x["s"], x["t"], strict=True)) if similar(of(s), of(t), least)]
            return {k: [x[k][i] for i in good] for k in ("a", "b")}

        return step

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")
    return map_rows(both.select("a", "b", "s", "t"), make, "a long, b long")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, copy_id (the first document with the same words), class_id and kept."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(sketches(docs))
    first = materialize(rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "bands")).alias("f"), F.count(F.lit(1)).alias("copies")).select("digest", "copies", "f.*"))
    entries = first.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    facts = first.select(F.col("doc_id").alias("id"), F.col("n").alias("fact"))

    def texts_of(ids: DataFrame) -> DataFrame:
        chosen = semi(docs.withColumnRenamed("doc_id", "id"), ids, "id")
        return materialize(chosen.groupBy("id").agg(F.min("text").alias("text")))

    groups = link_buckets(entries, facts, lambda x, y: F.least(x, y) >= least * F.greatest(x, y), texts_of, lambda pairs, texts: check_pairs(pairs, texts, least=least), lambda: Shingles(least=least))
    classes = first.select("digest", "copies", F.col("doc_id").alias("copy_id")).join(groups, F.col("copy_id") == F.col("id"), "left")
    classes = classes.select("digest", "copies", "copy_id", F.coalesce("component", "copy_id").alias("class_id"))
    known = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = split_join(rows.where(known).select("doc_id", "digest"), classes, "digest", "copies").select("doc_id", "copy_id", "class_id")
    rest = rows.where(~known).select("doc_id", F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"))
    return out.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
