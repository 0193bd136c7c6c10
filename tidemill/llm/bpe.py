r"""BPE encoding by backtracking, decoding by an offset table.

The encoder looks for the longest token at each position (one Aho-Corasick pass over the word finds them all)
and accepts a token only if the pair of it and its predecessor is compatible: taking both apart again, newest
merge first, must never meet a merge that ordinary BPE would have made earlier across their border. Where no
prefix of the longest match is compatible, the predecessor is taken back; a position that failed once is never
tried again, so the work is linear in the word. The result equals that of applying the merges in rank order.

Edge cases: a null text counts as empty; an empty text has no tokens and decodes to the empty string; texts are
encoded whole, whatever their length; the vocabulary's own special strings become their ids, as the tokenizers
library does by default. Extra columns of the input are kept by ``encode`` unless their name is an output's.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows

#: Ends a word. Words are strings of byte values (Latin-1), and this is no byte.
END = chr(256)
#: White space that the vocabulary's patterns know (fixed values of Unicode).
BLANK = "\t-\r \x85\xa0  -     　"
#: Letters and numbers of later versions of Unicode, which are neither in the library's classes (fixed values).
LATER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A "
    "11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF "
    "2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Capitals that the library knows and Python may not know yet, and their small letters (fixed values).
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Distinct words that one worker remembers before it forgets them all.
REMEMBERED = 400_000


def code_points(ranges: str) -> str:
    """Ranges as a set of a pattern."""
    return "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in ranges.split())


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merges by rank and special strings of one tokenizer file; small, and sent to executors whole."""

    def __init__(self, spec: dict) -> None:
        model, letters = spec["model"], byte_letters()
        self.end = model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}

        def raw(name: str) -> str:
            last = bool(self.end) and name.endswith(self.end)
            return "".join(chr(letters[c]) for c in (name[: -len(self.end)] if last else name)) + END * last

        self.raw = {i: raw(t) for t, i in model["vocab"].items()}
        pairs = (m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"])
        ids = model["vocab"]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        made = {c for _, _, c in vocabulary.merges}
        # Ranks order all tokens by the time of their making: single bytes first, then merge by merge.
        base = sorted(i for i in vocabulary.raw if i not in made)
        self.id_of = [*base, *(c for _, _, c in vocabulary.merges)]
        rank = {t: r for r, t in enumerate(self.id_of)}
        self.split = [(r, r) for r in range(len(base))] + [(rank[a], rank[b]) for a, b, _ in vocabulary.merges]
        self.joined = {(rank[a], rank[b]): rank[c] for a, b, c in vocabulary.merges}
        self.text = [vocabulary.raw[t] for t in self.id_of]
        self.length = [len(t) for t in self.text]
        self.special = vocabulary.special
        at = {t: r for r, t in enumerate(self.text)}
        self.compatible: dict[tuple[int, int], bool] = {}
        # A token that its own halves would never form is no result of BPE: it is neither matched nor a prefix.
        proper = [a == b or self._fits(a, b, r) for r, (a, b) in enumerate(self.split)]
        self.shorter = [next((at[t[:k]] for k in range(len(t) - 1, 0, -1) if proper[at.get(t[:k], 0)] and t[:k] in at), -1) for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for t, r in at.items():
            if proper[r]:
                self.automaton.add_word(t, r)
        self.automaton.make_automaton()
        import regex

        letters, numbers = (rf"[\p{{{kind}}}--[{code_points(later)}]]" for kind, later in (("L", LATER_LETTERS), ("N", LATER_NUMBERS)))
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{letters}+|{numbers}|[^{BLANK}{letters}{numbers}]+", regex.V1)
        self.capitals = re.compile(f"[{''.join(map(chr, CAPITALS))}]")
        # The same classes for texts of basic and accented Latin letters only, which the plain engine scans faster.
        latin = "a-z\xdf-\xf6\xf8-\u017f"
        self.foreign = re.compile(f"[^\x00-\x7f{latin}]")
        self.latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{latin}]+|[0-9]|[^\t-\r 0-9{latin}]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = _Known(self)

    def _fits(self, left: int, right: int, limit: int) -> bool:
        """Whether BPE keeps the border of two adjacent tokens until the merge of rank ``limit``."""
        joined, split = self.joined, self.split
        while True:
            if joined.get((left, right), limit) < limit:
                return False
            # Undo the newer of the two; at equal ranks the right one, as merges go from left to right.
            if left > right:
                limit, left = left, split[left][1]
                if left != limit:
                    continue
                limit, right = right + 1, split[right][0]
                if right + 1 == limit:
                    return True
            else:
                limit, right = right + 1, split[right][0]
                if right + 1 != limit:
                    continue
                limit, left = left, split[left][1]
                if left == limit:
                    return True

    def fits(self, left: int, right: int) -> bool:
        if (kept := self.compatible.get((left, right))) is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            kept = self.compatible[left, right] = self._fits(left, right, 1 << 60)
        return kept

    def word(self, text: str) -> list[int]:
        """Ranks of the tokens of one word given as a string of byte values (with END)."""
        length, shorter = self.length, self.shorter
        longest = [-1] * len(text)
        for last, r in self.automaton.iter(text):
            longest[last + 1 - length[r]] = r  # ends ascend, so the longest is set last
        open_, at, out, token = [True] * (len(text) + 1), 0, [], longest[0]
        while at < len(text):
            before = out[-1] if out else -1
            while token >= 0 and not (open_[at + length[token]] and (before < 0 or self.fits(before, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < len(text) else -1
            else:
                if before < 0:
                    raise ValueError(f"a byte of {text!r} is not in the vocabulary")
                open_[at] = False
                out.pop()
                at -= length[before]
                token = shorter[before]
        return out

    def normalise(self, text: str) -> str:
        # Letter by letter: a capital sigma that ends a word is no special case.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return (text.translate(CAPITALS) if not text.isascii() and self.capitals.search(text) else text).lower()

    def words(self, text: str) -> list[str]:
        text = self.normalise(text)
        return (self.pattern if self.foreign.search(text) else self.latin).findall(text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        parts, known = self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text], self.known
        if len(known) > REMEMBERED:
            known.clear()
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else b"".join(map(known.__getitem__, self.words(p))) for p in parts)


class _Known(dict):
    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        e = self.encoder
        try:
            raw = word.encode("utf-8").decode("latin-1") + END
            self[word] = out = np.array([e.id_of[r] for r in e.word(raw)], dtype="<u4").tobytes()
        except UnicodeEncodeError:  # a lone surrogate is no text in UTF-8
            self[word] = out = self[word.encode("utf-8", "replace").decode("utf-8")]
        return out


class Decoder:
    """Bytes of all tokens in one run, each followed by a space, and the offsets where they begin."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        most = max(vocabulary.names) + 1
        names = [vocabulary.names.get(i, "").encode() + b" " for i in range(most)]
        self.run = np.frombuffer(b"".join(names), dtype=np.uint8)
        self.size = np.array([len(n) for n in names], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.run[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1])][:-1].tobytes()


_built: dict[str, object] = {}


def _once(kind: type, sent):  # noqa: ANN001, ANN202
    """One encoder or decoder for each worker process and broadcast vocabulary."""
    key = f"{kind.__name__}-{sent.id if hasattr(sent, 'id') else sent._path if hasattr(sent, '_path') else id(sent)}"
    if key not in _built:
        for old in [k for k in _built if k.startswith(kind.__name__)]:
            del _built[old]
        _built[key] = kind(sent.value)
    return _built[key]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (array of int): the tokens of each whole text. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("array<int>")
    def run(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        e = _once(Encoder, sent)
        return pd.Series([np.frombuffer(e.encode(t or ""), dtype="<i4") for t in texts], dtype=object)

    return docs.withColumn(ids, run(F.col(text)))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with a column ``text``: what the ids decode to. A null list decodes to the empty string."""
    sent = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def run(lists):  # noqa: ANN001, ANN202
        import pandas as pd

        d = _once(Decoder, sent)
        return pd.Series(["" if x is None else d.decode(np.asarray(x, dtype=np.int64)).decode() for x in lists], dtype=object)

    return rows.withColumn(text, run(F.col(ids)))


def digest(docs: DataFrame, path: str, columns: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """Per document: n_tokens and digests of its ids and of what they decode to, in one pass without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    key, text = columns

    def make():  # noqa: ANN202
        e, d = _once(Encoder, sent), _once(Decoder, sent)

        def step(x: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": x["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in x["text"]:
                raw = e.encode(t or "")
                out["n_tokens"].append(len(raw) // 4)
                out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(d.decode(np.frombuffer(raw, dtype="<u4"))).hexdigest())
            return out

        return step

    picked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return map_rows(picked, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
