import hashlib
import random

import numpy as np
import pytest
import tokenizers

from tidemill.llm import bpe

TEXTS = [
    "", " ", "Hello, World! it's we'll I'D", "İstanbul ΣΑΣ ΟΔΟΣ ² ½ x²", "<|endoftext|>hi<|startoftext|> there<|endoftext|>", "a\u0085b c d\x1ce​f", "日本語テキスト 🙂👍🏽 é é ﬁ", "a" * 3000, "thethethethe" * 50,
    "aaaaabaaaaab", "퟿ ￿", "1234567890 ١٢٣ Ⅷ", "___ --- ''' 's't", "ÿÿ Ā ł Ń", "don't DON'T",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.load(bpe.default_path()))


def test_equals_the_library(library, encoder):
    rng = random.Random(1)
    random_texts = ["".join(rng.choice("abcdefghin ntrst'éñß.1") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    decoder = bpe.Decoder(bpe.Vocabulary.load(bpe.default_path()))
    for t in [*TEXTS, *random_texts]:
        ids = library.encode(t, add_special_tokens=False).ids
        ours = np.frombuffer(encoder.encode(t), dtype="<u4")
        assert ours.tolist() == ids, t
        assert decoder.decode(ours).decode() == library.decode(ids, skip_special_tokens=False)


def test_every_code_point_equals_the_library(library, encoder):
    """Beside letters, alone and twice: this shows its class and its small letter."""
    for first in range(0, 0x110000, 64):
        every = [chr(c) for c in range(first, first + 64) if not 0xD800 <= c < 0xE000]
        text = " ".join(f"a{c}b {c}{c}1" for c in every)
        if np.frombuffer(encoder.encode(text), dtype="<u4").tolist() != library.encode(text, add_special_tokens=False).ids:
            for c in every:
                for t in (f"a{c}b", f"{c}{c}1"):
                    assert np.frombuffer(encoder.encode(t), dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids, hex(ord(c))
            raise AssertionError(hex(first))


def test_random_unicode_equals_the_library(library, encoder):
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(chr(rng.choice((rng.randrange(32, 0x300), rng.randrange(0x300, 0xD800), rng.randrange(0xE000, 0x20000)))) for _ in range(12))
        assert np.frombuffer(encoder.encode(t), dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_equals_merging_by_rank(encoder):
    """The backtracking encoder against plain byte-pair encoding."""
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("aaabbcdehinrst") for _ in range(rng.randint(1, 14)))
        parts = [encoder.text.index(c) for c in [*word[:-1], word[-1] + bpe.END]]
        while True:
            pairs = [(encoder.joined[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in encoder.joined]
            if not pairs:
                break
            r, i = min(pairs)
            parts[i : i + 2] = [r]
        assert encoder.word(word + bpe.END) == parts


def test_columns(spark, corpus, nothing, cluttered, library):
    path = bpe.default_path()
    rows = bpe.digest(corpus, path).collect()
    texts = sorted((r.text or "" for r in corpus.collect()))
    want = sorted((len(i := library.encode(t, add_special_tokens=False).ids), hashlib.sha256(np.array(i, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for t in texts)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert bpe.digest(nothing, path).count() == 0
    assert bpe.digest(cluttered, path).count() == corpus.count()
    there_and_back = bpe.decode(bpe.encode(corpus, path), path)
    assert there_and_back.where("size(ids) > 0 and decoded = ''").count() == 0 and there_and_back.count() == corpus.count()
