"""The token cache and the cuts it works on, held against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tracelake.llm import textkernel, token_files
from tracelake.llm.textkernel import TokenCache, cuts, slices

PATH = public_tokenizers.path(token_files.VOCABULARY)
PIECES = ["a", "Zz", "7", "42", "'", "''", "'s", "'ll", "'re", "'S", ".", "###", "|>", "<|", "-", "_", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c"]
PIECES += ["\x00", "\x7f", "don't", "they've", "endoftext"]
#: Letters, marks, numbers, signs and blanks beyond ASCII.
PIECES += map(chr, [0xE9, 0xF1, 0xDF, 0xFF, 0x200, 0x24F, 0x27F, 0x2B0, 0xD7, 0xF7, 0x301, 0xB5, 0xAA, 0xB2, 0xBD, 0x663, 0xAB, 0x2014, 0x201C, 0x65E5, 0x306E, 0xE01, 0x1F600])
PIECES += map(chr, [0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0x200B, 0xFEFF])
END = "<|endoftext|>"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def made(seed: int, n: int, more: tuple = ()) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices([*PIECES, *more], k=rng.randint(0, 40))) for _ in range(n)]


def encoded(cache: TokenCache, texts: list[str]) -> list[list[int]]:
    out = []
    for _, _, offsets, data in slices(pa.array(texts), 4000):
        ids, bounds = cache.ids(offsets, data)
        out += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    return out


@pytest.mark.parametrize("more", [(), (END,)])
def test_fine_cuts_encode_alike(tokenizer, more):
    texts = made(5, 4000, more)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    cache = token_files._encoder.__wrapped__(PATH)
    assert encoded(cache, texts) == want
    assert encoded(cache, texts) == want


def test_signs_do_not_multiply_segments():
    """A word before many signs is encoded once, and so is each sign."""
    cache, sent = token_files._encoder.__wrapped__(PATH), []
    encode = cache.encode
    cache.encode = lambda new: sent.extend(new) or encode(new)
    words, signs = [f"w{chr(97 + i)}{chr(0xE9)}" for i in range(20)], [".", ",", "!!", "###", "$", "7", "'"]
    encoded(cache, ["".join(f" {w}{s}" for w in words) for s in signs])
    assert len(sent) == len(set(sent)) == len(words) + len(signs)


@pytest.mark.parametrize("values", [1, 3, 1 << 62])
def test_equal_hashes_keep_own_ids(tokenizer, monkeypatch, values):
    """Segments of one hash are told apart by their bytes."""
    own = textkernel.range_hashes
    monkeypatch.setattr(textkernel, "range_hashes", lambda *a: own(*a) % np.uint64(values))
    texts = made(7, 300)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    cache = token_files._encoder.__wrapped__(PATH)
    assert encoded(cache, texts) == want
    assert encoded(cache, texts[::-1]) == want[::-1]


def test_cache_grows_and_empties():
    def encode(new):
        return np.array([int(x) for x in new], dtype=np.uint32), np.ones(len(new), dtype=np.int64)

    texts = [" ".join(map(str, range(a, a + 5000))) for a in range(0, 200_000, 5000)]
    for most in (1 << 20, 7000):
        cache = TokenCache(lambda new: encode([x.strip() for x in new]), most)
        for a, t in enumerate(texts):
            assert encoded(cache, [t]) == [list(range(5000 * a, 5000 * a + 5000))]
        assert (cache.used > 199_000) == (most == 1 << 20)
        assert encoded(cache, texts[:2] + ["", "5"]) == [list(range(5000)), list(range(5000, 10_000)), [], [5]]


def test_fine_cuts_stand_at_characters():
    for t in made(9, 500):
        data = np.frombuffer(t.encode(), dtype=np.uint8)
        at = cuts(np.array([0, len(data)]), data, True)
        assert all((data[i] & 0xC0) != 0x80 for i in at) and set(cuts(np.array([0, len(data)]), data)) <= set(at)
