"""Word hashes beside words found by regular expressions."""

import random
import re

import pyarrow as pa
import pytest

from plumbline.llm import words as w

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = [(w.SPACED, r"[^\x20\x09-\x0D]+"), (w.ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


@pytest.mark.parametrize("window", [1 << 16, 64])
@pytest.mark.parametrize("keep,pattern", KINDS)
def test_same_words_as_the_pattern(monkeypatch, window, keep, pattern):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbZ9 \t\n\x0b.,é漢ß\x00|") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "  ", "x" * 3000]
    monkeypatch.setattr(w, "WINDOW", window)
    got = w.words_of(pa.array(texts), keep, shapes=True)
    seen = {}
    for i, text in enumerate(texts):
        want = [x.encode() for x in re.findall(pattern, (text or "").translate(TO_LOWER))]
        span = range(got.first[i], got.first[i + 1])
        assert [got.text(j) for j in span] == want
        for j, word in zip(span, want):
            assert seen.setdefault(got.hashes[j], word) == word
            assert seen.setdefault(word, got.hashes[j]) == got.hashes[j]


def test_shapes_see_case_digits_and_signs():
    got = w.words_of(pa.array(["Ab cd Xyz A1 b!! c! 12", "ef"]), w.SPACED, shapes=True)
    ab, cd, xyz, a1, b2, c1, n, ef = got.shapes
    assert ab == xyz and cd == ef and b2 == c1 and len({ab, cd, a1, b2, n}) == 5


def test_empty_column():
    got = w.words_of(pa.array([], pa.string()), w.SPACED, shapes=True)
    assert len(got.hashes) == 0 and list(got.first) == [0]


def test_grams_depend_on_order():
    h = w.words_of(pa.array(["a b a b b a"]), w.SPACED).hashes
    g = w.grams(h, 2)
    assert g[0] == g[2] and len(set(g.tolist())) == 3 and len(w.grams(h, 7)) == 0
