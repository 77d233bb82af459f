"""Texts under the mask beside the texts that were given, whatever strings they hold."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from plumbline.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [*chat.CONTROL, *chat.FOREIGN, "\\", "\\\\", "[", "<", "/INST]", "s>", " ", "\n", "é", "漢", "😀", "a", "word", "  ", "\t", "\x00"]


def some(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))


def test_escapes_turn_back():
    rng = random.Random(1)
    for _ in range(3000):
        text = some(rng)
        assert chat.unescaped(chat.escaped(text)) == text
        assert not chat.FOUND.search(chat.escaped(text))


def test_rendering_turns_back():
    rng = random.Random(2)
    for _ in range(1000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[ROLE]", "a\nb"]), some(rng)) for _ in range(rng.randint(0, 6))]
        assert chat.parsed(chat.rendered(turns)[0]) == turns


def test_mask_beside_plain_search():
    rng = np.random.default_rng(0)
    for _ in range(200):
        cuts = np.sort(rng.choice(60, 8, replace=False))
        spans = [(int(a), int(b)) for a, b in cuts.reshape(-1, 2)]
        tokens = np.sort(rng.integers(0, 60, (30, 2)), axis=1)
        tokens = tokens[tokens[:, 0] < tokens[:, 1]]
        want = [any(a <= s and e <= b for a, b in spans) for s, e in tokens]
        assert chat.mask(tokens, spans).tolist() == want


def rows():
    rng = random.Random(3)
    out = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool", None]), rng.choice([some(rng), some(rng), None])) for c in range(120) for t in range(rng.randint(1, 7))]
    out += [(500, 0, "user", "long " * 30_000), (500, 1, "assistant", "漢字😀 " * 30_000), (None, 0, "assistant", "x"), (501, 3, "assistant", "b"), (501, 3, "assistant", "a"), (501, None, "user", "first"), (501, 3, "assistant", "a")]
    return out


def test_beside_the_given_texts(spark):
    df = spark.createDataFrame([(*r, "f", [1]) for r in rows()], "conv_id bigint, turn bigint, role string, text string, formatted string, ids array<int>").repartition(5)
    out = chat.formatted(df, PATH)
    got = {r["conv_id"]: r for r in chat.digest(out, PATH).collect()}
    want = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for r in sorted(rows(), key=key):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(learned) and got[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert got[c]["formatted_chars"] == len(chat.rendered(turns)[0])
    assert chat.formatted(df.limit(0), PATH).count() == 0


def test_a_broken_text_is_refused():
    with pytest.raises(ValueError):
        chat.parsed("x[INST]a[/INST]")
