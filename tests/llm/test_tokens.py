import numpy as np
import pyarrow as pa
import pytest

from grovemill.llm.tokens import WordEncoder, default_vocabulary

TEXTS = ["It's a TEST,\tof  the\nword-encoder 12345", "", "  lead and trail  ", "Éclaiŕ ́x naïve gap wide ΑΣ ΟΔΟΣ", "<|endoftext|> mid<|startoftext|>dle 'RE don't 日本語テキスト", "\x1c\x85odd\x0bspaces\x0c", "ﬁ ǅ İstanbul ẞ"]


@pytest.mark.parametrize("plain", [False, True])
def test_equals_direct_calls(plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = plain
    e = WordEncoder(plain_specials=plain, keep=10)
    for _ in range(2):
        ids, ends = e.encode(pa.array([*TEXTS, None]))
        at = 0
        for text, end in zip([*TEXTS, ""], ends.tolist(), strict=True):
            assert ids[at:end].tolist() == t.encode(text, add_special_tokens=False).ids
            at = end


def test_sliced_arrays():
    e = WordEncoder()
    whole = pa.array(TEXTS)
    ids, ends = e.encode(whole.slice(2, 3))
    assert ends[0] == len(e.direct(TEXTS[2])) and ends[-1] == sum(len(e.direct(x)) for x in TEXTS[2:5]) == len(ids)


def test_every_simple_character():
    e = WordEncoder()
    words = [f"a{chr(c)}B{chr(c)}" for c in [*range(33, 127), *range(0xA1, 0x180)]]
    ids, ends = e.encode(pa.array(words))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [e.direct(w) for w in words]


def test_long_pieces_and_apostrophes():
    from grovemill.llm.tokens import LONG

    e = WordEncoder()
    words = [c * n for c in ("in", "é", "=", "7") for n in (LONG // 2, LONG - 1, LONG, LONG + 1, 5 * LONG)]
    words += [f"{a}'{b}{c}" for a in ("", "x", "4", "'", "-") for b in ("s", "t", "re", "ve", "m", "ll", "d", "r", "l", "", "'s") for c in ("", "s", "e", "'", "'ll", "9", "é")]
    words += ["it's'", "we'RE", "'", "a''s"]
    for own in (words, words[::-1]):
        ids, ends = e.encode(pa.array(own))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [e.direct(w) for w in own]


def test_merges_of_random_words(monkeypatch):
    from grovemill.llm import tokens

    monkeypatch.setattr(tokens, "WORDS", 500)
    e, rng = WordEncoder(), np.random.default_rng(3)
    letters = np.array(list("etaoinshrdluETH'\u00e9\u00df.-1"))
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 30, 3000)]
    ids, ends = e.encode(pa.array(words))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [e.direct(w) for w in words]
    assert e.encode(pa.array([], pa.string()))[0].tolist() == [] and e.encode(pa.array(["", None, "  "]))[1].tolist() == [0, 0, 0]
