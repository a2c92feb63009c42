import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.functions import needles
from sparkloom.functions.needles import Needles


def brute(rows, texts):
    return sorted({(i, k) for i, t in enumerate(texts) for k, n in rows if n in (t or "")})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab\0é𝄞", min_size=1, max_size=20), max_size=12), st.lists(st.one_of(st.none(), st.text("ab\0é𝄞", max_size=60)), max_size=6))
def test_against_brute_force(quotes, texts):
    rows = list(enumerate(quotes))
    assert Needles(rows).find(texts) == brute(rows, texts)


def test_slices_and_repeats(monkeypatch):
    monkeypatch.setattr(needles, "CHARS", 50)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.choice([0, 3, 40, 200]))) for _ in range(60)]
    rows = [(i, texts[rng.randrange(60)][rng.randrange(3) :][: rng.randrange(1, 70)] or "a") for i in range(80)] + [(99, "a"), (98, "a")]
    assert Needles(rows).find(texts) == brute(rows, texts)
    assert Needles([]).find(texts) == [] and Needles(rows).find([]) == []


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(needles, "_A", needles.np.uint64(0))
    monkeypatch.setattr(needles, "_B", needles.np.uint64(0))
    rows, texts = [(0, "ab"), (1, "abcdefgh"), (2, "zz")], ["xxabxx", "abcdefgi", "abcdefgh"]
    assert Needles(rows).find(texts) == [(0, 0), (1, 0), (2, 0), (2, 1)]
