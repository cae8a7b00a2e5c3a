"""Names and windows: equal words have equal names and symbols wherever they lie, different ones do not."""

import numpy as np
import pytest

from bytegrain.llm import recompress


def split(seed, size=13):
    """Two documents that share passages, as hashes of words and each document's first word."""
    draw = np.random.default_rng(seed)
    words = draw.integers(0, 2**63, 40, dtype=np.uint64)
    shared = words[draw.integers(0, 40 if seed % 2 else 3, 60)]
    a = np.concatenate([draw.integers(0, 2**63, 31, dtype=np.uint64), shared, draw.integers(0, 2**63, 7, dtype=np.uint64)])
    b = np.concatenate([shared, draw.integers(0, 2**63, 19, dtype=np.uint64), shared[:25]])
    return np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])


@pytest.mark.parametrize("rounds", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("seed", range(6))
def test_equal_windows_have_equal_symbols(seed, rounds, size=13):
    words, first = split(seed)
    found = recompress.names(words.copy(), first, rounds)
    at = recompress.useful(found, first, size)
    symbols = recompress.window_symbols(words, size, found, at)
    doc = recompress.owners(first)
    inside = np.flatnonzero(doc[: len(words) - size + 1] == doc[size - 1 :])
    by_words, by_symbols = {}, {}
    for i in inside.tolist():
        by_words.setdefault(words[i : i + size].tobytes(), set()).add(i)
        by_symbols.setdefault(int(symbols[i]), set()).add(i)
    assert sorted(map(sorted, by_words.values())) == sorted(map(sorted, by_symbols.values()))
    if rounds >= 2 and seed % 2:
        assert len(at)  # names do take part


def test_symbols_are_made_of_names():
    """A window's symbols change when a name in it does, though its words are the same to the sums."""
    words, first = split(1)
    found = recompress.names(words.copy(), first, 3)
    at = recompress.useful(found, first, 13)
    other = (found[0] ^ np.uint64(1), *found[1:])
    changed = np.flatnonzero(recompress.window_symbols(words, 13, found, at) != recompress.window_symbols(words, 13, other, at))
    since, to = found[3][at], found[4][at]
    held = {i for i in range(len(words) - 12) if ((since >= i) & (to <= i + 13)).any()}
    assert set(changed.tolist()) == held and held
