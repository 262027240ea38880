import numpy as np
import pytest

from spliceframe.llm import fm_index as fm


def _text(rng, docs, sigma, copies):
    parts = [rng.integers(1, sigma, rng.integers(0, 30)) for _ in range(docs)]
    parts += [parts[0]] * copies
    return np.concatenate([np.append(p, 0) for p in parts]).astype(np.int32)


@pytest.mark.parametrize("seed", range(6))
def test_finds_and_locates_every_occurrence(seed):
    rng = np.random.default_rng(seed)
    sigma = [2, 3, 5, 17, 4, 9][seed]
    text = _text(rng, 40, sigma, 20)
    index = fm.build(text, sigma)
    phrases = rng.integers(1, sigma, (60, 1 + seed % 4))
    rows, low, high = fm.search(index, phrases)
    of, at = fm.locate(index, low, high)
    got = {(int(rows[o]), int(p)) for o, p in zip(of, at)}
    size = phrases.shape[1]
    assert got == {(r, p) for r in range(60) for p in range(len(text) - size + 1) if (text[p : p + size] == phrases[r]).all()}
    assert len(got) == len(of)


def test_words_the_shard_lacks():
    index = fm.build(np.array([1, 2, 0], np.int32), 3)
    assert len(fm.search(index, np.array([[1, -1], [-1, 2]]))[0]) == 0


def test_a_shard_without_words():
    index = fm.build(np.array([0, 0], np.int32), 1)
    assert len(fm.search(index, np.array([[-1]]))[0]) == 0
