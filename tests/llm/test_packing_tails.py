"""Operator 9 with tails that do not pair up."""

import numpy as np
import pytest

from gridweave.llm.sos_packing import Packer


def _pieces(windows):
    return sorted((doc, start, ids.tolist()) for win in windows for doc, start, ids, _ in win)


@pytest.mark.parametrize(("max_open", "window"), [(4, 16), (1, 8), (1000, 16)])
def test_every_id_once_whatever_may_be_open(max_open, window):
    rng = np.random.default_rng(max_open)
    docs = [np.arange(rng.integers(1, 3 * window)) for _ in range(400)]
    packer, done = Packer(window, max_open), []
    for doc, ids in enumerate(docs):
        done += packer.add(doc, ids)
        assert packer.n_open <= max_open and packer.n_open == packer.levels.sum() == sum(map(len, packer.open.values()))
    done += packer.close()
    back = {i: [] for i in range(len(docs))}
    for doc, start, ids in _pieces(done):
        assert start == len(back[doc])
        back[doc] += ids
    assert all(back[i] == ids.tolist() for i, ids in enumerate(docs))
    sizes = [sum(len(p[2]) for p in win) for win in done]
    assert max(sizes) <= window and len(done) == -(-sum(map(len, docs)) // window)


def test_large_tails_are_packed_as_they_come():
    """Documents of 1100 to 2000 ids: no two tails fit one window, yet few windows are left for the end."""
    rng = np.random.default_rng(0)
    sizes = rng.integers(1100, 2000, 30_000)
    packer, done = Packer(), []
    for doc, n in enumerate(sizes.tolist()):
        done += packer.add(doc, np.zeros(n, np.int32))
    assert packer.n_open <= 1024 < 0.05 * len(done)
    done += packer.close()
    assert len(done) == -(-int(sizes.sum()) // 2048)
