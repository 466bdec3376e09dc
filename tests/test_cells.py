"""A cell of the grid of neighbours holds a tile of scores, whatever the blocks' sizes."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from lotwise.operators import vectors


def blocks(n, m, dims=16):
    x = np.random.default_rng(3).integers(-2, 3, (n + m, dims)).astype("float32")  # with many ties, and rows of zeros
    return pd.DataFrame({"id": np.arange(n), "v": list(x[:n])}), pd.DataFrame({"query_id": np.arange(m) * 2, "v": list(x[n:])})


@pytest.mark.parametrize("earlier", [False, True])
def test_tiles_give_the_rows_of_one_product(monkeypatch, earlier):
    c, q = blocks(700, 90, 4)
    told = lambda: vectors._cell(6, earlier)(c, q).reset_index(drop=True)
    want = told()
    monkeypatch.setattr(vectors, "TILE", 5)
    monkeypatch.setattr(vectors, "ASKED_TILE", 7)
    pd.testing.assert_frame_equal(told(), want)


def test_a_cell_holds_a_tile_of_scores():
    c, q = blocks(20_000, 600)
    cell = vectors._cell(10, False)
    tracemalloc.start()
    cell(c, q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # the scores of 256 queries alone took more than twice that
