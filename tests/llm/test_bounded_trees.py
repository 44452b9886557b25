"""Signature trees: memory of a block of near copies; lattices: the same order of sums."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tardy.llm import lattice_lm as L
from tardy.llm import signature_join as J


def near_copies(n, parts):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    sets = []
    for k in range(n):
        s = base.copy()
        s[k % 60] = r.integers(0, 2**63, dtype=np.uint64)
        sets.append(np.unique(s))
    columns = {"cls": np.arange(n), "comp": np.arange(n) % parts, "n": np.array([len(s) for s in sets])}
    return pa.table({**{k: pa.array(v, pa.int64()) for k, v in columns.items()}, "side": pa.array([0] * n, pa.int32()), "sig": pa.array([J.signature(s) for s in sets], pa.binary())})


def pairs(table):
    out = J._tree_pairs(J.Join())(table)
    return list(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))


def test_copies_of_one_component_take_no_pairs():
    table = near_copies(3000, 1)
    tracemalloc.start()
    try:
        assert pairs(table) == []
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


def test_pairs_of_components_do_not_depend_on_the_portions(monkeypatch):
    table = near_copies(300, 3)
    whole = pairs(table)
    monkeypatch.setattr(J, "NODE_PAIRS", 7)
    assert pairs(table) == whole
    sig, n = table.column("sig").to_pylist(), table.column("n").to_pylist()
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if a % 3 != b % 3 and J.pair_possible(sig[a], n[a], sig[b], n[b])}
    assert want <= set(whole)


def test_levels_sort_small_depths_by_radix(monkeypatch):
    vocab = L.Vocabulary([chr(L.MARK), chr(L.MARK) + "ab", "a", "b", "ab", "ba", "aba"])
    logp = np.log(np.full(vocab.stop + 1, 1.0 / (vocab.stop + 1)))
    sorted_by = []
    real = np.lexsort
    monkeypatch.setattr(L.np, "lexsort", lambda keys: sorted_by.append(keys[-1].dtype) or real(keys))
    lattice = L.Lattice(vocab, ["ab", "abab", "b", "aba"])
    assert np.isfinite(lattice.log_prob(logp)).all()
    assert sorted_by == [np.uint16]  # the beginnings are sorted only where they are asked for
    lattice.expected(logp)
    assert len(sorted_by) == 2
