import random

import brute
import numpy as np
import pytest
from conftest import EDGE
from pyspark.sql import functions as F

from tardy.llm import drift_clusters as D
from tardy.llm import spelling_kd as S


def _spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def _corpus(seed=5, count=400):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choices("abé", k=rnd.randint(6, 9))) for _ in range(60)] + ["ÀÿÜabcdefg", "zzzzzzzzzzzz", "aaaaaaaé"]

    def word():
        w = list(rnd.choice(stems[: rnd.choice((3, 10, len(stems)))]))
        for _ in range(rnd.choice((0, 0, 0, 0, 1, 1, 2))):
            i = rnd.randrange(len(w) + 1)
            act = rnd.randrange(3)
            w[i : i + (act > 0)] = [] if act == 1 else [rnd.choice("abéÉA")]
        return "".join(w)

    return [(i, " ".join(word() for _ in range(60))) for i in range(count)]


@pytest.mark.parametrize("points,queries", [(S.POINTS, S.QUERIES), (16, 64), (4, 8)])
def test_spelling_matches_brute_force(spark, points, queries):
    """Also with cells of a few words, so that upper trees, routing and slices of hot cells all work."""
    docs = _corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("x")).repartition(4)
    want = brute.spellings(docs)
    assert max(len(w) for w in want) > 9 and sum(v[0] is not None for v in want.values()) > 20 and any(v[1] != v[0] and v[0] for v in want.values())
    assert _spelled(S.variant_forms(df, points=points, queries=queries)) == want


def test_spelling_edges(edge, nothing):
    rows = [(i, t) for i, t in EDGE]
    assert _spelled(S.variant_forms(edge)) == brute.spellings(rows)
    assert S.variant_forms(nothing).count() == 0


def test_spelling_long_words(spark):
    a = "ab" * 4000
    docs = [(1, f"{a} {a} {a}b {a}b {a[:-1]}"), (2, f"{a[:100]}c{a[101:]} " * 21), (3, f"{a[:-1]} {a}")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert _spelled(S.variant_forms(df)) == brute.spellings(docs)


def test_letter_checks():
    rnd = random.Random(2)
    for _ in range(300):
        a = "".join(rnd.choices("ab", k=6))
        b = "".join(rnd.choices("ab", k=6))
        c = "".join(rnd.choices("ab", k=7))
        x, y, z = (S.letters([w], len(w)) for w in (a, b, c))
        assert S.one_replaced(x, y)[0] == (sum(p != q for p, q in zip(a, b)) == 1)
        assert S.one_inserted(x, z)[0] == any(c[:i] + c[i + 1 :] == a for i in range(7))


def test_tree_search_reaches_all_in_distance():
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choices("abcdeé", k=8)) for _ in range(900)})
    sig = S.signatures(S.letters(words, 8))
    tree = S.Tree(sig)
    got = {(int(a), int(b)) for q, p in tree.search(sig, 1, 1) for a, b in zip(q, p)}
    bits = S._bits(sig).astype(int)
    up = np.maximum(bits[None] - bits[:, None], 0).sum(axis=2)
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero((up <= 1) & (up.T <= 1)))}
    nodes = S.plan_cells(sig[:, ::3], 12)
    own = dict(zip(*map(list, S.reach(nodes, sig, 0, 0))))
    assert len(own) == len(words) and len(set(own.values())) > 8
    reached = set(zip(*map(list, S.reach(nodes, sig, 1, 1))))
    assert all((a, own[b]) in reached for a, b in got)
    assert len(reached) < len(words) * 8  # and prunes


def _vectors(seed, n=400, dim=64, spread=0.3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    rows = [(int(i), [float(c) for c in np.float32(centres[rnd.integers(12)] + spread * rnd.normal(size=dim))]) for i in range(n)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1]), (901, None), (902, [0.0] * 63), (903, [0.0] * 63 + [float("nan")]), (904, [float("inf")] * 64), (905, [None] * 64)]
    return rows


def _clusters(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("x", F.lit(1)).repartition(3)
    assigned, cents, scans = D.cluster_vectors(df, **kw)
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(map(tuple, D.with_inertia(spark, assigned, cents).collect()), key=key), scans


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_clusters_match_plain_lloyd(spark, spread):
    rows = _vectors(1, spread=spread)
    got, scans = _clusters(spark, rows)
    assert got == sorted(brute.lloyd(rows), key=lambda r: tuple((x is None, x) for x in r))
    if spread < 0.1:
        assert scans[-1] < scans[0] / 4  # most vectors are settled by their bounds


def test_clusters_edges(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(6)]  # ties, fewer vectors than centroids
    assert _clusters(spark, rows)[0] == sorted(brute.lloyd(rows))
    assert _clusters(spark, [])[0] == []
    assert _clusters(spark, rows[:1])[0] == brute.lloyd(rows[:1])
    big = [(i, [float(x) for x in np.random.default_rng(i).integers(-400000, 400000, 64)]) for i in range(60)]
    assert _clusters(spark, big)[0] == sorted(brute.lloyd(big))
    with pytest.raises(Exception, match="2\\*\\*27"):
        _clusters(spark, [(1, [1e9] * 64)])


def test_drift_bound_holds_and_tightens():
    rnd = np.random.default_rng(4)
    tighter = 0
    for _ in range(300):
        near, old = rnd.normal(size=5) * 4, rnd.normal(size=5) * 4
        new = old + rnd.normal(size=5) * rnd.choice([0.1, 1.0, 5.0])
        radius = np.array([0.5, 2.0, 6.0])
        bound = D.drift_bound(near, radius, old, new)
        for r, b in zip(radius, bound):
            x = rnd.normal(size=(2000, 5))
            x = near + r * rnd.random((2000, 1)) ** 0.2 * x / np.linalg.norm(x, axis=1)[:, None]
            x = x[np.linalg.norm(x - near, axis=1) <= np.linalg.norm(x - old, axis=1)]
            assert (np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1) <= b + 1e-9).all()
        tighter += bound[0] < 0.9 * np.linalg.norm(new - old)
    assert tighter > 200
