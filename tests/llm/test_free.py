import math
import random

import brute
import numpy as np
import public_tokenizers as P
import pytest
from conftest import EDGE
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tardy.llm import lattice_lm, signature_join, tree_bpe, zstd_langid

BPE = P.path("word_bpe_49k.json")


def test_bpe(edge, nothing):
    tok = Tokenizer.from_file(BPE)
    want = sorted((i or 0, tok.encode(t or "", add_special_tokens=False).ids) for i, t in EDGE)
    for leaf in (4096, 64):
        got = tree_bpe.encode(edge, BPE, [F.col("doc_id")], leaf=leaf).collect()
        assert sorted((r.doc_id or 0, r.ids) for r in got) == want
        assert all(r.decoded == tok.decode(r.ids, skip_special_tokens=False) for r in got)
    assert tree_bpe.encode(nothing, BPE, [F.col("doc_id")]).count() == 0


def test_tree_concatenation():
    codec, rnd = tree_bpe.Codec.of(BPE), random.Random(1)
    for letters in ("a", "ab", "theinr", "aéß", "!?."):
        for leaf in (1, 3, 16, 50):
            s = "".join(rnd.choices(letters, k=rnd.randint(1, 700)))
            for symbols, _ in codec.pretokens(s):
                leaves = [codec.merge(symbols[i : i + leaf], i + leaf >= len(symbols)) for i in range(0, len(symbols), leaf)]
                assert codec.tree(leaves) == codec.merge(symbols, True)


def _all_paths(word, logp, vocab):
    """Probability of a word by recursion over every segmentation."""
    ids = {p: i for i, p in enumerate(vocab.pieces)}
    text = "\u2581" + word

    def go(i):
        if i == len(text):
            return math.exp(logp[vocab.stop])
        total = 0.0
        for j in range(i + 1, len(text) + 1):
            piece = text[i:j]
            if piece in ids and "\u2581" not in text[max(i, 1) : j]:
                total += math.exp(logp[ids[piece]]) * go(j)
        if i > 0:
            total += math.exp(sum(logp[vocab.first_byte + b] for b in text[i].encode())) * go(i + 1)
        return total

    return go(0)


def test_lattice_sums_all_segmentations():
    vocab = lattice_lm.Vocabulary(["\u2581", "\u2581a", "\u2581ab", "a", "b", "ab", "ba", "é", "\u2581\u2581"])
    logp = lattice_lm._normalise(np.random.default_rng(1).random(vocab.stop + 1), vocab, lattice_lm.Training())
    words = ["a", "ab", "abab", "baé☃", "\u2581a", "x" * 50, "abba" * 5]
    got = lattice_lm.Lattice(vocab, words).log_prob(logp)
    for w, g in zip(words, got, strict=True):
        assert math.isclose(g, math.log(_all_paths(w, logp, vocab)) if len(w) < 30 else g, rel_tol=1e-9)
    counts = lattice_lm.Lattice(vocab, ["ab"]).expected(logp)
    assert math.isclose(counts[vocab.marked].sum(), 1.0) and counts[vocab.stop] == 1


def test_every_round_reads_all_words(spark):
    """Over more distinct words than any sample of 100,000."""
    letters = "abcdefghij"
    words = ["".join(letters[int(c)] for c in str(i)) for i in range(120_000)]
    vocab, how = lattice_lm.Vocabulary([*("\u2581" + c for c in letters), *letters, "ab", "cde", "hij"]), lattice_lm.Training()
    start = [1.0] * len(vocab.pieces)
    got = lattice_lm.fit_scores(spark.createDataFrame([(w,) for w in words], "word string").repartition(8), vocab, start, how)
    first = np.zeros(vocab.stop + 1)
    first[: vocab.first_byte] = 3 * len(words) / len(start)
    first[vocab.stop] = len(words)
    want, lattice = lattice_lm._normalise(first, vocab, how), lattice_lm.Lattice(vocab, words)
    for _ in range(5):
        want = lattice_lm._normalise(lattice.expected(want), vocab, how)
    assert np.allclose(got, want, rtol=1e-9)


def test_lattice_base_columns(edge, nothing):
    pieces, start = lattice_lm.read_pieces(P.path("piece_bpe_32k.model"))
    docs = edge.where("doc_id IS NOT NULL AND doc_id <> 12")
    how = lattice_lm.Training(block_tokens=500)
    training = zstd_langid.is_training("doc_id", 7, 2)
    got = lattice_lm.score_documents(docs, training, pieces, start, how=how).collect()
    want = brute.base_lm([(i, t) for i, t in EDGE if i not in (None, 12)])
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 and math.isfinite(r.score)
    assert len(got) == len(want)
    assert lattice_lm.score_documents(nothing, training, pieces, start).count() == 0


def test_language_id(spark, edge, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    training = zstd_langid.is_training("doc_id", 5, 0)
    known = zstd_langid.fit_dictionaries(docs.where(training))
    got = zstd_langid.predict(docs.where(~training), known, [F.col("lang")])
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.95
    rows = zstd_langid.predict(edge, known, [F.col("doc_id").alias("i"), F.col("text").alias("t")]).collect()
    for r in rows:
        assert (r.lang_pred == "und") == (r.t is None or not any(c.isalpha() for c in r.t)) and 0 <= r.score <= 1
    assert zstd_langid.predict(edge, {}, [F.col("doc_id")]).where("lang_pred <> 'und'").count() == 0
    assert zstd_langid.fit_dictionaries(nothing) == {}


def _near(docs, **how):
    got = signature_join.near_duplicates(docs, how=signature_join.Join(**how)).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


def test_near_edge(edge, nothing):
    docs = edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    assert _near(docs) == brute.near([(i, t) for i, t in dict(EDGE).items() if i is not None])
    assert signature_join.near_duplicates(edge).count() == len(EDGE)
    assert signature_join.near_duplicates(nothing).count() == 0
    left = signature_join.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5, 6, 8, 10, 11, 12]


@pytest.mark.parametrize("how", [{}, {"salt_rows": 4, "tile": 8, "group_rows": 500, "sketch_bits": 12}])
def test_near_groups(spark, how):
    """Groups of edited copies around originals, and a passage shared by many;
    dealt shingles and tiles are forced by the second setting."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    passage = [word() for _ in range(40)]
    docs = [(1000 + i, " ".join([word() for _ in range(30)] + passage)) for i in range(60)]
    for g in range(3):
        base = [word() for _ in range(90)]
        for i in range(50):
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = word()
            docs.append((100 * g + i, " ".join(w)))
    rnd.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert _near(frame, **how) == brute.near(docs)


def test_bounds_never_prune_links():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 5, 33, 400):
        a = np.unique(rnd.integers(1, 2**63, n, dtype=np.uint64))
        for drop in range(0, max(1, n // 3), max(1, n // 40)):
            b = np.unique(np.concatenate([a[drop:], rnd.integers(1, 2**63, drop // 2, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 75 * (len(a) + len(b) - common):
                assert signature_join.pair_possible(signature_join.signature(a), len(a), signature_join.signature(b), len(b))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.cls: r.comp for r in signature_join.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_langid_null_ids_and_spread_samples(spark):
    """A null id is dealt to the held-out rows or not, never null; sampled texts
    are read over their whole length."""
    docs = spark.createDataFrame([(None, "abc", "x"), (1, "abc", "x"), (5, None, None)], "doc_id bigint, text string, lang string")
    assert docs.where(zstd_langid.is_training("doc_id", 5, 0).isNull()).count() == 0
    text = "header words in front " * 400 + "zyxwv utsrq " * 400
    fit = zstd_langid.Fit(sample_docs=10, dict_bytes=8000)
    got = zstd_langid.fit_dictionaries(spark.createDataFrame([(i, text, "x") for i in range(10)], "doc_id bigint, text string, lang string"), fit=fit)
    assert b"header" in got["x"] and got["x"].count(b"zyxwv") > 20 and len(got["x"]) <= 8000


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    a = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    rows = [(1, a), (2, a + " tail"), (2, other), (3, "x y z"), (3, "x y z"), (4, other + " end"), (5, None), (5, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    left = sorted((r.doc_id or 0, r.text or "") for r in signature_join.drop_near_duplicates(docs).collect())
    assert left == sorted([(0, a), (1, a), (2, other), (3, "x y z"), (5, ""), (5, "")])


def test_near_duplicates_of_ids_of_any_type(spark):
    a = " ".join(f"w{i}" for i in range(40))
    rows = [("b", a), ("a", a + " x"), ("c", "one two"), (None, "three"), ("10", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.component_id for r in signature_join.near_duplicates(docs).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", None: None, "10": "10"}
    assert sorted(r.doc_id or "" for r in signature_join.drop_near_duplicates(docs).collect()) == ["", "10", "a", "c"]
