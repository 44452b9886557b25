import brute
import pytest
from conftest import EDGE, LONG
from pyspark.sql import functions as F

from tardy.llm import chat_parts as C
from tardy.llm import chunk_dedup, host_quality, length_buckets, pii_bootstrap, url_cascade
from tardy.llm.common import prefix_sums


def test_prefix_sums(spark):
    rows = spark.createDataFrame([([],), ([5],), (list(range(1000)),)], "x array<bigint>")
    for r in rows.select("x", prefix_sums(F.col("x")).alias("s")).collect():
        assert r["s"] == [sum(r["x"][:i]) for i in range(len(r["x"]))]


def test_quality(edge, nothing):
    got = host_quality.judge_documents(edge).collect()
    assert len(got) == len(EDGE)
    want = sorted(brute.quality(t) for _, t in EDGE)
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert host_quality.judge_documents(nothing).count() == 0
    kept = host_quality.keep_good(edge)
    assert kept.columns == edge.columns and kept.count() == 0  # the host fails as a whole


def test_quality_keeps_clean_hosts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, good + f" {i}", "a") for i in range(9)] + [(10, "too short", "a"), (11, good, "b"), (12, "bad", "c"), (13, "bad", "c")], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in host_quality.keep_good(docs).collect()} == {*range(9), 11}


def _copies(rows):
    return sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.text_sha256) for r in rows)


@pytest.mark.parametrize("weak", [False, True])
def test_chunk_dedup(edge, nothing, weak):
    # With a weak hash all chunks collide and get verified order numbers.
    how = {"hash_of": lambda c: F.pmod(F.xxhash64(c), F.lit(2))} if weak else {}
    got = chunk_dedup.copy_groups(edge, **how).collect()
    groups = {}
    for i, t in EDGE:
        groups.setdefault(brute.normal(t), []).append(i)
    want = [(i or 0, min((x for x in g if x is not None), default=0), len(g), brute.sha(t)) for t, g in groups.items() for i in g]
    assert _copies(got) == sorted(want)
    assert sum(r.kept for r in got) == len(groups)
    assert chunk_dedup.copy_groups(nothing, **how).count() == 0


def test_drop_copies(edge, nothing):
    left = chunk_dedup.drop_copies(edge)
    assert left.columns == edge.columns
    assert sorted((r.doc_id for r in left.collect())) == [1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12]
    assert chunk_dedup.drop_copies(nothing).count() == 0


def test_chunks_resynchronise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'")
    text = " ".join(r.t for r in docs.select(chunk_dedup.normalised().alias("t")).orderBy("doc_id").collect())
    made = spark.createDataFrame([(text,), ("another start " + text,)], "t string").select(chunk_dedup.chunks(F.col("t")).alias("c")).collect()
    assert "".join(made[0].c) == text and max(map(len, made[0].c)) <= 4096
    assert len(made[0].c) > 200 and len({*made[0].c} - {*made[1].c}) <= 5


def test_pii_base(edge, nothing):
    got = pii_bootstrap.find_spans(edge).select("doc_id", pii_bootstrap.spell(F.col("base")).alias("s")).collect()
    assert sorted((r.doc_id or 0, r.s) for r in got) == sorted((i or 0, ",".join(brute.pii(t))) for i, t in EDGE)
    assert pii_bootstrap.find_spans(nothing).count() == 0


def test_pii_bootstraps(spark):
    rows = [(i, f"Some text. Please write card number: {n} thanks") for i, n in enumerate(["4111111111111111", "5500005555555559", "340000000000009", "6011000000000004", "4012888888881881"])]
    rows += [(9, "Well, card number: 4111111111111112 maybe"), (10, "we made 4111111111111112345678 units")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.s for r in pii_bootstrap.find_spans(docs).select("doc_id", pii_bootstrap.spell(F.col("found")).alias("s")).collect()}
    assert found[9] == "card:19:35" and found[10] == ""
    red = {r.doc_id: r.text for r in pii_bootstrap.redact(docs).collect()}
    assert red[9] == "Well, card number: <CARD> maybe" and red[0].endswith("number: <CARD> thanks")


def test_pii_keeps_every_confident_pattern(spark):
    """More than 10,000 patterns, each with four seeds and an unseen identifier."""
    n = 10_050
    w = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, "".join(f"{w(i)} mail x{j}{w(i)}@b.co and " for j in range(4)) + f"{w(i)} mail {100_000 + i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert pii_bootstrap.find_spans(docs).where(F.size("found") == 5).count() == n


def test_pii_patterns_without_seeds(spark):
    """p stands before 200 emails and 40 identifiers; q only before those 40 and
    8 others; r only before those 8 and a last one."""
    after = {"p": [f"x{i}@b.co" for i in range(200)] + [f"A1000{i}" for i in range(40)], "q": [f"A1000{i}" for i in range(40)] + [f"A2000{i}" for i in range(8)]}
    after["r"] = after["q"][40:] + ["A30000"]
    rows = [(i, f"the {w} code {v} is") for i, (w, v) in enumerate((w, v) for w, vs in after.items() for v in vs)]
    found = pii_bootstrap.find_spans(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2))
    got = {r.doc_id: r.s for r in found.select("doc_id", pii_bootstrap.spell(F.col("found")).alias("s")).collect()}
    assert len(got) == 297 and all(got[i].startswith("email:11:") for i, _ in rows)


def _found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    return {r.doc_id: r.s for r in pii_bootstrap.find_spans(docs).select("doc_id", pii_bootstrap.spell(F.col("found")).alias("s")).collect()}


def test_pii_contexts_are_whole_words(spark):
    """Words of any length count in full: only the same two words are a pattern."""
    a, b = "a" * 30, "b" * 30
    texts = [f"{a} {b} x{i}@b.co" for i in range(5)] + ["z" * 13 + "a" * 17 + f" {b} 100045", f"{a} {b} 100046", f"{'c' * 5000} {b} 100047"]
    got = _found(spark, texts)
    assert got[6] == "email:62:68" and got[5] == got[7] == ""


def test_pii_other_patterns_and_occurrences(spark):
    """A phone number that the base pattern drops as it runs into a card number is
    found by its parts; what names itself is marked elsewhere too."""
    texts = [f"w{'xyz'[i % 3]} call +1 ({200 + i}) 555-{1000 + i} q{'abc'[i % 3]}" for i in range(9)]
    texts += ["hello +1 (999) 555-9999 4111111111111112 bye"]
    texts += [f"my number {'abc'[i % 3]}{'def'[i % 3]}: x{i}@y.zz ok then" for i in range(9)]
    texts += ["some number 12345678 ok then", "lone 12345678", "some number 777 ok then", "lone 777", None, ""]
    got = _found(spark, texts)
    assert got[9] == "phone:10:23"
    assert got[19] == "email:12:20" and got[20] == "email:5:13"
    assert got[21] == "email:12:15" and got[22] == got[23] == got[24] == ""


def test_boundaries_are_real_lengths(spark):
    lengths = spark.createDataFrame([(n,) for n in (5, 1030, 2049, 2050, 9001)], "_n bigint")
    assert length_buckets.boundaries(lengths) == [5, 1030, 2049, 2050, 9001]  # five lengths, no padding


def test_redact_edge(edge, nothing):
    out = {r.doc_id: r for r in pii_bootstrap.redact(edge).collect()}
    assert out[10].text == "mail me: <EMAIL><EMAIL>, ip <IP> and 10.0.0.256.1.2, card <CARD> call <PHONE>."
    assert out[3].text is None and out[8].text == LONG and len(out[10]) == len(edge.columns)
    assert pii_bootstrap.redact(nothing).count() == 0


URLS = [None, "", "no scheme/x", "http://", "https://Example.COM/en/a?x#y", "http://www.example.com/en/", "http://a.b.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://x.net", "http://org/..com/", "http://y.com?a/b", "a://b://c.com/"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:6])], "page_id bigint, url string, verdict string")
    for judge in (url_cascade.judge_urls, url_cascade.judge_by_join):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, brute.RULES).collect()}
        assert got == {i: brute.judge_url(u) for i, u in enumerate(URLS + URLS[:6])}
        assert judge(pages.limit(0), brute.RULES).count() == 0
    assert url_cascade.judge_urls(pages, ()).where("rule IS NULL AND verdict = 'allow'").count() == len(URLS) + 6


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("key like '%7'")
    cascade = url_cascade.build_cascade(listed, keys)
    assert len(cascade.levels) > 1
    assert keys.where(cascade.contains(F.col("key"))).count() == listed.count()


TURNS = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", r"<s\> <\s </s\\>"), (2, 1, None, None), (2, 1, "assistant", ""), (2, 0, "assistant", "x<|body|>"), (None, 5, "<|turn|>", "é☃" * 9000), (3, 1, "user", "same"), (3, 1, "user", "same")]


def test_chat_round_trip(spark):
    t = C.Template()
    turns = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").withColumn("parts", C.text_part(F.col("text")))
    made = C.format_conversations(turns, template=t)
    got = made.select("conv_id", C.read_turns(F.col("formatted"), t).alias("t"), C.masked_text(F.col("formatted"), F.col("loss_spans"), t).alias("m")).collect()
    want = brute.conversations(TURNS)
    for r in got:
        n, sha, chars, loss = want[r.conv_id]
        assert (len(r.t), brute.sha("".join(f"{x.role}\n{x.text}\n" for x in r.t)), len(r.m), brute.sha(r.m)) == (n, sha, chars, loss)
    assert len(got) == len(want)
    assert C.format_conversations(turns.limit(0)).count() == 0


def test_chat_parts(spark):
    p = [("text", "see <|image|>", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", 10), ("text", "!", None, None), ("video", None, "c", 1)]
    turns = spark.createDataFrame([(1, 0, "user", p)], f"conv_id bigint, turn bigint, role string, parts {C.PART}")
    r = C.format_conversations(turns).select("*", C.read_parts(F.regexp_extract("formatted", r"(?s)<\|body\|>(.*)</s>", 1)).alias("p")).first()
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 512), ("audio", "b.wav", 250), ("other", "c", 0)]
    assert r.expanded_tokens == 762
    assert [(x.type, x.text) for x in r.p] == [("text", "see <|image|>"), ("image", ""), ("audio", ""), ("text", "!"), ("other", "")]


def test_boundaries_are_optimal():
    from itertools import combinations

    ends, counts = [1, 2, 4, 7, 8, 13, 20], [5, 1, 9, 2, 2, 1, 1]

    def cost(cuts):
        return sum(c * min(b for b in cuts if b >= e) for e, c in zip(ends, counts, strict=True))

    for k in range(1, 8):
        best = min(cost([*x, 20]) for x in combinations(ends[:-1], k - 1))
        assert cost(length_buckets.best_boundaries(ends, counts, k)) == best


def test_packing(edge, nothing):
    how = length_buckets.Packing(buckets=3, token_budget=40)
    got = length_buckets.pack(edge, packing=how).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(brute.WORD.findall(t or "")) + 1 for _, t in EDGE)
    batches = {}
    for r in got:
        assert r.padding == r.boundary - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), rows in batches.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * rows[0].boundary <= 40
    assert length_buckets.pack(nothing).count() == 0


def test_boundaries_are_optimal_over_all_lengths():
    """Against the plain programme over every pair of cells."""
    import random

    rnd = random.Random(7)
    for n in (1, 2, 3, 17, 120):
        ends = sorted(rnd.sample(range(1, 30_000), n))
        counts = [rnd.choice([1, 1, 2, 50]) for _ in ends]
        below = [sum(counts[:i]) for i in range(n + 1)]
        for k in (1, 2, 5, 16):
            best = [0] + [ends[j - 1] * below[j] for j in range(1, n + 1)]
            for _ in range(k - 1):
                best = [0] + [min(best[i] + ends[j - 1] * (below[j] - below[i]) for i in range(j)) for j in range(1, n + 1)]
            got = length_buckets.best_boundaries(ends, counts, k)
            assert len(got) <= k and got[-1] == ends[-1] and got == sorted(set(got))
            assert sum(c * min(b for b in got if b >= e) for e, c in zip(ends, counts)) == best[n]


def test_rows_without_id_are_spread(spark):
    docs = spark.range(400).select(F.lit(None).cast("bigint").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"))
    out = length_buckets.pack(docs).collect()
    assert len(out) == 400 and len({(r.bucket, r.batch, r.slot) for r in out}) == 400 and {r.padding for r in out} == {0}
