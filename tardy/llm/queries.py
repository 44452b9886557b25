"""The registered queries ``opN_<name>`` over whole tables: each applies its
operator with production parameters and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_parts, chunk_dedup, drift_clusters, host_quality, lattice_lm, length_buckets, main_text, pii_bootstrap, signature_join, spelling_kd, tree_bpe, url_cascade, zstd_langid

#: op5: (verdict, host and path prefix).
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: op7: a conversation whose texts hold control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_lm(spark: SparkSession, sf_dir: str, name: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    pieces, start = lattice_lm.read_pieces(public_tokenizers.path(name))
    return lattice_lm.score_documents(_table(spark, sf_dir, "documents"), zstd_langid.is_training("doc_id", 7, 2), pieces, start)


def op2_tree_bpe(spark: SparkSession, sf_dir: str, name: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    coded = tree_bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(name), [F.col("doc_id")])
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.pack(_table(spark, sf_dir, "documents"))


def op4_zstd_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    training = zstd_langid.is_training("doc_id", 5, 0)
    dictionaries = zstd_langid.fit_dictionaries(docs.where(training))
    return zstd_langid.predict(docs, dictionaries, [F.col("doc_id"), (~training).alias("held_out")])


def op5_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], turns.schema)
    t = chat_parts.Template()
    parts = turns.unionByName(extra).withColumn("parts", chat_parts.text_part(F.col("text"))).drop("text")
    made = chat_parts.format_conversations(parts, template=t)
    read = made.select(
        "conv_id",
        chat_parts.read_turns(F.col("formatted"), t).alias("turns"),
        chat_parts.masked_text(F.col("formatted"), F.col("loss_spans"), t).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "expanded_tokens",
    )
    spelled = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "expanded_tokens",
    )


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_bootstrap.find_spans(_table(spark, sf_dir, "documents"))
    of = lambda n: F.size(F.filter("base", lambda x: x["k"] == n))
    counts = [of(n).cast("bigint").alias(f"n_{k}") for n, k in enumerate(pii_bootstrap.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii_bootstrap.spell(F.col("base")), 256).alias("base_sha256"), pii_bootstrap.spell(F.col("found")).alias("spans"))


def op9_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = chunk_dedup.copy_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_quality.judge_documents(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "fail_rate")


def op11_max_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return main_text.extract_main_text(pages, ["page_id", "url"], *main_text.fit_weights(pages))


def op12_drift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids, _ = drift_clusters.cluster_vectors(_table(spark, sf_dir, "embeddings"))
    return drift_clusters.with_inertia(spark, assigned, centroids)


def op13_spelling_kd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_kd.variant_forms(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lattice_lm": op1_lattice_lm,
    "op2_tree_bpe": op2_tree_bpe,
    "op3_length_buckets": op3_length_buckets,
    "op4_zstd_langid": op4_zstd_langid,
    "op5_bloom_cascade": op5_bloom_cascade,
    "op6_signature_trees": op6_signature_trees,
    "op7_chat_parts": op7_chat_parts,
    "op8_pii_bootstrap": op8_pii_bootstrap,
    "op9_chunk_recipes": op9_chunk_recipes,
    "op10_host_rules": op10_host_rules,
    "op11_max_subsequence": op11_max_subsequence,
    "op12_drift_clusters": op12_drift_clusters,
    "op13_spelling_kd": op13_spelling_kd,
}
