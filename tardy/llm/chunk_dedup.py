"""Exact deduplication by content-defined chunk recipes, DataFrame functions only.

Texts are compared after each run of ASCII white space became one space. A
text is cut at content-defined places, so equal passages give equal chunks
wherever they stand. Distinct chunk texts are shuffled once and checked: a
64-bit hash names a chunk only if no other chunk text has the same hash;
colliding chunks get an order number besides. Documents are then compared by
their ordered lists of verified chunk identifiers, a few numbers each, and the
long texts move no further.

Defined results: null text counts as empty; all empty texts are equal (empty
recipe). Of equal texts the row with the smallest id stays; a null id is larger
than any other. Repeated rows with the same id are copies too: one of them
stays. An empty table gives an empty result. Other columns are not read.

Scale: one pass over the texts for recipes and one for the chunks. Groups of
copies are counted by a partial aggregate (one row per task and group), and
joined back by recipe, where adaptive execution splits a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .common import WS, small_side, whole

#: A chunk ends after six characters of these classes, about one place in 600 of
#: the prose at hand, or else at 4,096 characters (always so in other scripts);
#: it has 64 at least, but for the last one of a text.
BOUNDARY = "[hr][aeo-rt][hinr][aeo-rt][hn ][aeo-rt]"
CHUNK = rf"(?s).{{58,4090}}?(?:{BOUNDARY}|\z)|.{{1,4096}}"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(whole(text), WS + "+", " ")


def chunks(norm: Column) -> Column:
    """The chunks of a normalised text, in order; joined they give the text."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def colliding_chunks(chunk_rows: DataFrame) -> DataFrame:
    """``_h``, ``_chunk``, ``_alt`` (1, 2, ...) of every chunk text whose hash
    ``_h`` another chunk text has too. The distinct texts are compared whole;
    only hashes are grouped after that."""
    distinct = chunk_rows.select("_h", "_chunk").distinct()
    hashes = distinct.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")
    hashes = materialize(hashes, "chunk_collisions")
    if hashes.isEmpty():
        return hashes.select("_h", F.lit("").alias("_chunk"), F.lit(0).alias("_alt")).limit(0)
    same = chunk_rows.join(small_side(hashes), "_h", "left_semi").select("_h", "_chunk").distinct()
    ranked = same.groupBy("_h").agg(F.sort_array(F.collect_list("_chunk")).alias("_c"))
    return materialize(ranked.select("_h", F.posexplode("_c").alias("_alt", "_chunk")).select("_h", "_chunk", (F.col("_alt") + 1).alias("_alt")), "chunk_alts")


def recipes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", hash_of=chunk_hash) -> DataFrame:
    """Per row of ``docs``: ``_id``, ``text_sha256`` of the normalised text and
    ``recipe``, the ordered list of its chunks' verified identifiers."""
    norm = docs.select(F.col(id_col).alias("_id"), normalised(text).alias("_t"))
    cut = norm.withColumn("_c", chunks(F.col("_t")))
    plain = cut.select("_id", F.sha2("_t", 256).alias("text_sha256"), F.transform("_c", hash_of).alias("recipe"))
    chunk_rows = cut.select(F.explode("_c").alias("_chunk")).select(hash_of(F.col("_chunk")).alias("_h"), "_chunk")
    alts = colliding_chunks(chunk_rows)
    if alts.isEmpty():  # every hash was verified: it names one chunk text
        return plain
    # Colliding hashes: their rows alone take the longer way, by the digest of
    # the chunk, and each such identifier gets the order number of its text.
    known = alts.groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct(F.sha2("_chunk", 256), "_alt"))).alias("_m"))
    parts = cut.select("_id", F.sha2("_t", 256).alias("text_sha256"), F.transform("_c", lambda c: F.struct(hash_of(c).alias("h"), F.sha2(c, 256).alias("d"))).alias("_r"))
    parts = materialize(parts.withColumn("_k", F.monotonically_increasing_id()), "chunk_recipes")
    rows = parts.select("_k", F.posexplode("_r").alias("_p", "_x")).select("_k", "_p", F.col("_x.h").alias("_h"), F.col("_x.d").alias("_d"))
    rows = rows.join(small_side(known), "_h", "left").select("_k", "_p", "_h", F.coalesce(F.col("_m")[F.col("_d")], F.lit(0)).cast("bigint").alias("_a"))
    lists = rows.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_p", "_h", "_a"))).alias("_l"))
    ids = F.flatten(F.transform("_l", lambda x: F.array(x["_h"], x["_a"])))
    return parts.join(lists, "_k", "left").select("_id", "text_sha256", F.coalesce(ids, F.array().cast("array<bigint>")).alias("recipe"))


def copy_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", hash_of=chunk_hash) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``, ``n_chunks``."""
    found = materialize(recipes(docs, text, id_col, hash_of), "recipes")
    # Rows with the same id and text: counted, then laid out again, one kept.
    rows = found.groupBy("recipe", "_id").agg(F.count(F.lit(1)).alias("_n"), F.first("text_sha256").alias("text_sha256"))
    groups = found.groupBy("recipe").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = small_side(materialize(groups, "copy_group_sizes"))  # written, so that a hot recipe's rows can be split
    out = rows.join(groups, "recipe").select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_i"))
    return out.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged. Dropped ids are
    looked up next to the texts if they are few; rows whose id occurs more than
    once are told apart by their text's digest."""
    groups = materialize(copy_groups(docs, text, id_col), "copy_groups")
    gone = groups.where(~F.col("kept")).select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    stay = groups.where("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"))
    repeated = materialize(gone.join(stay, (gone["_id"].eqNullSafe(stay["_id"])) & (gone["_sha"] == stay["_sha"]), "left_semi"), "repeated_rows")
    gone = materialize(gone, "dropped_ids")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_did"), F.sha2(normalised(text), 256).alias("_dsha"))
    dropped = small_side(gone, 1_000_000)
    kept = rows.join(dropped, rows["_did"].eqNullSafe(dropped["_id"]) & (rows["_dsha"] == dropped["_sha"]), "left_anti")
    out = kept.select("_row")
    if not repeated.isEmpty():
        again = small_side(repeated)
        first = rows.join(again, rows["_did"].eqNullSafe(again["_id"]) & (rows["_dsha"] == again["_sha"]), "left_semi")
        out = out.unionByName(first.groupBy("_did", "_dsha").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select("_row.*")
