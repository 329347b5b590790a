"""Exact dedup: an extendible-hash index on shared files, in DataFrame operations only.

Texts get a 64-bit key.  A directory of key prefixes doubles while a bucket has
too many distinct keys and can still be split; it is broadcast, as it has
2 ** DIRECTORY_BITS rows at most.  Every row finds its bucket there.

Building: rows of a bucket that agree in key *and* text, compared byte by byte,
become one slot; they are combined in each map task first, so a group of copies
that holds a third of all rows crosses the network once a task.  Owner tasks
take ranges of (bucket, key), number the slots of equal keys as a chain and
write the pages of the index.

Looking up: a row goes by its key's prefix to the directory, by that to its
bucket, and there by its key to its slot.  Slots that hold more than one in
``HOT_SHARE`` of all rows, of which there can be no more than that, are
broadcast; all others are joined by bucket and key.  In a chain the texts
themselves are compared.

Defined results: null text is the empty text, and texts of any length are
compared whole; null doc_ids count as smaller than any other, and a group of
nulls only keeps null; rows that repeat a doc_id with an equal text are one
document and are flagged alike; an empty table gives no rows; other columns
are neither read nor needed, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_folder, stored

#: Distinct keys in a bucket before it splits, and the most bits of the directory.
BUCKET_ROWS = 32_768
DIRECTORY_BITS = 16
#: Slots with a larger share of all rows than one in so many are found by broadcast.
HOT_SHARE = 1024


class ExactIndex(NamedTuple):
    """pages: bucket, key, chain, chain_size, keep_id, group_size, text_sha256; texts: bucket, key, text, text_sha256 of chains of two or more; directory: prefix, depth."""

    pages: DataFrame
    texts: DataFrame
    directory: DataFrame
    bits: int
    key: Callable[[Column], Column]


def _key(bits: int) -> Callable[[Column], Column]:
    return lambda text: F.xxhash64(text) if bits >= 64 else F.shiftleft(F.xxhash64(text), 64 - bits)


def _directory(keys: DataFrame, folder: str, bucket_rows: int, bits: int) -> DataFrame:
    """Local depth of each key prefix: all buckets start as one; the overfull ones split by their next bit, round by round."""
    prefix = F.shiftrightunsigned("key", 64 - bits).alias("prefix")
    state = stored(keys.groupBy(prefix).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("depth")), folder, "directory0")
    bucket = F.expr(f"shiftright(prefix, {bits} - depth)").alias("bucket")
    for depth in range(bits):
        full = state.groupBy("depth", bucket).agg(F.sum("n").alias("rows")).filter((F.col("rows") > bucket_rows) & (F.col("depth") == depth))
        if full.isEmpty():
            break
        state = state.withColumn("bucket", bucket).join(F.broadcast(full.select("depth", "bucket", F.lit(1).alias("split"))), ["depth", "bucket"], "left")
        state = stored(state.select("prefix", "n", (F.col("depth") + F.coalesce("split", F.lit(0))).alias("depth")), folder, f"directory{depth + 1}")
    return state.select("prefix", "depth")


def _addressed(rows: DataFrame, directory: DataFrame, bits: int) -> DataFrame:
    """rows (with a column key) with the bucket that the directory names; -1 for prefixes that it doesn't have."""
    placed = rows.withColumn("prefix", F.shiftrightunsigned("key", 64 - bits)).join(F.broadcast(directory), "prefix", "left")
    bucket = F.expr(f"shiftleft(shiftright(prefix, {bits} - depth), {bits} - depth)")
    return placed.withColumn("bucket", F.coalesce(bucket, F.lit(-1))).drop("prefix", "depth")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, bucket_rows: int = BUCKET_ROWS, directory_bits: int = DIRECTORY_BITS, key_bits: int = 64) -> ExactIndex:
    """The index of all texts, on files in the shared folder.  key_bits under 64 is for tests: it makes keys collide."""
    folder, key = shared_folder(docs.sparkSession, "exact"), _key(key_bits)
    rows = _texts(docs, id_col, text_col, normalise, key)
    directory = _directory(rows.select("key").distinct(), folder, bucket_rows, directory_bits)
    rows = _addressed(rows, directory, directory_bits)
    slots = rows.groupBy("bucket", "key", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    slots = stored(slots.select("bucket", "key", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")), folder, "slots")
    chain = Window.partitionBy("bucket", "key")
    owned = slots.repartitionByRange("bucket", "key").withColumn("chain", F.row_number().over(chain.orderBy("text_sha256"))).withColumn("chain_size", F.count(F.lit(1)).over(chain))
    pages = stored(owned, folder, "pages")
    chained = pages.filter("chain_size > 1").select("bucket", "key").distinct()
    texts = rows.select("bucket", "key", "text").join(chained, ["bucket", "key"]).distinct().withColumn("text_sha256", F.sha2("text", 256))
    if chained.isEmpty():
        texts = texts.limit(0)
    return ExactIndex(pages, stored(texts, folder, "texts"), directory, directory_bits, key)


def _texts(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column] | None, key: Callable[[Column], Column]) -> DataFrame:
    text = (normalise or (lambda c: c))(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).withColumn("key", key(F.col("text")))


def look_up(rows: DataFrame, index: ExactIndex, hot_share: int = HOT_SHARE) -> DataFrame:
    """doc_id, keep_id, group_size, text_sha256 for each row of doc_id, text, key; nulls where the index doesn't have the text."""
    slot = ["keep_id", "group_size", "text_sha256", "chain_size"]
    heads = index.pages.filter("chain = 1").select("bucket", "key", *slot)
    total = index.pages.agg(F.sum("group_size")).first()[0] or 0
    hot = (F.col("chain_size") == 1) & (F.col("group_size") * hot_share > total)  # fewer than hot_share slots
    found = _addressed(rows.select("doc_id", "key"), index.directory, index.bits)
    found = found.join(F.broadcast(heads.filter(hot).select("bucket", "key", F.struct(*slot).alias("hot"))), ["bucket", "key"], "left")
    # what has been found is dealt out by its doc_id, so that it burdens no task
    met = F.col("hot").isNotNull()
    found = found.select("doc_id", "hot", F.when(met, -2).otherwise(F.col("bucket")).alias("bucket"), F.when(met, F.xxhash64("doc_id", "key")).otherwise(F.col("key")).alias("key"))
    found = found.join(heads.filter(~hot), ["bucket", "key"], "left")
    found = found.select("doc_id", *(F.coalesce(F.col(f"hot.{c}"), F.col(c)).alias(c) for c in slot))
    if index.texts.isEmpty():
        return found.drop("chain_size")
    # in a chain the bytes decide
    members = index.texts.join(index.pages, ["bucket", "key", "text_sha256"]).select("bucket", "key", "text", "keep_id", "group_size", "text_sha256")
    chains = index.texts.select("bucket", "key").distinct()
    own = _addressed(rows, index.directory, index.bits).join(chains, ["bucket", "key"], "left_semi").join(members, ["bucket", "key", "text"], "left")
    return found.filter("chain_size is null or chain_size = 1").drop("chain_size").unionByName(own.select("doc_id", "keep_id", "group_size", "text_sha256"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, **index_options) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build_index(docs, id_col, text_col, normalise, **index_options)
    found = look_up(_texts(docs, id_col, text_col, normalise, index.key), index)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, **index_options) -> DataFrame:
    """docs, all columns, with the row of the largest doc_id of each group of equal texts; rows that repeat it with its text go as well, but for one of them."""
    marked = stored(mark_copies(docs, id_col, text_col, normalise, **index_options), shared_folder(docs.sparkSession, "marked"), "marked")
    gone = marked.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone_id"), F.col("text_sha256").alias("__gone_sha")).distinct()
    sha = F.sha2((normalise or (lambda c: c))(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), 256)
    left = docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__gone_id")) & (sha == F.col("__gone_sha")), "left_anti")
    if not marked.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty():
        left = left.withColumn("__sha", sha).dropDuplicates([id_col, "__sha"]).drop("__sha")
    return left
