"""Sharding by extendible hashing, in DataFrame functions only.

The directory is indexed by bits of a hash of the key. It begins with one bucket; buckets above the byte limit are
split on one more bit, all others stay as they are. Only sums decide: rows are first reduced to the bytes of each cell
of 20 hash bits, and each round sums up the cells of the buckets that are still too large. Buckets that are too large
at 20 bits go on with cells of 40, then 60 bits.

Rows with equal hashes cannot be told apart by more bits. If they exceed the limit together, their bucket gets
overflow pages: its rows are dealt to groups of some dozen limits each, and in a group running sums fill page after
page, up to half a limit before the last row; rows above half a limit have pages of their own. So every page keeps the
limit, but for a row that exceeds it alone, and no task holds a bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tristrata.llm.common import text_or_empty, unused, written

#: Bits of the hash, and bits of the cells that the directory is built from, one after the other.
HASH_BITS = 60
CELL_BITS = (20, 40, 60)
#: Limits, and rows, of one group of an overflowing bucket, about.
GROUP_LIMITS, GROUP_ROWS = 64, 1 << 20


def hash_bits(column):
    """The first 60 bits of the MD5 of a value's text; of ``null`` as a text for null."""
    text = F.coalesce(column.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(column: str, bits: int, depth: int):
    return F.shiftright(column, bits - depth)


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """Buckets of ``sized`` (``hash``, ``n_bytes``) as ``(cell_bits, cell, depth, prefix, shard_docs, shard_bytes)``.

    A bucket has a row for each of its cells, so that a row finds it by an equality. A bucket deeper than the cells of
    20 bits is listed by the finer cells only.
    """
    spark = sized.sparkSession
    found, depth, rows = [], 0, sized
    for bits in CELL_BITS:
        cells = rows.groupBy(_prefix("hash", HASH_BITS, bits).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("docs"))
        cells = written(cells, "cells")
        while depth <= bits:
            own = cells.withColumn("prefix", _prefix("cell", bits, depth))
            sums = own.groupBy("prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
            fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | F.lit(depth == HASH_BITS)
            joined = written(own.join(sums.withColumn("fits", fits), "prefix"), "buckets")
            found.append(joined.filter("fits").select(
                F.lit(bits).alias("cell_bits"), "cell", F.lit(depth).alias("depth"), "prefix", "shard_docs", "shard_bytes"))
            cells = joined.filter(~F.col("fits")).select("cell", "n_bytes", "docs")
            depth += 1
            if cells.isEmpty():
                return written(reduce(DataFrame.unionByName, found), "directory")
        large = cells.select("cell")
        rows = rows.withColumn("cell", _prefix("hash", HASH_BITS, bits)).join(large, "cell", "left_semi").select("hash", "n_bytes")
    return written(reduce(DataFrame.unionByName, found), "directory")


def _sized(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("doc_id"), hash_bits(F.col(id_column)).alias("hash"),
        F.octet_length(text_or_empty(text_column)).cast("long").alias("n_bytes"))


def _placed(rows: DataFrame, buckets: DataFrame, limit: int) -> DataFrame:
    """``rows`` (with ``hash``) and their buckets; each level of cells is joined by equality."""
    out, left = [], rows
    present = {r.cell_bits for r in buckets.select("cell_bits").distinct().collect()} or {CELL_BITS[0]}  # at most three
    for bits in CELL_BITS:
        if bits not in present:
            continue
        level = buckets.filter(F.col("cell_bits") == bits).drop("cell_bits")
        keyed = left.withColumn("cell", _prefix("hash", HASH_BITS, bits))
        if max(present) == bits:
            out.append(keyed.join(level, "cell"))
            break
        out.append(keyed.join(level, "cell"))
        left = keyed.join(level.select("cell"), "cell", "left_anti").drop("cell")
    placed = reduce(DataFrame.unionByName, out)
    # The last ``depth`` digits: the prefix may begin with zeros.
    placed = placed.withColumn("shard", F.expr("if(depth = 0, '', right(lpad(bin(prefix), 64, '0'), depth))"))
    overflowing = (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
    if buckets.filter(overflowing).isEmpty():
        return placed.withColumn("page", F.lit(0).cast("long"))
    whole = placed.filter(~overflowing).withColumn("page", F.lit(0).cast("long"))
    return whole.unionByName(_with_pages(placed.filter(overflowing), limit))


def _with_pages(rows: DataFrame, limit: int) -> DataFrame:
    """The rows of overflowing buckets with their pages, which are numbered with gaps."""
    half = max(1, limit // 2)
    groups = F.ceil(F.greatest(F.col("shard_bytes") / (GROUP_LIMITS * limit), F.col("shard_docs") / GROUP_ROWS))
    dealt = rows.withColumn("__at", F.monotonically_increasing_id())
    dealt = dealt.withColumn("__group", F.pmod(F.xxhash64("__at"), groups).cast("long"))
    small = F.col("n_bytes") <= limit - half
    before = Window.partitionBy("shard", "__group").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum(F.when(small, F.col("n_bytes"))).over(before), F.lit(0))
    large = F.count_if(~small).over(before)
    number = F.when(small, 2 * F.floor(filled / half)).otherwise(2 * large + 1).cast("long")
    return dealt.withColumn("page", F.col("__group") * F.lit(1 << 40) + number).drop("__at", "__group")


def assign_shards(docs: DataFrame, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, shard, depth, shard_docs, shard_bytes, page``.

    ``shard`` holds the hash bits of the bucket, an empty string while all rows fit into one. ``shard_bytes`` is at most
    ``limit`` unless the bucket is one row, or rows of equal hashes; then the rows of each ``page`` are, or are one row.

    A null text has no bytes; a null id is a key of its own, hashed as the text ``null``. Rows with equal ids share a
    bucket. Empty tables give empty results. Other columns of ``docs`` are ignored.
    """
    if limit < 1:
        raise ValueError("the limit is at least one byte")
    sized = written(_sized(docs, id_column, text_column), "sized")
    return _placed(sized, directory(sized.select("hash", "n_bytes"), limit), limit).select(
        "doc_id", "n_bytes", "shard", "depth", "shard_docs", "shard_bytes", "page")


def write_shards(docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write all rows and columns of ``docs``, a Parquet folder per shard and page, below ``path``.

    Folders are called ``shard=b<bits>/page=<n>``. Columns of these names keep their values under names with underscores.
    """
    names = {c: unused(docs.drop(c), f"_{c}") for c in docs.columns if c.lower() in ("shard", "page", "hash", "cell", "depth", "prefix", "shard_docs", "shard_bytes", "n_bytes")}
    docs = docs.withColumnsRenamed(names)
    id_column, text_column = names.get(id_column, id_column), names.get(text_column, text_column)
    buckets = directory(written(_sized(docs, id_column, text_column), "sized").select("hash", "n_bytes"), limit)
    sized = docs.withColumns({"hash": hash_bits(F.col(id_column)), "n_bytes": F.octet_length(text_or_empty(text_column)).cast("long")})
    placed = _placed(sized, buckets, limit)
    placed = placed.withColumn("shard", F.concat(F.lit("b"), "shard"))
    placed.repartition("shard", "page").select(*docs.columns, "shard", "page").write.partitionBy("shard", "page").parquet(path)
