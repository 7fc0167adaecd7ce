"""Reproducible shuffle into shards: a Feistel permutation of global row numbers with cycle walking.

Shard and slot of a row follow from its row number alone, and the row number from shard and slot, so a
reader can find the i-th row of a shard without a table. All of it is column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import stored

ROUNDS = 4
# Round functions work modulo this prime, so that products stay below 2**62.
PRIME = (1 << 31) - 1
# Cycle-walk steps evaluated per pass over the rows; each step leaves less than half of the rows outside.
WALK_STEPS = 8


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Multiplier and addend of each round, from a linear congruential sequence."""
    out, x = [], (seed * 2 + 1) % PRIME
    for _ in range(rounds):
        a = x = (x * 48271 + 11) % PRIME
        b = x = (x * 48271 + 11) % PRIME
        out.append((a or 1, b))
    return out


def half_bits(n: int) -> tuple[int, int]:
    """Bits of the left and right half of the smallest power of two that holds ``n`` numbers."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    return bits // 2, bits - bits // 2


def _feistel(x: Column, left_bits: int, right_bits: int, keys: list[tuple[int, int]]) -> Column:
    """One pass of the permutation over [0, 2**(left_bits + right_bits)); halves swap their widths every round."""
    left, right = F.shiftright(x, right_bits), x.bitwiseAND(F.lit((1 << right_bits) - 1))
    for a, b in keys:
        t = (right * a + b) % PRIME
        t = (t * t + a) % PRIME
        left, right = right, left.bitwiseXOR(t % (1 << left_bits))
        left_bits, right_bits = right_bits, left_bits
    return F.shiftleft(left, right_bits).bitwiseOR(right)


def permuted(rows: DataFrame, number: str, n: int, seed: int, name: str = "permuted") -> DataFrame:
    """Add the place of row ``number`` (0 to n - 1) under the permutation of [0, n).

    Values outside [0, n) are permuted again until they are inside: walking a cycle of a permutation
    from inside always comes back, so the result is a permutation of [0, n). A pass takes
    WALK_STEPS steps; the (few) rows still outside take another pass, until there are none.
    """
    left, right = half_bits(n)
    keys = round_keys(seed)
    walk = lambda start: F.aggregate(
        F.array_repeat(F.lit(0), WALK_STEPS), start,
        lambda x, _: F.when(x < n, x).otherwise(_feistel(x, left, right, keys)))
    out = rows.withColumn(name, walk(_feistel(F.col(number), left, right, keys)))
    while out.filter(F.col(name) >= n).limit(1).count():
        out = out.withColumn(name, walk(F.col(name)))
    return out


def with_row_number(rows: DataFrame, order: list[Column], name: str = "row_number") -> tuple[DataFrame, int]:
    """Number all rows from 0 in the given order; the rows and their count.

    Rows are dealt out by ranges of the order, sorted within each range and written; a row's number is
    its place in its range plus the sizes of the ranges before. No task holds more than one range.
    """
    tie = "_tie"
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn(tie, F.monotonically_increasing_id())
    placed = stored(
        tied.repartitionByRange(parts, *order, F.col(tie)).sortWithinPartitions(*order, F.col(tie)).drop(tie)
        .withColumn("_at", F.monotonically_increasing_id()), "op2-ordered")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    bases = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    numbered = placed.join(F.broadcast(bases), part == F.col("_part")).select(
        *rows.columns, (F.col("_base") + at).alias(name))
    return numbered, placed.count()


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 17, *, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Shuffle all documents into ``shards`` shards whose row counts differ by one at most (law ``rows``).

    A row's number is its place by doc_id (null first), then by size, checksum and hash of the text;
    equal rows are interchangeable. With p the permuted number, shard = p mod shards and
    slot = p div shards, so slots are gapless from 0. ``size`` is the UTF-8 length plus 1, null text: 1,
    with the checksum of no bytes. ``grown_shard`` is null: under this law a new shard deals all rows
    anew. An empty table gives no rows. Other columns are ignored. Equal texts get no common shard:
    groups of copies may outweigh a shard, and counts at most one apart leave no room for it.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                         F.crc32(F.encode(raw, "utf-8")).alias("text_crc32"), F.xxhash64(raw).alias("_hash"))
    narrow = stored(narrow, "op2-rows")
    numbered, n = with_row_number(
        narrow, [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32"), F.col("_hash")])
    return permuted(numbered, "row_number", n, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("permuted") % shards).cast("int").alias("shard"), F.expr(f"permuted div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number")
