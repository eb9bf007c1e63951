"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
PUSHDOWN_LIMIT = 1000
BROADCAST_BYTES = 64 << 20
FILTER_BITS = 8 * BROADCAST_BYTES
ROW_BYTES = 100  # a row's fixed part, generously


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join whose hot left keys are spread over ``salts`` tasks.

    ``spread`` is a left expression that varies inside a key. The right side
    is repeated once per salt, so it should be the smaller, key-unique one.
    """
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def fits_broadcast(df: DataFrame, *strings: str) -> bool:
    """Whether ``df``, known by its longest ``strings``, is safe to broadcast."""
    longest = [F.coalesce(F.max(F.octet_length(c)), F.lit(0)) for c in strings]
    row = df.agg(F.count(F.lit(1)), *longest).first()
    return row[0] * (ROW_BYTES + sum(row[1:])) <= BROADCAST_BYTES


def keyed_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", small: bool = False,
    spread: Column | None = None,
) -> DataFrame:
    """Broadcast ``right`` when it was found ``small``, else join by shuffle.

    With ``spread`` the left keys may be hot, so the shuffle is salted.
    """
    if small:
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how) if spread is None else salted_join(left, right, on, spread, how)


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1


def bitmaps(keys: DataFrame, column: str) -> DataFrame:
    """``(_page, _bits)``: one bit per hash of a key, in pages of 4 KB.

    At most ``FILTER_BITS`` in all, whatever the number of keys. Bits are shuffled
    as numbers and set where they arrive.
    """
    slots = keys.select(_slot(F.col(column)).alias("_slot")).select(
        F.bitmap_bucket_number("_slot").alias("_page"), F.bitmap_bit_position("_slot").alias("_bit")
    )
    return slots.repartition("_page").groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def _marked(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``table`` with ``_possible``: false only where ``column`` is surely not among ``keys``."""
    slot = _slot(F.col(column))
    bit = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    possible = F.coalesce(F.getbit(byte.cast("int"), (bit % 8).cast("int")) == 1, F.lit(False))
    paged = table.withColumn("_page", F.bitmap_bucket_number(slot))
    met = paged.join(F.broadcast(bitmaps(keys, column)), "_page", "left")
    return met.select(*table.columns, possible.alias("_possible"))


def split_by_keys(table: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``table`` split without a shuffle: rows to look up among ``keys``, and surely others.

    By the set of key hashes while that may be broadcast, else by bitmaps of a fixed size.
    """
    hashes = keys.select(F.xxhash64(column).alias("_hash")).distinct()
    if hashes.count() * 16 > BROADCAST_BYTES:
        marked = _marked(table, keys, column)
        return marked.filter("_possible").drop("_possible"), marked.filter("NOT _possible").drop("_possible")
    hashed = table.withColumn("_hash", F.xxhash64(column))
    small = F.broadcast(hashes)
    return hashed.join(small, "_hash", "left_semi").drop("_hash"), hashed.join(small, "_hash", "left_anti").drop("_hash")


def sieve(
    keys: DataFrame, held: DataFrame, column: str, text: str | None = None
) -> Callable[[DataFrame], DataFrame] | None:
    """Adds ``_listed`` to a table: whether its ``column`` is among ``keys``. The table is not shuffled.

    The hashes of ``split_by_keys`` tell what may be listed. What they take in
    wrongly is found among the keys that are ``held``, all that the table may
    have, and is broadcast; None when it is too much for that. ``text`` names the
    string that makes a key long.
    """
    keys, held = (rows.select(column).filter(F.col(column).isNotNull()) for rows in (keys, held))
    hashes = keys.select(F.xxhash64(column).alias("_hash")).distinct()
    crowded = hashes.count() * 16 > BROADCAST_BYTES

    def possible(table: DataFrame) -> DataFrame:
        if crowded:
            return _marked(table, keys, column)
        met = table.withColumn("_hash", F.xxhash64(column)).join(
            F.broadcast(hashes.withColumn("_met", F.lit(True))), "_hash", "left"
        )
        return met.select(*table.columns, F.col("_met").isNotNull().alias("_possible"))

    wrong = possible(held).filter("_possible").select(column).distinct().join(keys, column, "left_anti")
    n, longest = wrong.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length(text or column)), F.lit(0))).first()
    if n and n * (ROW_BYTES + longest) > BROADCAST_BYTES:
        return None

    def mark(table: DataFrame) -> DataFrame:
        marked = possible(table).withColumn("_listed", F.col("_possible") & F.col(column).isNotNull())
        if n:
            marked = marked.join(F.broadcast(wrong.withColumn("_wrong", F.lit(True))), column, "left").withColumn(
                "_listed", F.col("_listed") & F.col("_wrong").isNull()
            )
        return marked.select(*table.columns, "_listed")

    return mark


def holding(table: DataFrame, keys: DataFrame, column: str, small: bool) -> DataFrame:
    """Rows of a wide ``table`` whose ``column`` is among ``keys``; at most candidates are shuffled."""
    if small:
        return table.join(F.broadcast(keys), column, "left_semi")
    mark = sieve(keys, table, column)
    if mark is not None:
        return mark(table).filter("_listed").drop("_listed")
    return split_by_keys(table, keys, column)[0].join(keys, column, "left_semi")


def without(table: DataFrame, keys: DataFrame, column: str, small: bool) -> DataFrame:
    """Rows of a wide ``table`` whose ``column`` is not among ``keys``; only candidates are shuffled."""
    if small:
        return table.join(F.broadcast(keys), column, "left_anti")
    candidates, others = split_by_keys(table, keys, column)
    return candidates.join(keys, column, "left_anti").unionByName(others)


def covered_by(
    paths: DataFrame, prefixes: DataFrame, component: bool = False, small: bool | None = None,
    lengths: set[int] | None = None,
) -> DataFrame:
    """Rows of ``paths`` joined with each ``prefixes`` row their path starts with.

    Each path is cut at the distinct prefix lengths (found by a job unless
    given), which turns the prefix test into an equality. Cuts that are no prefix
    are dropped before any shuffle. With ``component`` a prefix covers itself and
    what lies below it. ``prefixes`` has a unique ``prefix`` column, without a
    slash at the end, next to any others.
    """
    if lengths is None:
        # At most one entry per possible path length, whatever the data size.
        lengths = prefixes.agg(F.collect_set(F.length("prefix"))).first()[0]
    if not lengths:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in prefixes.schema]
        return paths.select("*", *empty).filter(F.lit(False))
    if small is None:
        small = fits_broadcast(prefixes, "prefix")
    cut_at = F.explode(F.array(*[F.lit(n) for n in sorted(lengths)])).alias("_len")
    cut = paths.select("*", cut_at).filter(F.length("path") >= F.col("_len"))
    if component:
        following = F.substr(F.col("path"), F.col("_len") + 1, F.lit(1))
        cut = cut.filter(
            (F.length("path") == F.col("_len")) | (following == "/")
            | (F.substr(F.col("path"), F.col("_len"), F.lit(1)) == "/")
        )
    cut = cut.withColumn("prefix", F.substr(F.col("path"), F.lit(1), F.col("_len"))).drop("_len")
    if not small:
        cut = split_by_keys(cut, prefixes, "prefix")[0]
    return keyed_join(cut, prefixes, ["prefix"], small=small, spread=F.col("path"))


def few(keys: DataFrame, limit: int = PUSHDOWN_LIMIT) -> list | None:
    """The rows of ``keys`` when there are at most ``limit``, else None."""
    found = keys.limit(limit + 1).collect()
    return found if len(found) <= limit else None


def among(column: str, keys: list[str]) -> Column:
    """Scan condition for a list of keys."""
    return F.col(column).isin(keys)


def below(column: str, prefixes: list[str]) -> Column:
    """Scan condition for a list of prefixes."""
    return reduce(lambda x, y: x | y, [F.col(column).startswith(p) for p in prefixes], F.lit(False))


def narrow(table: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Push the ``keys`` into the scan of ``column`` when few.

    Only a hint to the scan: the caller still joins, so a longer key list
    simply leaves ``table`` as it is.
    """
    found = few(keys.distinct())
    return table if found is None else table.filter(among(column, [row[0] for row in found]))
