"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size:
``(offset + j * skip) mod size`` visits each slot once. Shards take turns
claiming the next slot they prefer that is still free, until the table is full.
Shares differ by at most one slot, and when a shard leaves, few slots of the
others move. A row's slot is a hash of its key, its shard one lookup away.

Nulls and ties: a null key column counts as the empty string; equal keys go to
the same shard unless ``salts`` splits them; repeated rows stay repeated; an
empty table gives an empty result. Columns of the input that clash with
``slot`` or ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:02d}" for i in range(64))
SIZE = 10_007  # a prime, over 100 slots a shard
DIGITS = 15  # hex digits of the digest that make the hash: fits a long


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def fill(shards: Sequence[str], size: int = SIZE) -> list[int]:
    """Index of the shard that owns each slot. Work and size are fixed by the parameters, not by the data."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime")
    if len(shards) > size:
        raise ValueError("more shards than slots")
    at = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    claimed = 0
    while claimed < size:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            claimed += 1
            if claimed == size:
                break
    return owner


def lookup(spark: SparkSession, shards: Sequence[str], size: int = SIZE) -> DataFrame:
    """The table as rows (slot, shard): ``size`` rows."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, size)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(1).select(F.posexplode(owners).alias("slot", "i")).select(
        "slot", F.element_at(names, F.col("i").cast("int") + 1).alias("shard")
    )


def slot_of(keys: Sequence[Column], size: int = SIZE) -> Column:
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") % F.lit(size)


def place(
    df: DataFrame,
    keys: Sequence[str],
    shards: Sequence[str] = SHARDS,
    size: int = SIZE,
    spread: Sequence[str] = (),
    salts: int = 1,
) -> DataFrame:
    """Add ``slot`` and ``shard`` by the values of ``keys``.

    ``salts`` over 1 spreads the rows of one key over so many slots, dealt by
    the columns ``spread``; for keys that hold a large share of all rows.
    The lookup table is broadcast: it has ``size`` rows, whatever the input.
    """
    if salts > 1 and not spread:
        raise ValueError("salts need columns to spread by")
    parts = [F.col(k) for k in keys]
    if salts > 1:
        parts.append(slot_of([F.col(c) for c in spread], salts))
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(parts, size).cast("int"))
    return rows.join(F.broadcast(lookup(df.sparkSession, shards, size)), "slot").select(
        *df.drop("slot", "shard").columns, "slot", "shard"
    )
