"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size (an offset and a step
taken from its name); shards take turns, each claiming the first free slot of its order, until the table is
full. Shares differ by at most one slot, and when a shard comes or goes few other keys move. A key's
place is one lookup by its hash, whatever the number of shards; the table's size is fixed by its parameter, so it is
safe to broadcast. All on the DataFrame's own functions.

Cases: null keys hash like any other value and share a shard; equal keys share a shard; repeated rows are
placed each; every column of the input passes through, whatever its name; ``slot`` and ``shard`` are put behind, and
``prefix`` renames them where the input has columns of these names; an empty table gives an empty one; no shards, repeated names or a size that
is not a prime over the number of shards are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def _preference(name: str, size: int) -> tuple[int, int]:
    """(offset, step): slots offset, offset + step, ... modulo size are all slots, as size is prime."""
    h = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(h[:8], "little") % size, int.from_bytes(h[8:16], "little") % (size - 1) + 1


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] = SHARDS, size: int = SIZE) -> list[int]:
    """For each slot the index of its shard."""
    if not shards or len(set(shards)) < len(shards) or not _is_prime(size) or size < len(shards):
        raise ValueError("needs distinct shard names and a prime size that is not under their number")
    # Turns follow the names' order, so a shard list in another order gives the same table.
    turn = sorted(range(len(shards)), key=lambda k: shards[k])
    at, step = {}, {}
    for k in turn:
        at[k], step[k] = _preference(shards[k], size)
    table, filled = [-1] * size, 0
    while True:
        for k in turn:
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            filled += 1
            if filled == size:
                return table


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str] = SHARDS, size: int = SIZE, prefix: str = "") -> DataFrame:
    """All columns of ``df``, then the slot (int) and the shard (string) of each row's key columns."""
    table = lookup_table(shards, size)
    slots = df.sparkSession.createDataFrame([(k, shards[s]) for k, s in enumerate(table)], "slot int, shard string")
    hashed = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(size)).cast("int")
    names = [f"c{i}" for i in range(len(df.columns))]
    at = df.select(hashed.alias("own slot"), "*").toDF("own slot", *names)
    placed = at.join(F.broadcast(slots.toDF("own slot", "own shard")), "own slot", "left")
    return placed.select(*names, "own slot", "own shard").toDF(*df.columns, f"{prefix}slot", f"{prefix}shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
