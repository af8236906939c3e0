"""A bitmap of fixed size that tells most rows of one table that have no partner in another, so that they need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap, 8 MB, whatever the sizes of the tables: all that is broadcast.
SLOTS = 1 << 26
#: Name of the added column.
MAYBE = "_veil_maybe"


def maybe_in(source: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """source with MAYBE: false where no row of wanted has its `key`; true where one has, and for a few others. The more keys
    wanted has beyond the bitmap's size, the more others."""
    slot: Column = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    held = wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits")
    )
    j = source.withColumn("_slot", slot)
    j = j.join(F.broadcast(held), F.bitmap_bucket_number("_slot") == F.col("_bucket"), "left")
    bit = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return j.select(*source.columns, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)).alias(MAYBE))
