"""A bounded filter of a large key set, for rows that meet none of the keys.

The filter is a table of 64-bit words.  A key's hash names one word and four bits of it;
aggregation sets the bits of all keys, and a broadcast join on the word asks for them.  A
key of the set always passes.  Of other keys a few in a hundred pass with 16 bits
a key; beyond ``MOST_WORDS`` words more and more do, so the filter costs the same for any
set and its users stay right without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the largest filter: 8 MiB of bits, some 40 MiB as a broadcast table.
LEAST_WORDS, MOST_WORDS = 1 << 10, 1 << 20
#: Keys that share a word as planned, and bits set for one.
KEYS_A_WORD, BITS = 4, 4


def _place(key: str, words: int) -> tuple[Column, Column]:
    """The word of a key, and its bits in it."""
    h = F.xxhash64(F.col(key), F.lit(11))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    mask = bit(0)
    for i in range(1, BITS):
        mask = mask.bitwiseOR(bit(i))
    return F.shiftrightunsigned(h, 64 - (words.bit_length() - 1)), mask


def key_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(word, bits) of the keys, with the number of words, a power of two within the limits."""
    wanted = -(-keys.count() // KEYS_A_WORD)
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << max(0, wanted - 1).bit_length()))
    word, bits = _place(key, words)
    return keys.select(word.alias("__word"), bits.alias("__bits")).groupBy("__word").agg(F.bit_or("__bits").alias("__bits")), words


def may_be_known(rows: DataFrame, key: str, known: DataFrame, words: int) -> DataFrame:
    """``rows`` without those whose key is certainly not in the set; nothing is shuffled."""
    word, bits = _place(key, words)
    asked = rows.withColumn("__at", word).withColumn("__asked", bits)
    filled = F.broadcast(known)  # at most MOST_WORDS rows
    meets = (F.col("__at") == F.col("__word")) & (F.col("__bits").bitwiseAND(F.col("__asked")) == F.col("__asked"))
    return asked.join(filled, meets, "left_semi").drop("__at", "__asked")
