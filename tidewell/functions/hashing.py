"""The 40-letter row key of a URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letter_hash(text: Column) -> Column:
    """SHA-1 as forty letters, two a byte.

    A byte's number is itself, but 0 counts as 255 and those from 128 on are one less
    (so 127 and 128 are alike); number n gives the letters n % 26 and 2 * (n / 26).
    """

    def letters(i: Column) -> Column:
        byte = F.conv(F.substring(F.sha1(F.encode(text, "UTF-8")), i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        n = F.when(byte == 0, 255).when(byte >= 128, byte - 1).otherwise(byte)
        return F.concat(F.char(n % 26 + 97), F.char(F.floor(n / 26).cast("int") * 2 + 97))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), letters), "")
