"""Column expressions over bytes and keys that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GOLDEN = 0x9E3779B9


def low_word(crc: Column) -> Column:
    """low32(crc * 0x9e3779b9), split so that no product overflows under ANSI rules."""
    low = crc.bitwiseAND(F.lit(65535)) * F.lit(GOLDEN)
    high = F.shiftleft((F.shiftrightunsigned(crc, 16) * F.lit(GOLDEN)).bitwiseAND(F.lit(65535)), 16)
    return (low + high).bitwiseAND(F.lit(0xFFFFFFFF))


def bloom_positions(crc: Column, bits: int, k: int) -> Column:
    """The k positions low + i * crc modulo bits."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(low_word(crc) + i * crc, F.lit(bits)))


def hex64(signed: Column) -> Column:
    """A signed long's 64 bits as 16 hex digits, which sort like the unsigned number."""
    return F.lpad(F.lower(F.hex(signed)), 16, "0")


def layer(df: Column, df_max: int, df_top: int | None = None) -> Column:
    """B up to df_max, else C; beyond df_top, where given, none."""
    out = F.when(df <= df_max, "B")
    return out.otherwise("C") if df_top is None else out.when(df <= df_top, "C")
