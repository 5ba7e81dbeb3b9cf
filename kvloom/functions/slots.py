"""Hash slots: CRC16 (XMODEM) of a key, or of its tag in braces, modulo 16,384."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 16384
POLYNOMIAL = 0x1021


def crc_table() -> list[int]:
    """The CRC of each byte, from the polynomial."""
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ (POLYNOMIAL if crc & 0x8000 else 0)
        out.append(crc & 0xFFFF)
    return out


def crc16(text: Column) -> Column:
    """CRC16 of the UTF-8 bytes, in the JVM: a fold over the bytes with a table from the plan."""
    hexes = F.hex(F.encode(text, "UTF-8"))
    table = F.array(*[F.lit(x) for x in crc_table()])
    n = F.octet_length(text)
    byte = lambda i: F.conv(F.substring(hexes, 2 * i - 1, F.lit(2)), 16, 10).cast("int")

    def step(crc: Column, i: Column) -> Column:
        index = F.shiftright(crc, 8).bitwiseXOR(byte(i))
        return F.shiftleft(crc, 8).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.get(table, index))

    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step))


def tag(key: Column) -> Column:
    """What is hashed: what stands between the first { and the next }, if both are there, else the whole key."""
    opened = F.instr(key, "{")
    rest = F.substring(key, opened + 1, F.length(key))
    closed = F.instr(rest, "}")
    return F.when((opened > 0) & (closed > 0), F.substring(rest, F.lit(1), closed - 1)).otherwise(key)


def slot(key: Column) -> Column:
    return (crc16(tag(key)) % SLOTS).cast("int")
