"""Reading fields out of raw packets with built-in binary functions.

Positions are 0-based. Comparisons with fixed bytes are made on the binary
value itself; only fields that are shown become numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def cut(data: Column, start: int | Column, size: int | Column | None = None) -> Column:
    """Bytes from ``start``, at most ``size`` of them."""
    first = F.lit(start + 1) if isinstance(start, int) else start + 1
    if size is None:
        return F.substr(data, first)
    return F.substr(data, first, F.lit(size) if isinstance(size, int) else size)


def raw(*values: int) -> Column:
    return F.lit(bytes(values))


def uint(data: Column, start: int, size: int = 1) -> Column:
    """Big-endian unsigned number of one or two bytes; null past the end."""
    return F.conv(F.nullif(F.hex(cut(data, start, size)), F.lit("")), 16, 10).cast("int")


def ipv4_text(data: Column, start: int) -> Column:
    return F.concat_ws(".", *[uint(data, start + i).cast("string") for i in range(4)])


def ip_protocol_name(number: Column) -> Column:
    name = F.concat(F.lit("PROTO_"), number.cast("string"))
    for value, label in C.IP_PROTOCOLS.items():
        name = F.when(number == value, label).otherwise(name)
    return name


def tcp_flags_text(flags: Column) -> Column:
    return F.concat(*[
        F.when(flags.bitwiseAND(F.lit(mask)) != 0, letter).otherwise("") for mask, letter in C.TCP_FLAGS
    ])
