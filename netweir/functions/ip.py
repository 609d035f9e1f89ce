"""IP address expressions. Addresses are 16 bytes; IPv4 is held in its mapped form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

V4_MAPPED = "00000000000000000000FFFF"


def _hex_literal(text: str) -> Column:
    return F.expr(f"X'{text}'")


def u32_to_text(ip: Column) -> Column:
    """32-bit number to dotted text."""
    parts = [F.shiftright(ip, shift).bitwiseAND(F.lit(255)) for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *[p.cast("string") for p in parts])


def text_to_u32(text: Column) -> Column:
    """Dotted text to a 32-bit number held in a BIGINT; NULL for anything but four octets."""
    octets = F.when(text.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.split(text, r"\."))
    parts = [F.get(octets, F.lit(i)).try_cast("long") for i in range(4)]
    total = F.lit(0).cast("long")
    for part in parts:
        total = total * 256 + part
    return F.when(F.greatest(*parts) <= 255, total)


def u32_to_binary(ip: Column) -> Column:
    """32-bit number to the 16-byte mapped form."""
    return F.concat(_hex_literal(V4_MAPPED), F.unhex(F.lpad(F.hex(ip), 8, "0")))


def wire_to_binary(ip: Column) -> Column:
    """4- or 16-byte wire address to 16 bytes; empty stays empty."""
    return F.when(F.octet_length(ip) == 4, F.concat(_hex_literal(V4_MAPPED), ip)).otherwise(ip)


def is_v4(ip: Column) -> Column:
    return F.substring(ip, 1, 12) == _hex_literal(V4_MAPPED)


def binary_to_text(ip: Column) -> Column:
    """Dotted text for mapped IPv4, eight groups of hex digits for IPv6."""
    dotted = F.concat_ws(".", *[F.conv(F.hex(F.substring(ip, 13 + i, 1)), 16, 10) for i in range(4)])
    groups = F.regexp_replace(F.lower(F.hex(ip)), "(.{4})(?=.)", "$1:")
    return F.when(is_v4(ip), dotted).otherwise(groups)


def mask(ip: Column, prefix_len: int) -> Column:
    """Clear every bit after ``prefix_len`` of a 16-byte address."""
    if not 0 <= prefix_len <= 128:
        raise ValueError(f"prefix length {prefix_len} is outside 0..128")
    full, rest = divmod(prefix_len, 8)
    parts = []
    if full:
        parts.append(F.substring(ip, 1, full))
    if rest:
        keep = (0xFF << (8 - rest)) & 0xFF
        byte = F.conv(F.hex(F.substring(ip, full + 1, 1)), 16, 10).cast("int")
        parts.append(F.unhex(F.lpad(F.hex(byte.bitwiseAND(F.lit(keep))), 2, "0")))
    zeros = 16 - full - (1 if rest else 0)
    if zeros:
        parts.append(_hex_literal("00" * zeros))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def words(ip: Column) -> tuple[Column, Column]:
    """A 16-byte address as two signed 64-bit halves; NULL for anything else.

    Masks and keys on numbers stay in compiled code, where byte strings would be copied.
    """
    whole = F.octet_length(ip) == 16
    half = lambda start: F.conv(F.hex(F.substring(ip, start, 8)), 16, -10).cast("long")
    return F.when(whole, half(1)), F.when(whole, half(9))


def network(ip: Column) -> Column:
    """The reporting network of an address: /24 for IPv4, /48 for IPv6."""
    return F.when(is_v4(ip), mask(ip, 96 + 24)).otherwise(mask(ip, 48))


def strip_cidr(address: Column) -> Column:
    return F.substring_index(address, "/", 1)


def tcp_flag_names(flags: Column) -> Column:
    """Names of the set bits, lowest bit first, joined by commas."""
    from netweir.schema import TCP_FLAG_BITS

    return F.concat_ws(
        ",",
        *[F.when(flags.bitwiseAND(F.lit(1 << bit)) != 0, name) for bit, name in TCP_FLAG_BITS.items()],
    )
