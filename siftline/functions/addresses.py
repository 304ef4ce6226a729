"""Internet addresses as column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# IPv4 blocks that are not publicly routed, and the two exceptions inside them.
PRIVATE_BLOCKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
PRIVATE_EXCEPTIONS = ["192.0.0.9", "192.0.0.10"]
# IPv6 blocks that are not publicly routed, and the exceptions inside them.
PRIVATE_BLOCKS_6 = [
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
]
PRIVATE_EXCEPTIONS_6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"
_GROUP = "[0-9A-Fa-f]{1,4}"


def _number_of(ip: Column, pattern: str) -> Column:
    parts = [F.regexp_extract(ip, pattern, i).try_cast("long") for i in (1, 2, 3, 4)]
    return F.when(ip.rlike(pattern), parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3])


def ipv4_number(ip: Column) -> Column:
    """32-bit value of a dotted address, null for any other text."""
    return _number_of(ip, rf"\A{_DOTTED}\z")


def _inside(value: Column, low: Column, high: Column) -> Column:
    return value.between(low, high)


def _in_any(value: Column, ranges: list[tuple]) -> Column:
    """Whether a value lies in one of some ranges given by their ends."""
    listed = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in ranges])
    return F.exists(listed, lambda r: _inside(value, r["low"], r["high"]))


def _public_number(number: Column) -> Column:
    blocks = [ipaddress.ip_network(b) for b in PRIVATE_BLOCKS]
    ranges = [(int(b.network_address), int(b.broadcast_address)) for b in blocks]
    exceptions = [int(ipaddress.ip_address(a)) for a in PRIVATE_EXCEPTIONS]
    return ~_in_any(number, ranges) | number.isin(exceptions)


def is_public_ipv4(ip: Column) -> Column:
    # The number is bound once, in an array of its own, instead of being worked out for every block.
    return F.coalesce(F.exists(F.array(ipv4_number(ip)), _public_number), F.lit(False))


def ipv6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an address in lower case, null for a text that is none.

    Takes one ``::`` for any number of groups, a dotted address in place of the
    last two groups and a zone behind ``%``.  Texts of this form compare as the
    addresses do, so blocks are ranges of them.
    """
    zoned = F.when(ip.rlike(r"\A[^%/]*(%[^%/]+)?\z"), F.regexp_replace(ip, r"(?s)%.*\z", ""))
    tail = _number_of(zoned, rf":{_DOTTED}\z")
    pair = F.lower(F.format_string("%x:%x", F.shiftright(tail, 16), tail.bitwiseAND(0xFFFF)))
    plain = F.when(tail.isNotNull(), F.regexp_replace(zoned, r"(?<=:)[0-9.]+\z", pair)).otherwise(zoned)
    some = f"({_GROUP}(:{_GROUP})*)?"
    whole = plain.rlike(rf"\A({_GROUP}:){{7}}{_GROUP}\z")
    cut = plain.rlike(rf"\A{some}::{some}\z")

    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda g: g != "")

    head, last = groups(F.regexp_extract(plain, r"\A(.*)::", 1)), groups(F.regexp_extract(plain, r"::(.*)\z", 1))
    gap = 8 - F.size(head) - F.size(last)
    listed = F.when(whole, groups(plain)).when(cut & (gap >= 1), F.concat(head, F.array_repeat(F.lit("0"), gap), last))
    return F.lower(F.array_join(F.transform(listed, lambda g: F.lpad(g, 4, "0")), ""))


def _digits(address) -> str:
    return f"{int(address):032x}"


def _public_digits(digits: Column) -> Column:
    ends = lambda blocks: [
        (_digits(n.network_address), _digits(n.broadcast_address)) for n in map(ipaddress.ip_network, blocks)
    ]
    mapped = digits.startswith("0" * 20 + "ffff")
    number = F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")
    outside = ~_in_any(digits, ends(PRIVATE_BLOCKS_6)) | _in_any(digits, ends(PRIVATE_EXCEPTIONS_6))
    return F.when(mapped, F.exists(F.array(number), _public_number)).otherwise(outside)


def is_public_ipv6(ip: Column) -> Column:
    """Addresses that carry an IPv4 address are judged by that one."""
    return F.coalesce(F.exists(F.array(ipv6_digits(ip)), _public_digits), F.lit(False))
