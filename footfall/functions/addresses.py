"""IP addresses: masks, ranges, flags."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.text import as_column

_IPV4 = r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"

# Private and reserved ranges.
RESERVED_RANGES = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "240.0.0.0/4",
    "::/127",
    "fc00::/7",
    "fe80::/10",
    "2001:db8::/32",
    "2001:10::/28",
    "5f00::/8",
]
_IPV4_IN_IPV6 = "00000000000000000000ffff"


def is_ipv4(address) -> Column:
    return as_column(address).rlike(_IPV4)


def ipv4_number(address) -> Column:
    """IPv4 text as a number, NULL for anything else."""
    parts = F.split(as_column(address), r"\.")
    number = sum(
        (F.get(parts, F.lit(i)).try_cast("bigint") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("bigint")
    )
    return F.when(is_ipv4(address), number)


def ipv6_groups(address) -> Column:
    """IPv6 text as 32 hex digits, NULL for anything else."""
    text = F.lower(as_column(address))
    halves = F.split(text, "::")
    head = F.filter(F.split(F.get(halves, F.lit(0)), ":"), lambda g: g != "")
    tail = F.filter(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":"), lambda g: g != "")
    gap = F.greatest(F.lit(8) - F.size(head) - F.size(tail), F.lit(0))
    groups = F.concat(head, F.array_repeat(F.lit("0"), gap), tail)
    packed = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(text.rlike("^[0-9a-f:]+$") & text.contains(":"), packed)


def is_ipv6(address) -> Column:
    text = F.lower(as_column(address))
    whole = F.length(ipv6_groups(address)) == 32
    short = (F.size(F.split(text, "::")) == 2) | (F.size(F.split(text, ":")) == 8)
    return F.coalesce(text.rlike("^[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,7}$") & ~text.contains(":::") & short & whole, F.lit(False))


def number_key(number) -> Column:
    """An IPv4 number in the order of `address_key`."""
    return F.concat(F.lit(_IPV4_IN_IPV6), F.lower(F.lpad(F.hex(as_column(number)), 8, "0")))


def address_key(address) -> Column:
    """Any address as 32 hex digits that sort as addresses do; NULL for other text."""
    return F.coalesce(number_key(ipv4_number(address)), F.when(is_ipv6(address), ipv6_groups(address)))


def address_bits(key) -> Column:
    """An `address_key` as 128 characters 0 and 1."""
    halves = [F.lpad(F.conv(F.substring(as_column(key), at, 16), 16, 2), 64, "0") for at in (1, 17)]
    return F.concat(*halves)


def range_prefixes(low, high) -> Column:
    """The fewest binary prefixes that cover exactly the addresses from `low` to `high` (as `address_bits`), at most two per bit.

    Behind the bits that both ends share, the lower end's side is the end's own block (without the zeros it ends in) and, for each
    earlier 0 of the end, everything above it; the upper side is its mirror image.
    """
    low, high = as_column(low), as_column(high)
    same = F.zip_with(F.split(low, ""), F.split(high, ""), lambda a, b: a == b)
    fork = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)).cast("int") - 1, F.lit(128))  # bits in common

    def side(end: Column, fill: str, other: str) -> Column:
        last = F.greatest(F.length(F.rtrim(end, F.lit(fill))), fork + 1)  # bits of the end's own block
        between = F.when(last - 1 > fork, F.sequence(fork + 1, last - 1)).otherwise(F.array().cast("array<int>"))
        steps = F.transform(F.filter(between, lambda i: F.substring(end, i + 1, F.lit(1)) == fill), lambda i: F.concat(F.substring(end, F.lit(1), i), F.lit(other)))
        return F.concat(steps, F.array(F.substring(end, F.lit(1), last)))

    whole = (F.length(F.rtrim(low, F.lit("0"))) <= fork) & (F.length(F.rtrim(high, F.lit("1"))) <= fork)
    split = F.concat(side(low, "0", "1"), side(high, "1", "0"))
    return F.when(low > high, F.array().cast("array<string>")).when(whole | (fork == 128), F.array(F.substring(low, F.lit(1), fork))).otherwise(split)


def cidr_prefix(text) -> Column:
    """A range in CIDR form, or a single address, as its binary prefix; NULL for other text."""
    text = F.trim(as_column(text))
    size = F.get(F.split(text, "/"), F.lit(1)).try_cast("int")
    base = F.substring_index(text, "/", 1)
    key = address_key(base)
    bits = F.when(text.contains("/"), F.when(is_ipv4(base), size + 96).otherwise(size)).otherwise(F.lit(128))
    fits = bits.between(F.when(is_ipv4(base), 96).otherwise(0), 128)
    return F.when(fits, F.substring(address_bits(key), F.lit(1), bits))


def mask_address(address) -> Column:
    """IPv4 with the last part 0; IPv6 cut to three groups; other text as it is."""
    text = as_column(address)
    v6 = F.concat(F.array_join(F.slice(F.split(text, ":"), 1, 3), ":"), F.lit("::"))
    return (
        F.when(text.contains(":"), v6)
        .when(F.size(F.split(text, r"\.")) == 4, F.regexp_replace(text, r"\.[^.]*$", ".0"))
        .otherwise(text)
    )


def in_ranges(address, ranges: list[str]) -> Column:
    """True when the address lies in one of the given ranges (CIDR or single)."""
    hit = F.lit(False)
    number, digits = ipv4_number(address), ipv6_groups(address)
    for text in ranges:
        net = ipaddress.ip_network(text.strip(), strict=False)
        if net.version == 4:
            inside = number.between(int(net.network_address), int(net.broadcast_address))
        else:
            low, high = f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"
            inside = digits.between(low, high)
        hit = hit | F.coalesce(inside, F.lit(False))
    return hit


def is_private(address) -> Column:
    """True for private and reserved addresses, and for text that is no address at all."""
    known = is_ipv4(address) | is_ipv6(address)
    return ~F.coalesce(known, F.lit(False)) | in_ranges(address, RESERVED_RANGES)
