"""Per-row normalisation as column expressions: blanks, strict numbers, times, ports, protocols, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean a missing value.
MISSING = ("", "-", "none", "nan")


def first_present(*aliases: Column) -> Column:
    """The first alias whose trimmed text is not a missing value."""
    return F.coalesce(*[F.when(~F.lower(F.trim(a)).isin(*MISSING), F.trim(a)) for a in aliases])


def first_filled(*aliases: Column, missing: Sequence[str] = ("", "-", "None", "nan")) -> Column:
    """The first alias whose trimmed text is none of `missing`, in their exact case."""
    return F.coalesce(*[F.when(~F.trim(a.cast("string")).isin(*missing), F.trim(a.cast("string"))) for a in aliases])


def iso_utc(t: Column) -> Column:
    """A time as ISO text with its offset, microseconds only where there are any (session zone UTC)."""
    whole = F.unix_micros(t) % 1_000_000 == 0
    return F.concat(F.when(whole, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.lit("+00:00"))


def strict_long(value: Column, low: int | None = None, high: int | None = None) -> Column:
    """A whole number, also written as "12.0"; null for fractions, infinities and values out of bounds."""
    number = F.trim(value.cast("string")).try_cast("double")
    fine = ~F.isnan(number) & (F.abs(number) < 9.2e18) & (number == F.floor(number))
    if low is not None:
        fine &= number >= low
    if high is not None:
        fine &= number <= high
    return F.when(fine, number.cast("long"))


def finite_double(value: Column, low: float | None = None) -> Column:
    """A finite number of at least `low`; null otherwise."""
    number = F.trim(value.cast("string")).try_cast("double")
    fine = ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(fine & (number >= low) if low is not None else fine, number)


def any_timestamp(value: Column) -> Column:
    """Epoch seconds, ISO text or day-first text, read as UTC (session zone UTC)."""
    text = F.trim(value)
    epoch = F.when(text.rlike(r"^\d+(\.\d+)?$"), F.timestamp_micros(F.round(text.try_cast("decimal(20,6)") * 1_000_000).cast("long")))
    patterns = [F.try_to_timestamp(text, F.lit(p)) for p in ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "d/M/yyyy H:mm")]
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
    return F.coalesce(epoch, iso, *patterns)


def local_timestamp(value: Column) -> Column:
    """Strict day-first local time, kept without a zone."""
    return F.try_to_timestamp(F.trim(value), F.lit("dd/MM/yyyy HH:mm:ss")).cast("timestamp_ntz")


def protocol_name(value: Column) -> Column:
    """Protocol name or number as tcp, udp, icmp or other."""
    p = F.lower(F.trim(value.cast("string")))
    return F.when(p.isin("tcp", "6"), "tcp").when(p.isin("udp", "17"), "udp").when(p.isin("icmp", "1", "ipv6-icmp", "icmpv6", "58"), "icmp").otherwise("other")


def rate_per_second(amount: Column, duration_ms: Column) -> Column:
    return F.when(duration_ms > 0, amount / (duration_ms / 1000.0)).otherwise(0.0)


def mean_size(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / count).otherwise(0.0)


def end_time(start: Column, duration_ms: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + F.round(duration_ms * 1000).cast("long"))


def port_number(value: Column) -> Column:
    """Decimal or 0x-hexadecimal port in 0 .. 65535."""
    text = F.trim(value)
    number = F.when(text.rlike("^0[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substring(text, 3, 8), 16, 10)).when(text.rlike(r"^\d{1,9}$"), text).cast("long")
    return F.when(number.between(0, 65535), number)


def first_failure(checks: Sequence[tuple[str, str, Column]]) -> Column:
    """The first failing (field, reason) of (field, reason, holds) checks; null if all hold. A null check fails."""
    failed = F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"))) for field, reason, holds in checks])
    return F.try_element_at(F.array_compact(failed), F.lit(1))


# ---- addresses

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4_long(address: Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else (hex, octal, short or bracketed forms)."""
    parts = F.split(address, r"\.")
    total = sum((F.element_at(parts, i + 1).try_cast("long") * (1 << (8 * (3 - i))) for i in range(4)), F.lit(0).cast("long"))
    return F.when(address.rlike(IPV4), total)


def _in(number: Column, *nets: str) -> Column:
    found = F.lit(False)
    for net in nets:
        base, bits = net.split("/")
        low = sum(int(x) << (8 * (3 - i)) for i, x in enumerate(base.split(".")))
        found |= number.between(low, low + (1 << (32 - int(bits))) - 1)
    return found


def _plain_v6(address: Column) -> Column:
    """Lower case, without a zone, and with a dotted tail written as two groups of zeros (the digits do not matter here)."""
    bare = F.regexp_replace(F.lower(F.trim(address)), r"%[^%]+$", "")
    return F.regexp_replace(bare, rf":{IPV4[1:-1]}$", ":0:0")


def is_ipv6(address: Column) -> Column:
    """Whether a text is an IPv6 address: eight groups of up to four hex digits, the last two also as a dotted IPv4 address,
    one run of zeros as `::`, and optionally a zone behind `%`."""
    text = _plain_v6(address)
    sides = F.split(text, "::")
    group, groups = "[0-9a-f]{1,4}", lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, ":")))
    side = lambda c: (c == "") | c.rlike(rf"^{group}(:{group})*$")
    left, right = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    short = (F.size(sides) == 2) & side(left) & side(right) & (groups(left) + groups(right) <= 7)
    return F.coalesce(F.contains(text, F.lit(":")) & (text.rlike(rf"^({group}:){{7}}{group}$") | short), F.lit(False))


def is_valid_ip(address: Column) -> Column:
    return is_valid_ipv4(F.trim(address)) | is_ipv6(address)


def is_valid_ipv4(address: Column) -> Column:
    return F.coalesce(address.rlike(IPV4), F.lit(False))


def is_private_v4(address: Column) -> Column:
    """RFC 1918, loopback, link-local or unspecified; documentation ranges are not private."""
    return F.coalesce(_in(ipv4_long(address), "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/32"), F.lit(False))


def is_local(address: Column) -> Column:
    """RFC 1918, unique local (fc00::/7), loopback or link-local, of either version; an IPv4 address inside an IPv6 one
    (::ffff:a.b.c.d) counts as itself. Documentation ranges are not local; anything unreadable is not."""
    text = F.regexp_replace(F.lower(F.trim(address)), r"%[^%]+$", "")
    nets = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")
    dotted = F.regexp_extract(text, rf"^[0:]*:ffff:({IPV4[1:-1]})$", 1)
    hexed = [F.conv(F.regexp_extract(text, r"^[0:]*:ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", i), 16, 10).cast("long") for i in (1, 2)]
    inner = F.coalesce(ipv4_long(F.when(dotted != "", dotted)), F.when(text.rlike(r"^[0:]*:ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), hexed[0] * 65536 + hexed[1]))
    own = text.rlike(r"^f[cd][0-9a-f]{2}:") | text.rlike(r"^fe[89ab][0-9a-f]:") | text.rlike(r"^[0:]*:0{0,3}1$")
    v6 = is_ipv6(address) & F.when(inner.isNotNull(), _in(inner, *nets)).otherwise(own)
    return F.coalesce(F.when(is_valid_ipv4(text), _in(ipv4_long(text), *nets)).otherwise(v6), F.lit(False))


def is_public_v4(address: Column) -> Column:
    """A plainly written, globally routable unicast address: fit for a lookup outside."""
    # A one-element transform binds the number, so that it is read once an address.
    special = F.transform(F.array(ipv4_long(address)), lambda number: _in(
        number, "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
        "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    ))[0]
    return F.coalesce(~special, F.lit(False))  # null for what is no address


def is_noise_v4(src: Column, dst: Column, port: Column, infrastructure: Sequence[str] = ()) -> Column:
    """Multicast, link-local, broadcast, port 5353, infrastructure addresses, or unreadable end points."""
    noise = F.coalesce(port == 5353, F.lit(False))
    for address in (src, dst):
        number = ipv4_long(address)
        noise |= number.isNull() | _in(number, "224.0.0.0/4", "169.254.0.0/16", "255.255.255.255/32", "0.0.0.0/32")
        if infrastructure:
            noise |= address.isin(*infrastructure)
    return noise
