"""Scalar functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(s: Column) -> Column:
    """Shannon entropy in bits a character; null and empty give 0."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars)
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.when(F.length(s) > 0, F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(F.lit(0.0))


def share_of(s: Column, kind: str) -> Column:
    """Share of characters in the class ``kind``; null and empty give 0."""
    return F.when(F.length(s) > 0, F.regexp_count(s, F.lit(kind)) / F.length(s)).otherwise(F.lit(0.0))


def base_domain(host: Column) -> Column:
    """Last two labels; an address has none. Without a public-suffix list this is the documented fallback."""
    return F.when(host.rlike(r"^\d+(\.\d+){3}$"), "").otherwise(F.substring_index(host, ".", -2))


def freshness(age: Column, ttl: float) -> Column:
    """1 at once, falling to 0 at ``ttl``; equal to the ttl counts as gone."""
    return F.greatest(F.lit(0.0), 1 - age / ttl)


def staleness(days: Column) -> Column:
    """1 up to 14 days, then straight to 0 at 60; an unknown age counts as fresh."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (60 - days) / 46.0)), F.lit(1.0))


def risk_scale(confidence: Column) -> Column:
    return F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), confidence * 10)), 6)


def shape_key(host: Column) -> Column:
    """Length, last label and character set of a name's first label."""
    label = F.substring_index(host, ".", 1)
    kind = F.when(label.rlike(r"^[a-z]+$"), "alpha").when(label.rlike(r"^[0-9]+$"), "digit").when(label.rlike(r"^[a-z0-9]+$"), "alnum").otherwise("mixed")
    return F.concat_ws(":", F.length(label).cast("string"), F.substring_index(host, ".", -1), kind)


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the score interval; 0 without trials."""
    p = hits / n
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(n > 0, low).otherwise(F.lit(0.0))


def ipv4(s: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    parts = F.split(s, r"\.")
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long"))
    return F.when(s.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), value)


def ip_class(n: Column) -> Column:
    """Loopback, private, link-local, multicast, broadcast or public."""
    def within(base: int, bits: int) -> Column:
        return F.shiftright(n, 32 - bits) == base >> (32 - bits)

    out = F.when(n.isNull(), "none").when(n == 0xFFFFFFFF, "broadcast").when(within(0x7F000000, 8), "loopback")
    out = out.when(within(0x0A000000, 8) | within(0xAC100000, 12) | within(0xC0A80000, 16), "private")
    return out.when(within(0xA9FE0000, 16), "link-local").when(within(0xE0000000, 4), "multicast").otherwise("public")


def locally_administered(mac: Column) -> Column:
    """Whether the second bit of the first byte is set in a hardware address written in hexadecimal."""
    return F.conv(F.substring(mac, 1, 2), 16, 10).cast("int").bitwiseAND(2) != 0


def parents(host: Column) -> Column:
    """The name and its parents down to two labels, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
