"""Column helpers for identifiers, labels, paths, URLs and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHA256_HEX = "^[0-9a-f]{64}$"


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end (``trim`` takes off spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_empty(c: Column | str) -> Column:
    """Stripped text; null becomes ''."""
    return strip(F.coalesce(c, F.lit("")))


def is_blank(c: Column | str) -> Column:
    return blank_to_empty(c) == ""


def normalized_label(c: Column | str) -> Column:
    """Stripped lower-case text."""
    return F.lower(blank_to_empty(c))


def default_if_blank(c: Column | str, default: Column) -> Column:
    return F.when(is_blank(c), default).otherwise(strip(c))


def without_suffix(c: Column | str, suffix: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.endswith(suffix), F.left(c, F.length(c) - len(suffix))).otherwise(c)


def is_sha256(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(SHA256_HEX)


def is_lower_hex(c: Column | str, digits: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit("")).rlike(f"^[0-9a-f]{{{digits}}}$")


def file_stem(c: Column | str) -> Column:
    """The last part of a path less its last extension."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def file_suffix(c: Column | str) -> Column:
    """The last extension with its dot, in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(c, r"[^/.](\.[^./]*)$", 1))


def is_safe_relative_path(c: Column | str) -> Column:
    """Not blank, not absolute (POSIX, Windows or drive), and no part that goes up."""
    text = F.replace(blank_to_empty(c), F.lit("\\"), F.lit("/"))
    return (text != "") & ~text.rlike("^(/|[A-Za-z]:)") & ~F.array_contains(F.split(text, "/"), "..")


def prefixed_path(prefix: str, c: Column | str) -> Column:
    """``prefix/path`` of safe relative paths, null for others."""
    return F.when(is_safe_relative_path(c), F.concat(F.lit(prefix.rstrip("/") + "/"), strip(c)))


def url_allowed(c: Column | str, *, scheme: str = "https", hosts: tuple[str, ...] = (), path_prefix: str = "/", path_suffixes: tuple[str, ...] = ("",)) -> Column:
    part = lambda name: F.coalesce(F.try_parse_url(c, F.lit(name)), F.lit(""))
    host = part("HOST")
    path = part("PATH")
    tail = F.lit(False)
    for suffix in path_suffixes:
        tail = tail | path.endswith(suffix)
    known = F.lower(host).isin(*hosts) if hosts else host != ""
    return (part("PROTOCOL") == scheme) & known & path.startswith(path_prefix) & tail


def namespaced(namespace: str, c: Column | str, mark: str = ":") -> Column:
    return F.concat(F.lit(namespace + mark), F.col(c) if isinstance(c, str) else c)


def namespace_of(c: Column | str, mark: str = ":") -> Column:
    return F.split_part(F.col(c) if isinstance(c, str) else c, F.lit(mark), F.lit(1))


# ---- digests and hash-derived numbers


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def order_key(c: Column | str, seed: int, domain: str) -> Column:
    """SHA-256 of domain, seed and value with NUL between: an order that only these decide."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return sha256(F.lit(domain), nul, F.lit(str(seed)), nul, F.col(c) if isinstance(c, str) else c)


def _leading_bits(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def unit_interval(c: Column | str, seed: int) -> Column:
    """First 64 bits of SHA-256 of 'seed:value' as a double in [0, 1]."""
    return _leading_bits(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string") if isinstance(c, str) else c)).cast("double") / F.lit(float(2**64))


def hash_fold(c: Column | str, seed: int, folds: int) -> Column:
    """First 64 bits of SHA-256 of 'seed:cv:value' modulo the number of folds."""
    bits = _leading_bits(F.concat(F.lit(f"{seed}:cv:"), F.col(c).cast("string") if isinstance(c, str) else c))
    return (bits % F.lit(folds).cast("decimal(20,0)")).cast("int")


def id_set_digest(c: Column | str) -> Column:
    """Aggregate: SHA-256 over 'length:value' lines of the sorted distinct stripped values."""
    values = F.array_sort(F.collect_set(strip(c)))
    lines = F.transform(values, lambda v: F.concat(F.length(v).cast("string"), F.lit(":"), v, F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)


def row_checksum(*columns: str) -> Column:
    """Aggregate: an order-independent checksum of the rows, computed in parallel."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


# ---- hex fingerprints as 64-bit lanes


def hex_lane(c: Column | str, lane: int = 0) -> Column:
    """16 hex digits as a signed long."""
    return F.conv(F.substring(c, 1 + 16 * lane, 16), 16, -10).cast("long")


def hamming(left: Column, right: Column, digits: int) -> Column:
    """Differing bits of two hex strings of ``digits`` digits (at most 256 bits need four lanes)."""
    total = F.lit(0)
    for lane in range(-(-digits // 16)):
        total = total + F.bit_count(hex_lane(left, lane).bitwiseXOR(hex_lane(right, lane)))
    return total
