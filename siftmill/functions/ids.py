"""Identifiers that follow from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill.functions.text import strip

#: Namespace of URL names in RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def normalize_dn(value: Column) -> Column:
    return F.upper(strip(F.coalesce(value, F.lit(""))))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID (version 5): SHA-1 with the version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)
    )


def content_hash(*columns: str) -> Column:
    """SHA-256 over the named columns in order of name; NULLs are left out of the text that is hashed."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def url_quote(value: Column) -> Column:
    """Percent encoding of all but ASCII letters, digits and ``_.-~``; a blank is %20."""
    form = F.url_encode(value)
    for made, meant in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(made), F.lit(meant))
    return form
