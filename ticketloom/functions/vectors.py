"""Vector and identifier column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS name space of RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

UUID_FORM = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    # The one-element outer array binds the norm once instead of once per component.
    scaled = F.transform(
        F.array(l2_norm(a)),
        lambda norm: F.transform(a, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x.cast("double") / norm)),
    )
    return F.element_at(scaled, 1)


def cosine(a: Column, b: Column) -> Column:
    scale = l2_norm(a) * l2_norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def point_id(key: Column) -> Column:
    """The key itself when it is a UUID, else the name-based (version 5) UUID of it in the DNS name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), key.cast("binary")))
    variant = F.lit("89ab")
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    uuid = F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.substring(variant, nibble % 4 + 1, F.lit(1)), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
    return F.when(key.rlike(UUID_FORM), F.lower(key)).otherwise(uuid)
