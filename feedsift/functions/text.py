"""Expressions on text that is stored or shown: cuts by bytes, ids that a document store takes, keys, road labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in this order: signs that an id may not hold and what stands for them; ids that are taken.
ESCAPES = (("%", "%25"), ("/", "%2F"), ("~", "%7E"))
RESERVED = (".", "..")
#: Bytes of an id, bytes that stay readable before the digest of one that is too long, bytes of a stored text.
ID_BYTES, READABLE_BYTES, TEXT_BYTES = 1500, 200, 64 * 1024


def cut_utf8(text: Column, size: int) -> Column:
    """The longest start of the text of at most size bytes that ends with a whole character."""
    raw = F.encode(text, "UTF-8")

    def inside(at: int) -> Column:
        """Whether the byte behind the first `at` continues a character."""
        return F.hex(F.substring(raw, at + 1, 1)).between("80", "BF")

    cuts = [F.when(~inside(at), F.decode(F.substring(raw, 1, at), "UTF-8")) for at in range(size, max(size - 4, 0), -1)]
    return F.when(F.octet_length(text) <= size, text).when(text.isNotNull(), F.coalesce(*cuts, F.lit("")))


def safe_id(value: Column) -> Column:
    """One id for each value that a document store takes: signs are escaped; what is empty, reserved or too long becomes a
    readable start, a ~ and 32 digits of the value's SHA-256."""
    escaped = reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, value)
    legal = (escaped != "") & ~escaped.isin(*RESERVED) & ~(escaped.startswith("__") & escaped.endswith("__")) & (F.octet_length(escaped) <= ID_BYTES)
    return F.when(legal, escaped).otherwise(F.concat(cut_utf8(escaped, READABLE_BYTES), F.lit("~"), F.substring(F.sha2(value, 256), 1, 32)))


def pair_key(left: Column, right: Column, *more: str) -> Column:
    """The key of an unordered pair of texts under a model and a prompt version."""
    a, b = F.sha2(left, 256), F.sha2(right, 256)
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b), *(F.lit(x) for x in more))


def cache_key(text: Column, *more: str) -> Column:
    """The key of a text under a policy and a model."""
    return F.concat_ws("|", F.sha2(text, 256), *(F.lit(x) for x in more))


def road_label(names: Column, direction: Column, redacted: str) -> Column:
    """struct(label, redacted, alternatives) of a zone's road names: each name once (case and outer blanks do not count, the
    first spelling stays); without any, the direction or `unnamed`; empty where screening withheld every name."""
    names = F.coalesce(names, F.array().cast("array<string>"))
    plain = F.transform(F.filter(names, lambda x: (x != redacted) & (F.trim(x) != "")), lambda x: F.trim(x))
    first = F.filter(plain, lambda x, i: F.array_position(F.transform(plain, lambda x: F.lower(x)), F.lower(x)) == i + 1)
    held = F.size(F.filter(names, lambda x: x == redacted))
    other = F.when((held == 0) & F.coalesce(~direction.isin("unknown", ""), F.lit(False)), direction).when(held == 0, "unnamed").otherwise("")
    return F.struct(F.when(F.size(first) > 0, F.array_join(first, " / ")).otherwise(other).alias("label"), held.cast("long").alias("redacted"), F.greatest(F.size(first) - 1, F.lit(0)).cast("long").alias("alternatives"))
