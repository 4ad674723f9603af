"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
EARTH_METRES = 6_371_008.8

#: Fixed values, in this order: how road names are made alike.
ROAD_WORDS = [
    (r"\binterstate\b", "i"), (r"\bi[- ]?(?=\d)", "i "), (r"\bu s\b|\bus route\b|\bus highway\b|\bus hwy\b", "us"),
    (r"\bstate route\b|\bstate rte\b|\bstate highway\b|\bsr\b|\bsh\b", "sr"), (r"\bcounty road\b|\bcounty rd\b|\bcr\b", "cr"),
    (r"\bstreet\b", "st"), (r"\bavenue\b", "ave"), (r"\broad\b", "rd"), (r"\bdrive\b", "dr"), (r"\bhighway\b", "hwy"), (r"\bboulevard\b", "blvd"),
    (r"\bparkway\b", "pkwy"), (r"\bnorth\b", "n"), (r"\bsouth\b", "s"), (r"\beast\b", "e"), (r"\bwest\b", "w"),
]


def poll_failed() -> Column:
    """An error, a not-modified that isn't 304, or a status outside 2xx that isn't a proper not-modified."""
    status = F.col("http_status")
    return F.col("error").isNotNull() | F.when(F.col("not_modified"), status != 304).otherwise((status < 200) | (status >= 300))


def poll_unreached() -> Column:
    """The poll never left this side: it says nothing of the publisher."""
    return F.col("error").isNotNull() & F.coalesce(F.col("error_origin") == "OWN_SIDE", F.lit(False))


def has_body() -> Column:
    return ~poll_failed() & ~F.col("not_modified")


def day_of(micros: str) -> Column:
    """Whole days since 1970 in UTC."""
    return F.floor(F.col(micros) / F.lit(DAY_US)).cast("long")


def cadence_seconds(text: str) -> Column:
    """Digits with s, m or h as seconds; 3600 where null or unreadable."""
    unit = F.regexp_extract(text, r"^(\d+)([smh])$", 2)
    n = F.regexp_extract(text, r"^(\d+)([smh])$", 1).cast("long")
    return F.coalesce(n * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600), F.lit(3600)).cast("long")


def clamp(seconds: Column) -> Column:
    return F.least(F.greatest(seconds, F.lit(300)), F.lit(3600))


def normal_road(name: Column) -> Column:
    out = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9 ]+", " ")
    for pattern, word in ROAD_WORDS:
        out = F.regexp_replace(out, pattern, word)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def unwrapped(lon: Column, ref: Column) -> Column:
    """The longitude in the branch nearest to ref; halves go to the even turn."""
    return lon - 360 * F.bround((lon - ref) / 360)


def to_metres(lon: Column, lat: Column, lat0: Column) -> tuple[Column, Column]:
    """East and north in metres on the plane about latitude lat0."""
    return EARTH_METRES * F.radians(lon) * F.cos(F.radians(lat0)), EARTH_METRES * F.radians(lat)


def iso_utc(micros: Column) -> Column:
    """ISO text of a time in UTC; a fraction only where there is one."""
    at = F.timestamp_micros(micros)
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros % 1_000_000 != 0, F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def utc_moment(stamp: Column) -> Column:
    """A stamp for a reader: to the second in UTC; one without a zone, or that cannot be read, is named as such."""
    at = rfc3339_micros(stamp)
    local = F.try_to_timestamp(F.replace(F.substring(stamp, 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return (
        F.when(F.coalesce(stamp, F.lit("")) == "", "not recorded").when(at.isNotNull(), F.concat(F.date_format(F.timestamp_micros(at), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))
        .when(local.isNotNull(), F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" (no time zone given)"))).otherwise(F.concat(stamp, F.lit(" (unreadable as a timestamp)")))
    )


def classified(allowed: Column) -> tuple[Column, Column]:
    """(error, origin) of a raw response (transport_error, not_modified, http_status, body), in this order: a refused scheme is
    our own side's; then a transport error, a not-modified without its status, a status outside 2xx, no body, a body that is no
    JSON object."""
    status, body = F.col("http_status"), F.col("body")
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))
    error = (
        F.when(~allowed, "SchemeRefused").when(F.col("transport_error").isNotNull(), F.col("transport_error")).when(F.col("not_modified") & (status != 304), "HTTPStatus").when(F.col("not_modified"), None)
        .when((status < 200) | (status >= 300), "HTTPStatus").when(body.isNull(), "EmptyResponse").when(~readable, "Unreadable")
    )
    return error, F.when(error.isNotNull(), F.when(~allowed, "OWN_SIDE").otherwise("PUBLISHER"))


def point_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on the plane about their mean latitude; longitudes in one branch."""
    turned = lon2 - 360 * F.bround((lon2 - lon1) / 360)
    x = EARTH_METRES * F.radians(turned - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = EARTH_METRES * F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y)


def coordinates(vertices: str, axis: int) -> Column:
    """The longitudes (axis 0) or latitudes (1) of vertices."""
    return F.transform(vertices, lambda p: F.get(p, F.lit(axis)))


def line_length(vertices: str) -> Column:
    """Metres along a line on the plane about its mean latitude; 0 for a point, null without vertices."""
    v = F.col(vertices)
    lat = F.aggregate(v, F.lit(0.0), lambda s, p: s + F.get(p, F.lit(1))) / F.size(v)
    steps = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: point_distance(F.get(a, F.lit(0)), lat, F.get(b, F.lit(0)), lat) ** 2 + (EARTH_METRES * F.radians(F.get(b, F.lit(1)) - F.get(a, F.lit(1)))) ** 2)
    return F.when(F.size(v) > 1, F.aggregate(F.transform(steps, F.sqrt), F.lit(0.0), lambda s, x: s + x)).when(F.size(v) == 1, 0.0)


def rfc3339_micros(text: Column) -> Column:
    """Microseconds since 1970 of a date, time and offset; null for a bare date, a missing offset or anything else. A fraction of
    any length is cut to six digits."""
    pattern = r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}:\d{2})(?:\.(\d+))?(?:[Zz]|([+-])(\d{2}):?(\d{2}))$"
    date, time, fraction, sign, hours, minutes = (F.regexp_extract(text, pattern, k) for k in range(1, 7))
    whole = F.unix_micros(F.try_to_timestamp(F.concat(date, F.lit(" "), time, F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX")))
    part = F.rpad(F.substring(fraction, 1, 6), 6, "0").cast("long")
    offset = F.coalesce((F.when(hours != "", hours).cast("long") * 60 + F.when(minutes != "", minutes).cast("long")) * 60_000_000, F.lit(0))
    return F.when(date != "", whole + part - F.when(sign == "-", -offset).otherwise(offset))
