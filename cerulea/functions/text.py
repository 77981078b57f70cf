"""Links, lines and labels as Column expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats
GOOGLE = "https://www.google.com/maps/search/?api=1&query="
BING, BING_VIEW = "https://www.bing.com/maps?cp=", "&lvl=19&style=a"
OSM = "https://www.openstreetmap.org/?mlat="
#: Digits enough for any double with its decimals.
_WIDE = Context(prec=400)
CSV_HEADER = "rank,id,kind,lat,lon,area_m2,confidence,truncated,google_maps"


def written(v: float, digits: int) -> str | None:
    """As ``fixed``, for one number. Python's own format is exact but for ties, and a tie has a 5 after the last digit; only those go over decimals."""
    if v is None or v != v:
        return None
    if f"{v:.{digits + 1}f}"[-1] != "5":
        return f"{v:.{digits}f}"
    return f"{Decimal(v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, _WIDE):f}"


def fixed(x, digits: int) -> Column:
    """A number with so many decimals: its exact binary value, halves away from zero; null for null and NaN. The JVM's formats round the shortest decimal or to even, hence
    Arrow. Spark hands all numbers of a projection to Python in one batch."""

    @F.pandas_udf("string")
    def column(values: pd.Series) -> pd.Series:
        return pd.Series([written(v, digits) for v in values.tolist()], dtype=object)

    return column(x.cast("double"))


def google_link(lat, lon) -> Column:
    return F.concat(F.lit(GOOGLE), fixed(lat, 6), F.lit("%2C"), fixed(lon, 6))


def bing_link(lat, lon) -> Column:
    return F.concat(F.lit(BING), fixed(lat, 6), F.lit("~"), fixed(lon, 6), F.lit(BING_VIEW))


def osm_link(lat, lon) -> Column:
    return F.concat(F.lit(OSM), fixed(lat, 6), F.lit("&mlon="), fixed(lon, 6), F.lit("#map=19/"), fixed(lat, 6), F.lit("/"), fixed(lon, 6))


def area_label(area) -> Column:
    """Square metres up to a hectare, hectares up to a square kilometre, square kilometres beyond."""
    return (
        F.when(area >= 1e6, F.concat(fixed(area / 1e6, 2), F.lit(" km²")))
        .when(area >= 1e4, F.concat(fixed(area / 1e4, 2), F.lit(" ha")))
        .when(area >= 100, F.concat(fixed(area, 0), F.lit(" m²")))
        .otherwise(F.concat(fixed(area, 1), F.lit(" m²")))
    )


def duration_label(seconds) -> Column:
    s = F.round(seconds, 0).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(s / 60) % 60), two(s % 60))
    return F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), clock)).otherwise(clock)


def tile_url(template: str, z, x, y) -> Column:
    out = F.lit(template)
    for name, value in (("{z}", z), ("{x}", x), ("{y}", y)):
        out = F.replace(out, F.lit(name), value.cast("string"))
    return out


def csv_line(rank, name, kind, lat, lon, area, sure, cut) -> Column:
    """Only the link is quoted."""
    return F.concat_ws(",", rank.cast("string"), name, kind, fixed(lat, 6), fixed(lon, 6), fixed(area, 1), fixed(sure, 3), cut.cast("string"), F.concat(F.lit('"'), google_link(lat, lon), F.lit('"')))


def place_label(lat, lon, digits: int = 5) -> Column:
    return F.concat(fixed(lat, digits), F.lit(", "), fixed(lon, digits))


def count_label(n) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n.cast("long"), 0)


def dims_label(area) -> Column:
    """The sides of a rectangle of that area, twice as long as wide."""
    short = F.sqrt(area / 2)
    return F.concat(F.lit("≈ "), fixed(2 * short, 1), F.lit(" × "), fixed(short, 1), F.lit(" m"))


def progress(done, total, elapsed) -> dict[str, Column]:
    """Share done, and the time left at the pace so far, which counts from the fourth tile on."""
    return {"share": done / total, "left": F.when(done > 3, elapsed / done * (total - done))}


def cache_key(z, x, y, url) -> Column:
    """The file name under which a tile's bytes are kept: its place and 24 digits of its address's SHA-256."""
    return F.concat_ws("-", *[c.cast("string") for c in (z, x, y)], F.concat(F.substring(F.sha2(url.cast("binary"), 256), 1, 24), F.lit(".bin")))
