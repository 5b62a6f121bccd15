"""Column functions: text normalisers, parsers, bands, distances. All stay within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.0


def positive_number(text: Column) -> Column:
    """The first number in a text like "60 km/h" if it is positive, else null."""
    plain = F.regexp_replace(F.lower(text), "km/h|kmh|kph", " ")
    number = F.regexp_extract(plain, r"([-+]?\d*\.?\d+)", 1).try_cast("double")
    return F.when(number > 0, number)


def link_code(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(text)), "[^A-Z0-9]+", "")


def place_key(text: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "")


def route_codes(text: Column) -> Column:
    """"NH 7, nh-12" -> [NH07, NH12]: sorted, distinct, two digits at least."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"NH[ -]*0*(\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda d: F.concat(F.lit("NH"), F.when(F.length(d) < 2, F.lpad(d, 2, "0")).otherwise(d)))))


def sexagesimal(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value)


def terrain(lat: Column) -> Column:
    return F.when(lat < 27.5, "plain").when(lat >= 29.0, "mountain").otherwise("hill")


def macro_region(lon: Column) -> Column:
    return F.when(lon < 82.5, "west").when(lon < 85.7, "middle").otherwise("east")


def distance_km(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Equirectangular: degrees of longitude shrink with the cosine of the mean latitude."""
    x = (lon_a - lon_b) * F.cos(F.radians((lat_a + lat_b) / 2))
    return KM_PER_DEGREE * F.sqrt(x * x + (lat_a - lat_b) * (lat_a - lat_b))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment in the plane."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))


def geh(model: Column, count: Column) -> Column:
    return F.when(model + count > 0, F.sqrt(2 * (model - count) * (model - count) / (model + count))).otherwise(F.lit(0.0))


def min_max(value: Column, least: Column, most: Column) -> Column:
    """Scaled to 0..1 and clipped; 0 without a range."""
    return F.when(most - least > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - least) / (most - least)))).otherwise(F.lit(0.0))


def coordinate_pair(text: Column) -> Column:
    """lon and lat of a text like "27° 41' 30\" N, 85.3 E", or null unless it has both; of several the last counts.

    Fixed value: the pattern of a coordinate, degrees with optional minutes and seconds before a hemisphere."""
    pattern = r"(?i)(\d{1,3})(?:[^0-9NSEW]+(\d+(?:\.\d+)?))?(?:[^0-9NSEW]+(\d+(?:\.\d+)?))?[^0-9NSEW]*([NSEW])"
    number = lambda m, k: F.coalesce(F.regexp_extract(m, pattern, k).try_cast("double"), F.lit(0.0))
    side = lambda m: F.upper(F.right(m, F.lit(1)))
    found = F.regexp_extract_all(F.translate(text, "\u00a0", " "), F.lit(pattern), F.lit(0))
    last = lambda a, b: F.try_element_at(F.filter(found, lambda m: side(m).isin(a, b)), F.lit(-1))
    value = lambda m: sexagesimal(number(m, 1), number(m, 2), number(m, 3), side(m))
    lon, lat = last("E", "W"), last("N", "S")
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(value(lon).alias("lon"), value(lat).alias("lat")))
