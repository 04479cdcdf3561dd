"""Column expressions used across the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tastemark.lookups import PRICE_WORDS

EARTH_KM = 6371.0088
# WGS-84 ellipsoid
EQUATOR_KM = 6378.137
FLATTENING = 1 / 298.257223563


def liked(stars: Column, threshold: float = 3) -> Column:
    """1 when the rating is above the threshold."""
    return (stars > threshold).cast("int")


def epoch_seconds(date: Column) -> Column:
    """Midnight UTC of a date in epoch seconds, whatever the session time zone."""
    return F.unix_date(F.to_date(date)).cast("long") * F.lit(86400)


def date_from_swapped(year: Column, month: Column, day: Column) -> Column:
    """Date from three columns of which month and day arrive swapped; impossible dates become null."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), day.cast("int"), month.cast("int")), "yyyy-MM-dd")


def python_literal_json(text: Column) -> Column:
    """Text of a printed Python dict or list as JSON that ``from_json`` can read."""
    return F.regexp_replace(F.regexp_replace(text, r"\bNone\b", "null"), r"\b(True|False)\b", r'"$1"')


def category_titles(text: Column) -> Column:
    """Titles of a printed list of ``{alias, title}`` dicts as an array."""
    parsed = F.from_json(python_literal_json(text), "array<struct<alias:string,title:string>>", {"allowSingleQuotes": "true"})
    return F.transform(parsed, lambda c: c["title"])


def category_text(text: Column) -> Column:
    """Titles of a printed list of category dicts, joined with a comma and a blank."""
    return F.array_join(category_titles(text), ", ")


def coordinates(text: Column) -> Column:
    """``struct(latitude, longitude)`` of a printed coordinate dict; missing numbers stay null."""
    return F.from_json(python_literal_json(text), "latitude double, longitude double", {"allowSingleQuotes": "true"})


def display_address(text: Column) -> Column:
    """Address lines of a printed location dict, joined with a comma and a blank."""
    parsed = F.from_json(python_literal_json(text), "display_address array<string>", {"allowSingleQuotes": "true"})
    return F.array_join(parsed["display_address"], ", ")


def price_label(price: Column) -> Column:
    """Number of ``$`` signs, 1 to 4; null stays null."""
    return F.length(price)


def price_words(label: Column) -> Column:
    """Price label in words."""
    words = F.create_map(*[x for k, v in PRICE_WORDS.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(words, label.cast("int"))


def split_categories(text: Column) -> Column:
    """Category text at commas, trimmed."""
    return F.transform(F.split(text, ","), lambda c: F.trim(c))


def deviation(stars: Column, average: Column) -> Column:
    """Stars minus an average; an exact 0 becomes 0.01 so that the cell stays stored."""
    diff = stars - average
    return F.when(diff == 0, F.lit(0.01)).otherwise(diff)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def ellipsoid_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the WGS-84 ellipsoid by Lambert's formula (metres of error over city distances)."""
    b1 = F.atan(F.lit(1 - FLATTENING) * F.tan(F.radians(lat1)))
    b2 = F.atan(F.lit(1 - FLATTENING) * F.tan(F.radians(lat2)))
    dlon = F.radians(lon2 - lon1)
    a = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(dlon / 2), 2)
    sigma = F.lit(2.0) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(p) * F.cos(q), 2) / F.pow(F.cos(sigma / 2), 2)
    y = (sigma + F.sin(sigma)) * F.pow(F.cos(p) * F.sin(q), 2) / F.pow(F.sin(sigma / 2), 2)
    exact = F.lit(EQUATOR_KM) * (sigma - F.lit(FLATTENING / 2) * (x + y))
    return F.when(sigma == 0, F.lit(0.0)).otherwise(exact)


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, ellipsoid: bool = True) -> Column:
    """Distance in km, one decimal."""
    fn = ellipsoid_km if ellipsoid else haversine_km
    return F.round(fn(lat1, lon1, lat2, lon2), 1)


def replace_all(text: Column, pairs: Mapping[str, str]) -> Column:
    """Substring replacements applied one after the other."""
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def literal_map(values: Mapping) -> Column:
    """A short fixed lookup table as a map literal; large tables are joined with ``operators.lookup``."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
