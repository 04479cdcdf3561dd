"""Cleaning of review, business and user tables into one joined review table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemark.functions import scalars
from tastemark.lookups import ALIAS_ADD_BACK, ALIAS_DENY, CATEGORY_DENY, CATEGORY_KEYWORDS


def open_only(business: DataFrame) -> DataFrame:
    return business.where(F.col("is_open") == 1)


def after(df: DataFrame, date: str, start: str) -> DataFrame:
    """Rows strictly after ``start``."""
    return df.where(F.col(date) > F.lit(start).cast("date"))


def between(df: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """Rows strictly inside ``(start, end)``."""
    return df.where((F.col(date) > F.lit(start).cast("date")) & (F.col(date) < F.lit(end).cast("date")))


def located(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of one city or state."""
    return df.where(F.col(column) == value)


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without nulls in ``columns``."""
    return df.na.drop(subset=list(columns))


def matches(column: str | Column, keywords: str) -> Column:
    """Case-insensitive match of any keyword of an alternation."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.rlike(f"(?i){keywords}"), F.lit(False))


def has_attribute(business: DataFrame, key: str = "GoodForMeal") -> DataFrame:
    """Rows whose attribute map holds ``key``."""
    return business.where(F.try_element_at(F.col("attributes"), F.lit(key)).isNotNull())


def select_restaurants(
    business: DataFrame,
    include: str = CATEGORY_KEYWORDS,
    exclude: str = CATEGORY_DENY,
    alias_deny: str = ALIAS_DENY,
    alias_add_back: str = ALIAS_ADD_BACK,
) -> DataFrame:
    """Restaurants of a city catalogue: keyword match, keyword and conditional exclusions, alias deny list, then the
    allow-listed aliases among the keyword matches are added back (as a bag: a row may come twice)."""
    matched = business.where(matches("categories", include))
    kept = (
        matched.where(~matches("categories", exclude))
        .where(~(F.col("price").isNull() & matches("categories", "cater")))
        .where(~(F.coalesce(F.col("review_count") <= 6, F.lit(False)) & matches("categories", "fooddeliveryservices")))
        .where(~matches("alias", alias_deny))
    )
    return kept.unionByName(matched.where(matches("alias", alias_add_back)))


def missed_rows(df: DataFrame, column: str, include: str, exclude: str) -> DataFrame:
    """Audit: rows that neither list matches."""
    return df.where(~matches(column, include) & ~matches(column, exclude))


def distinct_tokens(df: DataFrame, column: str, leave_out: Sequence[str] = ("alias", "title")) -> DataFrame:
    """Distinct words of a text column, without the field names of printed dicts."""
    words = df.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"\w+"), F.lit(0))).alias("token"))
    return words.where(~F.col("token").isin(*leave_out)).distinct()


def parse_business(raw: DataFrame) -> DataFrame:
    """City catalogue rows with printed dicts as typed columns; rows without usable coordinates drop out."""
    point = scalars.coordinates(F.col("coordinates"))
    out = raw.withColumn("category_list", scalars.category_titles(F.col("categories")))
    out = out.withColumn("category_text", F.array_join("category_list", ", "))
    out = out.withColumn("latitude", point["latitude"]).withColumn("longitude", point["longitude"])
    if "location" in raw.columns:
        out = out.withColumn("address", scalars.display_address(F.col("location")))
    if "price" in raw.columns:
        out = out.withColumn("price_label", scalars.price_label(F.col("price")))
    return out.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def join_reviews(reviews: DataFrame, business: DataFrame, on: str = "business_id") -> DataFrame:
    """Reviews with their business; clashing names of the business side get the prefix ``business_``."""
    clash = [c for c in business.columns if c in reviews.columns and c != on]
    return reviews.join(business.withColumnsRenamed({c: f"business_{c}" for c in clash}), on)


def join_user_average(reviews: DataFrame, users: DataFrame, on: str = "user_id") -> DataFrame:
    """Reviews with the average stars of their user."""
    return reviews.join(users.select(on, F.col("average_stars").alias("user_avg_stars")), on)


def with_deviations(reviews: DataFrame, stars: str = "review_stars") -> DataFrame:
    """Stars minus the user's and the business's average."""
    return reviews.withColumn("dev_user", scalars.deviation(F.col(stars), F.col("user_avg_stars"))).withColumn(
        "dev_business", scalars.deviation(F.col(stars), F.col("business_stars"))
    )


def named(df: DataFrame, names: Sequence[str], columns: Sequence[str], name: str = "name") -> DataFrame:
    """Some columns of the rows with one of the given names."""
    return df.where(F.col(name).isin(*names)).select(*columns)


def item_ids_of_names(df: DataFrame, names: DataFrame, name: str = "name", item: str = "item_id") -> DataFrame:
    """Item ids of selected names."""
    return df.join(names.select(name), name, "left_semi").select(item).distinct()


def active_users(reviews: DataFrame, more_than: int = 5) -> DataFrame:
    """Reviews of users with more than ``more_than`` reviews."""
    counts = reviews.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > more_than)
    return reviews.join(counts, "user_id", "left_semi")
