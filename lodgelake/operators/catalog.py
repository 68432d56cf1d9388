"""Hotel catalog search, paging, detail and display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelake.functions import rules
from lodgelake.functions.columns import store_text

SEARCH_COLUMNS = ["hotel_id", "city", "title", "price", "image", "description"]


def _city_filter(hotels: DataFrame, city: str | None) -> DataFrame:
    # the store compared whatever the case and accents; an empty string and the page's choice "all" mean all cities
    if city and city.lower() != "all":
        return hotels.filter(store_text("city") == F.lit(city))
    return hotels


def page_size(offset: int) -> int:
    return rules.PAGE_FIRST if offset == 0 else rules.PAGE_NEXT


def sort_keys(sort: str | None) -> list:
    keys = {
        "price-low": [F.col("price").asc()],
        "price-high": [F.col("price").desc()],
        "name": [F.lower(F.col("title")).asc()],
    }.get(sort or "", [])
    return keys + [F.col("hotel_id").asc()]  # key last: ties never reorder pages


def hotel_search(hotels: DataFrame, city: str | None = None, sort: str | None = "recommended",
                 offset: int = 0, limit: int | None = None) -> DataFrame:
    """One page of hotels; plans as a single top-k (TakeOrderedAndProject with offset)."""
    df = _city_filter(hotels.select(*SEARCH_COLUMNS), city)
    return df.orderBy(*sort_keys(sort)).offset(offset).limit(limit or page_size(offset))


def hotel_search_meta(hotels: DataFrame, city: str | None = None, offset: int = 0) -> DataFrame:
    n = page_size(offset)
    return _city_filter(hotels.select("city"), city).agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        (F.col("total") > offset + n).alias("more"),
        F.lit(offset + n).alias("next_offset"),
    )


def distinct_cities(hotels: DataFrame) -> DataFrame:
    """One entry per city, compared as the store did, whatever the case and accents (the smallest spelling shown)."""
    return (hotels.groupBy(store_text("city").alias("_k")).agg(F.min("city").alias("city"))
            .orderBy("_k").select("city"))


def hotel_detail(hotels: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Hotel rows (all, or those whose hotel_id is in ``ids``) with their hero image path."""
    df = hotels if ids is None else hotels.join(ids.select("hotel_id").distinct(), "hotel_id", "left_semi")
    hero = F.concat(F.lit(rules.HOTEL_IMAGE_PREFIX), F.coalesce(F.col("image"), F.lit(rules.HOTEL_DEFAULT_IMAGE)))
    return df.withColumn("hero_image", hero)


def hotel_text_search(hotels: DataFrame, term: str = "", city: str = "") -> DataFrame:
    """Case-insensitive substring match on title, and on city when a city text is given."""
    cond = F.lower(F.col("title")).contains(term.lower())
    if city:
        cond = cond & F.lower(F.col("city")).contains(city.lower())
    return hotels.filter(cond)


GRAM = 3


def _grams(text: F.Column, longest: int = GRAM) -> F.Column:
    """Distinct substrings of up to ``longest`` letters, the empty one included."""
    n = F.char_length(text)
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
    return F.array_distinct(F.concat(F.array(F.lit("")), *[
        F.when(n >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in range(1, longest + 1)]))


def text_index(hotels: DataFrame, column: str = "title") -> DataFrame:
    """Postings (gram, hotel_id) of the lower-cased text: every substring of up to three letters, the empty one too."""
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    return hotels.where(F.col(column).isNotNull()).select("hotel_id", F.explode(_grams(text)).alias("gram"))


def hotel_text_search_many(hotels: DataFrame, terms: DataFrame, index: DataFrame | None = None,
                           column: str = "title") -> DataFrame:
    """(term, hotel) for each of many terms that a hotel's text holds, whatever the case: as hotel_text_search, by an index.

    A term meets the hotels that hold its rarest gram, and these are verified: so a term costs its shortest list, not
    a scan.  A term of one or two letters is a gram of its own, and the empty term is in every text.  Null terms
    find nothing.
    """
    index = text_index(hotels, column) if index is None else index
    held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    asked = terms.select("term").where("term IS NOT NULL").distinct().withColumn("_t", F.lower("term"))
    n = F.least(F.char_length("_t"), F.lit(GRAM))
    grams = asked.select("term", "_t", F.explode(F.filter(_grams(F.col("_t")), lambda g: F.char_length(g) == n)).alias("gram"))
    # a gram that no text holds settles its term: it counts as the rarest, with an empty list
    rarest = grams.join(held, "gram", "left").groupBy("term", "_t").agg(
        F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"))
    found = rarest.join(index, "gram").select("term", "_t", "hotel_id")
    return found.join(hotels, "hotel_id").where(F.lower(F.col(column)).contains(F.col("_t"))) \
        .select("term", *hotels.columns)


def hotel_options(hotels: DataFrame) -> DataFrame:
    return hotels.select("hotel_id", "title", "city").orderBy(F.lower("title"), "hotel_id")


def hotel_teasers(hotels: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("description"), F.lit(""))
    return hotels.select(
        "hotel_id", "title",
        F.concat(F.substring(text, 1, rules.TEASER_CHARS), F.lit("...")).alias("teaser"),
    )
