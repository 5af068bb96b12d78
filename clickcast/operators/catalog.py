"""Catalogue lookups: title search and category listing with paging, sorted categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGE_SIZE = 100


def _page(df: DataFrame, page: int, limit: int) -> DataFrame:
    limit = max(1, min(int(limit), MAX_PAGE_SIZE))
    page = max(1, int(page))
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy("id").offset((page - 1) * limit).limit(limit)
    return rows.select("*", total.alias("total"), F.ceil(total / F.lit(limit)).cast("bigint").alias("pages"))


def product_search(products: DataFrame, term: str, page: int = 1, limit: int = 20) -> DataFrame:
    """Case-insensitive substring match on the title, by id, one page, with the total
    number of matches and of pages."""
    hits = products.filter(F.col("title").ilike(f"%{term}%"))
    return _page(hits, page, limit)


def products_in_category(products: DataFrame, category, page: int = 1, limit: int = 20) -> DataFrame:
    """Products of one category, by id, one page (category may be a value or a Column)."""
    c = category if isinstance(category, F.Column) else F.lit(category)
    return _page(products.filter(F.col("category") == c), page, limit)


def categories_sorted(categories: DataFrame) -> DataFrame:
    return categories.orderBy("category_name")
