"""Dimension lookups: product enrichment and category names.

No join carries a hint: Spark broadcasts a dimension whose size in bytes is below its
threshold, and AQE decides again from the sizes at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def product_dimension(products: DataFrame) -> DataFrame:
    """(product_id text, product_category, product_price) - the enrichment columns."""
    return products.select(F.col("id").cast("string").alias("product_id"),
                           F.col("category").alias("product_category"),
                           F.col("price").cast("double").alias("product_price"))


def enrich_with_products(events: DataFrame, products: DataFrame) -> DataFrame:
    """Left join: every event kept, category/price attached when the product is known.
    Works for a streaming ``events`` frame too (stream-static join)."""
    return events.join(product_dimension(products), on="product_id", how="left")


def product_with_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Products with their category id and name (left lookup; unknown category -> NULL)."""
    cats = categories.select(F.col("id").alias("category_id"), "category_name")
    return products.join(cats, products.category == cats.category_name, "left").drop("category")
