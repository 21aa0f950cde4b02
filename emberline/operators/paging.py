"""Paging and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_DEFAULT, PAGE_MOST, LIST_DEFAULT, LIST_MOST = 100, 500, 200, 2000
_LIMIT_NAMES, _OFFSET_NAMES = ("limit", "per_page", "count"), ("offset", "cursor", "start")


def _first_int(params: dict, names: tuple[str, ...], default: int) -> int:
    for n in names:
        value = params.get(n)
        value = value[0] if isinstance(value, list) and value else value
        try:
            return int(str(value).strip())
        except (TypeError, ValueError):
            continue
    return default


def page_params(params: dict) -> tuple[int, int]:
    """(limit, offset) from query parameters: aliases, clamps, defaults for what is no number."""
    return max(1, min(PAGE_MOST, _first_int(params, _LIMIT_NAMES, PAGE_DEFAULT))), max(0, _first_int(params, _OFFSET_NAMES, 0))


def list_limit(value: object) -> int:
    return max(1, min(LIST_MOST, _first_int({"limit": value}, ("limit",), LIST_DEFAULT)))


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """Rows of a page with total and next_offset, which is NULL on the last page."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    following = F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit).cast("long"))
    return rows.crossJoin(total).withColumn("next_offset", following)  # total is one row
