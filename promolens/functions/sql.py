"""The SQL surface: scalar functions and a table function for sessions that speak SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from .scalars import TAGS


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, registry_view: str | None = None, tags: dict[str, Sequence[str]] | None = None) -> None:
    """Make ``norm_text(s)`` and ``dietary_tags(s)`` known to the session, and with a view of images ``lookup_product_image(brand, name, quantity, ean)``.

    The view has ean, brand, name, quantity, image_url and times_seen.  The table function
    gives at most one row (image_url, step) by the steps that need no similarity: EAN,
    brand, name and quantity, name.
    """
    define = lambda head, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    define("norm_text(s STRING) RETURNS STRING", r"nullif(lower(regexp_replace(trim(s), '[\\s\\u00A0]+', ' ')), '')")
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {_text(p)})' for p in parts)} THEN {_text(tag)} END" for tag, parts in (tags or TAGS).items())
    define("dietary_tags(s STRING) RETURNS ARRAY<STRING>", f"(SELECT array_compact(array({cases})) FROM (SELECT concat(lower(s), ' ') AS t))")
    if registry_view:
        one = lambda step, where: f"SELECT image_url, {step} AS step, times_seen FROM {registry_view} r WHERE {where}"
        name = "norm_text(r.name) = norm_text(p_name)"
        union = " UNION ALL ".join([
            one(1, "r.ean = p_ean"), one(2, f"{name} AND norm_text(r.brand) <=> norm_text(p_brand) AND norm_text(r.quantity) <=> norm_text(p_quantity)"), one(3, name)])
        define(
            "lookup_product_image(p_brand STRING, p_name STRING, p_quantity STRING, p_ean STRING) RETURNS TABLE(image_url STRING, step INT)",
            f"SELECT image_url, step FROM ({union}) ORDER BY step, times_seen DESC, image_url LIMIT 1")
