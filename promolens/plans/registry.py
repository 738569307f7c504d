"""How queries are registered: a name, a function of the retail views, and SQL or nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import offers as op
from ..sources.views import AS_OF, Retail, duck


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, run: Callable[[Retail], DataFrame], sql: str | None = None, *views: str) -> None:
        self.queries[name] = lambda spark, sf_dir: run(Retail(spark, sf_dir))
        if sql:
            self.sql[name] = duck(sql, *views) if views else sql.strip()


def live(r: Retail, keep_unmatched: bool = True) -> DataFrame:
    """The star join of the offers that are active on the as-of date."""
    return op.active_offers(r.offers, r.skus, r.products, r.chains, AS_OF, keep_unmatched)


#: Words of the generated names that stand for tags.
TAG_WORDS = {w: [w] for w in ("cold", "small", "large", "widget", "red", "hot")}


def tagged(r: Retail, skus: DataFrame | None = None) -> DataFrame:
    """All SKUs, or these (id, raw_name), with the tags of their names."""
    from ..functions.scalars import dietary_tags
    from pyspark.sql import functions as F

    return (r.skus if skus is None else skus).withColumn("tags", dietary_tags(F.col("raw_name"), TAG_WORDS))
