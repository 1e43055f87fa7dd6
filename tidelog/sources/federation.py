"""Many stores read and maintained as one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.merge import merge
from tidelog.plans.query import LogQuery
from tidelog.sources.store import LogStore


class Federation:
    """Stores by address.  Entries cannot be written to a federation, only to its stores."""

    def __init__(self, stores: dict[str, LogStore]):
        self.stores = dict(stores)

    def read(self, *queries: LogQuery, dedup: str | bool = "set", sort: bool = False, with_addr: bool = False) -> DataFrame:
        """Every query on every store, merged once over all of them."""
        if not self.stores:
            raise ValueError("no stores")
        parts = [s.read(*queries, dedup=False) for s in self.stores.values()]
        if with_addr:
            parts = [p.withColumn("addr", F.lit(a)) for a, p in zip(self.stores, parts, strict=True)]
        return merge(parts, dedup, sort)

    def stats(self, limits: dict[str, int]) -> DataFrame:
        """addr, size, limit of every store."""
        parts = [
            s.size().agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("size")).select(F.lit(a).alias("addr"), "size", F.lit(limits.get(a, 0)).cast("long").alias("limit"))
            for a, s in self.stores.items()
        ]
        return merge_all(parts)

    def truncate(self, limit: int, source: str = "") -> None:
        self.for_each(lambda s: s.truncate(limit, source))

    def for_each(self, action: Callable[[LogStore], object]) -> None:
        for store in self.stores.values():
            action(store)

    def rebalance(self, plan: DataFrame, now: int | None = None) -> dict[int, list[tuple[str, int, int]]]:
        """Carry out transfers (id, from_addr, to_addr, amount): what each moved."""
        rows = plan.orderBy("id").collect()  # half as many rows as hosts at most
        return {r["id"]: self.stores[r["from_addr"]].transfer(self.stores[r["to_addr"]], r["amount"], now) for r in rows}


def merge_all(parts: list[DataFrame]) -> DataFrame:
    return merge(parts, dedup=False)
