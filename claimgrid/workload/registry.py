"""Registry of queries and their SQL oracles."""

from __future__ import annotations

from claimgrid.workload.world import World, ctes

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register fn(world) -> DataFrame under name, with the equivalent SQL where one exists."""
    def deco(fn):
        def run(spark, sf_dir):
            return fn(World(spark, sf_dir))
        run.__name__, run.__doc__ = name.replace("-", "_"), fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = ctes(sql, "duckdb")
        return fn
    return deco
