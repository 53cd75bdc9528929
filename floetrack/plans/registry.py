"""Registry of runnable queries and the SQL that checks them."""
import importlib

from floetrack.plans.fixtures import Views, oracle

MODULES = ["tracks", "functions", "quality", "grids", "joins", "routes", "forecast", "status", "sources", "streams"]
CASES = {}
CTES = {}


def shared_cte(name, sql):
    """Register an SQL block oracles may name like a view."""
    CTES[name] = sql


def case(name, sql=None):
    """Register ``fn(v)`` under ``name``; ``sql`` is the oracle text (omit for rows-only checks)."""
    def wrap(fn):
        if name in CASES:
            raise KeyError(f"duplicate query {name}")
        CASES[name] = (fn, sql)
        return fn
    return wrap


def load():
    for m in MODULES:
        importlib.import_module(f"floetrack.plans.cases_{m}")
    return CASES


def queries():
    def make(fn):
        return lambda spark, sf_dir: fn(Views(spark, sf_dir))
    return {n: make(fn) for n, (fn, _) in load().items()}


def oracle_sql():
    return {n: oracle(sql, CTES) for n, (_, sql) in load().items() if sql}
