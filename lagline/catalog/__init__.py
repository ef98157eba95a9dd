"""Every operator as a runnable query over the benchmark tables, with its SQL check."""

from __future__ import annotations


def _load():
    from lagline.catalog import registry
    from lagline.catalog import backtests, columns, contracts, models, profile, summaries  # noqa: F401
    from lagline.catalog import stored  # noqa: F401 - sends results of the others through sinks

    return registry


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLE)
