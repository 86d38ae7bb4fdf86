"""Queries of the plan operators, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelore.functions.dialect import DUCK, SPARK, Dialect
from pagelore.operators import alignment, audits, evidence, fields, layout, records, structure, text_rules
from pagelore.plans import report
from pagelore.plans.oracles import ORACLES
from pagelore.sources.tables import duck_tables, table
from pagelore.streaming import resume

RULES: dict[str, tuple[tuple[str, ...], Callable[[Dialect], str]]] = {}
for _module in (text_rules, layout, audits, records, evidence, structure, report):
    RULES |= _module.QUERIES

#: Rules that run by levels of jobs; their SQL is the oracle's, and gives the same.
BY_LEVELS: dict[str, Callable[..., DataFrame]] = {"field_count": fields.field_count}


def apply(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """One rule query over the given DataFrames (named as the query's tables)."""
    needs, sql = RULES[name]
    if name in BY_LEVELS:
        return BY_LEVELS[name](**{t: tables[t] for t in needs})
    return spark.sql(sql(SPARK), **{t: tables[t] for t in needs}) if needs else spark.sql(sql(SPARK).replace("{{", "{").replace("}}", "}"))


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: apply(spark, name, **{t: table(spark, sf_dir, t) for t in RULES[name][0]})


def _oracle(name: str) -> str:
    needs, sql = RULES[name]
    text = ORACLES[name].strip() if name in ORACLES else sql(DUCK)
    tables = duck_tables(needs)
    if not tables:
        return text
    ctes = ", ".join(f"{k} AS ({v})" for k, v in tables.items())
    recursive = text.startswith("WITH RECURSIVE ")
    if text.startswith("WITH "):
        return ("WITH RECURSIVE " if recursive else "WITH ") + ctes + ", " + text.removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
    return f"WITH {ctes} {text}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in RULES} | alignment.QUERIES | resume.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: _oracle(name) for name in RULES} | resume.ORACLES
