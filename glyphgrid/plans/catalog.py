"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bindings import relation, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The relations of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return relation(self.spark, self.sf_dir, name)


def query(sql: str | None = None, *, uses: str = "", recursive: bool = False):
    """Registers a function of `Tables` under its name; `sql` goes behind the definitions of the relations in `uses`."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql is not None:
            head = with_clause(*uses.split(), recursive=recursive) if uses else ""
            ORACLE_SQL[f.__name__] = f"{head}\n{sql}" if head and not sql.lstrip().startswith(",") else f"{head}{sql}"
        return f

    return register
