"""One relational plan, spelled for Spark SQL and for the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .registry import query

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    @staticmethod
    def each(x: str) -> str:
        return f"explode({x})"

    @staticmethod
    def joined(x: str, order: str, separator: str = ",") -> str:
        return f"listagg({x}, '{separator}') WITHIN GROUP (ORDER BY {order})"

    @staticmethod
    def words(x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, r'{pattern}', 0)"

    @staticmethod
    def get(x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    @staticmethod
    def days(a: str, b: str) -> str:
        return f"datediff({a}, {b})"

    @staticmethod
    def plus(day: str, n: str) -> str:
        return f"date_add({day}, CAST({n} AS INT))"

    @staticmethod
    def seq(a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    @staticmethod
    def replaced(x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{by}')"

    @staticmethod
    def like(x: str, pattern: str) -> str:
        return f"({x} RLIKE r'{pattern}')"

    @staticmethod
    def weekday(x: str) -> str:
        return f"(weekday({x}) + 1)"

    @staticmethod
    def mapped(x: str, var: str, body: str) -> str:
        return f"transform({x}, {var} -> {body})"

    @staticmethod
    def kept(x: str, var: str, body: str) -> str:
        return f"filter({x}, {var} -> {body})"

    size, slice, distinct, join, ordered, text, set_and, levenshtein, position = "size", "slice", "array_distinct", "array_join", "sort_array", "STRING", "array_intersect", "levenshtein", "locate"


class Check:
    @staticmethod
    def each(x: str) -> str:
        return f"unnest({x})"

    @staticmethod
    def joined(x: str, order: str, separator: str = ",") -> str:
        return f"string_agg({x}, '{separator}' ORDER BY {order})"

    @staticmethod
    def words(x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, '{pattern}')"

    @staticmethod
    def get(x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    @staticmethod
    def days(a: str, b: str) -> str:
        return f"CAST({a} - {b} AS INT)"

    @staticmethod
    def plus(day: str, n: str) -> str:
        return f"CAST({day} + CAST({n} AS INT) AS DATE)"

    @staticmethod
    def seq(a: str, b: str) -> str:
        return f"generate_series({a}, {b})"

    @staticmethod
    def replaced(x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    @staticmethod
    def like(x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    @staticmethod
    def weekday(x: str) -> str:
        return f"isodow({x})"

    @staticmethod
    def mapped(x: str, var: str, body: str) -> str:
        return f"list_transform({x}, lambda {var}: {body})"

    @staticmethod
    def kept(x: str, var: str, body: str) -> str:
        return f"list_filter({x}, lambda {var}: {body})"

    size, slice, distinct, join, ordered, text, set_and, levenshtein, position = "len", "list_slice", "list_distinct", "array_to_string", "list_sort", "VARCHAR", "list_intersect", "levenshtein", "strpos"


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the tables that it names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def plan(spell: Callable[[type], str]) -> Callable[[type], str]:
    """Register a relational plan under its function's name."""
    ours = spell(Spark)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sf_dir, ours)

    run.__name__ = spell.__name__
    run.__doc__ = spell.__doc__
    query(spell(Check))(run)
    return spell
