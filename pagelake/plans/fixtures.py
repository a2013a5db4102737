"""Small tables written once and used on both sides: a DataFrame here, VALUES in DuckDB."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def literal(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"'{k}': {literal(x)}" for k, x in v.items()) + "}"
    return repr(v)


class Fixture:
    """Named rows with a Spark schema."""

    def __init__(self, name: str, ddl: str, rows: list[tuple]) -> None:
        self.name, self.ddl, self.rows = name, ddl, rows
        self.cols = [c.strip().split()[0].split(":")[0] for c in self._split()]

    def _split(self) -> list[str]:
        out, depth, cur = [], 0, ""
        for ch in self.ddl:
            depth += ch == "<"
            depth -= ch == ">"
            if ch == "," and not depth:
                out.append(cur)
                cur = ""
            else:
                cur += ch
        return [*out, cur]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.ddl)

    def cte(self) -> str:
        kinds = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
        types = [kinds.get(c.strip().split()[1]) if len(c.strip().split()) > 1 else None for c in self._split()]
        cols = ", ".join(f"CAST({c} AS {t}) AS {c}" if t else c for c, t in zip(self.cols, types, strict=True))
        rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {cols} FROM (VALUES {rows}) AS t({', '.join(self.cols)}))"


def expected(ddl: str, rows: list[tuple]) -> str:
    """SQL that gives exactly these rows."""
    f = Fixture("expected", ddl, rows)
    return f"WITH {f.cte()} SELECT * FROM expected"
