"""Operators as named SQL plans over DataFrames.

``@operator`` registers a function that builds an operator's SQL for a dialect.
Tables are written ``{tx}``; :meth:`Operator.apply` binds them to DataFrames, so
operators compose like any DataFrame function and Catalyst sees one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.workspace import small_partitions
from .dialect import DUCK, SPARK, Spark
from .fixtures import FIXTURES, fixture_sql, fixture_tables


@dataclass(frozen=True)
class Operator:
    name: str
    covers: str
    build: Callable[..., str]
    fixture: Mapping[str, object] = field(default_factory=dict)
    doc: str = ""
    #: Views of the test tables that stand for tables of the plan, where not of the same name.
    stand_in: Mapping[str, str] = field(default_factory=dict)

    def _fixture_text(self, d: Spark) -> str:
        text = self.build(d, **self.fixture)
        for name, view in self.stand_in.items():
            text = text.replace("{" + name + "}", "{" + view + "}")
        return text

    def apply(self, spark: SparkSession, tables: Mapping[str, DataFrame], **params: object) -> DataFrame:
        """The operator over ``tables``; ``params`` override its defaults."""
        small_partitions(spark)
        text = self.build(SPARK, **params)
        return spark.sql(text, **{t: tables[t] for t in tables if "{" + t + "}" in text})

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The operator over the tables of a fixture directory."""
        found = fixture_tables(spark, sf_dir, self._fixture_text(SPARK))
        found |= {name: found[view] for name, view in self.stand_in.items()}
        return self.apply(spark, found, **self.fixture)

    def oracle(self) -> str:
        text = self._fixture_text(DUCK)
        ctes = fixture_sql(text)
        for name in FIXTURES:
            text = text.replace("{" + name + "}", name)
        body = text.strip()
        if not ctes:
            return body
        if body[:5].lower() == "with ":
            return f"WITH {ctes}, {body[5:]}"
        if body[:15].lower() == "with recursive ":
            return f"WITH RECURSIVE {ctes}, {body[15:]}"
        return f"WITH {ctes} {body}"


OPERATORS: dict[str, Operator] = {}


def operator(covers: str, stand_in: Mapping[str, str] | None = None, **fixture: object) -> Callable[[Callable[..., str]], Operator]:
    """Register a plan that covers the given inventory ids; ``fixture`` holds the
    parameters that suit the small test tables, ``stand_in`` the views to use there."""

    def add(build: Callable[..., str]) -> Operator:
        found = Operator(build.__name__, covers, build, fixture, build.__doc__ or "", stand_in or {})
        if found.name in OPERATORS:
            raise ValueError(f"{found.name} is registered twice")
        OPERATORS[found.name] = found
        return found

    return add
