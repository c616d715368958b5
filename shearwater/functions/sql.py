"""The scalar rules as SQL functions whose bodies are SQL, so that user queries are planned as if written out."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dates, text, web

#: Rules of one projection: name -> (parameters with types, result type, rule over columns of the parameters' names).
RULES: dict[str, tuple[str, str, Callable[..., Column]]] = {
    "normalize_phone": ("number string", "string", web.phone),
    "public_phone": ("number string", "string", web.public_phone),
    "found_phone": ("said string", "string", web.found_phone),
    "normalize_species": ("said string", "string", text.species),
    "normalize_sex": ("said string", "string", text.sex),
    "normalize_size": ("said string", "string", text.size),
    "normalize_date": ("said string, today date", "date", dates.shelter_date),
    "redact": ("said string", "string", text.redact),
    "coarse_location": ("place string, category string", "string", text.coarse_location),
    "url_host": ("url string", "string", web.host),
    "url_species": ("url string", "string", web.url_species),
    "is_missing": ("said string", "boolean", text.missing),
}
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*$")


def _parameters(text: str) -> dict[str, str]:
    return dict(p.split(None, 1) for p in re.split(r",\s*", text))


def _steps(spark: SparkSession, parameters: str, rule: Callable[[DataFrame], DataFrame]) -> list[tuple[str, str, str, list[str]]]:
    """(column, type, SQL, columns it reads) of every column that a rule's projections make, the first ones first."""
    row = spark.sql("select " + ", ".join(f"cast(null as {t}) as {n}" for n, t in _parameters(parameters).items()))
    node, out = rule(row)._jdf.queryExecution().analyzed(), []
    while node.nodeName() == "Project" and node.children().apply(0).nodeName() == "Project":
        made = []
        for k in range(node.projectList().size()):
            e = node.projectList().apply(k)
            if e.nodeName() == "Alias":
                read, each = [], e.references().iterator()
                while each.hasNext():
                    read.append(each.next().name())
                made.append((e.name(), e.dataType().sql(), e.child().sql(), sorted(read)))
        out = made + out
        node = node.children().apply(0)
    return out


def _create(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    if not NAME.match(name):
        raise ValueError(f"{name!r} is no plain name")
    spark.sql(f"create or replace temporary function {name}({parameters}) returns {returns} return {body}")


def define(spark: SparkSession, name: str, parameters: str, returns: str, rule: Callable[..., Column]) -> None:
    """``name`` for this session's SQL: its body is the rule's own expression, which the optimizer inlines where it is called."""
    ((_, _, body, _),) = _steps(spark, parameters, lambda df: df.select(rule(*map(F.col, _parameters(parameters))).alias("made")))
    _create(spark, name, parameters, returns, body)


def define_staged(spark: SparkSession, name: str, parameters: str, returns: str, rule: Callable[[DataFrame], DataFrame]) -> None:
    """The same for a rule of several projections: each column is a function of its own, which ``name`` calls.

    ``rule`` takes a table of the parameters and appends the result as column ``made``.
    """
    types, calls = _parameters(parameters), {n: n for n in _parameters(parameters)}
    for column, kind, body, read in _steps(spark, parameters, rule):
        own = f"{name}_{column.strip('_')}"
        _create(spark, own, ", ".join(f"{c} {types[c]}" for c in read), kind, body)
        types[column], calls[column] = kind, f"{own}({', '.join(calls[c] for c in read)})"
    _create(spark, name, parameters, returns, calls["made"])


def register(spark: SparkSession, rules: Mapping[str, tuple[str, str, Callable[..., Column]]] = RULES) -> None:
    """All rules as temporary functions of the session, and ``normalize_age(said, today)`` in months."""
    for name, (parameters, returns, rule) in rules.items():
        define(spark, name, parameters, returns, rule)
    define_staged(spark, "normalize_age", "said string, today date", "int", lambda df: dates.with_age(df, "said", "made", F.col("today")))
