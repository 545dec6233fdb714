"""Nested values. Columns of fixed depth use native functions; JSON of any depth goes through Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def flatten_deep(column: Column, depth: int) -> Column:
    """An array nested ``depth`` times as one array."""
    for _ in range(depth):
        column = F.flatten(column)
    return column


def map_leaves(column: Column, f: Callable[[Column], Column], depth: int = 1) -> Column:
    """``f`` on the leaves of an array nested ``depth`` times."""
    return F.transform(column, f if depth == 1 else lambda x: map_leaves(x, f, depth - 1))


def map_values(column: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` on the values of a map."""
    return F.transform_values(column, lambda _, v: f(v))


def _ordered(column: Column, kind: DataType) -> Column:
    if isinstance(kind, MapType):
        return F.array_sort(F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("k"), _ordered(e["value"], kind.valueType).alias("v"))))
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(column.isNotNull(), F.struct(*[_ordered(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return column


def structural_hash(df: DataFrame, name: str) -> Column:
    """A hash of a nested column by its structure: the order of maps' entries, at any depth, makes no difference, that of lists does."""
    return F.xxhash64(F.to_json(F.struct(_ordered(F.col(name), df.schema[name].dataType).alias("v"))))


def _leaves(value: object, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], object]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, (*path, str(k)))
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v, path)
    else:
        yield path, value


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def flatten_values(value: object) -> list:
    """All leaves of nested lists, in order."""
    return [x for v in value for x in flatten_values(v)] if isinstance(value, list) else [value]


def reversed_paths(value: object, end_key: str) -> list:
    """Of each value under ``end_key`` the way to it, turned round: a nest of one-key objects with the value outermost; list levels are left out."""
    found: list = []

    def walk(v: object, keys: tuple) -> None:
        for k, x in v.items() if isinstance(v, dict) else ((None, y) for y in v) if isinstance(v, list) else ():
            if k == end_key:
                nest: dict = {}
                for outer in keys:
                    nest = {outer: nest}
                found.append({x if isinstance(x, (str, int, float)) else json.dumps(x): nest})
            else:
                walk(x, keys if k is None else (*keys, k))

    walk(value, ())
    return found


def json_flat(text: Column) -> Column:
    """The leaves of a JSON object by their keys joined with ``_`` (the last of several wins); null for no JSON object."""

    def flat(t: str | None) -> dict | None:
        v = _parsed(t)
        return {"_".join(p): x if isinstance(x, str) else json.dumps(x) for p, x in _leaves(v, ())} if isinstance(v, dict) else None

    @F.pandas_udf("map<string,string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(flat)

    return run(text)


def json_values(text: Column) -> Column:
    """The leaves of nested JSON lists, in order; null for no JSON."""

    def values(t: str | None) -> list | None:
        return None if (v := _parsed(t)) is None else [x if isinstance(x, str) else json.dumps(x) for x in flatten_values(v)]

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(values)

    return run(text)


def json_reversed(text: Column, end_key: str) -> Column:
    """``reversed_paths`` of a JSON value, each as JSON."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [json.dumps(x, sort_keys=True) for x in reversed_paths(_parsed(t), end_key)])

    return run(text)
