"""Rules over data: as columns for whole tables, and in Python for one object."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import kind_of
from ..plans.rules import BLOCKING, And, Not, Or, PathDisjoint, PathEquals, PropCount, PropEquals, PropIn, Shape, UniqueByMember, crosses_reference, local_name, path_name

VIOLATION = "array<struct<shape:string,fields:array<string>,message:string,enforcement_level:string,is_blocking:boolean,suggested_fix:string>>"


# One object
def text_of(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def values_equal(a, b) -> bool:
    """Equal as JSON, or a string equal to a boolean's or number's text; 1 and 1.0 differ."""
    if isinstance(a, str) != isinstance(b, str):
        s, other = (a, b) if isinstance(a, str) else (b, a)
        return not isinstance(other, list | dict) and other is not None and s == text_of(other)
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


_ABSENT = object()


def resolve(path: tuple, data):
    """The value at a path; absent for an inverse, a missing key, or a step into anything but an object."""
    match path:
        case ("iri", name):
            return data.get(local_name(name), _ABSENT) if isinstance(data, dict) else _ABSENT
        case ("seq", parts):
            for p in parts:
                data = resolve(p, data)
                if data is _ABSENT:
                    return _ABSENT
            return data
    return _ABSENT


def count_at(path: tuple, data) -> int:
    v = resolve(path, data)
    return 0 if v is _ABSENT or v is None else len(v) if isinstance(v, list) else 1


def holds(ast, data: dict) -> bool:
    match ast:
        case And(children):
            return all(holds(c, data) for c in children)
        case Or(children):
            return any(holds(c, data) for c in children)
        case Not(child):
            return not holds(child, data)
        case PropEquals(path, value):
            v = resolve(path, data)
            return v is not _ABSENT and values_equal(v, value)
        case PropIn(path, values):
            v = resolve(path, data)
            return v is not _ABSENT and any(values_equal(v, x) for x in values)
        case PropCount(path, least, most):
            n = count_at(path, data)
            return (least is None or n >= least) and (most is None or n <= most)
        case PathEquals(a, b) | PathDisjoint(a, b):
            if crosses_reference(a) or crosses_reference(b):
                return True
            x, y = resolve(a, data), resolve(b, data)
            if isinstance(ast, PathDisjoint):
                return x is _ABSENT or y is _ABSENT or not values_equal(x, y)
            return x is y is _ABSENT or x is not _ABSENT and y is not _ABSENT and values_equal(x, y)
        case UniqueByMember(path, member, allowed, most):
            v = resolve(path, data)
            if not isinstance(v, list):
                return True
            keys = [text_of(m[member]) for m in v if isinstance(m, dict) and member in m]
            return all(k in {text_of(x) for x in allowed} and keys.count(k) <= most for k in keys)
    raise TypeError(ast)


def violations_of(shapes: list[Shape], data: dict) -> list[dict]:
    return [{"shape": s.uri, "fields": s.fields, "message": s.message, "enforcement_level": s.level, "is_blocking": s.level in BLOCKING, "suggested_fix": None} for s in shapes if s.introspectable and s.ast is not None and not holds(s.ast, data)]


# Whole tables
class Columns:
    """Compiles rules to two-valued boolean columns over a table whose columns are the fields; NULL is absent."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def at(self, path: tuple) -> tuple[Column, T.DataType] | None:
        steps = [path] if path[0] == "iri" else path[1] if path[0] == "seq" else None
        if steps is None or any(s[0] != "iri" for s in steps):
            return None
        column, kind = None, self.schema
        for s in steps:
            name = local_name(s[1])
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return None
            column = F.col(f"`{name}`") if column is None else column.getField(name)
            kind = kind[name].dataType
        return column, kind

    def equal(self, column: Column, kind: T.DataType, value) -> Column:
        group = kind_of(kind)[0]
        if isinstance(value, bool):
            same = column == F.lit(value) if group == "bool" else column == F.lit(text_of(value)) if group == "str" else F.lit(False)
        elif isinstance(value, int | float):
            same = column == F.lit(value) if group == "num" else column == F.lit(text_of(value)) if group == "str" else F.lit(False)
        elif isinstance(value, str):
            same = column == F.lit(value) if group == "str" else F.lit(False) if group == "any" else column.cast("string") == F.lit(value)
        else:
            same = F.lit(False)
        return F.coalesce(same, F.lit(False))

    def both(self, a, b) -> Column:
        (x, kx), (y, ky) = a, b
        gx, gy = kind_of(kx)[0], kind_of(ky)[0]
        same = x == y if gx == gy else x.cast("string") == y.cast("string") if "str" in (gx, gy) and "any" not in (gx, gy) else F.lit(False)
        return F.coalesce(same, F.lit(False))

    def compile(self, ast) -> Column:
        match ast:
            case And(children):
                return reduce(Column.__and__, [self.compile(c) for c in children], F.lit(True))
            case Or(children):
                return reduce(Column.__or__, [self.compile(c) for c in children], F.lit(False))
            case Not(child):
                return ~self.compile(child)
            case PropEquals(path, value):
                found = self.at(path)
                return self.equal(*found, value) if found else F.lit(False)
            case PropIn(path, values):
                found = self.at(path)
                if not found or not values:
                    return F.lit(False)
                if kind_of(found[1])[0] == "str":
                    return F.coalesce(found[0].isin(*[text_of(v) for v in values]), F.lit(False))
                return reduce(Column.__or__, [self.equal(*found, v) for v in values])
            case PropCount(path, least, most):
                found = self.at(path)
                if not found:
                    n = F.lit(0)
                else:
                    n = F.when(found[0].isNull(), 0).otherwise(F.size(found[0]) if isinstance(found[1], T.ArrayType) else F.lit(1))
                return (n >= least if least is not None else F.lit(True)) & (n <= most if most is not None else F.lit(True))
            case PathEquals(a, b) | PathDisjoint(a, b):
                if crosses_reference(a) or crosses_reference(b):
                    return F.lit(True)
                x, y = self.at(a), self.at(b)
                equals = isinstance(ast, PathEquals)
                if not x or not y:
                    lone = x or y
                    return F.lit(True) if not equals or not lone else lone[0].isNull()
                if equals:
                    return (x[0].isNull() & y[0].isNull()) | self.both(x, y)
                return ~self.both(x, y)
            case UniqueByMember(path, member, allowed, most):
                found = self.at(path)
                if not found or not isinstance(found[1], T.ArrayType) or not isinstance(found[1].elementType, T.StructType) or member not in found[1].elementType.names:
                    return F.lit(True)
                keys = F.filter(F.transform(found[0], lambda m: m[member].cast("string")), lambda k: k.isNotNull())
                each = F.forall(keys, lambda k: k.isin(*[text_of(v) for v in allowed]) & (F.size(F.filter(keys, lambda j: j == k)) <= most))
                return F.coalesce(each, F.lit(True))
        raise TypeError(ast)


def violations(df: DataFrame, shapes: list[Shape], keep: list[str]) -> DataFrame:
    """One pass over ``df`` for all rules: a row for each violation, with the ``keep`` columns."""
    compiler = Columns(df.schema)
    made = []
    for s in shapes:
        if not s.introspectable or s.ast is None:
            continue
        fields = F.array(*[F.lit(f) for f in s.fields]).cast("array<string>")
        row = F.struct(F.lit(s.uri).alias("shape"), fields.alias("fields"), F.lit(s.message).alias("message"), F.lit(s.level).alias("enforcement_level"), F.lit(s.level in BLOCKING).alias("is_blocking"), F.lit(None).cast("string").alias("suggested_fix"))
        made.append(F.when(~compiler.compile(s.ast), row))
    found = F.filter(F.array(*made), lambda v: v.isNotNull()) if made else F.array().cast(VIOLATION)
    return df.select(*keep, F.explode(found).alias("v")).select(*keep, "v.*")


def cross_reference_violations(df: DataFrame, shape: Shape, keep: list[str], referenced: DataFrame, key: str) -> DataFrame:
    """A rule ``head/tail = field`` checked through the reference: ``head`` holds the key of ``referenced``."""
    (_, (head, tail)), own = (shape.ast.a, shape.ast.b) if shape.ast.a[0] == "seq" else (shape.ast.b, shape.ast.a)
    other = referenced.select(F.col(key).alias("_key"), F.col(path_name(tail)).alias("_tail"))
    joined = df.join(other, F.col(path_name(head)) == F.col("_key"), "left")
    return joined.where(~F.col(path_name(own)).eqNullSafe(F.col("_tail"))).select(*keep, F.lit(shape.uri).alias("shape"), F.lit(shape.message).alias("message"), F.lit(shape.level).alias("enforcement_level"))


def sparql_violations(spark, catalog, shapes: list[Shape], prefixes: dict[str, str] | None = None) -> DataFrame:
    """Violations of query rules (``sh:sparql``): the rule's SELECT runs over the catalog, each solution's ``$this`` breaks the rule.

    Gives this (the object's IRI) and the columns of ``violations``; the fields
    are the solutions' ``?path`` values.
    """
    from ..functions.expressions import Compiler
    from .lower import solutions

    made = []
    for s in shapes:
        if not s.select:
            continue
        f = solutions(spark, catalog, s.select, prefixes, ("this", "path"))
        c = Compiler(f)
        this = c.text(f.typed("this"))
        path = F.element_at(F.split(c.text(f.typed("path")), "[/#:]"), -1) if "path" in f.info else F.lit(None).cast("string")
        rows = f.df.select(this.alias("this"), path.alias("path")).groupBy("this").agg(F.array_sort(F.collect_set("path")).alias("fields"))
        made.append(rows.select("this", F.lit(s.uri).alias("shape"), "fields", F.lit(s.message).alias("message"), F.lit(s.level).alias("enforcement_level"), F.lit(s.level in BLOCKING).alias("is_blocking")))
    if not made:
        return spark.createDataFrame([], "this string, shape string, fields array<string>, message string, enforcement_level string, is_blocking boolean")
    return reduce(DataFrame.unionByName, made)
