"""Working back from rules: allowed values, peers, and predicates as JSON and columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import VeldgraphError
from ..plans import algebra as A
from ..plans.parser import parse
from ..plans.rules import And, Not, Or, PathEquals, PropCount, PropEquals, PropIn, Shape, UniqueByMember, from_json, local_name, parse_shapes, path_name, to_json
from .rules import text_of, values_equal, violations, violations_of
from .spread import spread_join


# Predicates
@dataclass(frozen=True)
class Simple:
    field: str
    operator: str
    value: object = None


@dataclass(frozen=True)
class Expression:
    operator: str  # AND, OR
    predicates: tuple


@dataclass(frozen=True)
class Negated:
    predicate: object


def combine(operator: str, predicates: list):
    """AND or OR; like operators are flattened one level, a single predicate stands for itself."""
    flat: list = []
    for p in predicates:
        flat += p.predicates if isinstance(p, Expression) and p.operator == operator else [p]
    return flat[0] if len(flat) == 1 else Expression(operator, tuple(flat))


def predicate_json(p) -> dict:
    match p:
        case Simple():
            return {"fieldId": p.field, "predicateTypeId": p.operator} | ({} if p.value is None else {"value": list(p.value) if isinstance(p.value, tuple) else p.value})
        case Expression():
            return {"operator": p.operator, "predicates": [predicate_json(x) for x in p.predicates]}
        case Negated():
            return {"operator": "NOT", "predicate": predicate_json(p.predicate)}
    raise TypeError(p)


def predicate_from_json(d: dict):
    if "predicate" in d:
        return Negated(predicate_from_json(d["predicate"]))
    if "predicates" in d:
        return Expression(d["operator"], tuple(predicate_from_json(x) for x in d["predicates"]))
    value = d.get("value")
    return Simple(d["fieldId"], d["predicateTypeId"], tuple(value) if isinstance(value, list) else value)


def passes(p, field: str, candidate: str) -> bool:
    """Whether a candidate value of ``field`` satisfies a predicate; what speaks of other fields is true."""
    match p:
        case Expression():
            return (all if p.operator == "AND" else any)(passes(x, field, candidate) for x in p.predicates)
        case Negated():
            return not passes(p.predicate, field, candidate)
        case Simple() if p.field == field:
            if p.operator == "in":
                return any(text_of(v) == candidate for v in p.value) if isinstance(p.value, tuple) else True
            if p.operator in ("equals", "notEquals"):
                same = p.value is not None and not isinstance(p.value, tuple) and text_of(p.value) == candidate
                return same == (p.operator == "equals")
    return True


def predicate_column(p) -> Column:
    """A predicate as a two-valued column over the fields' columns."""
    match p:
        case Expression():
            parts = [predicate_column(x) for x in p.predicates]
            return reduce(Column.__and__ if p.operator == "AND" else Column.__or__, parts)
        case Negated():
            return ~predicate_column(p.predicate)
        case Simple():
            c = F.col(p.field).cast("string")
            if p.operator == "in" and isinstance(p.value, tuple):
                return F.coalesce(c.isin(*[text_of(v) for v in p.value]), F.lit(False)) if p.value else F.lit(False)
            if p.operator in ("equals", "notEquals"):
                same = F.coalesce(c == F.lit(text_of(p.value)), F.lit(False))
                return same if p.operator == "equals" else ~same
    return F.lit(True)


# Solving: True and False, or ("eq" | "ne", v), ("in", vs), ("and" | "or", parts), ("not", x)
def _substitute(ast, known: dict, target: str):
    match ast:
        case And(children):
            return ("and", [_substitute(c, known, target) for c in children])
        case Or(children):
            return ("or", [_substitute(c, known, target) for c in children])
        case Not(child):
            return ("not", _substitute(child, known, target))
        case PropEquals() | PropIn() | PropCount():
            name = path_name(ast.path)
            if name == target:
                if isinstance(ast, PropEquals):
                    return ("eq", ast.value)
                return ("in", ast.values) if isinstance(ast, PropIn) else ast.most != 0
            if name is None or name not in known:
                return True
            v = known[name]
            if isinstance(ast, PropEquals):
                return values_equal(v, ast.value)
            if isinstance(ast, PropIn):
                return any(values_equal(v, x) for x in ast.values)
            n = 0 if v is None else len(v) if isinstance(v, list) else 1
            return (ast.least is None or n >= ast.least) and (ast.most is None or n <= ast.most)
    return True


def _simplify(x):
    if isinstance(x, bool):
        return x
    match x:
        case ("not", y):
            y = _simplify(y)
            match y:
                case bool():
                    return not y
                case ("eq", v):
                    return ("ne", v)
                case ("ne", v):
                    return ("eq", v)
                case ("not", z):
                    return z
                case ("and" | "or" as op, parts):
                    return _simplify(("or" if op == "and" else "and", [("not", p) for p in parts]))
            return ("not", y)
        case ("and" | "or" as op, parts):
            stop = op == "or"  # a true part settles OR, a false one AND
            kept = []
            for p in map(_simplify, parts):
                if isinstance(p, bool):
                    if p == stop:
                        return stop
                    continue
                kept += p[1] if p[0] == op else [p]
            return not stop if not kept else kept[0] if len(kept) == 1 else (op, kept)
    return x


def _extract(x, target: str):
    match x:
        case True:
            return None
        case False:
            return Simple(target, "in", ())
        case ("eq", v):
            return Simple(target, "equals", v)
        case ("ne", v):
            return Negated(Simple(target, "equals", v))
        case ("in", vs):
            return Simple(target, "in", tuple(vs))
        case ("not", y):
            return Negated(_extract(y, target))
        case (op, parts):
            return combine(op.upper(), [_extract(p, target) for p in parts])


def solve_backward(ast, known: dict, target: str):
    """The predicate that a rule leaves for ``target``; None if it leaves it free."""
    if isinstance(ast, PathEquals):
        return _through_reference(ast, known, target)
    found = _extract(_simplify(_substitute(ast, known, target)), target)
    if isinstance(ast, And):  # consistency through a reference, inside a conjunction
        more = [p for c in ast.children if isinstance(c, PathEquals) and (p := _through_reference(c, known, target))]
        if more:
            return combine("AND", [*([found] if found else []), *more])
    return found


def _through_reference(ast: PathEquals, known: dict, target: str):
    """``target/tail = field``: the referenced object's tail must equal the field's value."""
    for path, own in ((ast.a, ast.b), (ast.b, ast.a)):
        if path[0] == "seq" and len(path[1]) == 2 and all(p[0] == "iri" for p in path[1]) and path_name(path[1][0]) == target and own[0] == "iri":
            value = known.get(path_name(own))
            return None if value is None else Simple(path_name(path[1][1]), "equals", value)
    return None


def solve_member(ast, array: str, member: str, members: list):
    """(allowed values, values at capacity) of a member field; None if no rule speaks of it."""
    if isinstance(ast, UniqueByMember) and path_name(ast.path) == array and ast.member == member:
        used = [text_of(m[member]) for m in members if isinstance(m, dict) and member in m]
        return list(ast.allowed), {k for k in used if used.count(k) >= ast.most}
    if isinstance(ast, And):
        return next((r for c in ast.children if (r := solve_member(c, array, member, members))), None)
    return None


def shared_attributes(select: str, prefixes: dict[str, str] | None = None) -> list[str]:
    """Attributes in which ``$this`` and another object of a rule's query have one value."""
    found: list[str] = []
    names = {p: f"urn:prefix:{p}:" for p in {"", *_prefixes_in(select)}} | (prefixes or {})
    triples: list[A.Triple] = []

    def walk(node):
        if isinstance(node, A.Bgp):
            triples.extend(node.triples)
        for k in ("node", "left", "right"):
            if hasattr(node, k):
                walk(getattr(node, k))

    try:
        walk(parse(select, names).node)
    except VeldgraphError:
        return []
    own = {(t.p, t.o) for t in triples if t.s == A.Var("this") and isinstance(t.o, A.Var) and isinstance(t.p, A.Iri)}
    for t in triples:
        if isinstance(t.s, A.Var) and t.s.name != "this" and (t.p, t.o) in own:
            name = local_name(t.p.value.replace(":", "/"))
            if name not in found:
                found.append(name)
    return found


def _prefixes_in(text: str) -> set[str]:
    import re

    bare = re.sub(r"\"[^\"]*\"|'[^']*'|<[^>]*>|#[^\n]*", " ", text)
    return set(re.findall(r"(?<![\w?$])([A-Za-z][\w.-]*):", bare)) - {"xsd", "rdf", "rdfs"}


def scope_predicate(shape: Shape, focus: dict, uri_field: str):
    """The peers that a query rule relates an object to; None if it relates none or a value is missing."""
    if not shape.select:
        return None
    attributes = shared_attributes(shape.select)
    values = [focus.get(a) for a in attributes]
    if not attributes or any(v is None for v in values) or focus.get(uri_field) is None:
        return None
    return combine("AND", [*(Simple(a, "equals", v) for a, v in zip(attributes, values)), Negated(Simple(uri_field, "equals", focus[uri_field]))])


class ConstraintSet:
    """The rules of a class."""

    def __init__(self, shapes: list[Shape], enums: dict[str, list[str]] | None = None):
        #: Permissible values by field, where the schema says so; ``array.member`` for members.
        self.shapes, self.enums = shapes, enums

    @classmethod
    def from_shacl(cls, turtle: str, target_class: str = "", language: str = "en", enums: dict[str, list[str]] | None = None) -> ConstraintSet:
        return cls(parse_shapes(turtle, target_class, language), enums)

    @classmethod
    def from_json(cls, text: str, enums: dict[str, list[str]] | None = None) -> ConstraintSet:
        return cls(from_json(text), enums)

    def to_json(self) -> str:
        return to_json(self.shapes)

    @property
    def shape_count(self) -> int:
        return len(self.shapes)

    @property
    def has_schema(self) -> bool:
        return self.enums is not None

    def affected_fields(self) -> list[str]:
        return sorted({f for s in self.shapes for f in s.fields})

    def evaluate(self, data: dict) -> list[dict]:
        return violations_of(self.shapes, data)

    def violations(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return violations(df, self.shapes, keep)

    def solve(self, data: dict, target: str) -> dict | None:
        """What ``target`` may be, given the other fields (missing ones count as null)."""
        known = {f: None for f in self.affected_fields()} | data
        known.pop(target, None)
        found = [p for s in self.shapes if s.introspectable and s.ast is not None and (p := solve_backward(s.ast, known, target)) is not None]
        if not found:
            return None
        predicate = combine("AND", found)
        if self.enums and target in self.enums:
            return {"type": "allowedValues", "values": [v for v in self.enums[target] if passes(predicate, target, v)]}
        return {"type": "query", "predicate": predicate_json(predicate)}

    def solve_member(self, data: dict, array: str, member: str, editing_index: int | None = None) -> dict | None:
        """What a member's field may be beside the other members."""
        members = data.get(array) if isinstance(data.get(array), list) else []
        others = [m for i, m in enumerate(members) if i != editing_index]
        allowed, full = None, set()
        for s in self.shapes:
            if s.introspectable and s.ast is not None and (r := solve_member(s.ast, array, member, others)):
                allowed = r[0] if allowed is None else [v for v in allowed if v in r[0]]
                full |= r[1]
        if allowed is None:
            allowed = (self.enums or {}).get(f"{array}.{member}")
        if allowed is None:
            return None
        return {"type": "allowedValues", "values": [v for v in allowed if text_of(v) not in full]}

    def scope(self, focus: dict, uri_field: str) -> dict | None:
        found = [p for s in self.shapes if (p := scope_predicate(s, focus, uri_field)) is not None]
        return predicate_json(combine("OR", found)) if found else None


# Whole tables
def allowed_values(df: DataFrame, shapes: list[Shape], target: str, candidates: list[str], keep: list[str]) -> DataFrame:
    """For each row the candidates of ``target`` that break no rule: the rules judge each in the row's place."""
    from .rules import Columns

    tried = df.withColumn(target, F.explode(F.array(*[F.lit(c) for c in candidates])))
    compiler = Columns(tried.schema)
    rules = [compiler.compile(s.ast) for s in shapes if s.introspectable and s.ast is not None]
    return tried.where(reduce(Column.__and__, rules, F.lit(True))).select(*keep, target)


def allowed_members(df: DataFrame, rule: UniqueByMember, keep: list[str]) -> DataFrame:
    """For each row the member values that one member more may take."""
    keys = F.transform(F.coalesce(F.col(path_name(rule.path)), F.array()), lambda m: m[rule.member].cast("string"))
    free = F.filter(F.array(*[F.lit(text_of(v)) for v in rule.allowed]), lambda v: F.size(F.filter(keys, lambda k: k == v)) < rule.most)
    return df.select(*keep, free.alias("allowed"))


def peers(df: DataFrame, key: str, attributes: list[str], given: Iterable[list[str]] = ()) -> DataFrame:
    """(key, peer) of rows that agree in all attributes: an equi-join on these, never on NULL.

    Pairs that agree in all attributes of one of ``given`` are left out.
    """
    more = [a for a in dict.fromkeys(a for other in given for a in other) if a not in attributes]
    a = df.select(F.col(key), *attributes, *more)
    b = df.select(F.col(key).alias("peer"), *attributes, *[F.col(m).alias(f"_peer_{m}") for m in more])
    found = spread_join(a, b, attributes)[0].where(F.col(key) != F.col("peer"))
    for other in given:
        found = found.where(~F.coalesce(reduce(Column.__and__, [F.col(m) == F.col(f"_peer_{m}") for m in other if m in more], F.lit(True)), F.lit(False)))
    return found.select(key, "peer")


def scope_peers(df: DataFrame, shapes: list[Shape], key: str) -> DataFrame:
    """(key, peer) of all query rules together: for each rule the rows that agree in its shared attributes; a pair counts once.

    Where each row has a key of its own, a rule leaves out the pairs of the
    rules before it, so that no pair is looked up among all others.
    """
    found = [attributes for s in shapes if s.select and (attributes := shared_attributes(s.select))]
    if not found:
        return df.select(F.col(key), F.col(key).alias("peer")).limit(0)
    if not df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        return reduce(DataFrame.union, [peers(df, key, attributes) for attributes in found]).distinct()
    # a rule whose attributes hold all of another's gives nothing more
    least = [x for i, x in enumerate(found) if not any(set(y) < set(x) or j < i and set(y) == set(x) for j, y in enumerate(found))]
    return reduce(DataFrame.union, [peers(df, key, x, least[:i]) for i, x in enumerate(least)])
