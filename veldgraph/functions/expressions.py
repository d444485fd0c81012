"""Query expressions as columns.

An error is NULL, as SPARQL's unbound; ``where`` drops NULL like false. Each
expression carries a kind (num, str, bool, time, date, iri, any), so that no
comparison makes Spark cast one kind to another.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedConstruct
from ..plans.algebra import RDF, XSD, Call, Exists, Iri, Literal, Var


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str
    #: For iri: the prefix that makes an IRI of the column; None if it is one already.
    prefix: str | None = None
    datatype: str = ""
    constant: object = None
    #: Language tag of a literal.
    lang: str = ""


def kind_of(data_type: T.DataType) -> tuple[str, str]:
    """Kind and xsd datatype of a column type."""
    match data_type:
        case T.BooleanType():
            return "bool", XSD + "boolean"
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return "num", XSD + "integer"
        case T.DecimalType():
            return "num", XSD + "decimal"
        case T.FloatType():
            return "num", XSD + "float"
        case T.DoubleType():
            return "num", XSD + "double"
        case T.TimestampType() | T.TimestampNTZType():
            return "time", XSD + "dateTime"
        case T.DateType():
            return "date", XSD + "date"
        case T.StringType():
            return "str", XSD + "string"
    return "any", ""


_INTEGERS = {XSD + x for x in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong")}


def literal(term: Literal) -> Typed:
    v, d = term.value, term.datatype
    try:
        if d in _INTEGERS:
            n = int(v)
            return Typed(F.lit(n) if abs(n) < 1 << 63 else F.lit(v).cast("decimal(38,0)"), "num", datatype=d, constant=n)
        if d == XSD + "decimal":
            n = Decimal(v)
            digits, exponent = len(n.as_tuple().digits), n.as_tuple().exponent
            if isinstance(exponent, int) and max(digits, -exponent) <= 38 and exponent <= 0:
                return Typed(F.lit(n), "num", datatype=d, constant=float(v))
            return Typed(F.lit(float(v)), "num", datatype=d, constant=float(v))
        if d in (XSD + "double", XSD + "float"):
            return Typed(F.lit(float(v)), "num", datatype=d, constant=float(v))
    except (ValueError, InvalidOperation):
        return Typed(F.lit(None).cast("double"), "num", datatype=d)
    if d == XSD + "boolean":
        return Typed(F.lit(v in ("true", "1")), "bool", datatype=d, constant=v)
    if d == XSD + "dateTime":
        return Typed(F.lit(_in_utc(v)).try_cast("timestamp_ntz"), "time", datatype=d, constant=v)
    if d == XSD + "date":
        return Typed(F.lit(v).try_cast("date"), "date", datatype=d, constant=v)
    return Typed(F.lit(v), "str", datatype=d, constant=v, lang=term.lang)


_ZONE = re.compile(r"(Z|[+-]\d\d:\d\d)$")


def _in_utc(text: str) -> str:
    """A dateTime's text without its zone, moved to UTC."""
    if not _ZONE.search(text):
        return text
    try:
        return datetime.fromisoformat(text).astimezone(UTC).replace(tzinfo=None).isoformat()
    except ValueError:
        return text


def _zone(x: Typed) -> str:
    """The zone that a dateTime constant names; columns of times have none."""
    found = _ZONE.search(x.constant) if x.kind == "time" and isinstance(x.constant, str) else None
    return found[0] if found else ""


def _duration(zone: str) -> str:
    if zone in ("Z", "+00:00", "-00:00"):
        return "PT0S"
    hours, minutes = int(zone[1:3]), int(zone[4:6])
    return ("-" if zone[0] == "-" else "") + "PT" + (f"{hours}H" if hours else "") + (f"{minutes}M" if minutes else "")


def _null() -> Column:
    return F.lit(None).cast("boolean")


class Compiler:
    """Compiles expressions over one frame (see ``operators.lower``)."""

    def __init__(self, frame, exists=None):
        self.frame = frame
        self.exists = exists

    def boolean(self, e) -> Column:
        """The effective boolean value."""
        x = self.typed(e)
        match x.kind:
            case "bool":
                return x.column
            case "num":
                return (x.column != 0) & ~F.isnan(x.column.cast("double"))
            case "str":
                return F.length(x.column) > 0
        return _null()

    def text(self, x: Typed) -> Column:
        """The lexical form."""
        if x.kind == "iri":
            return F.concat(F.lit(x.prefix), x.column.cast("string")) if x.prefix else x.column.cast("string")
        if x.kind == "time":
            return F.date_format(x.column, "yyyy-MM-dd'T'HH:mm:ss")
        return x.column.cast("string")

    def typed(self, e) -> Typed:
        match e:
            case Var():
                return self.frame.typed(e.name)
            case Literal():
                return literal(e)
            case Iri():
                found = self.frame.catalog.resolve(e.value) if self.frame.catalog else None
                if found:
                    table, key = found
                    return Typed(F.lit(key).try_cast(table.key_type), "iri", table.prefix or None, constant=e.value)
                return Typed(F.lit(e.value), "iri", None, constant=e.value)
            case Exists():
                if self.exists is None:
                    raise UnsupportedConstruct("EXISTS is not possible here")
                return Typed(self.exists(e), "bool")
            case Call():
                return self.call(e)
        raise UnsupportedConstruct(f"expression {e!r}")

    def same(self, a: Typed, b: Typed) -> Column:
        if a.kind == b.kind == "iri":
            return a.column == b.column if a.prefix == b.prefix else self.text(a) == self.text(b)
        if a.kind == "iri" or b.kind == "iri":
            # a string slot may hold an IRI's text
            if "str" in (a.kind, b.kind) and (a.constant is None or b.constant is None):
                return self.text(a) == self.text(b)
            return F.lit(False)
        return self.order(a, b, lambda x, y: x == y)

    def order(self, a: Typed, b: Typed, op) -> Column:
        x, y = a.column, b.column
        if {a.kind, b.kind} == {"time", "date"}:
            return op(x.cast("timestamp_ntz"), y.cast("timestamp_ntz"))
        if a.kind != b.kind:
            return _null()
        return op(x, y)

    def number(self, e) -> Column:
        x = self.typed(e)
        return x.column if x.kind == "num" else F.lit(None).cast("double")

    def string(self, e) -> Column:
        x = self.typed(e)
        return x.column if x.kind == "str" else F.lit(None).cast("string")

    def call(self, e: Call) -> Typed:
        name, args = e.name, e.args
        match name:
            case "&&":
                return Typed(self.boolean(args[0]) & self.boolean(args[1]), "bool")
            case "||":
                return Typed(self.boolean(args[0]) | self.boolean(args[1]), "bool")
            case "!":
                return Typed(~self.boolean(args[0]), "bool")
            case "=" | "!=":
                same = self.same(self.typed(args[0]), self.typed(args[1]))
                return Typed(same if name == "=" else ~same, "bool")
            case "<" | ">" | "<=" | ">=":
                op = {"<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}[name]
                return Typed(self.order(self.typed(args[0]), self.typed(args[1]), op), "bool")
            case "IN":
                x, items = self.typed(args[0]), [self.typed(a) for a in args[1:]]
                if not items:
                    return Typed(F.lit(False), "bool")
                if all(i.kind == x.kind != "iri" and i.constant is not None for i in items):
                    return Typed(x.column.isin(*[i.column for i in items]), "bool")
                return Typed(reduce(Column.__or__, [self.same(x, i) for i in items]), "bool")
            case "+" | "-" | "*":
                x, y = self.number(args[0]), self.number(args[1])
                f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[name]
                return Typed(f(x, y), "num")
            case "/":
                return Typed(F.try_divide(self.number(args[0]).cast("double"), self.number(args[1]).cast("double")), "num")
            case "NEG":
                return Typed(-self.number(args[0]), "num")
            case "CAST":
                return self.cast(args[0].value, self.typed(args[1]))
        method = _FUNCTIONS.get(name)
        if method is None:
            raise UnsupportedConstruct(f"function {name}")
        return method(self, *args)

    def cast(self, target: str, x: Typed) -> Typed:
        text = self.text(x)
        local = target.removeprefix(XSD)
        if local == "string":
            return Typed(text, "str")
        if local == "boolean":
            return Typed(x.column != 0 if x.kind == "num" else F.lower(text).try_cast("boolean"), "bool", datatype=target)
        if target in _INTEGERS:
            return Typed(x.column.try_cast("bigint") if x.kind in ("num", "bool") else text.try_cast("bigint"), "num", datatype=target)
        if local in ("decimal", "double", "float"):
            kind = {"decimal": "decimal(38,10)"}.get(local, local)
            return Typed(x.column.try_cast(kind) if x.kind in ("num", "bool") else text.try_cast(kind), "num", datatype=target)
        if local == "dateTime":
            return Typed(F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz"), "time", datatype=target)
        if local == "date":
            return Typed(x.column.try_cast("date") if x.kind == "time" else text.try_cast("date"), "date", datatype=target)
        raise UnsupportedConstruct(f"cast to {target}")


def _string(f):
    return lambda c, *a: Typed(f(*[c.string(x) for x in a]), "str")


def _boolean(f):
    return lambda c, *a: Typed(f(*[c.string(x) for x in a]), "bool")


def _number(f):
    return lambda c, a: Typed(f(c.number(a)), "num")


def _whole(f):
    """Spark's ceil and floor give BIGINT; keep the operand's type."""

    def run(c, a):
        x = c.typed(a)
        if x.datatype in _INTEGERS:
            return x
        return Typed(f(x.column.cast("double")).cast("double") if x.kind == "num" else F.lit(None).cast("double"), "num")

    return run


def _part(f):
    def run(c, a):
        x = c.typed(a)
        return Typed(f(x.column) if x.kind in ("time", "date") else F.lit(None).cast("int"), "num")

    return run


def _pick(c, cond, yes, no):
    a, b = c.typed(yes), c.typed(no)
    test = c.boolean(cond)
    same = a.kind == b.kind and a.prefix == b.prefix
    x, y = (a.column, b.column) if same else (c.text(a), c.text(b))
    return Typed(F.when(test, x).when(~test, y), a.kind if same else "str", a.prefix if same else None)


def _coalesce(c, *args):
    xs = [c.typed(a) for a in args]
    same = len({(x.kind, x.prefix) for x in xs}) == 1
    return Typed(F.coalesce(*[x.column if same else c.text(x) for x in xs]), xs[0].kind if same else "str", xs[0].prefix if same else None)


def _regex(c, text, pattern, flags=None):
    p = c.string(pattern)
    if flags is not None and flags.value:
        p = F.concat(F.lit(f"(?{flags.value})"), p)
    return Typed(F.regexp(c.string(text), p), "bool")


def _replace(c, text, pattern, by, flags=None):
    p = c.string(pattern)
    if flags is not None and flags.value:
        p = F.concat(F.lit(f"(?{flags.value})"), p)
    return Typed(F.regexp_replace(c.string(text), p, c.string(by)), "str")


def _substr(c, text, start, length=None):
    s, i = c.string(text), c.number(start).cast("int")
    n = F.lit((1 << 31) - 1) if length is None else c.number(length).cast("int")
    # positions before the first count towards the length
    return Typed(F.substring(s, F.greatest(i, F.lit(1)), F.greatest(F.lit(0), F.when(i < 1, n + i - 1).otherwise(n))), "str")


def _around(before: bool):
    def run(c, text, mark):
        s, m = c.string(text), c.string(mark)
        at = F.position(m, s)
        found = F.substring(s, F.lit(1), at - 1) if before else F.substring(s, at + F.length(m), F.length(s))
        return Typed(F.when(F.length(m) == 0, F.lit("") if before else s).when(at > 0, found).when(at == 0, F.lit("")), "str")

    return run


def _str(c, a):
    return Typed(c.text(c.typed(a)), "str")


def _datatype(c, a):
    x = c.typed(a)
    return Typed(F.when(x.column.isNotNull(), F.lit(x.datatype or XSD + "string")), "iri") if x.kind != "iri" else Typed(F.lit(None).cast("string"), "iri")


def _is(*kinds):
    return lambda c, a: Typed(F.when((x := c.typed(a)).column.isNotNull(), F.lit(x.kind in kinds)), "bool")


_FUNCTIONS = {
    "STR": _str,
    "STRLEN": lambda c, a: Typed(F.char_length(c.string(a)), "num"),
    "SUBSTR": _substr,
    "UCASE": _string(F.upper),
    "LCASE": _string(F.lower),
    "STRSTARTS": _boolean(F.startswith),
    "STRENDS": _boolean(F.endswith),
    "CONTAINS": _boolean(F.contains),
    "STRBEFORE": _around(True),
    "STRAFTER": _around(False),
    "CONCAT": lambda c, *a: Typed(F.concat(*[c.string(x) for x in a]) if a else F.lit(""), "str"),
    "REPLACE": _replace,
    "REGEX": _regex,
    "ENCODE_FOR_URI": _string(lambda s: F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))),
    "ABS": _number(F.abs),
    "CEIL": _whole(F.ceil),
    "FLOOR": _whole(F.floor),
    "ROUND": _whole(lambda x: F.floor(x + 0.5)),
    "RAND": lambda c: Typed(F.rand(), "num"),
    "YEAR": _part(F.year),
    "MONTH": _part(F.month),
    "DAY": _part(F.day),
    "HOURS": _part(F.hour),
    "MINUTES": _part(F.minute),
    "SECONDS": _part(F.second),
    "NOW": lambda c: Typed(F.localtimestamp(), "time"),
    "TZ": lambda c, a: Typed(F.when((x := c.typed(a)).column.isNotNull(), F.lit(_zone(x) if x.kind == "time" else None)), "str"),
    "TIMEZONE": lambda c, a: Typed(F.lit(_duration(z) if (z := _zone(c.typed(a))) else None).cast("string"), "str", datatype=XSD + "dayTimeDuration"),
    "MD5": _string(F.md5),
    "SHA1": _string(F.sha1),
    "SHA256": _string(lambda s: F.sha2(s, 256)),
    "SHA384": _string(lambda s: F.sha2(s, 384)),
    "SHA512": _string(lambda s: F.sha2(s, 512)),
    "UUID": lambda c: Typed(F.concat(F.lit("urn:uuid:"), F.expr("uuid()")), "iri"),
    "STRUUID": lambda c: Typed(F.expr("uuid()"), "str"),
    "IF": _pick,
    "COALESCE": _coalesce,
    "BOUND": lambda c, a: Typed(c.typed(a).column.isNotNull(), "bool"),
    "SAMETERM": lambda c, a, b: Typed(c.same(x, y) if (x := c.typed(a)).kind == (y := c.typed(b)).kind and (not x.datatype or not y.datatype or x.datatype == y.datatype) else F.lit(False), "bool"),
    "ISIRI": _is("iri"),
    "ISURI": _is("iri"),
    "ISBLANK": lambda c, a: Typed(F.when(c.typed(a).column.isNotNull(), F.lit(False)), "bool"),
    "ISLITERAL": _is("num", "str", "bool", "time", "date", "any"),
    "ISNUMERIC": _is("num"),
    "LANG": lambda c, a: Typed(F.when((x := c.typed(a)).column.isNotNull(), F.lit(x.lang) if x.kind != "iri" else F.lit(None).cast("string")), "str"),
    "LANGMATCHES": lambda c, a, b: Typed(F.when(c.string(b) == "*", c.string(a) != "").otherwise((F.lower(c.string(a)) == F.lower(c.string(b))) | F.startswith(F.lower(c.string(a)), F.concat(F.lower(c.string(b)), F.lit("-")))), "bool"),
    "DATATYPE": _datatype,
    "IRI": lambda c, a: Typed(c.text(c.typed(a)), "iri"),
    "URI": lambda c, a: Typed(c.text(c.typed(a)), "iri"),
    "STRDT": lambda c, a, d: c.cast(d.value, c.typed(a)),
    "STRLANG": lambda c, a, tag: Typed(c.string(a), "str", datatype=RDF + "langString", lang=tag.value.lower()),
    "BNODE": lambda c, *a: Typed(F.concat(F.lit("_:"), F.md5(c.string(a[0])) if a else F.expr("uuid()")), "iri"),
}
