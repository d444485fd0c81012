"""Terms, expressions and algebra nodes of graph queries."""

from __future__ import annotations

from dataclasses import dataclass, field

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
RDF_TYPE = RDF + "type"


@dataclass(frozen=True)
class Var:
    name: str
    #: Made by the parser (blank node or path step); never part of ``SELECT *``.
    hidden: bool = False


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = XSD + "string"
    lang: str = ""


Term = Var | Iri | Literal


# Property paths
@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    parts: tuple


@dataclass(frozen=True)
class Alternative:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    """``?`` (0, 1), ``*`` (0, many) or ``+`` (1, many)."""

    path: object
    least: int
    many: bool


@dataclass(frozen=True)
class Negated:
    """``!(p|^q)``: predicates that are left out, forwards and backwards; None for a direction that is not asked for."""

    forward: tuple | None
    backward: tuple | None


@dataclass(frozen=True)
class Triple:
    s: Term
    p: object
    o: Term


# Expressions
@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object | None
    distinct: bool = False
    separator: str = " "


# Nodes
@dataclass
class Bgp:
    triples: list[Triple] = field(default_factory=list)


@dataclass
class Join:
    left: object
    right: object


@dataclass
class LeftJoin:
    left: object
    right: object
    condition: object | None = None


@dataclass
class Filter:
    condition: object
    node: object


@dataclass
class Extend:
    node: object
    var: Var
    expression: object


@dataclass
class Union:
    left: object
    right: object


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Values:
    variables: list[Var]
    rows: list[list[Term | None]]


@dataclass
class Group:
    node: object
    keys: list[tuple[Var, object]]
    aggregates: list[tuple[Var, Aggregate]]


@dataclass
class Project:
    node: object
    variables: list[Var]


@dataclass
class Distinct:
    node: object


@dataclass
class Reduced:
    node: object


@dataclass
class Slice:
    node: object
    offset: int = 0
    limit: int | None = None


@dataclass
class OrderBy:
    node: object
    keys: list[tuple[object, bool]]  # expression, ascending


@dataclass
class Query:
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    node: object
    template: list[Triple] = field(default_factory=list)
    targets: list[Term] = field(default_factory=list)


def variables(node) -> list[Var]:
    """The visible variables that a node may bind, in order of first mention."""
    found: dict[Var, None] = {}

    def walk(n):
        match n:
            case Bgp():
                for t in n.triples:
                    for x in (t.s, t.p, t.o):
                        if isinstance(x, Var) and not x.hidden:
                            found[x] = None
            case Project():
                found.update(dict.fromkeys(n.variables))
            case Values():
                found.update(dict.fromkeys(n.variables))
            case Extend():
                walk(n.node)
                found[n.var] = None
            case Group():
                found.update(dict.fromkeys(v for v, _ in [*n.keys, *n.aggregates] if not v.hidden))
            case Minus():
                walk(n.left)
            case Join() | LeftJoin() | Union():
                walk(n.left)
                walk(n.right)
            case _ if hasattr(n, "node"):
                walk(n.node)

    walk(node)
    return list(found)
