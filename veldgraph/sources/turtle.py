"""A small Turtle parser, for rule files and single objects."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urljoin

from ..errors import ParseError
from ..plans.algebra import RDF, RDF_TYPE, Iri, Literal
from ..plans.parser import _Parser


@dataclass(frozen=True)
class Blank:
    label: str


Node = Iri | Blank | Literal


@dataclass
class Graph:
    """Triples by subject; objects in document order."""

    by_subject: dict[Node, dict[str, list[Node]]] = field(default_factory=dict)

    def add(self, s: Node, p: str, o: Node) -> None:
        self.by_subject.setdefault(s, {}).setdefault(p, []).append(o)

    def objects(self, s: Node, p: str) -> list[Node]:
        return self.by_subject.get(s, {}).get(p, [])

    def first(self, s: Node, p: str) -> Node | None:
        return next(iter(self.objects(s, p)), None)

    def predicates(self, s: Node) -> list[str]:
        return list(self.by_subject.get(s, {}))

    def subjects(self, p: str, o: Node) -> list[Node]:
        return [s for s, ps in self.by_subject.items() if o in ps.get(p, ())]

    def items(self, head: Node) -> list[Node]:
        """The members of an RDF list."""
        out = []
        while head != Iri(RDF + "nil"):
            out.append(self.first(head, RDF + "first"))
            head = self.first(head, RDF + "rest")
            if out[-1] is None or head is None:
                raise ParseError("a list breaks off")
        return out

    def pick(self, s: Node, p: str, language: str) -> str | None:
        """The text in a language, else without one, else the first."""
        texts = [o for o in self.objects(s, p) if isinstance(o, Literal)]
        for want in (lambda x: x.lang == language.lower(), lambda x: not x.lang, lambda x: True):
            for o in texts:
                if want(o):
                    return o.value
        return None

    def triples(self):
        for s, ps in self.by_subject.items():
            for p, os in ps.items():
                for o in os:
                    yield s, p, o


class _Turtle(_Parser):
    def __init__(self, text: str):
        super().__init__(text, {})
        self.prefixes = {}
        self.graph = Graph()
        self.labels: dict[str, Blank] = {}

    def blank(self) -> Blank:
        self.fresh += 1
        return Blank(f"b{self.fresh}")

    def document(self) -> Graph:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if text in ("@prefix", "@base") or self.is_("PREFIX", "BASE"):
                self.i += 1
                if text.lstrip("@").lower() == "prefix":
                    name = self.next()[1]
                    target = self.next()[1][1:-1]
                    self.prefixes[name[:-1]] = urljoin(self.base, target) if self.base else target
                else:
                    self.base = self.next()[1][1:-1]
                if text.startswith("@"):
                    self.need(".")
                continue
            inner = self.is_("[")
            subject = self.node()
            if isinstance(subject, Literal):
                raise ParseError("a literal can't be a subject")
            if not (inner and self.is_(".")):
                self.properties(subject)
            self.need(".")
        return self.graph

    def properties(self, subject: Node) -> None:
        while True:
            if self.peek() == ("word", "a"):
                self.i += 1
                p = RDF_TYPE
            else:
                iri = self.iri()
                if iri is None:
                    raise ParseError(f"expected a predicate, found {self.peek()[1]!r}")
                p = iri.value
            while True:
                self.graph.add(subject, p, self.node())
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.is_(".", "]"):
                return

    def node(self) -> Node:
        kind, text = self.peek()
        if kind == "bnode":
            self.i += 1
            if text not in self.labels:
                self.labels[text] = self.blank()
            return self.labels[text]
        if self.take("["):
            b = self.blank()
            if not self.is_("]"):
                self.properties(b)
            self.need("]")
            return b
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node())
            head: Node = Iri(RDF + "nil")
            for x in reversed(items):
                b = self.blank()
                self.graph.add(b, RDF + "first", x)
                self.graph.add(b, RDF + "rest", head)
                head = b
            return head
        found = self.iri() or self.literal()
        if found is None:
            raise ParseError(f"unexpected {text!r}")
        return found


def parse_turtle(text: str) -> Graph:
    return _Turtle(text).document()
