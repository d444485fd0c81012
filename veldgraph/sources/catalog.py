"""The catalog: from class and predicate IRIs to DataFrames and columns.

Two layouts share one interface. *Typed*: a table for each class, a column for
each slot (pruned and pushed down to Parquet). *Golden*: one table
``(uri, class_uri, data VARIANT)``, whose slots are read from the payload.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slot:
    name: str
    column: Column
    #: Name of the class that the slot refers to.
    ref: str | None = None
    #: The column is an array of values.
    many: bool = False


@dataclass
class ClassTable:
    name: str
    iri: str
    df: DataFrame
    #: Identity of a row; None for rows without one.
    key: Column | None
    #: An object's IRI is this prefix and its key.
    prefix: str
    slots: dict[str, Slot] = field(default_factory=dict)
    #: Names of all superclasses.
    ancestors: frozenset[str] = frozenset()

    @property
    def key_type(self) -> str:
        return "string" if self.key is None else self.df.select(self.key.alias("k")).dtypes[0][1]


class Catalog:
    def __init__(self, namespace: str, classes: list[ClassTable]):
        self.namespace = namespace
        self.classes = {c.name: c for c in classes}
        self.by_iri = {c.iri: c for c in classes}
        #: IRIs of classes without a table of their own (abstract ones).
        self.abstract: dict[str, str] = {}
        self.predicates = {namespace + s: s for c in classes for s in c.slots}

    def of_class(self, iri: str) -> list[ClassTable]:
        """The tables that hold instances of a class: its own and its subclasses'."""
        own = self.by_iri.get(iri)
        name = own.name if own else self.abstract.get(iri)
        return [c for c in self.classes.values() if c.iri == iri or name is not None and name in c.ancestors]

    def with_slots(self, names: set[str]) -> list[ClassTable]:
        return [c for c in self.classes.values() if names <= set(c.slots)]

    def resolve(self, iri: str) -> tuple[ClassTable, str] | None:
        """The class and key that an object's IRI stands for."""
        found = [c for c in self.classes.values() if c.key is not None and c.prefix and iri.startswith(c.prefix)]
        if not found:
            bare = [c for c in self.classes.values() if c.key is not None and not c.prefix]
            return (bare[0], iri) if bare else None
        best = max(found, key=lambda c: len(c.prefix))
        return best, iri[len(best.prefix) :]


def golden_catalog(golden: DataFrame, namespace: str, classes: dict[str, dict], prefix: str = "") -> Catalog:
    """A catalog over ``(uri, class_uri, data)``.

    ``classes``: name -> {iri, slots: {name: type or (type, ref) or (type, ref, many)}, ancestors}. A slot
    counts as absent where the payload lacks it or holds null.
    """
    out = []
    for name, spec in classes.items():
        slots = {}
        for slot, kind in spec["slots"].items():
            kind, ref, many = (*kind, None, False)[:3] if isinstance(kind, tuple) else (kind, None, False)
            slots[slot] = Slot(slot, F.try_variant_get("data", f"$.{slot}", f"array<{kind}>" if many else kind), ref, many)
        out.append(ClassTable(name, spec["iri"], golden.where(F.col("class_uri") == spec["iri"]), F.col("uri"), prefix, slots, frozenset(spec.get("ancestors", ()))))
    return Catalog(namespace, out)
