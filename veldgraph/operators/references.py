"""Edges between objects: foreign keys held by class tables or by single objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from ..sources.schema import SchemaView, truthy


def foreign_edges(catalog: Catalog, names: list[str] | None = None, include_keys: bool = False) -> DataFrame:
    """(holder, uri, object_type, object_type_uri, slot_name, slot_path, kind) of the classes' reference slots.

    One pass a class: its references become an array that is exploded. NULL
    references give no edge; a multivalued slot fans out, its index appended to
    the path. ``include_keys`` adds each object's own key as a primary edge.
    """
    parts = []
    for table in catalog.classes.values():
        if names is not None and table.name not in names or table.key is None:
            continue
        own = F.concat(F.lit(table.prefix), table.key.cast("string"))

        def edge(uri, cls, slot, path, kind):
            return F.struct(uri.alias("uri"), F.lit(cls.name).alias("object_type"), F.lit(cls.iri).alias("object_type_uri"), F.lit(slot).alias("slot_name"), path.alias("slot_path"), F.lit(kind).alias("kind"))

        singles, fans = [], []
        if include_keys:
            singles.append(edge(own, table, "id", F.array(F.lit("id")), "primary"))
        for s in table.slots.values():
            if not s.ref:
                continue
            cls = catalog.classes[s.ref]
            if s.many:

                def each(x, i):
                    return edge(F.concat(F.lit(cls.prefix), x.cast("string")), cls, s.name, F.array(F.lit(s.name), i.cast("string")), "foreign")

                fans.append(F.transform(F.coalesce(s.column, F.array()), each))
            else:
                singles.append(edge(F.concat(F.lit(cls.prefix), s.column.cast("string")), cls, s.name, F.array(F.lit(s.name)), "foreign"))
        if not singles and not fans:
            continue
        edges = F.filter(_concat(singles, fans), lambda e: e["uri"].isNotNull())
        parts.append(table.df.select(own.alias("holder"), F.explode(edges).alias("e")).select("holder", "e.*"))
    if not parts:
        raise ValueError("no class with references")
    return reduce(DataFrame.unionByName, parts)


def _concat(singles, fans):
    arrays = ([F.array(*singles)] if singles else []) + fans
    return arrays[0] if len(arrays) == 1 else F.concat(*arrays)


def foreign_references(view: SchemaView, class_name: str, instance, also_include_id_slots: bool = False, id_annotation: str = "id-slot") -> list[dict]:
    """The references in one object tree, in tree order.

    A slot whose range is held by reference gives an edge for each value (lists
    by index, mappings by key); such a slot is not searched further. A slot
    marked with ``id_annotation``, on itself or in the class's ``slot_usage``,
    is a primary edge if asked for.
    """
    out: list[dict] = []

    def emit(value, cls: str, slot: str, path: tuple, kind: str):
        if value is None:
            return
        if isinstance(value, list):
            for i, x in enumerate(value):
                emit(x, cls, slot, (*path, str(i)), kind)
        elif isinstance(value, dict):
            for k, x in value.items():
                emit(x, cls, slot, (*path, k), kind)
        else:
            out.append({"uri": str(value), "object_type": cls, "object_type_uri": view.class_uri(cls), "slot_name": slot, "slot_path": list(path), "kind": kind})

    def walk(cls: str, node, path: tuple):
        if not isinstance(node, dict):
            return
        for slot in view.slots(view.actual_class(cls, node)):
            value = node.get(slot.name)
            here = (*path, slot.name)
            if value is None:
                continue
            if slot.inline_mode == "Reference":
                emit(value, slot.range, slot.name, here, "foreign")
            elif also_include_id_slots and truthy(slot.annotations.get(id_annotation)):
                emit(value, cls, slot.name, here, "primary")
            elif slot.inline_mode == "Inline":
                if slot.container_mode == "Mapping" and isinstance(value, dict):
                    for k, x in value.items():
                        walk(slot.range, x, (*here, k))
                elif isinstance(value, list):
                    for i, x in enumerate(value):
                        walk(slot.range, x, (*here, str(i)))
                else:
                    walk(slot.range, value, here)

    walk(class_name, instance, ())
    return out
