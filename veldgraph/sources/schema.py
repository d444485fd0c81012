"""LinkML schemas: loading, effective slots, look-ups and Spark types."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

import yaml
from pyspark.sql import types as T

from ..errors import ParseError

# Base types and their Spark types.
SPARK_TYPES = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "boolean": T.BooleanType(),
    "float": T.DoubleType(),
    "double": T.DoubleType(),
    "decimal": T.DecimalType(38, 10),
    "time": T.StringType(),
    "date": T.DateType(),
    "datetime": T.TimestampType(),
}


def truthy(value) -> bool:
    """An annotation's truth: true, 1, yes, y, on (any case), or a number other than 0."""
    if isinstance(value, dict):
        value = value.get("value")
    if isinstance(value, bool | int | float):
        return bool(value)
    return isinstance(value, str) and value.strip().lower() in ("true", "1", "yes", "y", "on")


@dataclass(frozen=True)
class Slot:
    name: str
    range: str = "string"
    identifier: bool = False
    key: bool = False
    designates_type: bool = False
    multivalued: bool = False
    required: bool = False
    inlined: bool | None = None
    inlined_as_list: bool = False
    uri: str = ""
    annotations: dict = field(default_factory=dict, hash=False, compare=False)
    container_mode: str = "SingleValue"
    inline_mode: str = "Primitive"


class SchemaView:
    """Several schemas seen as one. Names are looked up bare, as CURIEs or as URIs."""

    def __init__(self):
        self.schemas: dict[str, dict] = {}
        self.class_defs: dict[str, dict] = {}
        self.slot_defs: dict[str, dict] = {}
        self.enum_defs: dict[str, dict] = {}
        self.type_defs: dict[str, dict] = {}
        self.prefixes: dict[str, str] = {}
        self.home: dict[str, str] = {}

    # Loading
    def add_schema(self, text: str, path: str | None = None) -> str:
        try:
            d = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ParseError(str(e)) from e
        if not isinstance(d, dict) or "name" not in d and "id" not in d:
            raise ParseError("a schema needs a name or an id")
        name = d.get("name") or d["id"]
        self.schemas[name] = d | {"_path": path}
        for p, v in (d.get("prefixes") or {}).items():
            self.prefixes[p] = v if isinstance(v, str) else v["prefix_reference"]
        for kind, into in (("classes", self.class_defs), ("slots", self.slot_defs), ("enums", self.enum_defs), ("types", self.type_defs)):
            for k, v in (d.get(kind) or {}).items():
                into[k] = v or {}
                if kind == "classes":
                    self.home[k] = name
        return name

    def add_path(self, path: str) -> str:
        with open(path) as f:
            return self.add_schema(f.read(), path)

    def unresolved_imports(self) -> list[str]:
        known = {*self.schemas, *(s.get("id") for s in self.schemas.values())}
        wanted = {i for s in self.schemas.values() for i in s.get("imports") or []}
        return sorted(i for i in wanted if i not in known and i.rsplit("/", 1)[-1] not in known and i.rsplit(":", 1)[-1] not in known and i != "linkml:types")

    def resolve_imports(self, folder: str | None = None) -> None:
        """Load imports from local files until none is left; there is no network."""
        tried: set[str] = set()
        while todo := [i for i in self.unresolved_imports() if i not in tried]:
            for i in todo:
                tried.add(i)
                folders = {folder or ".", *(os.path.dirname(s["_path"]) for s in self.schemas.values() if s["_path"])}
                for f in sorted(folders):
                    for end in ("", ".yaml", ".yml"):
                        if os.path.isfile(p := os.path.join(f, i + end)):
                            self.add_path(p)
                            break
        if left := self.unresolved_imports():
            raise ParseError(f"imports that are not found: {', '.join(left)}")

    def snapshot(self) -> str:
        return yaml.safe_dump([{k: v for k, v in s.items() if k != "_path"} for s in self.schemas.values()], sort_keys=False)

    @classmethod
    def from_snapshot(cls, text: str) -> SchemaView:
        out = cls()
        for s in yaml.safe_load(text):
            out.add_schema(yaml.safe_dump(s, sort_keys=False))
        return out

    # Names
    def expand(self, curie: str) -> str:
        prefix, colon, local = curie.partition(":")
        return self.prefixes[prefix] + local if colon and prefix in self.prefixes and not local.startswith("//") else curie

    def _default(self, schema: str) -> str:
        p = self.schemas[schema].get("default_prefix") or self.schemas[schema].get("id", "") + "/"
        return self.prefixes.get(p, self.expand(p))

    def class_uri(self, name: str) -> str:
        d = self.class_defs[name]
        return self.expand(d["class_uri"]) if "class_uri" in d else self._default(self.home[name]) + name

    def find_class(self, name: str) -> str | None:
        """A class by name, CURIE or URI."""
        if name in self.class_defs:
            return name
        uri = self.expand(name)
        return next((c for c in self.class_defs if self.class_uri(c) == uri), None)

    def tree_root(self) -> str | None:
        return next((c for c, d in self.class_defs.items() if d.get("tree_root")), None)

    # Classes
    def parents(self, name: str) -> list[str]:
        d = self.class_defs.get(name, {})
        return ([d["is_a"]] if d.get("is_a") else []) + list(d.get("mixins") or [])

    def ancestors(self, name: str) -> list[str]:
        """The class and all above it, nearest first."""
        out, todo = [], [name]
        while todo:
            c = todo.pop(0)
            if c not in out and c in self.class_defs:
                out.append(c)
                todo += self.parents(c)
        return out

    def descendants(self, name: str) -> list[str]:
        return sorted(c for c in self.class_defs if c != name and name in self.ancestors(c))

    def common_ancestor(self, names: list[str]) -> str | None:
        """The most specific class above (or equal to) all of them."""
        shared = [c for c in self.ancestors(names[0]) if all(c in self.ancestors(n) for n in names)]
        return next((c for c in shared if not any(o != c and c in self.ancestors(o) for o in shared)), None)

    def slots(self, name: str) -> list[Slot]:
        """Effective slots: inherited first, refined by every slot_usage on the way down."""
        made: dict[str, dict] = {}
        for c in reversed(self.ancestors(name)):
            d = self.class_defs[c]
            for s in d.get("slots") or []:
                made.setdefault(s, dict(self.slot_defs.get(s) or {}))
            for s, a in (d.get("attributes") or {}).items():
                made[s] = made.get(s, {}) | (a or {})
            for s, u in (d.get("slot_usage") or {}).items():
                if s in made:
                    merged = made[s] | (u or {})
                    merged["annotations"] = (made[s].get("annotations") or {}) | ((u or {}).get("annotations") or {})
                    made[s] = merged
        default = next((s["default_range"] for s in self.schemas.values() if s.get("default_range")), "string")
        return [self._slot(s, d, default) for s, d in made.items()]

    def _slot(self, name: str, d: dict, default: str) -> Slot:
        s = Slot(name, d.get("range") or default, bool(d.get("identifier")), bool(d.get("key")), bool(d.get("designates_type")), bool(d.get("multivalued")), bool(d.get("required")), d.get("inlined"), bool(d.get("inlined_as_list")), self.expand(d.get("slot_uri") or ""), d.get("annotations") or {})
        inline, container = "Primitive", "List" if s.multivalued else "SingleValue"
        if s.range in self.class_defs:
            # a class without an identifier has nothing to refer by
            keyed = self._key(s.range)
            inline = "Inline" if s.inlined or s.inlined_as_list or keyed is None or keyed.key else "Reference"
            if s.multivalued and inline == "Inline" and keyed is not None and not s.inlined_as_list:
                container = "Mapping"
        return replace(s, inline_mode=inline, container_mode=container)

    def _key(self, name: str) -> Slot | None:
        for c in self.ancestors(name):
            d = self.class_defs[c]
            own = {s: self.slot_defs.get(s) or {} for s in d.get("slots") or []} | (d.get("attributes") or {})
            for s, a in own.items():
                a = (a or {}) | ((self.class_defs[name].get("slot_usage") or {}).get(s) or {})
                if a.get("identifier") or a.get("key"):
                    return Slot(s, identifier=bool(a.get("identifier")), key=bool(a.get("key")))
        return None

    def identifier(self, name: str) -> str | None:
        key = self._key(name)
        return key.name if key and key.identifier else None

    def type_designator(self, name: str) -> str | None:
        return next((s.name for s in self.slots(name) if s.designates_type), None)

    def actual_class(self, name: str, node: dict) -> str:
        """The class that an object's type designator names, if it is one below ``name``."""
        slot = self.type_designator(name)
        named = self.find_class(str(node[slot])) if slot and node.get(slot) else None
        return named if named and name in self.ancestors(named) else name

    def slots_for_path(self, name: str, path: list[str], follow_references: bool = True) -> list[Slot]:
        """The slots that a path ends in, over the class and its subclasses."""
        classes, found = [name], []
        for i, step in enumerate(path):
            found = [s for c in classes for k in [c, *self.descendants(c)] for s in self.slots(k) if s.name == step]
            found = list(dict.fromkeys(found))
            if i < len(path) - 1:
                classes = [s.range for s in found if s.range in self.class_defs and (follow_references or s.inline_mode != "Reference")]
        return found

    def permissible_values(self, enum: str) -> list[str]:
        """Sorted values, those of inherited enums too."""
        d = self.enum_defs[enum]
        own = set(d.get("permissible_values") or {})
        for parent in [d.get("is_a"), *(d.get("inherits") or [])]:
            if parent in self.enum_defs:
                own |= set(self.permissible_values(parent))
        return sorted(own)

    def enums_of(self, name: str) -> dict[str, list[str]]:
        """Permissible values by field, and by ``array.member`` one level down."""
        out = {}
        for s in self.slots(name):
            if s.range in self.enum_defs:
                out[s.name] = self.permissible_values(s.range)
            elif s.multivalued and s.inline_mode == "Inline":
                out |= {f"{s.name}.{m.name}": self.permissible_values(m.range) for m in self.slots(s.range) if m.range in self.enum_defs}
        return out

    def managed_classes(self, annotations: list[str], only_registered: bool = True, only_default: bool = True) -> dict[str, dict[str, str]]:
        """Schema -> {type designator value: class} of classes marked by one of the annotations (all, unless ``only_registered``).

        With ``only_default`` a class stands under its URI alone, else under its name too.
        """
        out: dict[str, dict[str, str]] = {}
        for c, d in self.class_defs.items():
            marks = d.get("annotations") or {}
            if only_registered and not any(truthy(marks.get(a)) for a in annotations):
                continue
            if self.type_designator(c) is None:
                continue
            into = out.setdefault(self.home[c], {})
            into[self.class_uri(c)] = c
            if not only_default:
                into[c] = c
        return out

    # Spark
    def spark_type(self, name: str, depth: int = 4) -> T.StructType:
        """A class as a struct. Inlined classes nest up to ``depth``; deeper (or recursive) ones are VARIANT."""
        return T.StructType([T.StructField(s.name, self._slot_type(s, depth), not s.required) for s in self.slots(name)])

    def _slot_type(self, s: Slot, depth: int) -> T.DataType:
        if s.inline_mode == "Inline":
            item = self.spark_type(s.range, depth - 1) if depth > 0 else T.VariantType()
        elif s.inline_mode == "Reference" or s.range in self.enum_defs:
            item = T.StringType()
        else:
            base = s.range
            while base not in SPARK_TYPES and base in self.type_defs and self.type_defs[base].get("typeof"):
                base = self.type_defs[base]["typeof"]
            item = T.VariantType() if base in ("anyType", "Any") else SPARK_TYPES.get(base, T.StringType())
        return T.MapType(T.StringType(), item) if s.container_mode == "Mapping" else T.ArrayType(item) if s.container_mode == "List" else item


def load_json(spark, path: str, view: SchemaView, class_name: str):
    """Objects of a class from JSON lines; what does not fit goes to ``_corrupt_record``."""
    schema = view.spark_type(class_name).add("_corrupt_record", T.StringType())
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def load_yaml(spark, text: str, view: SchemaView, class_name: str):
    """Objects of a class from a YAML document (an object or a list of them); what does not fit goes to ``_corrupt_record``."""
    import json

    data = yaml.safe_load(text)
    rows = [(json.dumps(x, default=str),) for x in (data if isinstance(data, list) else [data])]
    from pyspark.sql import functions as F

    schema = view.spark_type(class_name).add("_corrupt_record", T.StringType())
    return spark.createDataFrame(rows, "j string").select(F.from_json("j", schema, {"mode": "PERMISSIVE"}).alias("v")).select("v.*")
