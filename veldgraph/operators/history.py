"""Object history: diff, patch, running values and who last wrote each node.

A node is named by its path (list indices as text). JSON objects fold in Python,
one object at a time; flat objects need no Python: windows and a full outer join
give the same deltas over whole tables.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import VeldgraphError

Path = tuple[str, ...]


class Delta(NamedTuple):
    path: Path
    op: str  # add, remove, update
    old: object = None
    new: object = None


@dataclass
class Trace:
    added: list[Path] = field(default_factory=list)
    deleted: list[Path] = field(default_factory=list)
    updated: list[Path] = field(default_factory=list)
    failed: list[Path] = field(default_factory=list)


@dataclass
class Stage:
    meta: dict
    value: object
    deltas: list[Delta] = field(default_factory=list)
    rejected_paths: list[Path] = field(default_factory=list)
    class_id: str = ""

    def to_json(self) -> str:
        return json.dumps({"class_id": self.class_id, "meta": self.meta, "value": self.value, "deltas": [{"path": list(d.path), "op": d.op, "old": d.old, "new": d.new} for d in self.deltas], "rejected_paths": [list(p) for p in self.rejected_paths]})

    @classmethod
    def from_json(cls, text: str) -> Stage:
        d = json.loads(text)
        return cls(d["meta"], d["value"], [Delta(tuple(x["path"]), x["op"], x.get("old"), x.get("new")) for x in d.get("deltas", [])], [tuple(p) for p in d.get("rejected_paths", [])], d.get("class_id", ""))


_SCALARS = frozenset((str, int, bool, float, type(None)))


def _copied(value):
    """A copy of a JSON value."""
    kind = type(value)
    if kind in _SCALARS:
        return value
    if kind is dict:
        return {k: x if type(x) in _SCALARS else _copied(x) for k, x in value.items()}
    return [x if type(x) in _SCALARS else _copied(x) for x in value] if kind is list else copy.deepcopy(value)


def _alike(a, b, nulls: bool = False) -> bool:
    """Whether two values surely have one JSON text with sorted keys; with ``nulls`` a key that is null is as one that is absent."""
    kind = type(a)
    if kind is not type(b):
        return False
    if kind is dict:
        held = 0
        for k, x in a.items():
            if nulls and x is None:
                continue
            if k not in b or not _alike(x, b[k], nulls):
                return False
            held += 1
        return held == (sum(x is not None for x in b.values()) if nulls else len(b))
    if kind is list:
        return len(a) == len(b) and all(_alike(x, y, nulls) for x, y in zip(a, b))
    return kind in _SCALARS and (a == b if kind is not float else repr(a) == repr(b))


def _same(a, b) -> bool:
    return type(a) is type(b) and a == b if not isinstance(a, dict | list) else json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def diff(source, target, treat_missing_as_null: bool = False, treat_changed_identifier_as_new_object: bool = True, identifiers: Iterable[str] = (), mappings: Iterable[str] = ()) -> list[Delta]:
    """Deltas from ``source`` to ``target``.

    A slot that ``target`` lacks is unchanged, or with ``treat_missing_as_null``
    becomes null (a key of one of the ``mappings`` slots is removed). Lists are
    always whole: a shorter one loses its tail. An inlined object whose
    identifier changes is replaced as one. Lists whose members all have an
    identifier of their own align by it: what is gone is removed (from the end),
    what is new is inserted at its place, and what both have is compared under
    its place in ``target``; if members changed their order the list is replaced
    as one.
    """
    ids, maps = frozenset(identifiers), frozenset(mappings)
    out: list[Delta] = []

    def identity(x):
        if isinstance(x, dict):
            for i in ids:
                if i in x:
                    return x[i]
        return None

    def keyed(names) -> bool:
        return all(isinstance(x, str | int) for x in names) and len(set(names)) == len(names)

    def walk(a, b, path: Path):
        if isinstance(a, dict) and isinstance(b, dict):
            if path and treat_changed_identifier_as_new_object and identity(a) is not None and identity(b) is not None and identity(a) != identity(b):
                out.append(Delta(path, "update", a, b))
                return
            for k in a:
                if k in b:
                    x, y = a[k], b[k]
                    if type(x) is not type(y) or type(x) not in _SCALARS or x != y:
                        walk(x, y, (*path, k))
                elif treat_missing_as_null:
                    if path and path[-1] in maps:
                        out.append(Delta((*path, k), "remove", a[k], None))
                    elif a[k] is not None:
                        out.append(Delta((*path, k), "update", a[k], None))
            for k in b:
                if k not in a:
                    out.append(Delta((*path, k), "add", None, b[k]))
        elif isinstance(a, list) and isinstance(b, list):
            mine, theirs = [identity(x) for x in a], [identity(x) for x in b]
            if a and b and keyed(mine) and keyed(theirs):
                places, held = {x: i for i, x in enumerate(mine)}, set(theirs)
                stay = [x for x in mine if x in held]
                if stay != [x for x in theirs if x in places]:
                    out.append(Delta(path, "update", a, b))
                    return
                for i in range(len(a) - 1, -1, -1):
                    if mine[i] not in held:
                        out.append(Delta((*path, str(i)), "remove", a[i], None))
                for i, x in enumerate(theirs):
                    if x not in places:
                        out.append(Delta((*path, str(i)), "add", None, b[i]))
                for i, x in enumerate(theirs):
                    if x in places:
                        walk(a[places[x]], b[i], (*path, str(i)))
                return
            for i, (x, y) in enumerate(zip(a, b)):
                walk(x, y, (*path, str(i)))
            for i in range(len(a), len(b)):
                out.append(Delta((*path, str(i)), "add", None, b[i]))
            for i in range(len(a) - 1, len(b) - 1, -1):
                out.append(Delta((*path, str(i)), "remove", a[i], None))
        elif not _same(a, b):
            out.append(Delta(path, "update", a, b))

    walk(source, target, ())
    return out


def subtree(value, path: Path) -> list[Path]:
    """A node's path and those of all below it, in tree order."""
    out = [path]
    children = value.items() if isinstance(value, dict) else ((str(i), x) for i, x in enumerate(value)) if isinstance(value, list) else ()
    for k, x in children:
        out += subtree(x, (*path, k))
    return out


_MISSING = object()


def navigate(value, path: Path, default=_MISSING):
    for step in path:
        if isinstance(value, dict) and step in value:
            value = value[step]
        elif isinstance(value, list) and step.isdigit() and int(step) < len(value):
            value = value[int(step)]
        elif default is _MISSING:
            raise KeyError(step)
        else:
            return default
    return value


def patch(source, deltas: Iterable[Delta], ignore_no_ops: bool = True, treat_missing_as_null: bool = False) -> tuple[object, Trace]:
    """Apply deltas to a copy; a path that can't be reached is reported as failed.

    With ``treat_missing_as_null`` a slot that is absent counts as null: an
    update of it writes it, and one to null leaves it absent.
    """
    trace = Trace()
    return _applied(_copied(source), deltas, trace, ignore_no_ops, treat_missing_as_null), trace


def _applied(value, deltas: Iterable[Delta], trace: Trace, ignore_no_ops: bool = True, treat_missing_as_null: bool = False):
    """``value`` itself, changed."""
    for d in deltas:
        if not d.path:
            value = _copied(d.new)
            trace.updated.append(())
            continue
        parent, key = navigate(value, d.path[:-1], None), d.path[-1]
        exists = isinstance(parent, dict) and key in parent
        if d.op == "remove":
            if exists:
                trace.deleted += subtree(parent.pop(key), d.path)
            elif isinstance(parent, list) and key.isdigit() and int(key) < len(parent):
                trace.deleted += subtree(parent.pop(int(key)), d.path)
            elif treat_missing_as_null and isinstance(parent, dict):
                continue
            else:
                trace.failed.append(d.path)
                continue
            trace.updated.append(d.path[:-1])
            continue
        new = _copied(d.new)
        if isinstance(parent, dict):
            if d.op == "update" and not exists and not treat_missing_as_null:
                trace.failed.append(d.path)
                continue
            if treat_missing_as_null and not exists and new is None or exists and ignore_no_ops and _same(parent[key], new):
                continue
            parent[key] = new
        elif isinstance(parent, list) and key.isdigit() and int(key) <= len(parent) - (d.op == "update"):
            exists = d.op == "update"
            if exists:
                if ignore_no_ops and _same(parent[int(key)], new):
                    continue
                parent[int(key)] = new
            else:
                parent.insert(int(key), new)
        else:
            trace.failed.append(d.path)
            continue
        if exists and not isinstance(new, dict | list):
            trace.updated.append(d.path)
        else:
            trace.added += subtree(new, d.path)
            if not exists:
                trace.updated.append(d.path[:-1])
    return value


def compute_history(stages: list[Stage]) -> tuple[object, list[Stage]]:
    """The final value, and the stages with the deltas that took effect.

    Each stage is compared with the running value; deltas at exactly a rejected
    path are dropped.
    """
    if not stages:
        raise VeldgraphError("history needs a stage at least")
    if len({s.class_id for s in stages}) > 1:
        raise VeldgraphError("all stages must be of one class")
    value, out = copy.deepcopy(stages[0].value), [stages[0]]
    for s in stages[1:]:
        rejected = set(map(tuple, s.rejected_paths))
        deltas = [d for d in diff(value, s.value, False, False) if d.path not in rejected]
        trace = Trace()
        # old values are kept as they were: the running value changes in place
        deltas = [Delta(d.path, d.op, copy.deepcopy(d.old) if isinstance(d.old, dict | list) else d.old, d.new) for d in deltas]
        value = _applied(value, deltas, trace)
        if trace.failed:
            raise VeldgraphError(f"paths that can't be patched: {trace.failed}")
        out.append(Stage(s.meta, s.value, deltas, s.rejected_paths, s.class_id))
    return value, out


def diff_json(base: str, current: str, treat_missing_as_null: bool = False, view=None, class_name: str | None = None) -> str:
    """Deltas between two JSON objects as a JSON list of {path, op, old, new}.

    With a schema view and a class, the identifier and key slots of the class
    and of all classes it reaches align inlined objects.
    """
    ids: set[str] = set()
    if view is not None and class_name is not None:
        todo, seen = [class_name], set()
        while todo:
            name = todo.pop()
            if name in seen:
                continue
            seen.add(name)
            for slot in view.slots(name):
                if slot.identifier or slot.key:
                    ids.add(slot.name)
                if slot.inline_mode == "Inline":
                    todo.append(slot.range)
    found = diff(json.loads(base), json.loads(current), treat_missing_as_null, identifiers=ids)
    return json.dumps([{"path": list(d.path), "op": d.op, "old": d.old, "new": d.new} for d in found], ensure_ascii=False)


def _shifted(blame: dict[Path, dict], path: Path, by: int) -> dict[Path, dict]:
    """Blame after a list member at ``path`` was inserted (by 1) or removed (by -1): the members behind it move."""
    at, i = len(path) - 1, int(path[-1])
    out = {}
    for p, m in blame.items():
        if p[:at] == path[:-1] and len(p) > at and p[at].isdigit() and int(p[at]) >= i + (by < 0):
            p = (*p[:at], str(int(p[at]) + by), *p[at + 1 :])
        out[p] = m
    return out


def apply_deltas(base, stages: list[Stage]) -> tuple[object, dict[Path, dict]]:
    """The value after all stages' deltas, and the meta of each node's last writer."""
    value, blame = copy.deepcopy(base), {}
    for s in stages:
        failed = []
        for d in s.deltas:
            trace = Trace()
            in_list = bool(d.path) and isinstance(navigate(value, d.path[:-1], None), list)
            value = _applied(value, [d], trace)
            failed += trace.failed
            for p in trace.deleted:
                blame.pop(p, None)
            if in_list and not trace.failed and d.op in ("add", "remove"):
                blame = _shifted(blame, d.path, 1 if d.op == "add" else -1)
            for p in [*trace.added, *trace.updated]:
                blame[p] = s.meta
        if failed:
            raise VeldgraphError(f"paths that can't be patched: {failed}")
    return value, blame


def blame_info(path: Path, blame: dict[Path, dict]) -> dict | None:
    """Who last wrote a node; None for one that no stage wrote."""
    return blame.get(tuple(path))


def blame_paths(value, blame: dict[Path, dict]) -> list[tuple[Path, dict]]:
    """The blame of a value's nodes in tree order."""
    return [(p, blame[p]) for p in subtree(value, ()) if p in blame]


def format_blame(value, blame: dict[Path, dict]) -> str:
    """A line for each node: who wrote it (72 characters), then the tree."""
    lines = []
    for p in subtree(value, ()):
        m = blame.get(p)
        head = "" if m is None else f"cid={m.get('change_id', 0):3d} author={m.get('author', '')} ts={m.get('timestamp', '')} src={m.get('source', '')} ics={m.get('ics_id', '')}"
        node = navigate(value, p)
        shown = "" if isinstance(node, dict | list) else f" {json.dumps(node, ensure_ascii=False)}"
        lines.append(f"{head[:72]:<72} {'  ' * len(p)}{p[-1] + ':' if p else '.'}{shown}")
    return "\n".join(lines)


def equals(a, b, treat_missing_as_null: bool = False) -> bool:
    if _alike(a, b, treat_missing_as_null):
        return True
    if treat_missing_as_null:

        def strip(x):
            return {k: strip(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [strip(v) for v in x] if isinstance(x, list) else x

        a, b = strip(a), strip(b)
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


# Whole tables
_DELTAS = "object {type}, seq long, path array<string>, op string, old string, new string"


def fold_history(stages: DataFrame, object_type: str = "long") -> DataFrame:
    """Deltas of every object from (object, seq, value JSON, rejected array<array<string>>), stages in order of seq.

    The fold is sequential by nature (each diff is against the running value):
    objects spread over tasks, and a task goes through its objects' stages as
    they come, sorted, and holds one running value.
    """

    def fold(frames):
        current, running = _MISSING, None
        for pdf in frames:
            rows = []
            for o, s, v, r in zip(pdf["object"], pdf["seq"], pdf["value"], pdf["rejected"]):
                stage = json.loads(v)
                if current is _MISSING or o != current:
                    current, running = o, stage
                    continue
                dropped = {tuple(p) for p in r} if r is not None and len(r) else ()
                deltas = [d for d in diff(running, stage, False, False) if d.path not in dropped]
                rows += [(o, s, list(d.path), d.op, json.dumps(d.old), json.dumps(d.new)) for d in deltas]
                trace = Trace()
                running = _applied(running, deltas, trace)
                if trace.failed:
                    raise VeldgraphError(f"paths that can't be patched: {trace.failed}")
            yield pd.DataFrame(rows, columns=["object", "seq", "path", "op", "old", "new"])

    ordered = stages.select("object", "seq", "value", "rejected").where("object is not null").repartition("object").sortWithinPartitions("object", "seq")
    return ordered.mapInPandas(fold, _DELTAS.format(type=object_type))


def flat_history(stages: DataFrame, fields: list[str], rejected: str | None = None) -> DataFrame:
    """The same deltas for flat objects (object, seq, one column a field), by windows.

    NULL is a missing slot and leaves the running value; ``rejected`` names an
    array column of fields that a stage may not write. The running value is the
    last one present before a stage.
    """
    w = Window.partitionBy("object").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("object").orderBy("seq")) == 1
    cells = []
    for f in fields:
        taken = F.col(f)
        if rejected:
            taken = F.when(first | ~F.coalesce(F.array_contains(rejected, f), F.lit(False)), F.col(f))
        cells.append(F.struct(F.lit(f).alias("field"), F.last(taken, True).over(w).cast("string").alias("old"), taken.cast("string").alias("new"), first.alias("first")).alias(f))
    # windows first, then the fields as rows: one sort for all fields
    wide = stages.select("object", "seq", *cells)
    long = wide.select("object", "seq", F.explode(F.array(*fields)).alias("c")).select("object", "seq", "c.*")
    return long.where("not first and new is not null and not (old <=> new)").select("object", "seq", F.col("field").alias("path"), F.when(F.col("old").isNull(), "add").otherwise("update").alias("op"), "old", "new")


def latest_writer(deltas: DataFrame, meta: Column) -> DataFrame:
    """(object, path, meta of the last writer): last writer wins, by one aggregation."""
    return deltas.groupBy("object", "path").agg(F.max_by(meta, F.col("seq")).alias("writer"))


def diff_tables(source: DataFrame, target: DataFrame, key: str, fields: list[str], treat_missing_as_null: bool = False) -> DataFrame:
    """Deltas between two tables of flat objects with one ``key``: a full outer join, then a row for each changed field."""
    a = source.select(F.col(key).alias("object"), *[F.col(f).cast("string").alias(f"a_{f}") for f in fields], F.lit(True).alias("in_a"))
    b = target.select(F.col(key).alias("object"), *[F.col(f).cast("string").alias(f"b_{f}") for f in fields], F.lit(True).alias("in_b"))
    cells = F.array(*[F.struct(F.lit(f).alias("path"), F.col(f"a_{f}").alias("old"), F.col(f"b_{f}").alias("new")) for f in fields])
    joined = a.join(b, "object", "full_outer").select("object", "in_a", "in_b", F.explode(cells).alias("c")).select("object", "in_a", "in_b", "c.*")
    op = (
        F.when(F.col("new").isNotNull() & F.col("old").isNull(), "add")
        .when(F.col("new").isNotNull() & (F.col("old") != F.col("new")), "update")
        .when(F.col("new").isNull() & F.col("old").isNotNull() & F.lit(treat_missing_as_null), F.when(F.col("in_b").isNull(), "remove").otherwise("update"))
    )
    return joined.select("object", "path", op.alias("op"), "old", "new").where("op is not null")


def diff_rows(df: DataFrame, key: str, base: str = "base", current: str = "current", treat_missing_as_null: bool = False, identifiers: Iterable[str] = ()) -> DataFrame:
    """Deltas of JSON objects, row by row: key, path, op, old, new (JSON). A NULL on either side is JSON null."""
    ids = tuple(identifiers)

    def run(frames):
        for pdf in frames:
            rows = []
            for k, a, b in zip(pdf[key], pdf[base], pdf[current]):
                for d in diff(json.loads(a or "null"), json.loads(b or "null"), treat_missing_as_null, identifiers=ids):
                    rows.append((k, list(d.path), d.op, json.dumps(d.old), json.dumps(d.new)))
            yield pd.DataFrame(rows, columns=[key, "path", "op", "old", "new"])

    return df.select(key, base, current).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, path array<string>, op string, old string, new string")


def patched_rows(df: DataFrame, key: str, base: str = "base", current: str = "current", identifiers: Iterable[str] = ()) -> DataFrame:
    """(key, value, same): each base patched by its deltas to current, and whether that gives current."""
    ids = tuple(identifiers)

    def run(frames):
        for pdf in frames:
            rows = []
            for k, a, b in zip(pdf[key], pdf[base], pdf[current]):
                a, b = json.loads(a or "null"), json.loads(b or "null")
                # the parsed base is this row's own: it changes in place
                trace = Trace()
                value = _applied(a, diff(a, b, True, identifiers=ids), trace)
                rows.append((k, json.dumps(value), not trace.failed and equals(value, b, True)))
            yield pd.DataFrame(rows, columns=[key, "value", "same"])

    return df.select(key, base, current).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, value string, same boolean")
