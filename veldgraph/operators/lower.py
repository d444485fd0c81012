"""Graph queries to lazy DataFrames.

Every algebra node becomes a frame: a DataFrame with a column for each variable
it may bind, and what is known of each variable (reference or literal, maybe
unbound). Stars become one pruned scan of a class table; joins stay equi-joins
wherever both sides are surely bound. Catalyst plans the rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ResultLimitExceeded, TripleLimitExceeded, Unscoped, UnsupportedConstruct
from ..functions.expressions import Compiler, Typed, kind_of, literal
from ..plans import algebra as A
from ..plans.parser import parse
from ..shared import shared_dir
from ..sources.catalog import Catalog, ClassTable
from ..sources.objects import term_struct
from .spread import spread_join


@dataclass(frozen=True)
class Info:
    #: iri: the column is a key (or, without prefix, a whole IRI).
    kind: str = "lit"
    prefix: str | None = None
    maybe: bool = False
    lang: str = ""
    #: xsd type of a literal, where the column's type does not tell it.
    datatype: str = ""


@dataclass
class Frame:
    df: DataFrame
    info: dict[str, Info] = field(default_factory=dict)
    catalog: Catalog | None = None
    #: Variables of which no value comes twice.
    unique: frozenset[str] = frozenset()
    #: Made by a join that was spread: not to be counted again.
    wide: bool = False

    def typed(self, name: str) -> Typed:
        if name not in self.info:
            return Typed(F.lit(None).cast("string"), "str")
        known = self.info[name]
        if known.kind == "iri":
            return Typed(F.col(name), "iri", known.prefix)
        kind, datatype = kind_of(self.df.schema[name].dataType)
        return Typed(F.col(name), kind, datatype=known.datatype or datatype, lang=known.lang)


def _and(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions) if conditions else F.lit(True)


def _vars_of(e) -> set[str]:
    match e:
        case A.Var():
            return {e.name}
        case A.Call() | A.Aggregate():
            return set().union(*[_vars_of(a) for a in (e.args if isinstance(e, A.Call) else [e.arg])])
    return set()


def _cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, kept in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _conjuncts(e) -> list:
    return [x for a in e.args for x in _conjuncts(a)] if isinstance(e, A.Call) and e.name == "&&" else [e]


def _plain(e) -> bool:
    """Whether an expression reads nothing but variables: no EXISTS, and the same value each time."""
    return not isinstance(e, A.Exists | A.Aggregate) and (not isinstance(e, A.Call) or e.name.lower() not in ("rand", "uuid", "struuid", "bnode") and all(map(_plain, e.args)))


class Lowering:
    def __init__(self, catalog: Catalog, spark):
        self.catalog, self.spark, self.fresh = catalog, spark, 0
        #: Class tables that were scanned.
        self.read: dict[str, ClassTable] = {}

    def name(self) -> str:
        self.fresh += 1
        return f"_t{self.fresh}"

    def unit(self) -> Frame:
        return Frame(self.spark.range(1).select(), {}, self.catalog)

    def empty(self, names) -> Frame:
        df = self.spark.range(0).select(*[F.lit(None).cast("string").alias(n) for n in names])
        return Frame(df, {n: Info() for n in names}, self.catalog)

    # Nodes
    def lower(self, node) -> Frame:
        match node:
            case A.Bgp():
                return self.bgp(node.triples, [])
            case A.Join():
                return self.join(self.lower(node.left), self.lower(node.right))
            case A.LeftJoin():
                return self.optional(node)
            case A.Filter():
                return self.filter(node)
            case A.Extend():
                return self.extend(self.lower(node.node), node.var.name, node.expression)
            case A.Union():
                return self.union(self.lower(node.left), self.lower(node.right))
            case A.Minus():
                return self.minus(self.lower(node.left), self.lower(node.right))
            case A.Values():
                return self.values(node)
            case A.Group():
                return self.group(node)
            case A.Project():
                f = self.lower(node.node)
                names = list(dict.fromkeys(v.name for v in node.variables))
                df = f.df.select(*[F.col(n) if n in f.info else F.lit(None).cast("string").alias(n) for n in names])
                return replace(f, df=df, info={n: f.info.get(n, Info(maybe=True)) for n in names}, unique=f.unique & set(names))
            case A.Distinct():
                f = self.lower(node.node)
                return replace(f, df=f.df.distinct())
            case A.Reduced():
                return self.lower(node.node)
            case A.Slice():
                f = self.lower(node.node)
                df = f.df.offset(node.offset) if node.offset else f.df
                return replace(f, df=df if node.limit is None else df.limit(node.limit))
            case A.OrderBy():
                f = self.lower(node.node)
                keys = []
                for e, up in node.keys:
                    column = Compiler(f).typed(e).column
                    keys.append(column.asc_nulls_first() if up else column.desc_nulls_last())
                return replace(f, df=f.df.orderBy(*keys))
        raise UnsupportedConstruct(type(node).__name__)

    def extend(self, f: Frame, name: str, e) -> Frame:
        if name in f.info:
            raise UnsupportedConstruct(f"?{name} is bound already")
        x = Compiler(f).typed(e)
        info = Info("iri", x.prefix, True) if x.kind == "iri" else Info(maybe=True, lang=x.lang, datatype=x.datatype if x.lang or x.datatype.endswith("Duration") else "")
        return replace(f, df=f.df.withColumn(name, x.column), info={**f.info, name: info})

    # Nodes of which only some variables are asked for, each solution once or more
    def lower_set(self, node, keep: set[str]) -> Frame:
        """Like ``lower``, but only the set of the solutions' ``keep`` values counts.

        So a star that is there to exist needs no join with each of its objects.
        """
        match node:
            case A.Project() if keep <= {v.name for v in node.variables}:
                return self.lower_set(node.node, keep)
            case A.Distinct() | A.Reduced():
                return self.lower_set(node.node, keep)
            case A.Extend() if isinstance(node.expression, A.Iri | A.Literal | A.Var) and node.var.name not in _vars_of(node.expression):
                return self.extend(self.lower_set(node.node, keep | {node.var.name} | _vars_of(node.expression)), node.var.name, node.expression)
            case A.Filter(condition, A.Extend() as bind) if bind.var.name not in _vars_of(condition) and all(_plain(c) for c in _conjuncts(condition)):
                return self.lower_set(replace(bind, node=A.Filter(condition, bind.node)), keep)
            case A.Filter(condition, A.Filter() as inner):
                return self.lower_set(A.Filter(A.Call("&&", (condition, inner.condition)), inner.node), keep)
            case A.Filter(condition, A.Bgp() as bgp) if all(_plain(c) for c in _conjuncts(condition)):
                return self._existing(bgp, _conjuncts(condition), keep)
            case A.Bgp():
                return self._existing(node, [], keep)
        return self.lower(node)

    def _existing(self, node: A.Bgp, conditions: list, keep: set[str]) -> Frame:
        """A filtered basic pattern; stars with nothing of ``keep`` but what they share become one row a shared value.

        Of a star's own variable that must differ from another (``?x != ?y``) the
        least and the greatest value suffice: if any differs, one of them does.
        """
        if not node.triples:
            return self.lower(A.Filter(reduce(lambda a, b: A.Call("&&", (a, b)), conditions), node) if conditions else node)
        frames, left = self.stars(node.triples, []), list(conditions)
        for i, f in enumerate(frames):
            others = set().union(*[g.info for j, g in enumerate(frames) if j != i])
            shared = [n for n in f.info if n in others]
            own = [n for n in f.info if n not in others]
            told = [c for c in left if _vars_of(c) & set(own)]
            if not shared or keep & set(own) or any(f.info[n].maybe for n in shared) or f.unique & set(shared):
                continue
            apart = [c for c in told if isinstance(c, A.Call) and c.name == "!=" and all(isinstance(a, A.Var) for a in c.args) and len(_vars_of(c) & set(own)) == 1]
            x = next(iter(_vars_of(apart[0]) & set(own))) if apart else None
            if len(told) != len(apart) or len(apart) > 1 or apart and (f.info[x].kind != "iri" or f.info[x].maybe or not _vars_of(apart[0]) - {x} <= others):
                continue
            info = {n: f.info[n] for n in shared}
            if apart:
                least, most = self.name(), self.name()
                df = f.df.groupBy(*shared).agg(F.min(x).alias(least), F.max(x).alias(most))
                info |= {least: f.info[x], most: f.info[x]}
                y = next(a for a in apart[0].args if a.name != x)
                left[left.index(apart[0])] = A.Call("||", tuple(A.Call("!=", (A.Var(n), y)) for n in (least, most)))
            else:
                df = f.df.select(*shared).distinct()
            frames[i] = Frame(df, info, self.catalog, frozenset(shared if len(shared) == 1 else ()))
        done = self.joined(frames)
        for c in left:
            done = self._marked(done, c)
        return done

    # Joins
    def _aligned(self, left: Frame, right: Frame, shared: list[str]) -> tuple[Frame, Frame]:
        """Both sides with shared variables in one representation each."""
        ldf, rdf, linfo, rinfo = left.df, right.df, dict(left.info), dict(right.info)
        for n in shared:
            a, b = left.info[n], right.info[n]
            if (a.kind, a.prefix) == (b.kind, b.prefix):
                ta, tb = left.df.schema[n].dataType, right.df.schema[n].dataType
                if ta == tb:
                    continue
                ka, kb = kind_of(ta)[0], kind_of(tb)[0]
                if ka == kb == "num":
                    continue  # Spark widens numbers
            # keys of different classes, or a key against a literal: compare the terms' text
            x, y = Compiler(left), Compiler(right)
            ldf = ldf.withColumn(n, x.text(left.typed(n)))
            rdf = rdf.withColumn(n, y.text(right.typed(n)))
            kind = "iri" if "iri" in (a.kind, b.kind) else "lit"
            linfo[n], rinfo[n] = replace(a, kind=kind, prefix=None), replace(b, kind=kind, prefix=None)
        return replace(left, df=ldf, info=linfo), replace(right, df=rdf, info=rinfo)

    def join(self, left: Frame, right: Frame, how: str = "inner", conditions: list | None = None) -> Frame:
        """Join on compatible bindings; ``conditions`` are expressions over both sides."""
        shared = [n for n in left.info if n in right.info]
        left, right = self._aligned(left, right, shared)
        loose = [n for n in shared if left.info[n].maybe or right.info[n].maybe]
        outer = how == "left"
        own = {n: replace(i, maybe=i.maybe or outer) for n, i in right.info.items() if n not in shared}
        info = {n: replace(i, maybe=i.maybe and (outer or right.info[n].maybe)) if n in shared else i for n, i in left.info.items()} | own
        if not loose and not conditions:
            once, once_left = right.unique & set(shared), left.unique & set(shared)
            # a row meets one other at most, or there may be many pairs
            unique = (left.unique if once else frozenset()) | (right.unique if once_left and not outer else frozenset())
            wide = left.wide or right.wide
            if how == "inner" and not (once or once_left or wide):
                df, wide = spread_join(left.df, right.df, shared)
            else:
                df = left.df.join(right.df, shared, how) if shared else left.df.crossJoin(right.df) if not outer else left.df.join(right.df, F.lit(True), "left")
            return Frame(df.select(*info), info, self.catalog, unique, wide)
        if not conditions and (split := self._split(left, right, loose, how)):
            return split
        renamed = {n: self.name() for n in shared}
        rdf = right.df.select(*[F.col(n).alias(renamed.get(n, n)) for n in right.info])
        on = []
        for n in shared:
            same = F.col(n) == F.col(renamed[n])
            if left.info[n].maybe:
                same = same | F.col(n).isNull()
            if right.info[n].maybe:
                same = same | F.col(renamed[n]).isNull()
            on.append(same)
        if conditions:
            # visible in the condition: the left's value where it is bound
            types = {**{n: left.df.schema[n] for n in left.info}, **{n: right.df.schema[n] for n in own}}
            probe = Frame(self.spark.createDataFrame([], T.StructType(list(types.values()))), {**left.info, **own}, self.catalog)
            on += [Compiler(probe).boolean(c) for c in conditions]
        df = left.df.join(rdf, _and(on), how)
        out = [F.coalesce(F.col(n), F.col(renamed[n])).alias(n) if n in loose and left.info[n].maybe else F.col(n) for n in info]
        return Frame(df.select(*out), info, self.catalog)

    def _split(self, left: Frame, right: Frame, loose: list[str], how: str) -> Frame | None:
        """A join on one or two maybe-unbound variables as a union of equi-joins: rows that bind the first, and rows that do not.

        An outer join can be split by its left side only.
        """
        n = next((n for n in loose if left.info[n].maybe or how == "inner"), None)
        if n is None or len(loose) > 2:
            return None
        mine = left.info[n].maybe
        side = left if mine else right
        bound = replace(side, df=side.df.where(F.col(n).isNotNull()), info={**side.info, n: replace(side.info[n], maybe=False)})
        unbound = replace(side, df=side.df.where(F.col(n).isNull()).drop(n), info={k: i for k, i in side.info.items() if k != n}, unique=side.unique - {n})
        parts = [self.join(x, right, how) if mine else self.join(left, x, how) for x in (bound, unbound)]
        return self.union(*parts)

    def optional(self, node: A.LeftJoin) -> Frame:
        single = self._slot_chain(node)
        if single:
            return self.bgp(*single)
        left, right = self.lower(node.left), node.right
        return self.join(left, self.lower(right), "left", _conjuncts(node.condition) if node.condition is not None else None)

    def _slot_chain(self, node):
        """Optionals that only read one single-valued slot of a star's subject need no join."""
        extra: list[A.Triple] = []
        while isinstance(node, A.LeftJoin):
            if node.condition is not None or not isinstance(node.right, A.Bgp) or len(node.right.triples) != 1:
                return None
            t = node.right.triples[0]
            slot = self.catalog.predicates.get(getattr(t.p, "value", None))
            if not isinstance(t.s, A.Var) or not isinstance(t.o, A.Var) or slot is None:
                return None
            if any(slot in c.slots and c.slots[slot].many for c in self.catalog.classes.values()):
                return None
            extra.insert(0, t)
            node = node.left
        if not isinstance(node, A.Bgp):
            return None
        bound = {x.name for t in node.triples for x in (t.s, t.o) if isinstance(x, A.Var)}
        subjects = {t.s.name for t in node.triples if isinstance(t.s, A.Var) and isinstance(t.p, A.Iri)}
        objects = [t.o.name for t in extra]
        if not all(t.s.name in subjects for t in extra) or bound & set(objects) or len(set(objects)) < len(objects):
            return None
        return node.triples, extra

    def union(self, left: Frame, right: Frame) -> Frame:
        names = list(dict.fromkeys([*left.info, *right.info]))
        shared = [n for n in left.info if n in right.info]
        left, right = self._aligned(left, right, shared)
        info = {}
        for n in names:
            own = left.info.get(n) or right.info[n]
            info[n] = replace(own, maybe=n not in left.info or n not in right.info or left.info[n].maybe or right.info[n].maybe)
        return Frame(left.df.unionByName(right.df, allowMissingColumns=True).select(*names), info, self.catalog, wide=left.wide or right.wide)

    def minus(self, left: Frame, right: Frame) -> Frame:
        shared = [n for n in left.info if n in right.info]
        if not shared:
            return left
        return self._semi(left, right, [], "left_anti", minus=True)

    def _semi(self, left: Frame, right: Frame, conditions: list, how: str, minus: bool = False) -> Frame:
        shared = [n for n in left.info if n in right.info]
        left, right = self._aligned(left, right, shared)
        if not conditions and not any(left.info[n].maybe or right.info[n].maybe for n in shared) and shared:
            return replace(left, df=left.df.join(right.df.select(*shared), shared, how))
        loose = [n for n in shared if left.info[n].maybe]
        if not conditions and len(loose) == 1 and not right.info[loose[0]].maybe:
            # rows that bind the variable and rows that do not: equi-joins each
            n = loose[0]
            bound = Frame(left.df.where(F.col(n).isNotNull()), {**left.info, n: replace(left.info[n], maybe=False)}, self.catalog)
            unbound = Frame(left.df.where(F.col(n).isNull()), {k: i for k, i in left.info.items() if k != n}, self.catalog)
            rest = [k for k in shared if k != n]
            if minus and not rest:
                done = unbound.df
            else:
                done = self._semi(unbound, Frame(right.df.select(*[k for k in right.info if k != n]).distinct(), {k: i for k, i in right.info.items() if k != n}, self.catalog), [], how, minus).df
            return replace(left, df=self._semi(bound, right, [], how, minus).df.select(*left.info).unionByName(done.select(*left.info)))
        renamed = {n: self.name() for n in shared}
        rdf = right.df.select(*[F.col(n).alias(renamed.get(n, n)) for n in right.info])
        on = [(F.col(n) == F.col(r)) | ((F.col(n).isNull() if left.info[n].maybe else F.lit(False)) | (F.col(r).isNull() if right.info[n].maybe else F.lit(False))) if left.info[n].maybe or right.info[n].maybe else F.col(n) == F.col(r) for n, r in renamed.items()]
        if minus:  # the solutions must share a bound variable
            on.append(reduce(Column.__or__, [F.col(n).isNotNull() & F.col(r).isNotNull() for n, r in renamed.items()]))
        if conditions:
            own = {n: i for n, i in right.info.items() if n not in shared}
            types = [left.df.schema[n] for n in left.info] + [right.df.schema[n] for n in own]
            probe = Frame(self.spark.createDataFrame([], T.StructType(types)), {**left.info, **own}, self.catalog)
            on += [Compiler(probe).boolean(c) for c in conditions]
        return replace(left, df=left.df.join(rdf, _and(on), how))

    def filter(self, node: A.Filter) -> Frame:
        f = self.lower(node.node)
        for c in _conjuncts(node.condition):
            negated = False
            while isinstance(c, A.Call) and c.name == "!" and isinstance(c.args[0], A.Exists | A.Call) and (isinstance(c.args[0], A.Exists) or c.args[0].name == "!"):
                c, negated = c.args[0], not negated
            if isinstance(c, A.Exists):
                how = "left_anti" if c.negated != negated else "left_semi"
                pattern, conditions = c.pattern, []
                if isinstance(pattern, A.Filter):
                    # filters of the block may speak of outer variables: they belong to the join
                    conditions, pattern = _conjuncts(pattern.condition), pattern.node
                f = self._semi(f, self.lower(pattern), conditions, how)
            else:
                c = A.Call("!", (c,)) if negated else c
                f = self._marked(f, c)
        return f

    def _marked(self, f: Frame, condition) -> Frame:
        """A filter; EXISTS below OR and the like becomes a marker column."""
        marks: list[str] = []
        box = [f]

        def exists(e: A.Exists) -> Column:
            outer, inner = box[0], self.lower(e.pattern)
            shared = [n for n in outer.info if n in inner.info]
            mark = self.name()
            keys = Frame(inner.df.select(*shared).distinct(), {n: inner.info[n] for n in shared}, self.catalog)
            keys = Frame(keys.df.withColumn(mark, F.lit(True)), {**keys.info, mark: Info()}, self.catalog)
            box[0] = self.join(outer, keys if shared else replace(keys, df=keys.df.limit(1)), "left")
            marks.append(mark)
            found = F.coalesce(F.col(mark), F.lit(False))
            return ~found if e.negated else found

        test = Compiler(f, exists).boolean(condition)
        df = box[0].df.where(test).drop(*marks)
        return Frame(df, {n: i for n, i in box[0].info.items() if n not in marks}, self.catalog)

    def values(self, node: A.Values) -> Frame:
        columns, info = [], {}
        for i, v in enumerate(node.variables):
            cells = [r[i] for r in node.rows]
            typed = [None if c is None else Compiler(Frame(None, {}, self.catalog)).typed(c) for c in cells]
            kinds = {(t.kind, t.prefix) for t in typed if t}
            same = len(kinds) <= 1
            kind, prefix = next(iter(kinds)) if kinds and same else ("str", None)
            name = v.name
            columns.append([(F.lit(None) if t is None else t.column if same else Compiler(Frame(None, {}, self.catalog)).text(t)) for t in typed])
            info[name] = Info("iri" if kind == "iri" else "lit", prefix, any(c is None for c in cells))
        if not node.rows:
            return self.empty([v.name for v in node.variables])
        rows = [F.struct(*[columns[i][j].alias(v.name) for i, v in enumerate(node.variables)]) for j in range(len(node.rows))]
        df = self.spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        return Frame(df, info, self.catalog)

    def group(self, node: A.Group) -> Frame:
        f = self.lower(node.node)
        keys, info = [], {}
        for v, e in node.keys:
            x = Compiler(f).typed(e)
            keys.append(x.column.alias(v.name))
            info[v.name] = Info("iri", x.prefix, True) if x.kind == "iri" else Info(maybe=True)
        made = []
        for v, a in node.aggregates:
            column, own = self.aggregate(f, a)
            made.append(column.alias(v.name))
            info[v.name] = own
        df = f.df.groupBy(*keys).agg(*made) if made else f.df.select(*keys).distinct()
        return Frame(df, info, self.catalog)

    def aggregate(self, f: Frame, a: A.Aggregate) -> tuple[Column, Info]:
        if a.arg is None:
            return (F.count_distinct(F.struct(*[F.coalesce(F.col(n).cast("string"), F.lit("\x00")) for n in f.info])) if a.distinct else F.count("*")), Info()
        x = Compiler(f).typed(a.arg)
        c = x.column
        same = Info("iri", x.prefix, True) if x.kind == "iri" else Info(maybe=True)
        match a.name:
            case "COUNT":
                return (F.count_distinct(c) if a.distinct else F.count(c)), Info()
            case "SUM":
                return F.coalesce(F.sum_distinct(c) if a.distinct else F.sum(c), F.lit(0)), Info()
            case "AVG":
                return F.coalesce(F.try_divide(F.sum_distinct(c), F.count_distinct(c)) if a.distinct else F.avg(c), F.lit(0)), Info()
            case "MIN" | "SAMPLE":
                return F.min(c), same
            case "MAX":
                return F.max(c), same
            case "GROUP_CONCAT":
                texts = Compiler(f).text(x)
                return F.array_join(F.sort_array(F.collect_set(texts) if a.distinct else F.collect_list(texts)), a.separator), Info()
        raise UnsupportedConstruct(a.name)

    # Basic graph patterns
    def bgp(self, triples: list[A.Triple], optional: list[A.Triple]) -> Frame:
        return self.joined(self.stars(triples, optional)) if triples else self.unit()

    def stars(self, triples: list[A.Triple], optional: list[A.Triple]) -> list[Frame]:
        """A frame for each subject and each path."""
        stars: dict[object, list[A.Triple]] = {}
        frames: list[Frame] = []
        for t in triples:
            p = t.p
            if isinstance(p, A.Sequence | A.Alternative | A.Inverse | A.Repeat | A.Negated):
                p = self.simplify(t)
                if isinstance(p, Frame):
                    frames.append(p)
                    continue
                for s in p:
                    stars.setdefault(s.s, []).append(s)
                continue
            stars.setdefault(t.s, []).append(t)
        extra: dict[object, list[A.Triple]] = {}
        for t in optional:
            extra.setdefault(t.s, []).append(t)
        # references to other stars' subjects tell those stars' classes
        hints = self.hints(stars)
        return frames + [self.star(s, ts, extra.get(s, []), hints.get(s)) for s, ts in stars.items()]

    def joined(self, frames: list[Frame]) -> Frame:
        """Join what shares a variable first; cross joins last."""
        done = frames.pop(0)
        while frames:
            i = next((i for i, f in enumerate(frames) if set(f.info) & set(done.info)), 0)
            done = self.join(done, frames.pop(i))
        return done

    def hints(self, stars) -> dict:
        out: dict = {}
        for ts in stars.values():
            for t in ts:
                if isinstance(t.o, A.Var) and isinstance(t.p, A.Iri) and t.o in stars:
                    slot = self.catalog.predicates.get(t.p.value)
                    refs = {c.slots[slot].ref for c in self.catalog.classes.values() if slot in c.slots}
                    if slot and len(refs) == 1 and None not in refs:
                        out[t.o] = refs.pop()
        return out

    def simplify(self, t: A.Triple):
        """A path as plain triples, or as a frame of its own."""
        match t.p:
            case A.Sequence(parts):
                at, out = t.s, []
                for i, p in enumerate(parts):
                    end = t.o if i == len(parts) - 1 else A.Var(self.name(), hidden=True)
                    out.append(A.Triple(at, p, end))
                    at = end
                if all(isinstance(x.p, A.Iri) for x in out):
                    return out
                return self.hide(self.bgp(out, []), t)
            case A.Inverse(path):
                turned = A.Triple(t.o, path, t.s)
                return [turned] if isinstance(path, A.Iri) else self.hide(self.bgp([turned], []), t)
            case A.Alternative(parts):
                return reduce(self.union, [self.hide(self.bgp([A.Triple(t.s, p, t.o)], []), t) for p in parts])
            case A.Repeat(path, least, many):
                return self.closure(t, path, least, many)
            case A.Negated(forward, backward):
                return self.negated(t, forward, backward)

    def negated(self, t: A.Triple, forward: tuple, backward: tuple) -> Frame:
        """``!(p|^q)``: any predicate but these, forwards, and backwards if one of them is inverse."""
        parts = []
        for names, s, o in ((forward, t.s, t.o), (backward, t.o, t.s)):
            if names is None:
                continue
            p = A.Var(self.name(), hidden=True)
            f = self.bgp([A.Triple(s, p, o)], [])
            if names:
                f = replace(f, df=f.df.where(~F.col(p.name).isin(*names)))
            parts.append(self.hide(f, t))
        return reduce(self.union, parts)

    def hide(self, f: Frame, t: A.Triple) -> Frame:
        keep = [x.name for x in (t.s, t.o) if isinstance(x, A.Var) and x.name in f.info]
        keep = list(dict.fromkeys(keep))
        return Frame(f.df.select(*keep), {n: f.info[n] for n in keep}, self.catalog)

    def closure(self, t: A.Triple, path, least: int, many: bool) -> Frame:
        """``?``, ``*`` and ``+``: semi-naive rounds until no new pair appears."""
        s, o = A.Var(self.name(), hidden=True), A.Var(self.name(), hidden=True)
        edges = self.bgp([A.Triple(s, path, o)], [])
        c = Compiler(edges)
        step = edges.df.select(c.text(edges.typed(s.name)).alias("s"), c.text(edges.typed(o.name)).alias("o")).distinct()
        # From a constant end the rounds walk outwards; the steps are read once.
        back = isinstance(t.o, A.Iri) and not isinstance(t.s, A.Iri)
        near, far = ("o", "s") if back else ("s", "o")
        if many:
            step = _cut(step)
        pairs = step
        if isinstance(t.s, A.Iri):
            pairs = pairs.where(F.col("s") == t.s.value)
        elif back:
            pairs = pairs.where(F.col("o") == t.o.value)
        if many:
            grown = pairs
            while True:
                grown = grown.select(near, F.col(far).alias("m")).join(step.withColumnRenamed(near, "m"), "m").select("s", "o").join(pairs, ["s", "o"], "left_anti").distinct()
                grown = _cut(grown)
                if grown.isEmpty():
                    break
                pairs = pairs.union(grown)
        if least == 0:
            nodes = step.select(F.explode(F.array("s", "o")).alias("s"))
            ends = [x.value for x in (t.s, t.o) if isinstance(x, A.Iri)]
            if ends:
                nodes = nodes.union(self.spark.createDataFrame([(e,) for e in ends], "s string"))
            pairs = pairs.union(nodes.select("s", F.col("s").alias("o"))).distinct()
        names = {}
        for column, x in (("s", t.s), ("o", t.o)):
            if isinstance(x, A.Var):
                names[column] = x.name
            else:
                pairs = pairs.where(F.col(column) == x.value)
        if len(set(names.values())) < len(names):
            pairs, names = pairs.where("s = o"), {"s": names["s"]}
        return Frame(pairs.select(*[F.col(k).alias(v) for k, v in names.items()]), {v: Info("iri") for v in names.values()}, self.catalog)

    def star(self, subject, triples: list[A.Triple], optional: list[A.Triple], hint: str | None) -> Frame:
        types = [t.o.value for t in triples if t.p == A.Iri(A.RDF_TYPE) and isinstance(t.o, A.Iri)]
        slots: set[str] = set()
        unknown = False
        for t in triples:
            if isinstance(t.p, A.Iri) and t.p.value != A.RDF_TYPE:
                slot = self.catalog.predicates.get(t.p.value)
                unknown |= slot is None
                slots.add(slot)
        names = list(dict.fromkeys(x.name for t in [*triples, *optional] for x in (t.s, t.p, t.o) if isinstance(x, A.Var)))
        if unknown:
            return self.empty(names)
        tables = [c for c in self.catalog.with_slots(slots)]
        for iri in types:
            fit = self.catalog.of_class(iri)
            tables = [c for c in tables if c in fit]
        if hint and not types:
            tables = [c for c in tables if c.name == hint or hint in c.ancestors]
        key = None
        if isinstance(subject, A.Iri):
            found = self.catalog.resolve(subject.value)
            tables = [c for c in tables if found and (c is found[0] or not c.prefix)]
            key = found and found[1]
        if not tables:
            return self.empty(names)
        parts = [self.scan(c, subject, key, triples, optional) for c in tables]
        return parts[0] if len(parts) == 1 else reduce(self.union, parts)

    def scan(self, table: ClassTable, subject, key: str | None, triples: list[A.Triple], optional: list[A.Triple]) -> Frame:
        """One pass over a class table: filters, then a column for each variable."""
        self.read[table.name] = table
        columns: dict[str, Column] = {}
        info: dict[str, Info] = {}
        conditions: list[Column] = []
        explodes: list[tuple[str, Column, Info]] = []
        if key is not None:
            conditions.append(table.key == F.lit(key).try_cast(table.key_type))
        if isinstance(subject, A.Var):
            if table.key is None:
                if not subject.hidden:
                    columns[subject.name], info[subject.name] = F.lit(None).cast("string"), Info(maybe=True)
            else:
                columns[subject.name], info[subject.name] = table.key, Info("iri", table.prefix or None)
        df = table.df
        for t in triples:
            if isinstance(t.p, A.Var):
                self.any_slot(table, t, explodes)
                continue
            if t.p.value == A.RDF_TYPE:
                if isinstance(t.o, A.Var):
                    columns[t.o.name], info[t.o.name] = F.lit(table.iri), Info("iri")
                continue
            slot = table.slots[self.catalog.predicates[t.p.value]]
            ref = self.catalog.classes.get(slot.ref) if slot.ref else None
            own = Info("iri", (ref.prefix if ref else None) or None) if slot.ref else Info()
            value = slot.column
            if slot.many:
                if isinstance(t.o, A.Var) and t.o.name not in columns:
                    explodes.append((t.o.name, slot.column, own))
                elif isinstance(t.o, A.Literal):
                    conditions.append(F.array_contains(slot.column, literal(t.o).column))
                elif isinstance(t.o, A.Iri):
                    conditions.append(F.array_contains(slot.column, F.lit(t.o.value[len(own.prefix or "") :])))
                continue
            match t.o:
                case A.Var(name) if name in columns:
                    conditions.append(columns[name] == value)
                case A.Var(name):
                    columns[name], info[name] = value, own
                    conditions.append(value.isNotNull())
                case A.Literal():
                    x, kind = literal(t.o), kind_of(df.select(value.alias("v")).schema["v"].dataType)[0]
                    conditions.append(value == x.column if kind == x.kind and own.kind == "lit" else value.cast("timestamp_ntz") == x.column.cast("timestamp_ntz") if {kind, x.kind} == {"time", "date"} else F.lit(False))
                case A.Iri(iri):
                    if own.kind != "iri":
                        conditions.append(value == F.lit(iri) if kind_of(df.select(value.alias("v")).schema["v"].dataType)[0] == "str" else F.lit(False))
                    elif own.prefix and not iri.startswith(own.prefix):
                        conditions.append(F.lit(False))
                    else:
                        conditions.append(value == F.lit(iri[len(own.prefix or "") :]).try_cast(df.select(value.alias("v")).dtypes[0][1]))
        for t in optional:
            slot = table.slots.get(self.catalog.predicates[t.p.value])
            ref = self.catalog.classes.get(slot.ref) if slot and slot.ref else None
            columns[t.o.name] = slot.column if slot else F.lit(None).cast("string")
            info[t.o.name] = Info("iri", ref.prefix or None, True) if ref else Info(maybe=True)
        if conditions:
            df = df.where(_and(conditions))
        df = df.select(*[c.alias(n) for n, c in columns.items()], *[c.alias(f"{n}#{i}") for i, (n, c, _) in enumerate(explodes)])
        for i, (n, _, own) in enumerate(explodes):
            at = f"`{n}#{i}`"
            if "\t" in n:  # predicate and object of an open triple
                df = df.withColumn("_po", F.explode(F.col(at))).drop(f"{n}#{i}")
                for name, part, known in zip(n.split("\t"), ("p", "o"), (Info("iri"), Info())):
                    if name:
                        df = df.withColumn(name, F.col(f"_po.{part}"))
                        info[name] = known
                df = df.drop("_po")
            else:
                df = df.withColumn(n, F.explode(F.col(at))).drop(f"{n}#{i}")
                info[n] = own
        unique = {subject.name} if isinstance(subject, A.Var) and table.key is not None and not explodes else ()
        return Frame(df, info, self.catalog, frozenset(unique))

    def any_slot(self, table: ClassTable, t: A.Triple, explodes: list) -> None:
        """A variable predicate: the row's slots as (p, o) pairs, o as text."""
        pairs = pairs_of(self.catalog, table)
        if not isinstance(t.o, A.Var):
            want = t.o.value
            pairs = F.filter(pairs, lambda x: x["o"] == want)
        explodes.append((f"{t.p.name}\t{t.o.name if isinstance(t.o, A.Var) else ''}", pairs, Info()))


def pairs_of(catalog: Catalog, table: ClassTable) -> Column:
    """All bound (predicate, object text, whether it is an IRI, datatype) of a row."""
    schema = table.df.select(*[s.column.alias(s.name) for s in table.slots.values()]).schema

    def one(p: str, o: Column, iri: bool, datatype: str) -> Column:
        return F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(iri).alias("is_iri"), F.lit(datatype).alias("datatype"))

    singles, many = [one(A.RDF_TYPE, F.lit(table.iri), True, "")], []
    for s in table.slots.values():
        p = catalog.namespace + s.name
        ref = catalog.classes.get(s.ref) if s.ref else None
        d = schema[s.name].dataType
        item = d.elementType if s.many and isinstance(d, T.ArrayType) else d

        def text(c):
            return F.concat(F.lit(ref.prefix), c.cast("string")) if ref else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kind_of(item)[0] == "time" else c.cast("string")

        datatype = "" if ref else kind_of(item)[1]
        if s.many:

            def each(c):
                return one(p, text(c), ref is not None, datatype)

            many.append(F.transform(F.coalesce(s.column, F.array()), each))
        else:
            singles.append(one(p, text(s.column), ref is not None, datatype))
    whole = F.array(*singles)
    if many:
        whole = F.concat(whole, *many)
    return F.filter(whole, lambda x: x["o"].isNotNull())


def triples(catalog: Catalog, table: ClassTable) -> DataFrame:
    """(s, p, o, is_iri, datatype) of a class with keys."""
    if table.key is None:
        raise Unscoped(f"objects of {table.name} have no identity")
    return table.df.select(F.concat(F.lit(table.prefix), table.key.cast("string")).alias("s"), F.explode(pairs_of(catalog, table)).alias("t")).select("s", "t.*")


_ESCAPE = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def ntriples_term(text: Column, is_iri: Column, datatype: Column) -> Column:
    quoted = text
    for a, b in _ESCAPE:
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    quoted = F.concat(F.lit('"'), quoted, F.lit('"'), F.when(datatype.isin("", A.XSD + "string"), F.lit("")).otherwise(F.concat(F.lit("^^<"), datatype, F.lit(">"))))
    return F.when(is_iri, F.concat(F.lit("<"), text, F.lit(">"))).otherwise(quoted)


def _guarded(df: DataFrame, limit: int | None) -> DataFrame:
    if limit is not None and df.limit(limit + 1).count() > limit:
        raise ResultLimitExceeded(f"the result has more than {limit} rows")
    return df


@dataclass(frozen=True)
class Limits:
    """What ``execute`` allows; None lifts a limit."""

    max_triples: int | None = 500_000
    max_rows: int | None = 10_000


def solutions(spark, catalog: Catalog, text: str, prefixes: dict[str, str] | None = None, keep: Iterable[str] | None = None) -> Frame:
    """The solutions of a SELECT with what is known of each variable.

    With ``keep`` only the set of these variables' values counts (those that the
    query selects): solutions that do not differ in them may be one, and other
    variables may be missing.
    """
    q = parse(text, {"": catalog.namespace, **(prefixes or {})})
    if q.form != "SELECT":
        raise UnsupportedConstruct(f"{q.form} has no solutions")
    low = Lowering(catalog, spark)
    if keep is None or not isinstance(q.node, A.Project | A.Distinct | A.Reduced):
        return low.lower(q.node)
    top = q.node
    while isinstance(top, A.Distinct | A.Reduced):
        top = top.node
    names = {v.name for v in top.variables} & set(keep) if isinstance(top, A.Project) else set(keep)
    f = low.lower_set(q.node, names)
    return replace(f, df=f.df.select(*[n for n in f.info if n in names]), info={n: i for n, i in f.info.items() if n in names})


def query(spark, catalog: Catalog, text: str, prefixes: dict[str, str] | None = None, max_rows: int | None = None) -> DataFrame:
    """Run a query of any form.

    SELECT gives a column for each variable: objects as their keys, literals as
    they are, unbound as NULL. ASK gives one row ``answer``. CONSTRUCT and
    DESCRIBE give distinct N-Triples terms ``s, p, o``.
    """
    return _guarded(_run(Lowering(catalog, spark), text, prefixes)[1], max_rows)


def _run(low: Lowering, text: str, prefixes: dict[str, str] | None) -> tuple[A.Query, DataFrame, Frame | None]:
    q = parse(text, {"": low.catalog.namespace, **(prefixes or {})})
    if q.form == "SELECT":
        f = low.lower(q.node)
        return q, f.df, f
    if q.form == "ASK":
        return q, low.lower(q.node).df.limit(1).agg((F.count("*") > 0).alias("answer")), None
    if q.form == "CONSTRUCT":
        return q, _construct(low.lower(q.node), q.template), None
    return q, _describe(low, q), None


def execute(spark, catalog: Catalog, text: str, format: str = "json", prefixes: dict[str, str] | None = None, limits: Limits = Limits()) -> str:
    """Run a query and give the whole result as one text: SPARQL results JSON for SELECT and ASK, Turtle for graphs.

    The result comes to the driver, so by default the tables that the query
    reads may hold 500,000 triples and the result 10,000 rows.
    """
    low = Lowering(catalog, spark)
    q, df, f = _run(low, text, prefixes)
    if limits.max_triples is not None:
        held = sum(_count_triples(t) for t in low.read.values())
        if held > limits.max_triples:
            raise TripleLimitExceeded(f"{held} triples, more than {limits.max_triples}")
    df = _guarded(df, limits.max_rows)
    if q.form == "ASK":
        return json.dumps({"head": {}, "boolean": df.first()["answer"]})
    if q.form == "SELECT":
        rows = [json.loads(r["binding"]) for r in results_json(f).collect()]
        return json.dumps({"head": {"vars": df.columns}, "results": {"bindings": rows}}, ensure_ascii=False)
    if format not in ("turtle", "text/turtle"):
        raise UnsupportedConstruct(f"graph format {format!r}")
    return "".join(f"{r['s']} {r['p']} {r['o']} .\n" for r in df.collect())


def _count_triples(table: ClassTable) -> int:
    """Triples of a class: one for each object's class, one for each value of a slot."""
    each = [F.count(s.column) if not s.many else F.sum(F.size(F.coalesce(s.column, F.array()))) for s in table.slots.values()]
    return sum(int(x or 0) for x in table.df.agg(F.count("*"), *each).first())


def _construct(f: Frame, template: list[A.Triple]) -> DataFrame:
    c = Compiler(f)

    def term(t) -> Column:
        x = c.typed(t)
        if isinstance(t, A.Iri):
            return F.lit(f"<{t.value}>")
        return ntriples_term(c.text(x), F.lit(x.kind == "iri"), F.lit(x.datatype))

    rows = F.array(*[F.struct(term(t.s).alias("s"), term(t.p).alias("p"), term(t.o).alias("o")) for t in template])
    return f.df.select(F.explode(rows).alias("t")).select("t.*").where("s is not null and p is not null and o is not null").distinct()


def _describe(low: Lowering, q: A.Query) -> DataFrame:
    catalog = low.catalog
    wanted = None
    f = low.lower(q.node) if not isinstance(q.node, A.Bgp) or q.node.triples else None
    for t in q.targets:
        if isinstance(t, A.Iri):
            one = low.spark.createDataFrame([(t.value,)], "s string")
            found = catalog.resolve(t.value)
            tables = [found[0]] if found else []
        else:
            one = f.df.select(Compiler(f).text(f.typed(t.name)).alias("s"))
            prefix = f.info[t.name].prefix
            tables = [c for c in catalog.classes.values() if c.key is not None and (not prefix or c.prefix == prefix)]
        for table in tables:
            found = triples(catalog, table).join(one.distinct(), "s", "left_semi")
            wanted = found if wanted is None else wanted.union(found)
    if wanted is None:
        return low.empty(["s", "p", "o"]).df
    return wanted.select(ntriples_term(F.col("s"), F.lit(True), F.lit("")).alias("s"), F.concat(F.lit("<"), "p", F.lit(">")).alias("p"), ntriples_term(F.col("o"), F.col("is_iri"), F.col("datatype")).alias("o")).distinct()


def results_json(f: Frame) -> DataFrame:
    """Solutions as SPARQL-results bindings (column ``binding``): a JSON object a row, unbound variables left out."""
    c, cells = Compiler(f), []
    for name in f.df.columns:
        x = f.typed(name)
        term = term_struct(c.text(x), F.lit(x.kind == "iri"), F.lit(x.datatype if x.kind != "iri" else ""), F.lit(x.lang))
        cells.append(F.when(F.col(name).isNotNull(), term).alias(name))
    return f.df.select(F.to_json(F.struct(*cells)).alias("binding"))


def ask_json(answer: DataFrame) -> DataFrame:
    """An ASK's answer in the same format (column ``result``)."""
    return answer.select(F.concat(F.lit('{"head":{},"boolean":'), F.col("answer").cast("string"), F.lit("}")).alias("result"))


def export_ntriples(catalog: Catalog, table: ClassTable) -> DataFrame:
    """A class as lines of N-Triples (column ``value``, for ``write.text``)."""
    t = triples(catalog, table)
    return t.select(F.concat_ws(" ", F.concat(F.lit("<"), "s", F.lit(">")), F.concat(F.lit("<"), "p", F.lit(">")), ntriples_term(F.col("o"), F.col("is_iri"), F.col("datatype")), F.lit(".")).alias("value"))


_NT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*$'


_PIECE = r"\\U[0-9A-Fa-f]{8}|\\u[0-9A-Fa-f]{4}|\\.|[^\\]+"


def _unescaped(text: Column) -> Column:
    """A literal's text with its escapes (\\n, \\u00e9, \\U0001F600) replaced."""

    def one(piece: Column) -> Column:
        code = F.decode(F.unhex(F.lpad(F.substring(piece, 3, 8), 8, "0")), "UTF-32")
        short = F.translate(F.substring(piece, 2, 1), "tnrbf", "\t\n\r\b\f")
        return F.when(piece.rlike(r"^\\[uU][0-9A-Fa-f]"), code).when(F.startswith(piece, F.lit("\\")), short).otherwise(piece)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), 0), one), "")).otherwise(text)


def import_ntriples(lines: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """(s, p, o, is_iri, datatype, lang) from lines (column ``value``); blank lines and comments are skipped.

    A line that does not parse fails the job (FAILFAST), is left out
    (DROPMALFORMED), or comes with NULLs and its text in ``_corrupt_record``
    (PERMISSIVE).
    """
    if mode not in ("FAILFAST", "DROPMALFORMED", "PERMISSIVE"):
        raise ValueError(f"mode {mode!r}")
    text = F.col("value")
    good = text.rlike(_NT)
    found = lines.where(~text.rlike(r"^\s*(#.*)?$"))
    if mode == "DROPMALFORMED":
        found = found.where(good)
    bad = F.raise_error(F.concat(F.lit("not a triple: "), text)) if mode == "FAILFAST" else F.lit(None).cast("string")
    part = lambda i: F.when(good, F.regexp_extract(text, _NT, i)).otherwise(bad)
    parts = found.select(part(1).alias("s"), part(2).alias("p"), part(3).alias("t"), F.when(~good, text).alias("_corrupt_record"))
    body = _unescaped(F.regexp_extract("t", r'(?s)^"((?:[^"\\]|\\.)*)"', 1))
    is_iri = ~F.startswith("t", F.lit('"'))
    datatype = F.regexp_extract("t", r"\^\^<([^>]*)>$", 1)
    lang = F.regexp_extract("t", r'"@([A-Za-z0-9-]+)$', 1)
    whole = F.col("t").isNotNull()
    out = parts.select(
        _unescaped(F.regexp_replace("s", "^<|>$", "")).alias("s"),
        _unescaped(F.col("p")).alias("p"),
        F.when(is_iri, _unescaped(F.regexp_replace("t", "^<|>$", ""))).when(whole, body).alias("o"),
        is_iri.alias("is_iri"),
        F.when(is_iri, F.lit("")).when(datatype != "", datatype).when(lang != "", F.lit(A.RDF + "langString")).when(whole, F.lit(A.XSD + "string")).alias("datatype"),
        lang.alias("lang"),
        "_corrupt_record",
    )
    return out if mode == "PERMISSIVE" else out.drop("_corrupt_record")
