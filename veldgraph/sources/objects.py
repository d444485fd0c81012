"""Objects in and out: instances, Turtle, term JSON and a plain printer."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParseError, TripleLimitExceeded, UnsupportedConstruct
from ..plans.algebra import RDF, XSD, Iri, Literal
from .catalog import Catalog, ClassTable
from .schema import SchemaView
from .turtle import Blank, parse_turtle

TRIPLE = "s string, p string, o string, is_iri boolean, datatype string, lang string"


def create_instances(spark: SparkSession, view: SchemaView, class_name: str, objects: list[dict]) -> DataFrame:
    """Objects given as dicts, typed by the class; fields the class lacks are dropped, values that do not fit become NULL."""
    name = view.find_class(class_name)
    if name is None:
        raise ParseError(f"unknown class {class_name!r}")
    rows = [(json.dumps(o, default=str),) for o in objects]
    return spark.createDataFrame(rows, "j string").select(F.from_json("j", view.spark_type(name), {"mode": "PERMISSIVE"}).alias("v")).select("v.*")


def _triples_of(text: str, blanks: str = "") -> list[tuple]:
    rows = []
    for s, p, o in parse_turtle(text).triples():
        subject = s.value if isinstance(s, Iri) else f"_:{blanks}{s.label}"
        if isinstance(o, Literal):
            rows.append((subject, p, o.value, False, o.datatype, o.lang))
        else:
            rows.append((subject, p, o.value if isinstance(o, Iri) else f"_:{blanks}{o.label}", True, "", ""))
    return rows


def import_turtle(spark: SparkSession, text: str, max_triples: int | None = None) -> DataFrame:
    """A Turtle document that fits the driver, as triples; blank nodes are named ``_:b<n>``."""
    rows = _triples_of(text)
    if max_triples is not None and len(rows) > max_triples:
        raise TripleLimitExceeded(f"{len(rows)} triples, more than {max_triples}")
    return spark.createDataFrame(rows, TRIPLE)


def import_turtle_files(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Turtle files, each read whole by one task, as triples; blank nodes are told apart by file.

    A file that does not parse fails the job, or, unless ``strict``, gives no triples.
    """

    def run(frames):
        for pdf in frames:
            rows = []
            for file, text in zip(pdf["file"], pdf["value"]):
                try:
                    rows += _triples_of(text, hashlib.md5(file.encode()).hexdigest()[:12])
                except ParseError:
                    if strict:
                        raise
            yield pd.DataFrame(rows, columns=["s", "p", "o", "is_iri", "datatype", "lang"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.mapInPandas(run, TRIPLE)


def check_triples(df: DataFrame, limit: int) -> DataFrame:
    """``df``, if it has at most ``limit`` rows; no more than one beyond is counted."""
    if df.limit(limit + 1).count() > limit:
        raise TripleLimitExceeded(f"more than {limit} triples")
    return df


def objects_of(triples: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """Triples turned to a row for each subject: ``predicates`` gives the column of each predicate (arrays of its values)."""
    wanted = triples.where(F.col("p").isin(*predicates))
    return wanted.groupBy(F.col("s").alias("uri")).agg(*[F.array_sort(F.collect_list(F.when(F.col("p") == p, F.col("o")))).alias(c) for p, c in predicates.items()])


def object_turtle(catalog: Catalog, table: ClassTable) -> DataFrame:
    """(uri, turtle): each object of a class as one Turtle block, predicates in order. A row's own slots make it: no shuffle."""
    from ..operators.lower import ntriples_term, pairs_of

    lines = F.transform(F.array_sort(pairs_of(catalog, table)), lambda t: F.concat(F.lit("  <"), t["p"], F.lit("> "), ntriples_term(t["o"], t["is_iri"], t["datatype"])))
    uri = F.concat(F.lit(table.prefix), table.key.cast("string"))
    return table.df.select(uri.alias("uri"), F.concat(F.lit("<"), uri, F.lit(">\n"), F.array_join(lines, " ;\n"), F.lit(" .")).alias("turtle"))


def graph_text(triples: DataFrame, format: str = "turtle") -> DataFrame:
    """Lines (column ``value``) of triples with N-Triples terms ``s, p, o``; N-Triples is Turtle."""
    if format not in ("turtle", "text/turtle"):
        raise UnsupportedConstruct(f"graph format {format!r}")
    return triples.select(F.format_string("%s %s %s .", "s", "p", "o").alias("value"))


def term_struct(value: Column, is_iri: Column, datatype: Column, lang: Column) -> Column:
    """A term as SPARQL results write it: uri, bnode or literal, with language, or datatype unless it is a string."""
    blank = is_iri & F.startswith(value, F.lit("_:"))
    kind = F.when(blank, "bnode").when(is_iri, "uri").otherwise("literal")
    text = F.when(blank, F.substring(value, 3, 1 << 20)).otherwise(value)
    plain = is_iri | (lang != "") | datatype.isin("", XSD + "string", RDF + "langString")
    return F.struct(kind.alias("type"), text.alias("value"), F.when(lang != "", lang).alias("xml:lang"), F.when(~plain, datatype).alias("datatype"))


def keys(value) -> list[str]:
    """The keys of an object or mapping, in order; none of anything else."""
    return list(value) if isinstance(value, dict) else []


def values(value) -> list:
    """The members of an object, mapping or list; none of a scalar."""
    return list(value.values()) if isinstance(value, dict) else list(value) if isinstance(value, list) else []


def length(value) -> int:
    """Members of an object, mapping or list; 0 for a scalar or null."""
    return len(value) if isinstance(value, dict | list) else 0


def get(value, key: str):
    return value.get(key) if isinstance(value, dict) else None


def at(value, index: int):
    return value[index] if isinstance(value, list) and 0 <= index < len(value) else None


def node_columns(json_column: Column) -> dict[str, Column]:
    """The same for a column of JSON text: keys, values (JSON texts) and length."""
    v = F.try_parse_json(json_column)
    is_list = F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
    members = F.when(is_list, v.try_cast("array<variant>"))
    pairs = v.try_cast("map<string,variant>")
    texts = F.coalesce(F.transform(members, lambda x: F.to_json(x)), F.transform(F.map_values(pairs), lambda x: F.to_json(x)), F.array().cast("array<string>"))
    return {"keys": F.coalesce(F.map_keys(pairs), F.array().cast("array<string>")), "values": texts, "length": F.size(texts)}


def sum_as_string(a: Column, b: Column) -> Column:
    """The sum of two whole numbers as text."""
    return (a.cast("long") + b.cast("long")).cast("string")


def pretty(value, indent: str = "") -> str:
    """An object as an indented tree."""
    if isinstance(value, dict):
        return "\n".join(f"{indent}{k}:" + (f"\n{pretty(v, indent + '  ')}" if isinstance(v, dict | list) and v else f" {_scalar(v)}") for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(f"{indent}-" + (f"\n{pretty(v, indent + '  ')}" if isinstance(v, dict | list) and v else f" {_scalar(v)}") for v in value)
    return indent + _scalar(value)


def _scalar(v) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


__all__ = ["Blank", "check_triples", "create_instances", "graph_text", "import_turtle", "import_turtle_files", "object_turtle", "objects_of", "pretty", "term_struct"]
