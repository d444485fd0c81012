"""The driver's Parquet tables as a catalog of classes."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, ClassTable, Slot

NAMESPACE = "http://veldgraph.example/"

# table, key, slots (name: column or (column, class))
_CLASSES = {
    "Region": ("region", "r_regionkey", {"name": "r_name"}),
    "Nation": ("nation", "n_nationkey", {"name": "n_name", "region": ("n_regionkey", "Region")}),
    "Customer": ("customer", "c_custkey", {"name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment", "nation": ("c_nationkey", "Nation")}),
    "Supplier": ("supplier", "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal", "nation": ("s_nationkey", "Nation")}),
    "Part": ("part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailPrice": "p_retailprice"}),
    "Order": ("orders", "o_orderkey", {"status": "o_orderstatus", "totalPrice": "o_totalprice", "orderDate": "o_orderdate", "priority": "o_orderpriority", "customer": ("o_custkey", "Customer")}),
    "LineItem": (
        "lineitem",
        None,
        {
            "lineNumber": "l_linenumber",
            "quantity": "l_quantity",
            "extendedPrice": "l_extendedprice",
            "discount": "l_discount",
            "tax": "l_tax",
            "returnFlag": "l_returnflag",
            "lineStatus": "l_linestatus",
            "shipDate": "l_shipdate",
            "order": ("l_orderkey", "Order"),
            "part": ("l_partkey", "Part"),
            "supplier": ("l_suppkey", "Supplier"),
        },
    ),
    "Event": ("events", "event_id", {"ts": "ts", "userId": "user_id", "eventType": "event_type", "value": "value", "props": "props"}),
    "Embedding": ("embeddings", "vec_id", {"vector": ("embedding", None, True), "label": "label"}),
    "Document": ("documents", "doc_id", {"text": "text", "lang": "lang", "source": "source", "nChars": "n_chars"}),
    "Label": ("labels", None, {"quality": "quality", "toxic": "toxic", "document": ("doc_id", "Document")}),
    "Page": ("pages", "page_id", {"url": "url", "html": "html"}),
    "BenchmarkItem": ("benchmark", "item_id", {"itemText": "text"}),
    "Turn": ("conversations", None, {"conversation": "conv_id", "turn": "turn", "role": "role", "turnText": "text"}),
}
#: Superclasses without rows of their own.
_ANCESTORS = {"Customer": {"Party"}, "Supplier": {"Party"}}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """A typed catalog; tables are read lazily, and only the columns that a query names."""
    classes = []
    for name, (file, key, slots) in _CLASSES.items():
        made = {}
        for slot, column in slots.items():
            column, ref, many = (*column, False)[:3] if isinstance(column, tuple) else (column, None, False)
            made[slot] = Slot(slot, F.col(column), ref, many)
        classes.append((name, file, F.col(key) if key else None, made))
    lazy = _Tables(spark, sf_dir)
    out = Catalog(NAMESPACE, [_LazyTable(name, NAMESPACE + name, lazy, file, key, f"{NAMESPACE}{name}/", slots, frozenset(_ANCESTORS.get(name, ()))) for name, file, key, slots in classes])
    out.abstract = {NAMESPACE + "Party": "Party"}
    return out


class _Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.read = spark, sf_dir, {}

    def __getitem__(self, name: str):
        if name not in self.read:
            self.read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.read[name]


class _LazyTable(ClassTable):
    def __init__(self, name, iri, tables, file, key, prefix, slots, ancestors):
        self.name, self.iri, self.key, self.prefix, self.slots, self.ancestors = name, iri, key, prefix, slots, ancestors
        self._tables, self._file = tables, file

    @property
    def df(self):
        return self._tables[self._file]
