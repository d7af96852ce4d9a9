"""Entity graph of products, categories, subcategories, resolution codes and documents as two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Node kinds by source column, and the edges between them.
NODE_KINDS = {
    "product": "PRODUCT", "category": "CATEGORY", "subcategory": "SUBCATEGORY", "resolution_code": "RESCODE",
    "doc_id": "DOC",
}
EDGE_KINDS = [
    ("product", "category"), ("category", "subcategory"), ("doc_id", "subcategory"),
    ("doc_id", "resolution_code"), ("doc_id", "product"),
]


def _node(column: str) -> Column:
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.concat(F.lit(f"{NODE_KINDS[column]}::"), value)


def graph_nodes(documents: DataFrame) -> DataFrame:
    """Distinct (node, kind); an empty attribute is a node too."""
    nodes = F.array(*[F.struct(_node(c).alias("node"), F.lit(k).alias("kind")) for c, k in NODE_KINDS.items()])
    return documents.select(F.inline(nodes)).distinct()


def graph_edges(documents: DataFrame) -> DataFrame:
    """Distinct undirected (src, dst); the two ends differ in kind, so one direction is canonical."""
    edges = F.array(*[F.struct(_node(a).alias("src"), _node(b).alias("dst")) for a, b in EDGE_KINDS])
    return documents.select(F.inline(edges)).distinct()
