"""All queries of the library and their SQL."""

from __future__ import annotations

import importlib

from .session import ship

MODULES = (
    "tessera.functions.lists",
    "tessera.functions.maps",
    "tessera.functions.scalars",
    "tessera.functions.text",
    "tessera.functions.features",
    "tessera.operators.term_vectors",
    "tessera.operators.similarity_queries",
    "tessera.operators.ngrams",
    "tessera.operators.estimates",
    "tessera.operators.intervals",
    "tessera.operators.suffixes",
    "tessera.operators.word_index",
    "tessera.operators.phrases",
    "tessera.operators.iterators",
    "tessera.operators.frames",
    "tessera.operators.spans",
    "tessera.operators.spelling",
    "tessera.operators.clustering",
    "tessera.operators.member_clusters",
    "tessera.sources.files",
    "tessera.sources.objects",
    "tessera.sources.transactions",
    "tessera.streaming.incremental",
    "tessera.streaming.clusters",
)


def shipped(query):
    """The query, after the package has been sent to the workers."""

    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(name)
        queries |= {k: shipped(f) for k, f in module.QUERIES.items()}
        sql |= module.SQL
    return queries, sql
