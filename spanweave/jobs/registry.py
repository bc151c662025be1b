"""Queries over the given tables, each with SQL that must give the same rows."""

from __future__ import annotations

from . import agreement_queries, cluster_queries, discovery_queries, element_queries, gene_queries, interval_queries, isoform_queries, scan_queries, site_queries

MODULES = (cluster_queries, interval_queries, element_queries, gene_queries, scan_queries, isoform_queries, site_queries, agreement_queries, discovery_queries)


def flagship(spark, sf_dir):
    return interval_queries.q_linkage_regions(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
