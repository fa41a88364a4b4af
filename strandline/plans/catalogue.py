"""The registered queries over the driver tables and their oracle SQL."""

from __future__ import annotations

from strandline.plans import haplotype_queries, interval_queries, kmer_queries, pileup_queries, read_queries, typing_queries

_MODULES = (kmer_queries, interval_queries, pileup_queries, haplotype_queries, read_queries, typing_queries)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
