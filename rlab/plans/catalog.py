"""All queries of the library: one entry per query, with its DuckDB twin where SQL can express it."""

from rlab.plans import corpus_queries, further_queries, grid_queries, retrieval_queries, source_queries, structure_queries, weighting_queries

FLAGSHIP = "bm25_ranking_metrics"
_MODULES = (retrieval_queries, corpus_queries, grid_queries, further_queries, source_queries, structure_queries, weighting_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
