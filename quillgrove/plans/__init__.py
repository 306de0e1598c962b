"""The registered queries of each family; importing them registers them."""

from quillgrove.plans import chunk_queries, dataset_queries, graph_queries, pipelines, retrieval_queries, source_queries, text_queries  # noqa: F401
