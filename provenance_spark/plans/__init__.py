"""Named query registry: importing this package registers every query."""

from provenance_spark.plans import (corpus_queries, model_queries, profile_queries,  # noqa: F401
                                    stream_queries, text_queries)
from provenance_spark.plans.registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
