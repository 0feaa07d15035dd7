"""All registered queries: importing the modules fills the registry."""

from kappaframe.plans import (  # noqa: F401
    agreement_queries,
    example_queries,
    fairness_queries,
    recode_queries,
    similarity_queries,
    source_queries,
    split_queries,
    text_queries,
)
from kappaframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
