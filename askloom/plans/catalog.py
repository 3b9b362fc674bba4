"""Imports every query module, which fills the registry."""

from askloom.plans import corpus_queries  # noqa: F401
from askloom.plans import retrieval_queries  # noqa: F401
from askloom.plans import evaluation_queries, library_queries  # noqa: F401
from askloom.plans import streaming_queries  # noqa: F401
