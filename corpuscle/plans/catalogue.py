"""All queries of the library itself."""

from . import answering, assembly, parsing, planning, records, relations, retrieval, shown, state, structure, talk  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
