"""Locally optimised product quantisation: training, encoding, search and its evaluation."""

from umbel.lopq.model import LOPQModel
from umbel.lopq.search import build_index, search

__all__ = ["LOPQModel", "build_index", "search"]
