"""Operators of a training-data pipeline, each with its registered query."""

from docflow.llm import alignment, bpe, crf, divergence, exact, html, langid, lines, mixing, pii, repeats, simhash, variants  # noqa: F401
from docflow.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
