"""Imports every module that registers queries."""

from __future__ import annotations

from topolake.plans import q_corpus, q_functions, q_manifests, q_relations, q_rules, q_sources  # noqa: F401
from topolake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
