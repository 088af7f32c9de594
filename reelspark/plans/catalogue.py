"""Queries of the engine and their oracle SQL: importing the topics fills the registry."""

from __future__ import annotations

from . import extras, files, generators, manifests, metrics, pixels, vectors, windows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
