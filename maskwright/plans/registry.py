"""Importing the query modules fills the registry."""

from __future__ import annotations

from . import configs, detectors, dictionaries, histories, renders, scans, streams, sweeps, tables, vaults  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
