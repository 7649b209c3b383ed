"""Loads every module that registers queries."""

from __future__ import annotations

from eventloom.llm import chat, decontaminate, hmm, language, mixing, negatives, neighbours, sanitize, simhash, spelling, tokenbin, toxicity, urlrules  # noqa: F401
from eventloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
