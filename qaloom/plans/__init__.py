"""Registered queries, by theme; ``load`` imports the themes and returns (queries, oracle SQL)."""

from __future__ import annotations

import importlib

from .registry import ORACLE, QUERIES

THEMES = ("leaderboard", "lengths", "curation", "alignment", "text_json", "prompts", "files", "similarity", "volumes", "incremental")


def load() -> tuple[dict, dict]:
    for theme in THEMES:
        importlib.import_module(f"{__name__}.{theme}")
    return QUERIES, ORACLE
