"""Queries of the training-data operators, by problem."""

from __future__ import annotations

import importlib

MODULES = ("distinctive", "copies", "clusters", "leaks", "containers", "quality", "languages", "sentences", "residue", "markup")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
