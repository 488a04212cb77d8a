"""Queries and SQL of this subpackage's operators, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sharding", "line_dedup", "simhash", "merkle", "sstable", "packing", "bpe", "knn", "toxicity", "passages", "divergence", "hyperdim", "negatives")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"{__package__}.{module}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def sql() -> dict:
    return _merged("SQL")
