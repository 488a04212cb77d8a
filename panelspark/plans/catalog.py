"""Registered queries and their SQL."""

from __future__ import annotations

from . import models, relational, staged


def queries() -> dict:
    return relational.Q | models.Q | staged.Q


def oracle_sql() -> dict:
    return relational.SQL | models.SQL | staged.SQL
