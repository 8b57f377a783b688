"""All core queries by name, and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("data_problems", "expression_queries", "relational_queries", "learn_queries", "model_queries", "model_closure", "stream_queries", "round_trip_queries")
FLAGSHIP = "p4_masks"


def _merged(attribute: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(import_module(f"fathom.plans.{m}"), attribute)
        if both := out.keys() & part.keys():
            raise ValueError(f"queries defined twice: {sorted(both)}")
        out |= part
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
