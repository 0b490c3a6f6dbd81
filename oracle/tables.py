"""DuckDB CTEs for the derived fact and dimension tables.

Rendered from the same rule table as the Spark derivation
(``adfunnel.sources.derived``), so both engines read identical inputs.
"""

from __future__ import annotations

from adfunnel.sources.derived import (
    ASSIGNMENT_PATTERNS, ASSIGNMENT_RULES, DIM_RULES, EVENT_TYPES, FACT_RULES,
)

ASG_TYPE = 'STRUCT(id BIGINT, "group" STRUCT(id BIGINT))[]'


def _duck(sql: str) -> str:
    return sql.format(div="//")


def _element(test_id: int, group: str | None) -> str:
    if group is None:
        grp = "NULL"
    elif group == "NULLID":
        grp = "{'id': NULL}"
    else:
        grp = "{'id': " + _duck(group) + "}"
    return "{'id': " + str(test_id) + ", 'group': " + grp + "}"


def _assignments(pattern: str, gate: str | None) -> str:
    arms = []
    for number, items in ASSIGNMENT_PATTERNS.items():
        if items is None:
            value = f"NULL::{ASG_TYPE}"
        else:
            value = "[" + ", ".join(_element(t, g) for t, g in items) + f"]::{ASG_TYPE}"
        arms.append(f"WHEN {number} THEN {value}")
    expr = f"CASE ({_duck(pattern)}) {' '.join(arms)} END"
    return expr if gate is None else f"CASE WHEN {_duck(gate)} THEN {expr} END"


def table_ctes() -> str:
    """``WITH``-less CTE list: ev, the five facts and the four dimensions."""
    parts = [
        "ev AS (SELECT event_id AS e, user_id AS u, epoch_us(ts) // 1000 AS ms, value AS v, "
        "event_type, strftime(ts, '%Y-%m-%dT%H') AS dt FROM events)"
    ]
    for name, where in EVENT_TYPES.items():
        cols = [f'{_duck(sql)} AS "{col}"' for col, sql in FACT_RULES[name]]
        cols += [f'{_assignments(p, g)} AS "{col}"' for col, p, g in ASSIGNMENT_RULES[name]]
        parts.append(f"{name} AS (SELECT {', '.join(cols)} FROM ev WHERE {_duck(where)})")
    for name, (table, rules) in DIM_RULES.items():
        cols = ", ".join(f"{_duck(sql)} AS {col}" for col, sql in rules)
        parts.append(f"{name} AS (SELECT {cols} FROM {table})")
    return ",\n".join(parts)
