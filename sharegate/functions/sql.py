"""SQL text for the large rule expressions.

A rule set is a few hundred operators. Written as SQL text it reaches the JVM in one call,
where building it operator by operator from Python takes seconds per query.
"""

from __future__ import annotations


def quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values) -> str:
    return "array(" + ", ".join(quote(v) for v in values) + ")"


def any_of(tests: list[str]) -> str:
    return tests[0] if len(tests) == 1 else "(" + " OR ".join(tests) + ")"


def all_of(tests: list[str]) -> str:
    return "(" + " AND ".join(tests) + ")" if tests else "true"
