"""Content rules as Spark columns: hits, attribution, fail-closed reading gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharegate import policy
from sharegate.functions.sql import all_of, any_of, quote, string_array
from sharegate.functions.text import fold_case, rx

RULES = [(r, p, d, "secret") for r, p, d in policy.CONTENT_RULES] + \
        [(r, p, d, "local") for r, p, d in policy.LOCAL_RULES]
N_SECRET = len(policy.CONTENT_RULES)


GUARDS = sorted({piece for sets, _ in policy.ANCHORS.values() for options in sets for piece in options})


def guards(text: str) -> Column:
    """struct of booleans: which of the pieces that rules need the text column holds."""
    return F.expr("struct(" + ", ".join(f"contains({text}, {quote(p)}) AS g{i}" for i, p in enumerate(GUARDS)) + ")")


def _guarded(guard: str, rule: str) -> str:
    return all_of([any_of([f"{guard}.g{GUARDS.index(piece)}" for piece in options])
                   for options in policy.ANCHORS[rule][0]])


def needs_fold(guard: str) -> Column:
    """True when a rule that looks at the case-folded text may still match."""
    return F.expr(any_of([_guarded(guard, r) for r, (_, words) in policy.ANCHORS.items() if words[0].startswith("~")]))


def anchor_test(text: str, folded: str, guard: str, rule: str) -> str:
    """SQL test that the text holds the literals the rule needs."""
    words = [f"contains({folded}, {quote(w[1:])})" if w.startswith("~") else f"contains({text}, {quote(w)})"
             for w in policy.ANCHORS[rule][1]]
    return f"{_guarded(guard, rule)} AND {any_of(words)}"


def content_hits(text: str, public: str = "true", *, folded: str | None = None, guard: str | None = None,
                 relaxed: bool = False, secrets_only: bool = False) -> Column:
    """array<struct<offset, ord, match_len>>: first match of every rule in a text column,
    NULL where none. ``public`` is an SQL condition that switches the local rules on.

    Offsets count code points. Struct order makes ``array_min`` the attribution: earliest
    offset, then rule order. With ``guard`` and ``folded`` (see :func:`with_hits`) a rule's
    pattern runs only on texts that pass its literal test. ``relaxed`` drops word
    boundaries (binary content).
    """
    out = []
    for order, (rule, pattern, _, family) in enumerate(RULES):
        if secrets_only and family != "secret":
            continue
        regex = quote(rx(pattern.replace(r"\b", "") if relaxed else pattern))
        tests = [f"({public})"] if family == "local" else []
        if guard is not None:
            tests.append(anchor_test(text, folded, guard, rule))
        tests.append(f"rlike({text}, {regex})")
        out.append(f"CASE WHEN {' AND '.join(tests)} THEN struct(length(split({text}, {regex}, 2)[0]) AS offset, "
                   f"{order} AS ord, length(regexp_extract({text}, {regex}, 0)) AS match_len) END")
    return F.expr("array(" + ", ".join(out) + ")")


def with_hits(df: DataFrame, text: str, out: str, public: str = "true", **options) -> DataFrame:
    """Adds ``content_hits`` of a text column. Guards and case folding are columns of their
    own stages, so that all rules share them."""
    guard, fold = f"{out}_guard", f"{out}_fold"
    return (df.withColumn(guard, guards(text))
              .withColumn(fold, F.when(needs_fold(guard), fold_case(F.col(text))))
              .withColumn(out, content_hits(text, public, folded=fold, guard=guard, **options))
              .drop(guard, fold))


# SQL text on a hit. get() and not element_at(): the latter ignores that the index may be NULL.

def hit_rule(ordinal: str) -> str:
    return f"get({string_array([r for r, *_ in RULES])}, {ordinal})"


def hit_desc(ordinal: str) -> str:
    return f"get({string_array([d for _, _, d, _ in RULES])}, {ordinal})"


def hit_family(ordinal: str) -> str:
    return f"CASE WHEN {ordinal} < {N_SECRET} THEN 'secret' WHEN {ordinal} IS NOT NULL THEN 'local' END"


def rule_set(hits: str) -> str:
    """Sorted rule IDs of all hits."""
    names = string_array([r for r, *_ in RULES])
    return f"array_sort(transform(filter({hits}, h -> h IS NOT NULL), h -> get({names}, h.ord)))"
