"""Personal-data rules as Spark columns: hits with offsets, first hit, redaction.

``allow`` is a tuple of values that are never findings, or the name of an array column.
``skip`` is an SQL condition: leave out findings on lines that name an author.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sharegate import policy
from sharegate.functions.sql import any_of, quote, string_array
from sharegate.functions.text import let, lines_keepends, prefix_starts, rx

_RULES = [(i, rule, quote(rx(pattern)), quote(token)) for i, (rule, pattern, token) in enumerate(policy.PII_RULES)]
_AUTHOR = quote(rx(policy.AUTHOR_PATTERN))
_NONE = "cast(array() AS array<struct<offset:int,ord:int,match_len:int>>)"
_NO_FACTS = "cast(array() AS array<struct<offset:int,ord:int,match_len:int,value:string,author:boolean>>)"


def may_hold_pii(text: str) -> str:
    """SQL: does any rule match somewhere? Keeps the line work off clean texts."""
    email, *others = [f"rlike({text}, {regex})" for _, _, regex, _ in _RULES]
    return any_of([f"contains({text}, '@') AND {email}", *others])


def pii_rule(ordinal: str) -> Column:
    return F.expr(f"get({string_array([r for _, r, _, _ in _RULES])}, {ordinal})")


def _allow_sql(allow) -> str | None:
    return allow if isinstance(allow, str) else string_array(allow) if allow else None


def _rule_hits(order: int, regex: str, allow: str | None, more: str = "", none: str = _NONE) -> str:
    """Hits of one rule in line ``x.l``, from its matches and the gaps before them."""
    spans = prefix_starts("zip_with(gs, vs, (g, v) -> length(g) + length(v))")
    hit = f"named_struct('offset', cast(x.s + z.st + length(z.gs) AS int), 'ord', {order}, 'match_len', length(z.vs){more})"
    pieces = let("st", spans, "arrays_zip(st, gs, vs)")
    if allow is not None:
        pieces = f"filter({pieces}, p -> NOT array_contains({allow}, p.vs))"
    hits = let("vs", f"regexp_extract_all(x.l, {regex}, 0)",
               let("gs", f"slice(split(x.l, {regex}, -1), 1, size(vs))", f"transform({pieces}, z -> {hit})"))
    return f"if(rlike(x.l, {regex}), {hits}, {none})"


def pii_hits(text: str, allow=None, skip: str = "true") -> Column:
    """array<struct<offset, ord, match_len>> of all hits in a text column, in text order
    (ties: rule order).

    No rule can match across a line end, so lines are handled one by one: that gives each
    match its author context without looking it up by offset. Matched values are not kept.
    """
    allow = _allow_sql(allow)
    numbered = let("s", prefix_starts("transform(l, y -> length(y))"), "arrays_zip(l, s)")
    wanted = f"filter({numbered}, x -> {may_hold_pii('x.l')} AND NOT (({skip}) AND rlike(x.l, {_AUTHOR})))"
    per_line = "concat(" + ", ".join(_rule_hits(order, regex, allow) for order, _, regex, _ in _RULES) + ")"
    hits = let("l", lines_keepends(text), f"array_sort(flatten(transform({wanted}, x -> {per_line})))")
    return F.expr(f"CASE WHEN {text} IS NULL THEN NULL WHEN {may_hold_pii(text)} THEN {hits} ELSE {_NONE} END")


def pii_facts(text: str) -> Column:
    """All hits as :func:`pii_hits` finds them, each with the SHA-256 of its value and whether its line names an author, so that
    allowed values and author lines can be left out later, by settings that the text need not meet."""
    numbered = let("s", prefix_starts("transform(l, y -> length(y))"), "arrays_zip(l, s)")
    more = f", 'value', sha2(z.vs, 256), 'author', rlike(x.l, {_AUTHOR})"
    per_line = "concat(" + ", ".join(_rule_hits(order, regex, None, more, _NO_FACTS) for order, _, regex, _ in _RULES) + ")"
    hits = let("l", lines_keepends(text), f"array_sort(flatten(transform(filter({numbered}, x -> {may_hold_pii('x.l')}), x -> {per_line})))")
    return F.expr(f"CASE WHEN {text} IS NULL THEN NULL WHEN {may_hold_pii(text)} THEN {hits} ELSE {_NO_FACTS} END")


def _redacted(text: str, allow: str | None) -> str:
    for order, _, regex, token in _RULES:
        if allow is None:
            text = f"regexp_replace({text}, {regex}, {token})"
        else:
            kept = f"CASE WHEN v IS NULL THEN '' WHEN array_contains({allow}, v) THEN v ELSE {token} END"
            text = let(f"t{order}", text, f"array_join(zip_with(split(t{order}, {regex}, -1), "
                       f"regexp_extract_all(t{order}, {regex}, 0), (g, v) -> concat(g, {kept})), '')")
    return text


def redact_pii(text: str, allow=None, skip: str = "true") -> Column:
    """Text column with every finding replaced by its token; author lines and allowed values
    stay. Lines are only cut up for texts that name an author."""
    allow = _allow_sql(allow)
    by_line = (f"array_join(transform({lines_keepends(text)}, x -> "
               f"if(rlike(x, {_AUTHOR}), x, {_redacted('x', allow)})), '')")
    return F.expr(f"CASE WHEN NOT {may_hold_pii(text)} THEN {text} "
                  f"WHEN ({skip}) AND rlike({text}, {_AUTHOR}) THEN {by_line} ELSE {_redacted(text, allow)} END")
