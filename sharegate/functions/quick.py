"""Quick-scan rules as Spark columns: paths, plain secrets, base64 and hex decodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sharegate import policy
from sharegate.functions.text import decode_ignore, rx

# a literal each rule needs, so that its pattern only runs where it can match
_NEEDS = {"SEC-CONT-AWS": "AKIA", "SEC-CONT-OPENAI": "sk-", "SEC-CONT-PRIVKEY": " PRIVATE KEY", "LOC-HOST": ".corp.internal"}
_SECRETS = [(rule, rx(pattern)) for rule, pattern in policy.QUICK_SECRETS]
_FINDING = "struct<rule:string,severity:string,detail:string>"


def _finding(rule: str, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit("high").alias("severity"), detail.alias("detail")).cast(_FINDING)


def _matches(text: Column, rule: str, regex: str) -> Column:
    return F.contains(text, F.lit(_NEEDS[rule])) & text.rlike(regex)


def first_secret(text: Column) -> Column:
    """First secret rule, in rule order, that matches the text; NULL when none does."""
    out = F.when(text.isNull(), F.lit(None))
    for rule, regex in _SECRETS:
        out = out.when(_matches(text, rule, regex), F.lit(rule))
    return out


def base64_decodes(text: Column) -> Column:
    """Decodes of all base64-like runs, lenient on padding. A body one character
    over a multiple of four cannot be decoded and is NULL."""
    tokens = F.regexp_extract_all(text, F.lit(policy.QUICK_BASE64), F.lit(0))
    return F.transform(tokens, lambda t: F.when(
        F.length(F.rtrim(t, F.lit("="))) % 4 != 1, decode_ignore(F.unbase64(F.rtrim(t, F.lit("="))))))


def hex_decodes(text: Column) -> Column:
    """Decodes of hex runs with an even number of digits; NULL for the others."""
    tokens = F.regexp_extract_all(text, F.lit(policy.QUICK_HEX), F.lit(0))
    digits = F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit("0x")), F.substring(t, 3, 1 << 30)).otherwise(t))
    return F.transform(digits, lambda d: F.when(F.length(d) % 2 == 0, decode_ignore(F.unhex(d))))


def encoded_secret(text: Column) -> Column:
    """Rule of the first decoded run that is a secret itself, base64 runs before hex runs."""
    has_run = text.rlike(r"[A-Za-z0-9+/]{16}")
    decoded = F.concat(base64_decodes(text), hex_decodes(text))
    rules = F.filter(F.transform(decoded, first_secret), lambda r: r.isNotNull())
    return F.when(has_run, F.get(rules, F.lit(0)))


def quick_findings(path: Column, text: Column) -> Column:
    """array<struct<rule, severity, detail>> of one file: path rules, plain secrets, encoded.

    Each rule appears at most once per file, as the first finding in that order. A NULL
    text (unreadable file) leaves the path findings only."""
    found = [F.when(path.rlike(rx(p)), _finding(r, F.lit("dangerous filename"))) for r, p in policy.QUICK_PATH_RULES]
    found += [F.when(_matches(text, r, p), _finding(r, F.lit("secret in content"))) for r, p in _SECRETS]
    hidden = encoded_secret(text)
    found.append(F.when(hidden.isNotNull(),
                        _finding("SEC-CONT-ENCODED", F.concat(F.lit("encoded "), hidden, F.lit(" secret")))))
    return F.array_compact(F.array(*found))
