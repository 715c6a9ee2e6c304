"""Text helpers as Spark columns: decoding, lines, offsets, block rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sharegate import policy
from sharegate.functions.sql import any_of, quote

# Unicode classes and only "\n" as a line end: how the policy's patterns are meant.
DIALECT = "(?Ud)"

# Zero-width split point behind every line terminator, so terminators stay attached.
LINE_SPLIT = r"(?<=\r\n|[\n\x0B\x0C\x1C-\x1E\u0085\x{2028}\x{2029}])|(?<=\r)(?!\n)"
LINE_END_TRIM = r"[\s\x1C-\x1F]+$"


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``value`` bound to a name, so that it is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def rx(pattern: str) -> str:
    return DIALECT + pattern


def valid_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def decode_text(content: Column) -> Column:
    """UTF-8 when the bytes are valid UTF-8, latin-1 otherwise."""
    return F.when(valid_utf8(content), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def decode_replace(content: Column) -> Column:
    """UTF-8 with U+FFFD for malformed bytes."""
    return F.make_valid_utf8(content.cast("string"))


def decode_ignore(content: Column) -> Column:
    """UTF-8 with malformed bytes dropped; a genuine U+FFFD in valid text stays."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.translate(F.make_valid_utf8(text), "\ufffd", ""))


def strip_invisible(text: str) -> Column:
    """Delete zero-width characters from a text column. ``translate`` walks every character,
    so it only runs on texts in which a byte search finds one."""
    present = any_of([f"contains({text}, {quote(c)})" for c in policy.INVISIBLE])
    return F.expr(f"if({present}, translate({text}, {quote(policy.INVISIBLE)}, ''), {text})")


def fold_case(text: Column) -> Column:
    """Lower case that also maps the long s, so that it covers every text a
    case-insensitive Unicode pattern over ASCII letters can match."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("\u017f")), F.translate(low, "\u017f", "s")).otherwise(low)


def lines_keepends(text: str) -> str:
    """SQL array of lines with their terminators; '' follows a final terminator."""
    return f"split({text}, {quote(LINE_SPLIT)}, -1)"


def prefix_starts(lengths: str) -> str:
    """SQL array of start offsets, given the lengths of consecutive pieces.

    Appending inside one fold copies the array at every step, which is quadratic. Blocks
    of about sqrt(n) pieces keep it near n^1.5 for texts with very many pieces.
    """

    def running(values: str, base: str) -> str:
        return (f"aggregate({values}, named_struct('pos', cast({base} AS int), 'out', cast(array() AS array<int>)), "
                "(acc, n) -> named_struct('pos', cast(acc.pos + n AS int), 'out', concat(acc.out, array(acc.pos))), "
                "acc -> acc.out)")

    blocks = "if(size(ns) > 0, sequence(0, cast((size(ns) - 1) div w AS int)), cast(array() AS array<int>))"
    chunks = let("w", "cast(greatest(1, ceil(sqrt(size(ns)))) AS int)",
                 f"transform({blocks}, b -> slice(ns, b * w + 1, w))")
    sums = "transform(cs, c -> aggregate(c, 0, (a, n) -> cast(a + n AS int)))"
    joined = f"flatten(zip_with(cs, {running(sums, '0')}, (c, at) -> {running('c', 'at')}))"
    return let("ns", lengths, let("cs", chunks, joined))


def rendered_lines(text: str) -> str:
    """SQL array of lines without a last empty one: a final terminator opens no further line."""
    return let("parts", lines_keepends(text),
               "if(element_at(parts, -1) = '', slice(parts, 1, size(parts) - 1), parts)")


def render_block(path: str, extension: str, text: str) -> str:
    """SQL for one file as a fenced, line-numbered block."""
    fences = "map(" + ", ".join(f"{quote(k)}, {quote(v)}" for k, v in policy.LANGUAGE_FENCES.items()) + ")"
    number = "lpad(cast(i + 1 AS string), greatest(4, length(cast(i + 1 AS string))), ' ')"
    numbered = (f"transform({rendered_lines(text)}, (x, i) -> concat({number}, ' | ', "
                f"regexp_replace(x, {quote(rx(LINE_END_TRIM))}, '')))")
    return (f"concat('### ', {path}, '\\n```', coalesce(element_at({fences}, ltrim('.', {extension})), ''), '\\n', "
            f"array_join({numbered}, '\\n'), '\\n```\\n\\n')")
