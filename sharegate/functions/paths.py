"""Path rules as Spark columns: names, extensions, globs, prunes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sharegate import policy
from sharegate.functions.sql import all_of, quote


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Lower-cased extension with its dot; leading dots belong to the stem."""
    bare = F.ltrim(F.lower(name), F.lit("."))
    return F.when(F.contains(bare, F.lit(".")), F.concat(F.lit("."), F.substring_index(bare, ".", -1))) \
            .otherwise(F.lit(""))


def suffix(name: Column) -> Column:
    """As :func:`extension`, but a trailing dot is no suffix and only one leading dot is skipped."""
    low = F.lower(name)
    tail = F.length(F.substring_index(low, ".", -1))
    return F.when((tail > 0) & (tail < F.length(low) - 1), F.concat(F.lit("."), F.substring_index(low, ".", -1))) \
            .otherwise(F.lit(""))


def parent_dir(path: Column) -> Column:
    """Directory part without the slash; '' for files at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/", 1)).otherwise(F.lit(""))


def ancestors(path: Column) -> Column:
    """All ancestor directories, shallowest first; empty for a file at the root."""
    parts = F.split(path, "/", -1)
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                    lambda i: F.array_join(F.slice(parts, 1, i), "/")),
    ).otherwise(F.array().cast("array<string>"))


def glob_regex(glob: str) -> str:
    """Whole-name glob (``* ? [seq] [!seq]``) as a Java regex; ``*`` spans everything."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (close := glob.find("]", i + (2 if glob[i:i + 1] == "!" else 1))) > 0:
            body, negate = glob[i:close], glob[i:i + 1] == "!"
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if negate else body)
            out.append(f"[{'^' if negate else ''}{body}]")
            i = close + 1
        else:
            out.append(c if c.isalnum() or c in "_/" else "\\" + c if ord(c) < 128 else c)
    return r"(?s)\A(?:" + "".join(out) + r")\z"


def glob_sql(name: str, glob: str) -> str:
    """Glob test on a name column as the cheapest string predicate that expresses it."""
    parts = glob.split("*")
    if "?" in glob or "[" in glob or len(parts) > 3 or (len(parts) == 3 and parts[0]):
        return f"rlike({name}, {quote(glob_regex(glob))})"
    if len(parts) == 1:
        return f"{name} = {quote(glob)}"
    head, tail = parts[0], parts[-1]
    tests = [f"length({name}) >= {sum(map(len, parts))}"] if head and tail else []
    tests += [f"startswith({name}, {quote(head)})"] if head else []
    tests += [f"endswith({name}, {quote(tail)})"] if tail else []
    if len(parts) == 3:
        # the middle must lie before the tail, so search it in the name without the tail
        tests.append(f"contains(left({name}, length({name}) - {len(tail)}), {quote(parts[1])})")
    return all_of(tests)


GLOB_PARTS = ("array<struct<text:string,size:int,sets:array<struct<k:int,negate:boolean,"
              "ranges:array<struct<lo:string,hi:string>>>>>>")


def glob_parts(glob: str) -> list[dict]:
    """A whole-name glob as the parts between its stars: a literal ``text``, or one set of characters per place."""
    parts, places, i = [], [], 0

    def close_part():
        literal = all(not negate and len(ranges) == 1 and ranges[0][0] == ranges[0][1] for negate, ranges in places)
        sets = None if literal else [{"k": k, "negate": n, "ranges": [{"lo": a, "hi": b} for a, b in r]} for k, (n, r) in enumerate(places)]
        parts.append({"text": "".join(r[0][0] for _, r in places) if literal else None, "size": len(places), "sets": sets})
        places.clear()

    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            close_part()
        elif c == "?":
            places.append((True, []))
        elif c == "[" and (end := glob.find("]", i + (2 if glob[i:i + 1] == "!" else 1))) > 0:
            negate = glob[i] == "!"
            body, ranges, k = glob[i + negate:end], [], 0
            while k < len(body):
                wide = body[k + 1:k + 2] == "-" and k + 2 < len(body)
                ranges.append((body[k], body[k + 2] if wide else body[k]))
                k += 3 if wide else 1
            places.append((negate, ranges))
            i = end + 1
        else:
            places.append((False, [(c, c)]))
    close_part()
    return [part for k, part in enumerate(parts) if part["size"] or k in (0, len(parts) - 1)]


def glob_match(name: Column, parts: Column) -> Column:
    """Does the name meet a glob given as a column of ``glob_parts``? Starts, ends and searches of literal pieces; no pattern is
    compiled. The leftmost place of each part between two stars is enough."""
    size, n = F.length(name), F.size(parts)
    head, tail = F.get(parts, F.lit(0)), F.get(parts, n - 1)

    def at(place: Column, part: Column) -> Column:
        def meets(s: Column) -> Column:
            char = F.substr(name, place + s["k"], F.lit(1))
            return F.exists(s["ranges"], lambda r: (char >= r["lo"]) & (char <= r["hi"])) != s["negate"]
        fits = (place >= 1) & (place + part["size"] - 1 <= size)
        return fits & F.when(part["text"].isNotNull(), F.substr(name, place, part["size"]) == part["text"]).otherwise(F.forall(part["sets"], meets))

    def after(place: Column, part: Column) -> Column:
        """The place behind the leftmost occurrence from ``place`` on, NULL without one."""
        last = size - part["size"] + 1
        literal = F.nullif(F.call_function("locate", part["text"], name, place), F.lit(0))
        other = F.when(last >= place, F.get(F.filter(F.sequence(place, F.greatest(last, place)), lambda p: at(p, part)), F.lit(0)))
        return (F.when(part["text"].isNotNull(), literal).otherwise(other) + part["size"]).cast("int")

    middles = F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0)))
    end = F.aggregate(middles, (head["size"] + 1).cast("int"), lambda place, part: F.when(place.isNotNull(), after(place, part)))
    starred = at(F.lit(1), head) & at(size - tail["size"] + 1, tail) & F.coalesce(end <= size - tail["size"] + 1, F.lit(False))
    return F.when(n == 1, (size == head["size"]) & at(F.lit(1), head)).otherwise(starred)


_GLOBS = [(rule, desc, glob) for rule, globs, desc in policy.PATH_RULES for glob in globs]


def _rule_sql(rule: str, desc: str, glob: str) -> str:
    return f"named_struct('rule', {quote(rule)}, 'desc', {quote(desc)}, 'glob', {glob})"


ALLOWED_NAMES = ", ".join(quote(n) for n in policy.PATH_ALLOWLIST)


def path_rule(name: str, deny_globs: tuple[str, ...] = ()) -> Column:
    """struct(rule, desc, glob) of the first path rule a base-name column meets, or NULL.

    ``deny_globs`` are run-wide literals. Allow-listed names never match a path rule."""
    low = f"lower({name})"
    cases = [(glob_sql(low, g.lower()), _rule_sql(*policy.USER_PATH_RULE, quote(g.lower()))) for g in deny_globs]
    cases += [(glob_sql(low, glob), _rule_sql(rule, desc, quote(glob))) for rule, desc, glob in _GLOBS]
    cases.append((f"contains({low}, '.bak') OR endswith({name}, '~') OR startswith({name}, '~$')",
                  _rule_sql("OPS-BACKUP", policy.OPS_RULES["OPS-BACKUP"], "'backup name pattern'")))
    return F.expr(f"CASE WHEN {low} IN ({ALLOWED_NAMES}) THEN NULL "
                  + " ".join(f"WHEN {test} THEN {row}" for test, row in cases) + " END")


def share_path_rule(name: str, found: str, globs: Column) -> Column:
    """The path rule of a file whose share denies names of its own (array of struct(glob, parts)): run-wide denied names come
    first, then the share's, then the fixed rules; ``found`` is the result of :func:`path_rule`."""
    matched = F.get(F.filter(globs, lambda g: glob_match(F.lower(F.col(name)), g["parts"])), F.lit(0))["glob"]
    own = F.when(~F.expr(f"lower({name}) IN ({ALLOWED_NAMES})"), matched)
    rule, desc = policy.USER_PATH_RULE
    denied = F.struct(F.lit(rule).alias("rule"), F.lit(desc).alias("desc"), own.alias("glob"))
    return F.when(F.expr(f"coalesce({found}.rule = {quote(rule)}, false)") | own.isNull(), F.col(found)).otherwise(denied)


_DIR_NAMES = [name for _, names, _ in policy.DIR_RULES for name in names]
_DIR_REGEX = ("(?s)(?:^|/)(" + "|".join(re.escape(n).replace("\\_", "_") for n in _DIR_NAMES)
              + "|" + policy.VENV_DIR_PATTERN + ")/")


def pruned_dir(path: Column) -> Column:
    """Shallowest ancestor directory that a directory rule names, '' when there is none.

    One literal pattern over the lower-cased path; the leftmost match is the shallowest."""
    return F.regexp_extract(F.lower(path), _DIR_REGEX, 1)


def dir_rule(dirname: str) -> Column:
    """Directory rule of a lower-cased directory-name column, or NULL."""
    cases = [f"WHEN {dirname} IN ({', '.join(map(quote, names))}) THEN {quote(rule)}"
             for rule, names, _ in policy.DIR_RULES]
    venv = quote(r"\A(?:" + policy.VENV_DIR_PATTERN + r")\z")
    return F.expr(f"CASE {' '.join(cases)} WHEN rlike({dirname}, {venv}) THEN 'OPS-DIR-BUILD' END")


def dir_depth(path: Column, dirname: Column) -> Column:
    """1-based depth of the first ancestor directory with this lower-cased name."""
    return F.array_position(F.split(F.lower(path), "/", -1), dirname)


def under_prefix(path: Column, prefix: Column) -> Column:
    bare = F.rtrim(prefix, F.lit("/"))
    return (path == bare) | F.startswith(path, F.concat(bare, F.lit("/")))


def is_source_name(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext == "", F.lower(name).isin(policy.SOURCE_EXTENSIONLESS)) \
            .otherwise(ext.isin(policy.SOURCE_EXTENSIONS))


def clean_relative(path: Column) -> Column:
    """Leading dots and slashes removed, the form ignore patterns are matched against."""
    return F.ltrim(path, F.lit("./"))
