"""Plain-Python statements of what the operators must give, for small fixtures."""

import re

from sharegate import policy

INVISIBLE = {ord(c): None for c in policy.INVISIBLE}


def first_hits(text, public=True):
    rules = list(policy.CONTENT_RULES) + (list(policy.LOCAL_RULES) if public else [])
    out = []
    for order, (rule, pattern, _) in enumerate(rules):
        found = re.search(pattern, text.translate(INVISIBLE))
        if found:
            out.append((found.start(), order, rule, found.end() - found.start()))
    return sorted(out)


def personal(text, allow=(), skip_author=True):
    out, pos = [], 0
    for line in text.splitlines(keepends=True):
        if not (skip_author and re.search(policy.AUTHOR_PATTERN, line)):
            for order, (rule, pattern, _) in enumerate(policy.PII_RULES):
                out += [(pos + m.start(), order, m.end() - m.start()) for m in re.finditer(pattern, line)
                        if m.group() not in allow]
        pos += len(line)
    return sorted(out)


def redacted(text, allow=(), skip_author=True):
    out = []
    for line in text.splitlines(keepends=True):
        if not (skip_author and re.search(policy.AUTHOR_PATTERN, line)):
            for _, pattern, token in policy.PII_RULES:
                line = re.sub(pattern, lambda m: m.group() if m.group() in allow else token, line)
        out.append(line)
    return "".join(out)


def bins(items, limit):
    """items: (size, path, n) -> {path: bin}"""
    number, fill, out = 0, 0, {}
    for size, path, n in sorted(items):
        if number == 0 or (fill and fill + n > limit):
            number, fill = number + 1, 0
        out[path], fill = number, fill + n
    return out


def plan(archives, now_days, days, cap, keep=None):
    """archives: (name, age in days, bytes) -> deleted names"""
    rest = [a for a in sorted(archives, key=lambda a: (-a[1], a[0])) if a[0] != keep]
    gone = [a[0] for a in rest if days > 0 and a[1] > days]
    left = [a for a in rest if a[0] not in gone]
    total = sum(a[2] for a in left) + sum(a[2] for a in archives if a[0] == keep)
    for name, _, size in left:
        if cap <= 0 or total <= cap:
            break
        gone.append(name)
        total -= size
    return set(gone)
