"""Plain versions that the operators are held against."""

import hashlib
import re

ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
SECRETS = (
    ("assign", ASSIGN, lambda m: len(m.group(2)) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24),
)


def luhn(text):
    total = 0
    for i, c in enumerate(reversed(text)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m.group())) <= 15),
)


def spans(text, kinds):
    found = []
    for i, (kind, pattern, valid) in enumerate(kinds):
        found += [(m.start(), i, kind, m.end()) for m in pattern.finditer(text or "") if valid(m)]
    found.sort()
    listed = ",".join(f"{k}:{b}:{e}" for b, _, k, e in found)
    counts = [sum(f[2] == kind for f in found) for kind, _, _ in kinds]
    return counts, hashlib.sha256(listed.encode()).hexdigest(), listed
