"""Key patterns: * and ? stop at a slash; [a-z] and [^a-z] are classes; a backslash takes the next character as it is."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(glob: str) -> str | None:
    """An anchored regular expression; None if the pattern is malformed, which matches nothing."""
    out, i, n = [], 0, len(glob)
    while i < n:
        c = glob[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == n:
                return None
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[":
            negated = glob[i : i + 1] == "^"
            i += negated
            ranges = []
            while not (glob[i : i + 1] == "]" and ranges):
                ends = []
                for _ in range(2):
                    if glob[i : i + 1] == "\\":
                        i += 1
                    elif glob[i : i + 1] in ("-", "]", ""):
                        return None
                    if i >= n:
                        return None
                    ends.append(glob[i])
                    i += 1
                    if glob[i : i + 1] != "-" or len(ends) == 2:
                        break
                    i += 1
                ranges.append("-".join(re.escape(e) for e in ends))
                if i >= n:
                    return None
            i += 1
            out.append(f"[{'^' if negated else ''}{''.join(ranges)}]")
        else:
            out.append(re.escape(c))
    return "^" + "".join(out) + "$"


def prefix(glob: str) -> str:
    """What every match begins with, before the first special character."""
    return re.match(r"[^*?\[\\]*", glob)[0]


def matches(key: Column, glob: str) -> Column:
    """A bare * matches all. A fixed beginning becomes a comparison that reaches the scan."""
    if glob == "*":
        return F.lit(True)
    regex = to_regex(glob)
    if regex is None:
        return F.lit(False)
    test = key.rlike("(?s)" + regex)
    return key.startswith(prefix(glob)) & test if prefix(glob) else test
