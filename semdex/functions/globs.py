"""File globs as regular expressions: case-sensitive, ``*`` and ``?`` also match ``/``, ``[^x]`` negates."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            negated = glob[i + 1 : i + 2] == "^"
            first = i + 1 + negated
            close = glob.find("]", first + 1)  # a bracket right after the opening one is a member
            if close < 0:
                return "(?!)"  # an unclosed class matches nothing
            members = re.sub(r"([\\\[\]&^~|])", r"\\\1", glob[first:close])
            out.append(f"[{'^' * negated}{members}]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def matches(path: Column, globs: str | Iterable[str]) -> Column:
    """Whether the path matches any of the globs."""
    each = [globs] if isinstance(globs, str) else sorted(set(globs))
    return reduce(lambda a, b: a | b, [path.rlike(to_regex(g)) for g in each], F.lit(False))
