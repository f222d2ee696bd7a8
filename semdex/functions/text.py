"""Lines, languages by file ending, and renderings of results as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

#: Languages by lower-case file ending.
LANGUAGES = {
    ".java": "java", ".kt": "kotlin", ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".scala": "scala", ".gradle": "groovy", ".xml": "xml",
    ".yml": "yaml", ".yaml": "yaml", ".toml": "toml", ".sql": "sql", ".sh": "bash", ".bash": "bash", ".c": "c",
    ".cpp": "cpp", ".h": "cpp", ".hpp": "cpp", ".cs": "c_sharp",
}
OTHER = "text"


def suffix(path: Column) -> Column:
    """The file name's last ending with its dot, lower-cased; empty for none, or for a name that begins with its only dot."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), suffix(path)), F.lit(OTHER))


def normal_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


#: Characters that end a line, besides a line feed and what stands for it.
LINE_ENDS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def lines(text: Column) -> Column:
    """The lines of a text; an end-of-line at its very end begins none."""
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in "\r" + LINE_ENDS])  # a search for bytes, far cheaper than a pattern
    plain = F.when(odd, F.translate(normal_newlines(text), LINE_ENDS, "\n" * len(LINE_ENDS))).otherwise(text)
    whole = let(F.split(plain, "\n"), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(whole)


def joined(rows: Column) -> Column:
    """Lines on end, without empty lines at either end."""
    return F.trim(F.array_join(rows, "\n"), F.lit("\n"))


def listed(rows: Column, first: Column) -> Column:
    """An array's lines behind their numbers, as '  12 | line'."""
    return F.array_join(F.transform(rows, lambda x, i: F.concat(F.lpad((first + i).cast("string"), 4, " "), F.lit(" | "), x)), "\n")


def numbered(text: Column, first: Column) -> Column:
    """Each line of a text behind its number."""
    return listed(F.split(text, "\n"), first)


def compact(repo: Column, path: Column, line: Column, score: Column) -> Column:
    return F.format_string("%s:%s:%d  %.2f", repo, path, line, score)

