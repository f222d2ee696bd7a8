import sys
from dataclasses import dataclass
from types import SimpleNamespace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from semdex.functions import text as T
from semdex.functions.globs import matches, to_regex
from semdex.operators import chunk as C
from semdex.operators import syntax as S


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def chunked(spark, path, content, **options):
    files = spark.createDataFrame([(path, content, 1.5)], "file_path string, content string, file_mtime double")
    rows = C.chunk_files(files, **options).orderBy("line_start", "line_end").collect()
    return [(r["line_start"], r["line_end"], r["content"], r["lang"]) for r in rows]


def test_line_windows(spark):
    text = "\n".join(f"l{i}" for i in range(1, 101))
    found = chunked(spark, "x.yaml", text)
    assert [(a, b, d) for a, b, _, d in found] == [(1, 80, "yaml"), (41, 100, "yaml")]
    assert found[1][2].split("\n")[0] == "l41"
    assert chunked(spark, "x.yaml", "") == []
    assert [(a, b) for a, b, *_ in chunked(spark, "x.txt", "a\n" * 80)] == [(1, 80)]


def test_a_failing_parser_falls_back_to_lines(spark):
    def fails(source, lang):
        raise RuntimeError

    text = "\n".join("x" for _ in range(100))
    assert [(a, b, d) for a, b, _, d in chunked(spark, "x.py", text, parser=fails)] == [(1, 80, "python"), (41, 100, "python")]


def test_python_nodes_with_imports(spark):
    body = "import os\nfrom a import (\n  b,\n)\n\n\nclass A:\n" + "\n".join(f"  x{i} = {i}" for i in range(12)) + "\n\ndef f():\n" + "\n".join("  pass" for _ in range(11))
    found = chunked(spark, "m.py", body)
    assert [(a, b) for a, b, *_ in found] == [(1, 19), (21, 32)]
    assert found[0][2].startswith("import os\nfrom a import (\n  b,\n)\nclass A:") or found[0][2].startswith("import os\nfrom a import (\n  b,\n)\n")
    assert chunked(spark, "m.py", "x = 1")[0][:2] == (1, 1)  # nothing to find: by lines
    big = "def f():\n" + "\n".join("  pass" for _ in range(99))
    assert [(a, b) for a, b, *_ in chunked(spark, "m.py", big)] == [(1, 80), (41, 100)]


def merged(spark, spans, least=10):
    rows = [([(a, b, f"{a}") for a, b in spans],)]
    df = spark.createDataFrame(rows, f"s array<{C.SEGMENT}>")
    return [(x["line_start"], x["line_end"], x["content"]) for x in df.select(C.merge_small(F.col("s"), least)).first()[0]]


def test_merge_small(spark):
    assert merged(spark, [(1, 3), (4, 6), (7, 20), (21, 40), (41, 42)]) == [(1, 20, "1\n4\n7"), (21, 42, "21\n41")]
    assert merged(spark, [(1, 3)]) == [(1, 3, "1")]
    assert merged(spark, []) == []
    assert merged(spark, [(1, 12), (13, 30)]) == [(1, 12, "1"), (13, 30, "13")]


def block(spark, lines, lang):
    df = spark.createDataFrame([(lines, lang)], "lines array<string>, lang string")
    r = df.select(C.import_block(F.col("lines"), F.col("lang")).alias("b")).first()["b"]
    return None if r is None else (r["line_start"], r["line_end"], r["content"])


@pytest.mark.parametrize(
    ("lines", "lang", "expected"),
    [
        (["import (", '  "fmt"', ")", "func main() {}"], "go", (1, 3, 'import (\n  "fmt"\n)')),
        (["package main", '"odd"', "x"], "go", (1, 2, 'package main\n"odd"')),
        (["", "import a", "", "x = 1", "import b"], "python", (1, 3, "import a")),
        (["x = 1", "import b"], "python", None),
        (["#include <a>", "int x;"], "cpp", (1, 1, "#include <a>")),
        (["anything"], "text", None),
        ([], "python", None),
    ],
)
def test_import_block(spark, lines, lang, expected):
    assert block(spark, lines, lang) == expected


def test_imports_before_or_in_the_first_piece(spark):
    df = spark.createDataFrame([([(5, 20, "node")], (1, 3, "import"), (1, 6, "import"))], f"s array<{C.SEGMENT}>, a {C.SEGMENT}, b {C.SEGMENT}")
    glued, put = df.select(C.with_imports(F.col("s"), F.col("a")), C.with_imports(F.col("s"), F.col("b"))).first()
    assert [tuple(x) for x in glued] == [(1, 20, "import\nnode")]
    assert [tuple(x) for x in put] == [(1, 6, "import"), (5, 20, "node")]


@dataclass
class Node:
    """As much of a syntax tree's node as is read."""

    type: str
    first: int
    last: int
    children: tuple = ()

    @property
    def start_point(self):
        return self.first - 1, 0

    @property
    def end_point(self):
        return self.last - 1, 0


class Trees:
    """A parser that gives the same tree for any source."""

    def __init__(self, *children):
        self.root_node = Node("file", 1, 99, children)

    def parse(self, source):
        assert isinstance(source, bytes)
        return self


def by_tree(*children):
    tree = Trees(*children)
    return lambda source, lang: S.tree_nodes(source, lang, lambda _: tree)


def test_outermost_nodes():
    nodes = by_tree(Node("method_declaration", 30, 31), Node("comment", 1, 2), Node("box", 3, 25, (Node("class_declaration", 3, 20, (Node("method_declaration", 5, 8),)), Node("class_declaration", 20, 22))))
    assert nodes("", "java") == [(3, 20), (20, 22), (30, 31)]
    assert S.tree_nodes("", "java", lambda _: None) == []


@pytest.mark.parametrize(
    ("path", "head", "kind"),
    [
        ("A.java", ["package a;", "import b.C;"], "class_declaration"),
        ("a.go", ["package a", "import (", '  "fmt"', ")"], "function_declaration"),
        ("a.ts", ["import x from 'x'"], "function_declaration"),
        ("a.rs", ["use std::fmt;", "mod b;"], "impl_item"),
        ("a.rb", ["require 'set'"], "class"),
        ("a.cs", ["using System;"], "class_declaration"),
    ],
)
def test_syntax_chunks_of_other_languages(spark, path, head, kind):
    body = [f"body {i}" for i in range(30)]
    first = len(head) + 2
    found = chunked(spark, path, "\n".join([*head, "", *body]), parser=by_tree(Node(kind, first, first + 11), Node(kind, first + 12, first + 29)))
    assert [(a, b) for a, b, *_ in found] == [(1, first + 11), (first + 12, first + 29)]
    assert found[0][2] == "\n".join([*head, *body[:12]]) and found[1][2] == "\n".join(body[12:])


def test_large_and_small_nodes(spark):
    text = "\n".join(f"l{i}" for i in range(1, 121))
    parser = by_tree(Node("function_item", 1, 100), Node("struct_item", 101, 103), Node("struct_item", 104, 120))
    assert [(a, b) for a, b, *_ in chunked(spark, "a.rs", text, parser=parser)] == [(1, 80), (41, 100), (101, 120)]


def test_grammars_are_loaded_once(monkeypatch):
    """Whichever way a grammar's package offers it."""
    made, loads = [], []

    class Parser:
        def __init__(self, language=None):
            if language is not None and old:
                raise TypeError
            self.language = language

        def set_language(self, language):
            self.language = language

    library = SimpleNamespace(Language=lambda x: ("made", x), Parser=Parser)
    modules = {"tree_sitter": library, "tree_sitter_go": SimpleNamespace(language=lambda: "go"), "tree_sitter_php": SimpleNamespace(language_php=lambda: "php"), "tree_sitter_ruby": SimpleNamespace(LANGUAGE="ruby"), "tree_sitter_scala": SimpleNamespace()}

    def load(name):
        loads.append(name)
        if name not in modules:
            raise ModuleNotFoundError(name)
        return modules[name]

    monkeypatch.setattr(S.importlib, "import_module", load)
    for old in (False, True):
        S.grammar.cache_clear()
        made = [S.grammar(x) and S.grammar(x).language for x in ("go", "php", "ruby", "scala", "java", "text")]
        assert made == [("made", "go"), ("made", "php"), "ruby", None, None, None]
    assert loads.count("tree_sitter_go") == 2
    S.grammar.cache_clear()


def test_lines_end_where_text_says(spark):
    text = "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029k\n"
    assert spark.createDataFrame([(text,)], "t string").select(T.lines(F.col("t"))).first()[0] == text.splitlines()


def test_languages(spark):
    names = ["a.py", "B.PY", "x.h", "build.gradle", "r.md", "Makefile", ".bashrc", "a/b.tsx", "c.cs"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(T.language(F.col("p"))).collect()]
    assert got == ["python", "python", "cpp", "groovy", "text", "text", "text", "typescript", "c_sharp"]


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("src/*.py", "src/a/b.py", True), ("src/*.py", "SRC/a.py", False), ("a?c", "a/c", True), ("[^a]x", "bx", True), ("[^a]x", "ax", False), ("m[1-3]", "m2", True), ("a.c", "abc", False), ("[]x]", "]", True), ("[ab", "a", False), ("*", "", True)],
)
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(matches(F.lit(path), glob)).first()[0] is hit, to_regex(glob)


def test_invalid_text_is_set_apart(spark):
    files = spark.createDataFrame([("a", bytearray(b"x\r\ny\rz")), ("b", bytearray(b"\xff\xfe"))], "file_path string, content binary")
    good, bad = C.readable(files)
    assert [tuple(r) for r in good.collect()] == [("a", "x\ny\nz")]
    assert [r[0] for r in bad.collect()] == ["b"]
