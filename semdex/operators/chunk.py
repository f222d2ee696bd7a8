"""Splitting of files: line windows, syntax nodes, merging of small pieces, and the import block.

Line windows, the merge and the import block are built-in expressions over arrays of lines. Syntax
nodes come from a parser that is plugged in, by default from installed grammars. A file whose parser
is missing, fails or finds nothing is split by lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import joined, language, lines, normal_newlines
from .syntax import syntax_nodes

MOST_LINES, LEAST_LINES, OVERLAP = 80, 10, 0.5

#: What begins a line of an import block, by language.
IMPORTS = {
    "java": ("package ", "import "),
    "kotlin": ("package ", "import "),
    "python": ("import ", "from "),
    "javascript": ("import ",),
    "typescript": ("import ",),
    "go": ("package ", "import "),
    "rust": ("use ", "mod ", "#![", "extern crate "),
    "ruby": ("require ", "require_relative "),
    "php": ("<?php", "use ", "require", "include"),
    "scala": ("package ", "import "),
    "groovy": ("package ", "import "),
    "c": ("#include",),
    "cpp": ("#include",),
    "c_sharp": ("using ", "namespace "),
}
SEGMENT = "struct<line_start:int,line_end:int,content:string>"

#: From a file's source and language: (first line, last line) of its outermost nodes, from 1.
Parser = Callable[[str, str], list[tuple[int, int]]]


def _segment(start: Column, end: Column, content: Column) -> Column:
    return F.struct(start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), content.alias("content"))


def step_of(most: int = MOST_LINES, overlap: float = OVERLAP) -> int:
    return max(1, round(most * (1 - overlap)))


def windows(rows: Column, most: int = MOST_LINES, overlap: float = OVERLAP, first: Column | int = 1) -> Column:
    """Overlapping windows over an array of lines, the last of which ends with it."""
    step = step_of(most, overlap)
    first = F.lit(first) if isinstance(first, int) else first

    def cut(r: Column) -> Column:
        n = F.size(r)
        last = F.greatest(F.lit(0), F.ceil((n - most) / step).cast("int")) * step
        return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: _segment(first + s, first + F.least(n, s + most) - 1, joined(F.slice(r, s + 1, most))))

    return let(rows, lambda r: F.when(F.size(r) > 0, cut(r)).otherwise(F.array().cast(f"array<{SEGMENT}>")))


def _glued(a: Column, b: Column) -> Column:
    parts = F.filter(F.array(a["content"], b["content"]), lambda x: x != "")
    return _segment(F.least(a["line_start"], b["line_start"]), F.greatest(a["line_end"], b["line_end"]), joined(parts))


def merge_small(segments: Column, least: int = LEAST_LINES) -> Column:
    """From left to right, a piece below ``least`` lines takes the next one in; a small last one joins the one before it."""
    size = lambda s: s["line_end"] - s["line_start"] + 1
    none = F.array().cast(f"array<{SEGMENT}>")

    def take(acc: Column, x: Column) -> Column:
        small = size(acc["held"]) < least
        out = F.when(small, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["held"])))
        return F.struct(out.alias("out"), F.when(small, _glued(acc["held"], x)).otherwise(x).alias("held"))

    def finish(acc: Column) -> Column:
        out, held, n = acc["out"], acc["held"], F.size(acc["out"])
        tail = F.concat(F.slice(out, 1, F.greatest(n - 1, F.lit(0))), F.array(_glued(F.element_at(out, -1), held)))
        return F.when((n > 0) & (size(held) < least), tail).otherwise(F.concat(out, F.array(held)))

    start = F.struct(none.alias("out"), F.element_at(segments, 1).cast(SEGMENT).alias("held"))
    folded = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), start, take, finish)
    return F.when(F.size(segments) > 0, folded).otherwise(none)


def import_block(rows: Column, lang: Column) -> Column:
    """The file's leading imports as a piece from line 1, or null.

    Blank lines count once an import was seen. A line that ends in an opening parenthesis begins a
    group, which ends with a line of a closing one. In Go, a quoted line after an import belongs to
    them. Any other line ends the block.
    """
    prefixes = F.try_element_at(F.create_map(*[x for k, v in IMPORTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), lang)

    def take(acc: Column, line: Column) -> Column:
        text = F.trim(line, F.lit(" \t\r\n\x0b\f"))
        starts = F.coalesce(F.exists(prefixes, lambda p: text.startswith(p)), F.lit(False))
        quoted = (lang == "go") & acc["seen"] & text.startswith('"')
        blank = text == ""
        on = ~acc["over"]
        keep = on & (acc["group"] | (blank & (F.size(acc["kept"]) > 0)) | (~blank & (starts | quoted)))
        number = acc["number"] + 1
        return F.struct(
            number.alias("number"),
            F.when(keep, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"),
            F.when(keep, number).otherwise(acc["end"]).alias("end"),
            F.when(on & acc["group"], text != ")").when(on & ~blank & starts, text.endswith("(")).otherwise(acc["group"]).alias("group"),
            (acc["seen"] | (on & ~acc["group"] & ~blank & starts)).alias("seen"),
            (acc["over"] | (on & ~acc["group"] & ~blank & ~starts & ~quoted)).alias("over"),
        )

    start = F.struct(
        F.lit(0).alias("number"), F.array().cast("array<string>").alias("kept"), F.lit(0).alias("end"),
        F.lit(False).alias("group"), F.lit(False).alias("seen"), F.lit(False).alias("over"),
    )
    end = lambda acc: F.when(acc["seen"], _segment(F.lit(1), acc["end"], joined(acc["kept"])))
    return F.when(prefixes.isNotNull(), F.aggregate(rows, start, take, end))


def with_imports(segments: Column, block: Column) -> Column:
    """Pieces with the import block: glued to the first if it ends before that begins, else put before it."""
    first = F.element_at(segments, 1)
    glued = F.concat(F.array(_segment(block["line_start"], first["line_end"], joined(F.filter(F.array(block["content"], first["content"]), lambda x: x != "")))), F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))))
    return F.when(block.isNull() | (F.size(segments) == 0), segments).when(block["line_end"] < first["line_start"], glued).otherwise(F.concat(F.array(block), segments))


def readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (file_path, content as bytes, ...) with text instead of bytes, and those that aren't UTF-8."""
    text = F.col("content").cast("string")
    rows = files.withColumn("_ok", F.is_valid_utf8(text))
    return rows.filter("_ok").withColumn("content", normal_newlines(text)).drop("_ok"), rows.filter("NOT _ok").drop("_ok", "content")


def chunk_files(files: DataFrame, parser: Parser | None = syntax_nodes, most: int = MOST_LINES, least: int = LEAST_LINES, overlap: float = OVERLAP) -> DataFrame:
    """(the columns of ``files`` but content, line_start, line_end, content, lang); files: file_path, content, ..."""
    rows = files.withColumn("lang", language(F.col("file_path"))).withColumn("_lines", lines(F.col("content")))
    by_lines = windows(F.col("_lines"), most, overlap)
    if parser is None:
        rows = rows.withColumn("_segments", by_lines)
    else:
        kept = [f for f in rows.schema if f.name != "_lines"]

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for source, lang in zip(batch.column("content").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    try:
                        found.append([{"s": s, "e": e} for s, e in parser(source, lang) if s <= e])
                    except Exception:  # whatever a parser fails with, the file is split by lines
                        found.append([])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], [*batch.schema.names, "_nodes"])

        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "_nodes array<struct<s:int,e:int>>"])
        rows = rows.drop("_lines").mapInArrow(parse, schema).withColumn("_lines", lines(F.col("content")))

        def pieces(text: Column) -> Column:
            node = lambda x: F.slice(text, x["s"], x["e"] - x["s"] + 1)
            piece = lambda x: F.when(x["e"] - x["s"] + 1 > most, windows(node(x), most, overlap, x["s"])).otherwise(F.array(_segment(x["s"], x["e"], joined(node(x)))))
            return F.flatten(F.transform(F.filter("_nodes", lambda x: x["s"] <= F.size(text)), piece))

        rows = rows.withColumn("_pieces", let(F.col("_lines"), pieces))
        rows = rows.withColumn("_merged", merge_small(F.col("_pieces"), least)).withColumn("_block", import_block(F.col("_lines"), F.col("lang")))
        rows = rows.withColumn("_segments", F.when(F.size("_pieces") > 0, with_imports(F.col("_merged"), F.col("_block"))).otherwise(by_lines))
    keep = [c for c in files.columns if c not in ("content", "lang")]
    return rows.select(*keep, "lang", F.explode("_segments").alias("_s")).select(*keep, "_s.line_start", "_s.line_end", "_s.content", "lang")
