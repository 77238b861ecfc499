"""Parsers of generated text: sections, function ranges, token streams, similarity bands."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import text


def numbered_lines(docs: DataFrame, key: str, said: str) -> DataFrame:
    """(key, line_no, line), from 0."""
    return docs.select(key, F.posexplode(text.lines(F.col(said))).alias("line_no", "line"))


def sections(lines: DataFrame, key: str, marker: Column) -> DataFrame:
    """(key, section, first, last): what each marker line opens, up to the next; section 0 has no marker."""
    order = Window.partitionBy(key).orderBy("line_no")
    return lines.withColumn("section", F.sum(marker.cast("int")).over(order)).groupBy(key, "section").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))


def function_ranges(lines: DataFrame, key: str, opens: Column, gap: int = 2) -> DataFrame:
    """(key, start, end): functions end `gap` lines before the next opens, the last at the end of the file."""
    starts = lines.where(opens).select(key, F.col("line_no").alias("start"))
    last = lines.groupBy(key).agg(F.max("line_no").alias("eof"))
    following = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    return starts.withColumn("next", following).join(last, key).select(key, "start", F.coalesce(F.col("next") - gap, F.col("eof")).alias("end"))


def python_functions(docs: DataFrame, key: str, said: str) -> DataFrame:
    """(key, name, start, end) of top-level functions by the parser; texts that do not parse have none."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    body = ast.parse(t or "").body
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                rows += [(k, x.name, x.lineno, x.end_lineno) for x in body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int32()) for i in (2, 3))], [key, "name", "start", "end"])

    return docs.select(key, said).mapInArrow(run, f"{key} {kind}, name string, start int, end int")


#: Comments and literals of the brace languages, and what stands before a block that is no function.
MASKED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.S)
BLOCKS = frozenset("if for while switch catch foreach using lock synchronized do else try return new when fixed".split())
SIGNATURE = re.compile(r"(?<!\w)(\w++)\s*+\([^()]*+\)[^()]*+\Z")


def braced(code: str) -> list[tuple[str, int, int]]:
    """(name, start, end) of the outermost functions of C, C#, C++ or Java code; lines from 1. One walk over braces."""
    code = MASKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    out, depth, since, held, line, last = [], 0, 0, None, 1, 0
    for m in re.finditer(r"[{};]", code):
        line += code.count("\n", last, m.start())
        last = m.start()
        if m[0] == "{":
            head = code[since : m.start()]
            found = SIGNATURE.search(head) if held is None else None
            if found and found[1] not in BLOCKS and not re.search(r"\b(?:class|struct|enum|interface|namespace|record)\b", head):
                held = (found[1], line - head.lstrip().count("\n"), depth)
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
            if held and depth == held[2]:
                out.append((held[0], held[1], line))
                held = None
        since = m.end()
    return out


def brace_functions(docs: DataFrame, key: str, said: str) -> DataFrame:
    """(key, name, start, end) of the functions of brace languages."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *f) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f in braced(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int32()) for i in (2, 3))], [key, "name", "start", "end"])

    return docs.select(key, said).mapInArrow(run, f"{key} {kind}, name string, start int, end int")


def layout_python(tokens: str) -> str:
    """Code from tokens with NEW_LINE, INDENT and DEDENT among them, each a whole token; empty lines are left out."""
    out, depth, words = [], 0, []
    for w in [*tokens.split(), "NEW_LINE"]:
        if w in ("INDENT", "DEDENT"):
            depth = depth + 1 if w == "INDENT" else max(0, depth - 1)
        elif w != "NEW_LINE":
            words.append(w)
        elif words:
            out.append("    " * depth + " ".join(words))
            words = []
    return "\n".join(out)


def layout_braces(tokens: str) -> str:
    """Code from tokens of which braces and semicolons end lines."""
    out, depth, held = [], 0, []

    def end() -> None:
        if held:
            out.append("    " * depth + " ".join(held))
            held.clear()

    for w in tokens.split():
        if w == "}":
            end()
            depth = max(0, depth - 1)
        held.append(w)
        if w in ("{", "}", ";"):
            end()
            depth += w == "{"
    end()
    return "\n".join(out)


def laid_out(docs: DataFrame, key: str, tokens: str, python: Column) -> DataFrame:
    """(key, code) of token streams."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = [(layout_python if p else layout_braces)(t or "") for t, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code, pa.string())], [key, "code"])

    return docs.select(key, tokens, python.alias("python")).mapInArrow(run, f"{key} {kind}, code string")


def similarity_band(similarity: Column, keep: float = 75, split: float = 50) -> Column:
    """type-3 above the split, type-4 at or below; beyond keep, none."""
    return F.when(similarity > keep, None).when(similarity > split, "type-3").otherwise("type-4")


def with_input_first(files: Column, wanted: Column) -> Column:
    """The files of a clone with the input first; null if it is not among them."""
    return F.when(F.array_contains(files, wanted), F.concat(F.array(wanted), F.filter(files, lambda f: f != wanted)))


def language_pairings(files: DataFrame, key: str, rank: str) -> DataFrame:
    """Every two languages of a file once, the lower rank first; a file has a handful of languages."""
    a, b = files.alias("a"), files.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{rank}") < F.col(f"b.{rank}"))).select(F.col(f"a.{key}").alias(key), F.col(f"a.{rank}").alias(f"{rank}1"), F.col(f"b.{rank}").alias(f"{rank}2"))
