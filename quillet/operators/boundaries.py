"""Languages, syntax boundaries and the ranges that changed lines expand to."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions.text import CHARS_PER_TOKEN

# File suffixes (case-sensitive) and their languages.
SUFFIXES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go",
    ".rs": "rust", ".java": "java", ".rb": "ruby", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "c_sharp",
    ".php": "php", ".kt": "kotlin", ".swift": "swift", ".scala": "scala",
}

# Syntax node types that bound a reviewable unit; languages without an entry use the generic ones.
BOUNDARY_TYPES = {
    "python": ("function_definition", "class_definition"),
    "javascript": ("function_declaration", "method_definition", "class_declaration", "arrow_function"),
    "typescript": ("function_declaration", "method_definition", "class_declaration", "arrow_function", "interface_declaration"),
    "tsx": ("function_declaration", "method_definition", "class_declaration", "arrow_function", "interface_declaration"),
    "go": ("function_declaration", "method_declaration"),
    "rust": ("function_item", "impl_item", "struct_item"),
    "java": ("method_declaration", "class_declaration", "constructor_declaration"),
    "ruby": ("method", "class", "module"),
}
GENERIC_TYPES = ("function_definition", "function_declaration", "method_definition", "class_definition", "class_declaration")

CONTEXT_LINES = 10

BOUNDARY_SCHEMA = "review_id long, path string, node_id long, parent_id long, node_type string, start_line long, start_col long, end_line long, end_col long"


def suffix(path: Column) -> Column:
    """The last suffix of a path's name, '' if it has none; a leading dot starts no suffix, a final one neither."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def language(path: Column) -> Column:
    """Language of a path, null if unknown: a literal map, so no join."""
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.try_element_at(table, suffix(path))


def is_boundary(lang: Column, node_type: Column) -> Column:
    """Whether a node type bounds a unit in a language."""
    listed = F.create_map(*[x for k, v in BOUNDARY_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_contains(F.coalesce(F.try_element_at(listed, lang), F.array(*map(F.lit, GENERIC_TYPES))), node_type)


class BoundaryProvider(Protocol):
    """Syntax nodes of files: ``files(review_id, path, lines)`` to a table of BOUNDARY_SCHEMA.

    Files that a provider can't parse get no rows; ``languages`` names what it can.
    """

    languages: tuple[str, ...]

    def nodes(self, files: DataFrame) -> DataFrame: ...


class PythonSyntax:
    """Functions and classes of Python files by the standard parser; a file that doesn't parse is left to the heuristic."""

    languages = ("python",)

    def nodes(self, files: DataFrame) -> DataFrame:
        sources = files.filter(language(F.col("path")) == "python").select("review_id", "path", F.array_join("lines", "\n").alias("source"))
        return sources.mapInPandas(_python_nodes, BOUNDARY_SCHEMA)


def _python_nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kinds = {ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition"}
    names = [c.split()[0] for c in BOUNDARY_SCHEMA.split(", ")]
    for frame in frames:
        rows = []
        for review_id, path, source in frame.itertuples(index=False):
            try:
                tree = ast.parse(source)
            except (SyntaxError, ValueError, RecursionError):
                continue
            lines = source.split("\n")
            rows.append((review_id, path, 0, None, "module", 1, 0, max(1, len(lines)), len(lines[-1])))
            todo, number = [(tree, 0)], 0
            while todo:
                node, parent = todo.pop()
                for child in ast.iter_child_nodes(node):
                    if not hasattr(child, "lineno"):
                        todo.append((child, parent))
                        continue
                    number += 1
                    if type(child) in kinds:  # others only count as parents
                        rows.append((review_id, path, number, parent, kinds[type(child)], child.lineno, child.col_offset, child.end_lineno, child.end_col_offset))
                    todo.append((child, number))
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({"parent_id": "Int64"})


def enclosing_boundary(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lines(review_id, path, line_no, n_chars, ...)`` with the smallest boundary node around the whole line (null if none).

    Equality on review and path plus a range; nested nodes that span the same
    text go by the larger number, which is the inner one.
    """
    units = nodes.filter(is_boundary(language(F.col("path")), F.col("node_type")))
    units = units.select(F.col("review_id").alias("_r"), F.col("path").alias("_p"), "node_id", "start_line", "start_col", "end_line", "end_col")
    last = F.greatest(F.col("n_chars") - 1, F.lit(0))
    starts = (F.col("start_line") < F.col("line_no")) | ((F.col("start_line") == F.col("line_no")) & (F.col("start_col") == 0))
    ends = (F.col("end_line") > F.col("line_no")) | ((F.col("end_line") == F.col("line_no")) & (F.col("end_col") >= last))
    met = lines.join(units, (F.col("review_id") == F.col("_r")) & (F.col("path") == F.col("_p")) & starts & ends, "left")
    inner = F.struct((F.col("end_line") - F.col("start_line")).alias("span"), (-F.col("start_line")).alias("late"), (-F.col("start_col")).alias("in"), (-F.col("node_id")).alias("id"), "node_id", "start_line", "end_line")
    best = met.groupBy(*lines.columns).agg(F.min(F.when(F.col("node_id").isNotNull(), inner)).alias("_b"))
    return best.select(*lines.columns, F.col("_b.node_id").alias("node_id"), F.col("_b.start_line").alias("start_line"), F.col("_b.end_line").alias("end_line"))


def module_window(line_no: Column, n_lines: Column) -> tuple[Column, Column]:
    """A fixed window around a line that no boundary encloses."""
    return F.greatest(F.lit(1), line_no - CONTEXT_LINES).cast("long"), F.least(n_lines, line_no + CONTEXT_LINES).cast("long")


def split_oversized(units: DataFrame, nodes: DataFrame, changed: DataFrame, token_budget: int) -> DataFrame:
    """Ranges of boundary nodes: a node over budget gives its direct boundary children with a changed line, else itself.

    ``units(review_id, path, node_id, start_line, end_line, n_chars)`` are distinct
    nodes with the characters of their lines joined; ``changed(review_id, path,
    line_no)``. Returns ``review_id, path, node_id, start_line, end_line``.
    """
    keys = ["review_id", "path"]
    tokens = F.greatest(F.lit(1), F.floor(F.col("n_chars") / CHARS_PER_TOKEN))
    over, within = units.filter(tokens > token_budget), units.filter(tokens <= token_budget)
    children = nodes.filter(is_boundary(language(F.col("path")), F.col("node_type"))).select(*keys, F.col("parent_id").alias("node_id"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    candidates = over.select(*keys, "node_id").join(children, [*keys, "node_id"])
    lines = changed.select(F.col("review_id").alias("_r"), F.col("path").alias("_p"), "line_no")
    touched = candidates.join(lines, (F.col("review_id") == F.col("_r")) & (F.col("path") == F.col("_p")) & F.col("line_no").between(F.col("c_start"), F.col("c_end")), "left_semi")
    halves = over.join(touched, [*keys, "node_id"], "left")
    halves = halves.select(*keys, "node_id", F.coalesce("c_start", "start_line").alias("start_line"), F.coalesce("c_end", "end_line").alias("end_line"))
    return within.select(*keys, "node_id", "start_line", "end_line").unionByName(halves).distinct()


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
