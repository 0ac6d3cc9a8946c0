"""Changed lines to review chunks: expand, merge, cut to the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions.text import CHARS_PER_TOKEN, is_blank, join_lines
from quillet.operators.boundaries import BoundaryProvider, enclosing_boundary, language, module_window, split_oversized
from quillet.runtime import materialize

TOKEN_BUDGET = 6000
FILE = ["review_id", "file_seq", "path"]


def file_lines(files: DataFrame) -> DataFrame:
    """``review_id, path, line_no, line, n_lines`` of ``files(review_id, path, lines)``."""
    rows = files.select("review_id", "path", F.size("lines").cast("long").alias("n_lines"), F.posexplode("lines").alias("_pos", "line"))
    return rows.select("review_id", "path", (F.col("_pos") + 1).cast("long").alias("line_no"), "line", "n_lines")


def heuristic_ranges(changed: DataFrame, lines: DataFrame) -> DataFrame:
    """Each changed line with the block between the blank lines around it.

    The neighbouring blanks exclude the line itself, so a blank changed line takes
    both blocks; lines outside the file are dropped. Only changed lines, blank ones
    and each file's last are sorted, without their texts.
    """
    file = ["review_id", "path"]
    blank = is_blank(F.col("line"))
    marks = lines.filter(blank | (F.col("line_no") == F.col("n_lines"))).select(*file, F.lit(None).cast("long").alias("file_seq"), "line_no", F.when(blank, F.col("line_no")).alias("_blank"), "n_lines")
    asked = changed.select(*file, "file_seq", "line_no", F.lit(None).cast("long").alias("_blank"), F.lit(None).cast("long").alias("n_lines"))
    down, up = Window.partitionBy(*file).orderBy("line_no"), Window.partitionBy(*file).orderBy(F.desc("line_no"))  # a frame that grows costs each line once
    start = F.coalesce(F.max("_blank").over(down.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    last = F.max("n_lines").over(up.rangeBetween(Window.unboundedPreceding, 0))
    end = F.coalesce(F.min("_blank").over(up.rangeBetween(Window.unboundedPreceding, -1)), last + 1) - 1
    around = marks.unionByName(asked).withColumn("start_line", start).withColumns({"end_line": end, "_last": last})
    return around.filter((F.col("file_seq").isNotNull()) & F.col("_last").isNotNull() & (F.col("line_no") >= 1)).select(*FILE, "line_no", "start_line", "end_line")


def merge_ranges(ranges: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """Overlapping and adjacent ranges become one: an island starts where no earlier range reaches its start."""
    order = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = ranges.withColumn("_new", F.coalesce(F.col("start_line") > reach + 1, F.lit(True)).cast("int"))
    islands = flagged.withColumn("_island", F.sum("_new").over(order))  # equal ranges share a sum
    return islands.groupBy(*keys, "_island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("_island")


def build_chunks(ranges: DataFrame, files: DataFrame, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Chunks of merged ranges; over budget, the whole lines that fit are kept and the chunk is partial.

    Ranges and ids describe the uncut text. The lines stay in their file's array,
    so nothing is exploded.
    """
    sliced = ranges.join(files.select("review_id", "path", "lines"), ["review_id", "path"])
    sliced = sliced.withColumn("_lines", F.slice("lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))).drop("lines")
    chars = F.aggregate("_lines", F.lit(-1).cast("long"), lambda a, x: a + F.length(x) + 1)
    sliced = sliced.withColumn("is_partial", F.greatest(F.lit(1), F.floor(chars / CHARS_PER_TOKEN)) > token_budget)
    limit = F.lit(token_budget * CHARS_PER_TOKEN)
    start = F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def take(a, x):  # noqa: ANN001, ANN202
        fits = a["open"] & (a["chars"] + F.length(x) + 1 <= limit)
        return F.struct((a["chars"] + F.length(x) + 1).cast("long").alias("chars"), (a["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    kept = F.aggregate("_lines", start, take)["n"]
    content = F.when(F.col("is_partial"), F.when(kept > 0, join_lines(F.slice("_lines", F.lit(1), F.greatest(kept, F.lit(1))))).otherwise("")).otherwise(join_lines(F.col("_lines")))
    chunk_id = F.concat("path", F.lit(":"), "start_line", F.lit("-"), "end_line")
    return sliced.select(*FILE, chunk_id.alias("chunk_id"), "start_line", "end_line", content.alias("content"), "is_partial")


def boundary_ranges(changed: DataFrame, files: DataFrame, nodes: DataFrame, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Ranges by syntax: the enclosing unit (split if over budget), or a window where there is none."""
    sized = files.select("review_id", "path", "lines", F.size("lines").cast("long").alias("n_lines"))
    lines = changed.join(sized, ["review_id", "path"]).filter(F.col("line_no").between(1, F.col("n_lines")))
    lines = lines.select(*FILE, "line_no", "n_lines", F.length(F.element_at("lines", F.col("line_no").cast("int"))).cast("long").alias("n_chars"))
    placed = enclosing_boundary(lines, nodes)
    low, high = module_window(F.col("line_no"), F.col("n_lines"))
    loose = placed.filter("node_id IS NULL").select(*FILE, low.alias("start_line"), high.alias("end_line"))
    units = placed.filter("node_id IS NOT NULL").select(*FILE, "node_id", "start_line", "end_line").distinct()
    part = F.slice("lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))
    measured = units.join(sized, ["review_id", "path"]).withColumn("n_chars", F.aggregate(part, F.lit(-1).cast("long"), lambda a, x: a + F.length(x) + 1))
    # each group of a path that occurs twice in a diff has its own changed lines
    names = F.concat_ws("\0", F.col("file_seq"), F.col("path"))
    by_group = lambda df: df.withColumn("path", names)
    groups = changed.select(*FILE).distinct()
    own_nodes = by_group(nodes.join(groups, ["review_id", "path"]))
    ranges = split_oversized(by_group(measured), own_nodes, by_group(changed), token_budget)
    back = ranges.withColumns({"file_seq": F.substring_index("path", "\0", 1).cast("long"), "path": F.substring_index("path", "\0", -1)})
    return loose.unionByName(back.select(*FILE, "start_line", "end_line"))


def chunk_changes(changed: DataFrame, files: DataFrame, provider: BoundaryProvider | None = None, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Chunks of changed lines: by syntax where the provider has nodes for the file, else between blank lines."""
    readable = files.filter("is_readable") if "is_readable" in files.columns else files
    readable = readable.join(changed.select("review_id", "path").distinct(), ["review_id", "path"], "left_semi")
    if provider is None:
        ranges = heuristic_ranges(changed, file_lines(readable)).select(*FILE, "start_line", "end_line")
    else:
        nodes = materialize(provider.nodes(readable.filter(language(F.col("path")).isin(*provider.languages))), "nodes")  # each changed file is parsed once
        parsed = nodes.select("review_id", "path").distinct()
        by_syntax = boundary_ranges(changed.join(parsed, ["review_id", "path"], "left_semi").select(*FILE, "line_no"), readable, nodes, token_budget)
        rest = changed.join(parsed, ["review_id", "path"], "left_anti").select(*FILE, "line_no")
        ranges = by_syntax.unionByName(heuristic_ranges(rest, file_lines(readable.join(parsed, ["review_id", "path"], "left_anti"))).select(*FILE, "start_line", "end_line"))
    chunks = build_chunks(merge_ranges(ranges), readable, token_budget)
    order = Window.partitionBy("review_id").orderBy("file_seq", "start_line")
    return chunks.withColumn("chunk_ord", F.row_number().over(order).cast("long"))
