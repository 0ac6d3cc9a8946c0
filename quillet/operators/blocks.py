"""Syntax blocks of source files without a parser: masking, then brackets paired by windows.

One leftmost regular expression per language cuts a text into comments, strings,
words and single signs; comments become blanks and strings two signs of their own,
of the same length, so that what is left are braces, keywords and places. Braces
(``end`` in Ruby) are paired by their depth: in the order of a file, the event that
follows an opening one on its level closes it. Python's blocks end before the next
line that is indented as little as their header. A block's type follows from the
text between it and what precedes it.

Broken files give what precedes the break; a block that nothing closes reaches to the
end of its file. Bodies without a block (arrow functions and functions that are one
expression) are no nodes. A header is looked for in the last ``HEADER`` signs before
its brace.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.operators.boundaries import BOUNDARY_SCHEMA, language
from quillet.runtime import materialize

HEADER = 2000
_FILE = ["review_id", "path"]
_STRING, _WITHIN = "\x02", "\x01"

# --- masking -----------------------------------------------------------------------------------------------------------------------


def _quoted(q: str, lines: bool = False) -> str:
    """A string in ``q`` with backslash escapes; one that isn't closed ends with its line, or the text if it may have ``lines``."""
    plain = f"[^{q}\\\\]*+" if lines else f"[^{q}\\\\\\n]*+"
    return f"{q}{plain}(?:\\\\[\\s\\S]{plain})*+{q}?"


def _nested(open_: str, close: str, signs: str, depth: int) -> str:
    """A comment that holds comments, to a depth."""
    inner = f"|{_nested(open_, close, signs, depth - 1)}" if depth else ""
    return f"{open_}(?:[^{signs}]{inner}|(?!{close}{'|' + open_ if depth else ''})[{signs}])*+(?:{close})?"


def _hole(depth: int) -> str:
    """``{...}`` in a back-quoted string, with braces and such strings in it to a depth."""
    inner = f"|{_hole(depth - 1)}|{_template(depth - 1)}" if depth else ""
    return f"\\{{(?:[^`{{}}]++{inner})*+\\}}"


def _template(depth: int) -> str:
    return f"`(?:[^`\\\\$]++|\\\\[\\s\\S]|\\${_hole(depth)}|\\$)*+`?"


_LINE, _HASH, _BLOCK = r"//[^\n]*+", r"#[^\n]*+", r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?"
_DEEP = _nested(r"/\*", r"\*/", "*/", 3)
_DIRECTIVE = r"(?md:^)[ \t]*+#(?:[^\n\\]|\\[\s\S])*+"
_DQ, _SQ, _DQ_LINES, _SQ_LINES = _quoted('"'), _quoted("'"), _quoted('"', True), _quoted("'", True)
_CHAR, _RAW = r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,8}+)'", r"`[^`]*+`?"
_TRIPLE, _TRIPLE_SQ = r'"""[\s\S]*?(?:"""|\z)', r"'''[\s\S]*?(?:'''|\z)"
_PATTERN_JS = r"(?<=[(,=:\[!&|?{};]\s{0,4}|return\s)/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
_RAW_RUST, _RAW_CPP = r'\bb?r(?<h>#*+)"[\s\S]*?(?:"\k<h>|\z)', r'\bR"(?<d>[^()\s"\\]{0,16})\([\s\S]*?(?:\)\k<d>"|\z)'
_HEREDOC_PHP, _HEREDOC_RUBY = r"<<<[\"']?(?<p>\w+)[\"']?\n[\s\S]*?(?:\n[ \t]*\k<p>\b|\z)", r"<<[~-][\"']?(?<y>\w+)[\"']?[^\n]*\n[\s\S]*?(?:\n[ \t]*\k<y>\b|\z)"
_SCRIPT = (_LINE, _BLOCK, _template(3), _DQ, _SQ, _PATTERN_JS)

OPAQUE = {
    "javascript": _SCRIPT, "typescript": _SCRIPT, "tsx": _SCRIPT, "go": (_LINE, _BLOCK, _DQ, _CHAR, _RAW), "rust": (_LINE, _DEEP, _RAW_RUST, _DQ_LINES, _CHAR), "java": (_TRIPLE, _LINE, _BLOCK, _DQ, _CHAR),
    "c": (_DIRECTIVE, _LINE, _BLOCK, _DQ, _CHAR), "cpp": (_DIRECTIVE, _RAW_CPP, _LINE, _BLOCK, _DQ, _CHAR), "c_sharp": (_DIRECTIVE, _TRIPLE, r'[$]?@[$]?"[^"]*+(?:""[^"]*+)*+"?', _LINE, _BLOCK, _DQ, _CHAR),
    "php": (_LINE, r"#(?!\[)[^\n]*+", _BLOCK, _HEREDOC_PHP, _DQ_LINES, _SQ_LINES), "kotlin": (_TRIPLE, _LINE, _DEEP, _DQ, _CHAR), "swift": (_TRIPLE, _LINE, _DEEP, _DQ), "scala": (_TRIPLE, _LINE, _DEEP, _DQ, _CHAR),
    "ruby": (_HASH, r"(?md:^)=begin\b[\s\S]*?(?:\n=end[^\n]*|\z)", _HEREDOC_RUBY, _DQ_LINES, _SQ_LINES), "python": (_TRIPLE, _TRIPLE_SQ, _HASH, _DQ, _SQ),
}


def _constant(value: object, kind: str) -> Column:
    """A literal of a nested type: one expression that is folded once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


_MARK = "\x00"


def _cut(parts: tuple[str, ...]) -> str:
    """A pattern of what is plain before a comment or string, and of that or the text's end; plain text is passed word by word."""
    opaque = "|".join(parts)
    ahead = opaque
    for name in set(re.findall(r"\?<(\w)>", opaque)):
        ahead = ahead.replace(f"?<{name}>", f"?<{name}{name}>").replace(f"\\k<{name}>", f"\\k<{name}{name}>")
    return rf"(?<plain>(?:(?!{ahead})(?:\w++|[^\S\n]++|[\s\S]))*+)(?<opaque>{opaque}|\z)"


def masked(text: Column, lang: Column) -> Column:
    """A text of the same length and lines whose comments are blanks and whose strings are \\x02 and \\x01 signs."""
    patterns = _constant({k: _cut(parts) for k, parts in OPAQUE.items()}, "map<string,string>")
    marked = F.call_function("regexp_replace", F.replace(text, F.lit(_MARK), F.lit("\x03")), F.try_element_at(patterns, lang), F.lit(f"${{plain}}{_MARK}${{opaque}}{_MARK}"))
    tokens = F.split(marked, _MARK, -1)  # plain and opaque in turn

    def filled(t: Column, sign: str) -> Column:
        lines = F.transform(F.split(t, "\n", -1), lambda x: F.repeat(F.lit(sign), F.length(x)))
        return F.when(F.contains(t, F.lit("\n")), F.array_join(lines, "\n")).otherwise(F.repeat(F.lit(sign), F.length(t)))

    def mask(t: Column, i: Column) -> Column:
        comment = t.rlike(r"^(?://|/\*|[ \t]*#[\s\S]|=begin)")
        string = F.concat(F.lit(_STRING), filled(F.substring(t, 2, 2**31 - 1), _WITHIN))
        return F.when((i % 2 == 0) | (F.length(t) < 2), t).when(comment, filled(t, " ")).otherwise(string)

    return F.array_join(F.transform(tokens, mask), "")


# --- headers -----------------------------------------------------------------------------------------------------------------------

_CONTROL = r"(?!(?:if|for|while|switch|catch|else|do|try|return|function|with|new|throw|synchronized|using|lock|foreach|case|sizeof|super|this|await|yield|match|when|guard|elseif|fixed|defer)\b)"
_ON_A_LINE = r"(?s)^(?:.*\n)?[ \t]*(?:{before})?({head}[^{{}}]*)$"  # the last line that starts so, to the end
_WHOLE = r"(?s)^\s*+({head})$"


def _lined(head: str, before: str = "") -> str:
    return _ON_A_LINE.format(head=head, before=before)


_EXPORT = r"(?:export\s+(?:default\s+)?|declare\s+)++"
_JS = [
    ("class_declaration", _lined(r"(?:abstract\s+)?class\b", _EXPORT)),
    ("function_declaration", _lined(r"(?:async\s+)?function\s+[\w$]+\s*[(<]", _EXPORT)),
    ("arrow_function", r"(?s)((?:async\s+)?(?:\([^()]*(?:\([^()]*\)[^()]*)*+\)|[\w$]+)(?:\s*:\s*[\w$<>\[\], |.]+)?\s*=>\s*)$"),
    ("method_definition", r"(?s)^(?:.*\n|.*,)?\s*(" + r"(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?\s*" + _CONTROL + r"[\w$#]+\s*(?:<[^<>(){}]*>\s*)?\([^{}]*\)\s*(?::\s*[^{}()=]+)?)$"),
]
_TS = [("interface_declaration", _lined(r"interface\s+[\w$]+", _EXPORT)), *_JS]
_MODIFIERS = r"(?:(?:@[\w.]+(?:\s*\([^()]*\))?|public|private|protected|internal|static|final|abstract|synchronized|native|strictfp|default|sealed|virtual|override|async|partial|unsafe|readonly|open|data|inner|inline|suspend|operator|infix|tailrec|enum|annotation|companion|case|implicit|lazy|mutating|fileprivate|indirect|dynamic|convenience|required|non-sealed|extern|actual|expect|external|value)\s+)*+"
_THROWS = r"(?:throws\s+[\w., ]+)?"
_JAVA = [
    ("class_declaration", _WHOLE.format(head=_MODIFIERS + r"class\s+\w[^{}]*")),
    ("constructor_declaration", _WHOLE.format(head=_MODIFIERS + r"(?:<[^<>]*>\s*)?" + _CONTROL + r"\w++\s*+\([^{}]*\)\s*" + _THROWS)),
    ("method_declaration", _WHOLE.format(head=_MODIFIERS + r"(?:<[^{}()]*?>\s*)?" + _CONTROL + r"[\w.]++(?:\s*<[^{}()=]*>)?(?:\s*\[\s*\])*+\s+" + _CONTROL + r"\w++\s*+\([^{}]*\)\s*" + _THROWS)),
]
_C = [("function_definition", _WHOLE.format(head=_CONTROL + r"(?!namespace\b|struct\s+\w+\s*$|class\b|enum\b|union\b|extern\s*$)[\w~:][^{}()=]*+\([^{}]*\)[^{}=]*"))]

#: Node types by language and the pattern of what stands before their brace, first match first; the first group is the node's beginning.
HEADERS = {
    "javascript": _JS, "typescript": _TS, "tsx": _TS,
    "go": [("method_declaration", _lined(r"func\s*\([^()]*\)\s*\w+\s*[(\[]")), ("function_declaration", _lined(r"func\s+\w+\s*[(\[]"))],
    "rust": [
        ("function_item", _lined(r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+[\x01\x02]+)?|default)\s+)*+fn\s+\w+")), ("impl_item", _lined(r"(?:unsafe\s+)?impl\b")),
        ("struct_item", _lined(r"(?:pub(?:\s*\([^)]*\))?\s+)?struct\s+\w+")),
    ],
    "java": _JAVA, "c": _C, "cpp": [(k, p.replace(r"^\s*+", r"^\s*+(?:template\s*<[^{}()]*>\s*)?", 1)) for k, p in _C], "c_sharp": [("class_declaration", _WHOLE.format(head=r"(?:\[[^\]{}]*\]\s*)*+" + _MODIFIERS + r"class\s+\w[^{}]*"))],
    "php": [("class_declaration", _lined(r"(?:(?:abstract|final|readonly)\s+)*+class\s+\w+")), ("function_definition", _lined(r"function\s+&?\s*\w+\s*\("))],
    "kotlin": [("class_declaration", _lined(_MODIFIERS + r"(?:class|interface)\s+\w+")), ("function_declaration", _lined(_MODIFIERS + r"fun\s+(?:<[^<>]*>\s*)?[\w.`<>?]+\s*\("))],
    "swift": [("class_declaration", _lined(_MODIFIERS + r"(?:class|struct|enum|actor|extension)\s+(?!func\b|var\b)\w+")), ("function_declaration", _lined(_MODIFIERS + r"(?:class\s+)?func\s+[^\s(]+\s*[(<]"))],
    "scala": [("class_definition", _lined(_MODIFIERS + r"class\s+\w+")), ("function_definition", _lined(_MODIFIERS + r"def\s+[^\s(\[:=]+"))],
    "ruby": [("method", r"^[ \t]*((?:(?:private|public|protected|module_function)\s+)?def\s[^\n]*)$"), ("class", r"^[ \t]*(class\s+(?!<<)[^\n]*)$"), ("module", r"^[ \t]*(module\s[^\n]*)$")],
}
_RUBY_OPENS = r"^[ \t]*+(?:[\w@$.\[\], ]++=[ \t]*+)?(?:(?:(?:private|public|protected|module_function)[ \t]+)?def|class|module|if|unless|while|until|case|for|begin)\b(?![:?!])|\bdo[ \t]*(?:\|[^|\n]*\|)?[ \t]*$"
_RUBY_ONE_LINE = r"^[ \t]*+(?:\w++[ \t]++)?def\s[^\n=]*\)?[ \t]*=(?!=)|\bend\b[ \t]*$"
_PYTHON_HEAD = r"^[ \t]*((?:async[ \t]+)?def|class)\b"


def _with_node(rows: DataFrame, code: Column) -> DataFrame:
    """Add ``node_type`` and ``_decl``, the text from a node's beginning to its brace; null where ``code`` heads no node."""
    found = None
    for k, table in HEADERS.items():  # each pattern is a literal, so it is compiled once
        tried = F.array(*[F.struct(F.lit(kind).alias("node_type"), F.regexp_extract(code, p, 1).alias("_decl")) for kind, p in table])
        found = F.when(F.col("lang") == k, tried) if found is None else found.when(F.col("lang") == k, tried)
    first = F.get(F.filter(F.when(code != "", found), lambda t: t["_decl"] != ""), F.lit(0))
    return rows.withColumn("_head", first).select("*", F.col("_head.node_type").alias("node_type"), F.col("_head._decl").alias("_decl")).drop("_head")


# --- blocks ------------------------------------------------------------------------------------------------------------------------


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


_ENDS = ["n_lines", "last_col"]  # of a file, where a block ends that nothing closes


def _last_line(text: Column) -> Column:
    return F.length(F.substring_index(text, "\n", -1))


def _brace_events(files: DataFrame) -> DataFrame:
    """Opening and closing braces in order, ``step`` 1 or -1, and the node that a brace or, for a structure without one, a semicolon ends the header of.

    Of each piece of a text only lengths and counts of lines are sorted; its place follows from those before it.
    """
    rows = files.select(*_FILE, *_ENDS, "lang", F.posexplode(F.regexp_extract_all("code", F.lit("[^{};]*+[{};]|[^{};]++"), F.lit(0))).alias("i", "piece"))
    rows = rows.withColumns({"sign": F.expr("right(piece, 1)"), "_code": F.expr("substring(piece, 1, length(piece) - 1)")})
    ends_header = (F.col("sign") == ";") & (F.col("lang") == "rust") & F.col("_code").rlike(r"\bstruct\b")
    rows = rows.withColumn("step", F.when(F.col("sign") == "{", 1).when(F.col("sign") == "}", -1).when(ends_header, 0))
    rows = _with_node(rows, F.when(F.col("step") >= 0, F.expr(f"right(_code, {HEADER})")).otherwise(""))
    rows = rows.withColumn("_lead", F.expr("substring(_code, 1, length(_code) - length(_decl))"))
    rows = rows.select(
        *_FILE, *_ENDS, "i", "step", "node_type", F.length("piece").alias("_len"), _newlines(F.col("piece")).alias("_nl"), _last_line(F.col("piece")).alias("_tail"),
        _newlines(F.col("_lead")).alias("_lead_nl"), _last_line(F.col("_lead")).alias("_lead_tail"),
    )
    order = Window.partitionBy(*_FILE).orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum("_len").over(before), F.lit(0)))
    start = F.coalesce(F.max(F.when(F.col("_nl") > 0, F.col("_at") + F.col("_len") - F.col("_tail"))).over(before), F.lit(0))
    rows = rows.withColumns({"_line": F.coalesce(F.sum("_nl").over(before), F.lit(0)) + 1, "_col": F.col("_at") - start}).filter("step IS NOT NULL")
    in_line = F.when(F.col("_lead_nl") > 0, F.col("_lead_tail")).otherwise(F.col("_col") + F.col("_lead_tail"))
    end_col = F.when(F.col("_nl") > 0, F.col("_tail")).otherwise(F.col("_col") + F.col("_len"))
    return rows.select(
        *_FILE, *_ENDS, "i", "step", "node_type", (F.col("_line") + F.col("_lead_nl")).alias("start_line"), in_line.alias("start_col"), (F.col("_line") + F.col("_nl")).alias("end_line"), end_col.alias("end_col"),
    )


def _ruby_events(files: DataFrame) -> DataFrame:
    """The same of lines that open a block and of ``end`` lines."""
    rows = files.select(*_FILE, *_ENDS, "lang", F.posexplode(F.split("code", "\n", -1)).alias("i", "_code"))
    opens, closes = F.col("_code").rlike(_RUBY_OPENS) & ~F.col("_code").rlike(_RUBY_ONE_LINE), F.col("_code").rlike(r"^[ \t]*end\b(?![:?!])")
    rows = _with_node(rows.filter(opens | closes).withColumn("_closes", closes), F.when(closes, "").otherwise(F.col("_code")))
    line, start = (F.col("i") + 1).cast("long"), (F.length("_code") - F.length("_decl")).cast("long")
    end = F.length(F.regexp_extract("_code", r"^([ \t]*end)\b", 1)).cast("long")
    return rows.select(*_FILE, *_ENDS, "i", F.when(F.col("_closes"), -1).otherwise(1).alias("step"), "node_type", line.alias("start_line"), start.alias("start_col"), line.alias("end_line"), end.alias("end_col"))


def _paired(events: DataFrame) -> DataFrame:
    """Blocks of events: ``id`` and ``close`` are the event that opens a block and the one that closes it."""
    order = Window.partitionBy(*_FILE).orderBy("i")
    level = F.when(F.col("step") != 0, F.sum("step").over(order) + F.when(F.col("step") == -1, 1).otherwise(0))
    level_order = Window.partitionBy(*_FILE, "_level").orderBy("i")
    own = F.struct("step", "i", "end_line", "end_col")
    leveled = events.withColumn("_level", level).withColumn("_next", F.lead(own).over(level_order)).filter("step >= 0")
    closed = F.when(F.col("step") == 0, own).when(F.col("_next.step") == -1, F.col("_next"))
    return leveled.select(
        *_FILE, F.col("i").alias("id"), F.coalesce(closed["i"], F.lit(2**31 - 1)).alias("close"), "node_type", "start_line", "start_col", F.coalesce(closed["end_line"], "n_lines").alias("end_line"), F.coalesce(closed["end_col"], "last_col").alias("end_col")
    )


def _indented(files: DataFrame) -> DataFrame:
    """Blocks of Python: from a header to the last line with code before the next statement that is indented as little."""
    rows = files.select(*_FILE, F.posexplode(F.split("code", "\n", -1)).alias("i", "line"))
    without = lambda signs: sum((F.length(F.replace("line", F.lit(x), F.lit(""))) for x in signs), F.lit(0))
    bracket = without(")]}") - without("([{")
    code = F.col("line").rlike(r"[^ \t\x0c]")
    head = F.regexp_extract("line", _PYTHON_HEAD, 1)
    kind = F.when(head == "class", "class_definition").when(head != "", "function_definition")
    rows = rows.select(*_FILE, "i", bracket.alias("_bracket"), code.alias("_code"), F.when(code, F.struct("i", F.length("line").alias("n"))).alias("_end_of"), F.length(F.regexp_extract("line", r"^([ \t]*)", 1)).alias("indent"), (code & ~F.col("line").startswith(_WITHIN)).alias("_begins"), kind.alias("node_type"))
    file = Window.partitionBy(*_FILE)
    before = file.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_depth": F.coalesce(F.sum("_bracket").over(before), F.lit(0)), "_last": F.max("_end_of").over(before), "_final": F.max("_end_of").over(file)})
    statements = rows.filter(F.col("_begins") & (F.col("_depth") <= 0)).select(*_FILE, "i", "_last", "_final", "indent", "node_type")
    levels = F.collect_set(F.when(F.col("node_type").isNotNull(), F.col("indent"))).over(Window.partitionBy(*_FILE))
    each = statements.withColumn("_levels", levels).withColumn("_level", F.explode(F.filter("_levels", lambda k: k >= F.col("indent")))).drop("_levels")
    after = F.lead("_last").over(Window.partitionBy(*_FILE, "_level").orderBy("i"))
    blocks = each.withColumn("_end", after).filter(F.col("node_type").isNotNull() & (F.col("_level") == F.col("indent")))
    end = F.coalesce("_end", "_final")
    return blocks.select(
        *_FILE, (F.col("i") * 2).alias("id"), (end["i"] * 2 + 1).alias("close"), "node_type", (F.col("i") + 1).cast("long").alias("start_line"), F.col("indent").cast("long").alias("start_col"), (end["i"] + 1).cast("long").alias("end_line"), end["n"].cast("long").alias("end_col")
    )


def _with_parents(blocks: DataFrame) -> DataFrame:
    """Add ``parent``, the ``id`` of the block around each: the last one that began a level further out."""
    rest = F.struct("node_type", "start_line", "start_col", "end_line", "end_col")
    none = F.lit(None).cast("int")
    ends = F.array(F.struct(F.col("id").alias("at"), F.lit(1).alias("step"), rest.alias("_rest")), F.struct(F.col("close").alias("at"), F.lit(-1).alias("step"), F.lit(None).alias("_rest")))
    events = blocks.select(*_FILE, "id", F.explode(ends).alias("e")).select(*_FILE, "id", "e.*")
    depth = events.withColumn("_level", F.sum("step").over(Window.partitionBy(*_FILE).orderBy("at", F.desc("step"), "id"))).filter("step = 1")
    own = F.struct(F.col("_level").alias("level"), F.col("id").alias("own"), none.alias("child"), F.lit(None).alias("_rest"))
    asked = F.struct((F.col("_level") - 1).alias("level"), none.alias("own"), F.col("id").alias("child"), "_rest")
    rows = depth.select(*_FILE, F.col("id").alias("_at"), F.explode(F.array(own, asked)).alias("q")).select(*_FILE, "_at", "q.*")
    parent = rows.withColumn("parent", F.last("own", ignorenulls=True).over(Window.partitionBy(*_FILE, "level").orderBy("_at"))).filter("child IS NOT NULL")
    return parent.select(*_FILE, F.col("child").alias("id"), "parent", "_rest.*")


class BlockSyntax:
    """Boundary nodes of all languages of the suffix table, as a provider; every file gets a ``program`` node over it."""

    languages = tuple(OPAQUE)

    def nodes(self, files: DataFrame) -> DataFrame:
        lang = language(F.col("path"))
        text = F.array_join("lines", "\n")
        code = files.filter(lang.isin(*self.languages)).select(*_FILE, lang.alias("lang"), masked(text, lang).alias("code"), F.greatest(F.size("lines"), F.lit(1)).alias("n_lines"), F.coalesce(F.length(F.try_element_at("lines", F.lit(-1))), F.lit(0)).alias("last_col"))
        braced, ruby = code.filter(~F.col("lang").isin("ruby", "python")), code.filter("lang = 'ruby'")
        blocks = _paired(_brace_events(braced)).unionByName(_paired(_ruby_events(ruby))).unionByName(_indented(code.filter("lang = 'python'")))
        found = _with_parents(materialize(blocks, "blocks")).filter("node_type IS NOT NULL")
        names = [c.split()[0] for c in BOUNDARY_SCHEMA.split(", ")]
        number = found.withColumns({"node_id": F.col("id") + 1, "parent_id": F.coalesce(F.col("parent") + 1, F.lit(0))})
        whole = code.select(*_FILE, F.lit(0).alias("node_id"), F.lit(None).alias("parent_id"), F.lit("program").alias("node_type"), F.lit(1).alias("start_line"), F.lit(0).alias("start_col"), F.col("n_lines").alias("end_line"), F.col("last_col").alias("end_col"))
        both = number.select(*names).unionByName(whole.select(*names))
        return both.select(*[F.col(n) if n in ("path", "node_type") else F.col(n).cast("long").alias(n) for n in names])
