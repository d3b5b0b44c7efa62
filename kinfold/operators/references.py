"""Which function refers to which name: tokens of source files by position, their braces, and the function around each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.code import WORDS
from kinfold.operators.intervals import innermost

#: Comments, directives with their continued lines, literals, template arguments before a declared name, words, numbers, operators, line ends.
TOKEN = r"""//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|(?m:^)[ \t]*+#(?:[^\\\n]++|\\[\s\S])*+|(?:u8|[uUL])?R"\(([\s\S]*?)\)"|(?:u8|[uUL])?"(?:[^"\\\n]++|\\[\s\S])*+"?|'(?:[^'\\\n]++|\\.)*+'?|<(?:[\w:,* ]|<[\w:,* ]*+>)*+>(?=\s*[&*]*\s*[A-Za-z_]\w*\s*[({;=,)])|[A-Za-z_]\w*+|\d[\w.']*+|->\*?|::|&&|\|\||[-+*/%&|^=<>!]=|\n|[^\s\w]"""
#: Keywords after which an expression begins, words that join expressions, and words before a name that is a type or a namespace.
BEFORE_EXPRESSIONS = ("return", "else", "do", "case", "throw", "sizeof", "delete", "and", "or", "not", "xor", "bitand", "bitor", "compl", "co_return", "co_await", "co_yield")
JOINING = ("and", "or", "xor", "bitand", "bitor", "and_eq", "or_eq", "xor_eq", "not_eq")
BEFORE_TYPES = ("struct", "class", "union", "enum", "typename", "namespace", "goto", "new")
#: What may stand between a parameter list and a function's body.
AFTER_PARAMETERS = (")", "const", "noexcept", "override", "final", "mutable", "volatile")


def is_word(token: Column) -> Column:
    return token.rlike(r"^[A-Za-z_]\w*$")


def is_keyword(token: Column) -> Column:
    return token.isin(*WORDS)


def source_tokens(files: DataFrame) -> DataFrame:
    """``path``, ``pos``, ``token``, ``line``, ``depth`` and ``in_body`` of the tokens of source files (path, text).

    Comments, directives and line ends are no tokens, but lines are counted through them; a string is ``"`` and a character
    ``'``. ``depth`` is the number of open braces. A brace after a parameter list opens a function's body, and tokens up
    to its closing brace, which is the next one at its depth, are ``in_body``. Null and empty texts have no tokens, and two
    files of one path are told apart by their text.
    """
    file = [F.col("path"), F.xxhash64("text").alias("file")]
    found = files.select(*file, F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "token")).dropDuplicates(["path", "file", "pos"])
    by_file = Window.partitionBy("path", "file").orderBy("pos")
    before, up_to = by_file.rowsBetween(Window.unboundedPreceding, -1), by_file.rowsBetween(Window.unboundedPreceding, 0)
    ends = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    found = found.withColumn("line", (F.coalesce(F.sum(ends).over(before), F.lit(0)) + 1).cast("int"))
    kept = found.where(~F.col("token").rlike(r"^(//|/\*|[ \t]*#|\n)"))
    short = F.when(F.col("token").rlike('^(u8|[uUL])?R?"'), '"').when(F.col("token").startswith("'"), "'").when(F.col("token").rlike("^<.+>$"), "<>").otherwise(F.col("token"))
    kept = kept.withColumn("token", short).withColumn("last", F.lag("token").over(by_file))
    opens, closes = F.col("token") == "{", F.col("token") == "}"
    kept = kept.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(up_to).cast("int"))
    # A pair of braces: both at the depth inside them, one after the other.
    level = F.when(opens, F.col("depth")).when(closes, F.col("depth") + 1)
    body = F.coalesce(F.col("last").isin(*AFTER_PARAMETERS), F.lit(False))
    pair = Window.partitionBy("path", "file", "level").orderBy("pos")
    kept = kept.withColumn("level", level).withColumn("body", F.when(opens, body.cast("int")))
    step = F.when(opens, F.col("body")).when(closes, -F.coalesce(F.lag("body").over(pair), F.lit(0))).otherwise(0)
    kept = kept.withColumn("step", step).withColumn("in_body", F.sum("step").over(up_to) > 0)
    return kept.select("path", "file", "pos", "token", "line", "depth", "in_body")


def identifiers(tokens: DataFrame, mode: str = "direct") -> DataFrame:
    """``path``, ``name``, ``line`` of the names of ``source_tokens`` that refer to something.

    ``direct``: names that are called by themselves inside a function's body. Members and names of a scope are not, neither
    are keywords, declared names (after a type, or after a star or ampersand and a type that begins a statement) and
    types that are made with ``new``. ``all``: all names but keywords, members, scopes, labels and types, the latter by what
    stands beside them. A lexer sees no symbols: ``a * f(x);`` at the beginning of a statement counts as a declaration.
    """
    if mode not in ("direct", "all"):
        raise ValueError(f"no such mode: {mode}")
    w = Window.partitionBy("path", "file").orderBy("pos")
    blank = F.lit("")
    rows = tokens
    for name, c in (("p1", F.lag("token", 1)), ("p2", F.lag("token", 2)), ("p3", F.lag("token", 3)), ("n1", F.lead("token", 1)), ("n2", F.lead("token", 2))):
        rows = rows.withColumn(name, F.coalesce(c.over(w), blank))
    token, p1, p2, p3, n1, n2 = (F.col(c) for c in ("token", "p1", "p2", "p3", "n1", "n2"))
    begins = lambda c: c.isin("", ";", "{", "}", ":") | (is_keyword(c) & ~c.isin(*BEFORE_EXPRESSIONS))
    type_word = lambda c: is_word(c) & ~c.isin(*BEFORE_EXPRESSIONS) & ~c.isin(*JOINING)
    rows = rows.where(is_word(token) & ~is_keyword(token) & ~p1.isin(".", "->", "->*"))
    if mode == "direct":
        declared = type_word(p1) | (p1 == "<>") | (p1.isin("*", "&", "&&") & ((type_word(p2) & begins(p3)) | (p2 == "<>")))
        rows = rows.where(F.col("in_body") & (n1 == "(") & ~p1.isin("::", "~") & ~declared)
    else:
        types = (is_word(n1) & ~n1.isin(*JOINING)) | n1.isin("<>", "::") | p1.isin(*BEFORE_TYPES) | (n1.isin("*", "&", "&&") & is_word(n2) & (begins(p1) | (~F.col("in_body") & p1.isin("(", ","))))
        rows = rows.where(~types & ~((n1 == ":") & p1.isin(";", "{", "}")))
    return rows.select("path", token.alias("name"), "line")


def references(files: DataFrame, functions: DataFrame, mode: str = "direct") -> DataFrame:
    """``path``, ``name``, ``line``, ``nid``: names referred to and the innermost function (path, nid, line_start, line_end)
    around each. References outside all functions are dropped."""
    return innermost(identifiers(source_tokens(files), mode), functions).select("path", "name", "line", "nid")


def reference_edges(files: DataFrame, functions: DataFrame, mode: str = "direct") -> DataFrame:
    """``src``, ``dst``: functions (path, nid, name, line_start, line_end) and those whose name they refer to, by any file.

    Names are joined by sorting: functions may be made from a table that is much smaller than they are.
    """
    found = references(files, functions, mode).select(F.col("nid").alias("src"), "name").distinct()
    return found.join(functions.select("name", F.col("nid").alias("dst")).hint("merge"), "name").select("src", "dst").distinct()
