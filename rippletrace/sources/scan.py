"""Import statements, definitions and uses of source files.

Each reader is a chain of whole-text expressions over one row per file: no Python runs
per row and nothing is shuffled until the statements are exploded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    MARK, blank_tokens, drop_marks, drop_tokens, first_line_number, head_line, let, line_at, lines_of, number_lines, strip,
    unix_lines,
)


# a block comment that goes on in another line, and where comments begin
_LONG_COMMENT = r"/\*(?:[^*\n]|\*(?!/))*+\n"
_COMMENT = r"//|/\*"



# ---- python ---------------------------------------------------------------------------

_PY_TOKENS = (r'("""[\s\S]*?(?:"""|\z)|' r"'''[\s\S]*?(?:'''|\z)|"
              r'"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+\\?"?|' r"'[^'\\\n]*+(?:\\[^\n][^'\\\n]*+)*+\\?'?|"
              r'#[^\n]*|[^"' r"'#]+)")
_PY_END = MARK + r"\d+"
# an import statement from its first line over brackets and backslashes
_PY_IMPORT = (r"(?:(?<=\n)|\A)[ \t]*(?:import|from)(?=[\s(.])"
              r"(?:[^\n(\[{\\]++|\\[ \t]*" + _PY_END + r"\n|\\|[(\[{][^)\]}]*+[)\]}]?)*+")
_IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
# a name with what makes it no use of an import in front: a dot, or a word that binds it anew
_PY_USE = (r"(\.[ \t]*+|(?<![A-Za-z0-9_])(?:def|class|as)[ \t]++|(?<![A-Za-z0-9_]))"
           r"(" + _IDENT + r")(?:[ \t]*+\.[ \t]*+(" + _IDENT + r"))?+[ \t]*+(\(?)")
_STMT = ("array<struct<ord:bigint,module:string,level:int,names:array<string>,bound:array<string>,"
         "line:int,snippet:string>>")


def _first_token(text: Column) -> Column:
    return F.regexp_extract(text, r"^[\s()]*([A-Za-z0-9_.*]*)", 1)


def _alias(text: Column) -> Column:
    return F.when(text.rlike(r"\S\s* as "), _first_token(F.regexp_extract(text, r" as (.*)$", 1))).otherwise(
        F.lit(""))


def _py_statements(numbered: Column) -> Column:
    fragments = F.regexp_extract_all(numbered, F.lit(_PY_IMPORT), F.lit(0))

    def statements(fragment: Column) -> Column:
        line = first_line_number(fragment)
        snippet = strip(F.regexp_replace(head_line(fragment), r"\\$", ""))
        flat = drop_marks(F.regexp_replace(fragment, r"\\[ \t]*(" + _PY_END + ")", "$1"))

        def one(text: Column) -> Column:
            def plain(part: Column) -> Column:
                module = _first_token(part)
                bound = let(_alias(part), lambda alias: F.when(alias != "", alias).otherwise(F.substring_index(module, ".", 1)))
                return F.struct(F.lit(0).alias("ord"), module.alias("module"), F.lit(0).alias("level"),
                                F.array().cast("array<string>").alias("names"), F.array(bound).alias("bound"),
                                line.alias("line"), snippet.alias("snippet"))

            modules = F.filter(F.transform(F.split(F.regexp_replace(text, r"^import", ""), ","), plain),
                               lambda s: s["module"] != "")
            head = r"^from\s*(\.*)([A-Za-z0-9_.]*)"
            dots, module = F.regexp_extract(text, head, 1), F.regexp_extract(text, head, 2)
            listed = F.regexp_extract(text, head + r".*?import(?=[\s(.])(.*)$", 3)
            parts = F.filter(F.split(listed, ","), lambda p: _first_token(p) != "")
            names = F.transform(parts, _first_token)
            bound = F.transform(parts, lambda p: let(_alias(p), lambda alias: F.when(alias != "", alias).otherwise(_first_token(p))))
            from_ok = text.rlike(head + r".*?import[\s(.]") & (module != "__future__") & (
                (dots != "") | (module != ""))
            single = F.array(F.struct(
                F.lit(0).alias("ord"), module.alias("module"), F.length(dots).alias("level"),
                names.alias("names"), bound.alias("bound"), line.alias("line"), snippet.alias("snippet")))
            none = F.array().cast(_STMT)
            return (F.when(text.rlike(r"^import[\s(.]"), modules.cast(_STMT))
                    .when(text.rlike(r"^from[\s(.]") & from_ok, single.cast(_STMT)).otherwise(none))

        return F.flatten(F.transform(F.split(flat, ";"), lambda text: let(strip(text), one)))

    # the place in the file is the order, however many statements share a line
    return F.transform(F.flatten(F.transform(fragments, statements)),
                       lambda s, i: s.withField("ord", i.cast("long")))


def parse_python(files: DataFrame) -> DataFrame:
    """One row per python file with its scrubbed text and statements: the stage to store.

    Result: repo_id, rel, content, numbered, stmts.
    """
    text = blank_tokens(F.col("content"), _PY_TOKENS, lambda t: t.rlike("^[\"'#]"), F.lit(" "))
    return (files.where(F.col("rel").endswith(".py") & (F.length("rel") > 3))
            .select("repo_id", "rel", unix_lines(F.col("content")).alias("content"))
            .withColumn("numbered", number_lines(text))
            .withColumn("stmts", _py_statements(F.col("numbered"))))


def python_import_stmts(parsed: DataFrame) -> DataFrame:
    """repo_id, rel, ord, module, level, names, bound, line, snippet."""
    # an outer explode: Spark guards a plain one by a filter that would read every text again
    return (parsed.select("repo_id", "rel", F.explode_outer("stmts").alias("s")).where("s is not null")
            .select("repo_id", "rel", "s.*"))


def python_definitions(parsed: DataFrame) -> DataFrame:
    """Top-level classes and functions: repo_id, rel, name, kind, line."""
    head = r"^(class|def|async def)[ \t]+(" + _IDENT + ")"
    lines = parsed.select("repo_id", "rel", F.explode(F.filter(
        F.split("numbered", "\n"), lambda t: t.rlike(head))).alias("t"))
    return lines.select(
        "repo_id", "rel", F.regexp_extract("t", head, 2).alias("name"),
        F.when(F.regexp_extract("t", head, 1) == "class", F.lit("class")).otherwise(F.lit("function"))
        .alias("kind"), first_line_number(F.col("t")).alias("line"))


def python_uses(parsed: DataFrame) -> DataFrame:
    """Mentions of imported names: repo_id, rel, ord, name, attr, call, line, snippet."""
    bound = F.array_distinct(F.flatten(F.transform("stmts", lambda s: s["bound"])))
    code = F.regexp_replace("numbered", _PY_IMPORT, "")

    def in_line(text: Column) -> Column:
        bare = F.substring_index(text, MARK, 1)
        found = F.filter(F.regexp_extract_all(bare, F.lit(_PY_USE), F.lit(0)),
                         lambda u: F.regexp_extract(u, _PY_USE, 1) == "")
        return F.transform(found, lambda u: F.struct(
            first_line_number(text).alias("line"),
            F.regexp_extract(u, _PY_USE, 2).alias("name"),
            F.regexp_extract(u, _PY_USE, 3).alias("attr"),
            u.endswith("(").alias("call")))

    def kept(names: Column) -> Column:
        return F.filter(F.flatten(F.transform(F.split(code, "\n"), in_line)), lambda u: F.array_contains(names, u["name"]))

    def cited(lines: Column) -> Column:
        return F.transform(let(bound, kept), lambda u: u.withField("snippet", line_at(lines, u["line"])))

    rows = parsed.where(F.size("stmts") > 0).select(
        "repo_id", "rel", F.posexplode(let(lines_of(F.col("content")), cited)).alias("ord", "u"))
    return rows.select("repo_id", "rel", "ord", "u.name", "u.attr", "u.call", "u.line", "u.snippet")


# ---- typescript -----------------------------------------------------------------------

_TS_DROPPED = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
_TS_KEPT = (r'"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+\\?"?|'
              r"'[^'\\\n]*+(?:\\[^\n][^'\\\n]*+)*+\\?'?|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?|" r"[^/\"'`]+|/")
# one alternative per quote, each unrolled, so that a long literal needs no deep stack
_TS_STRING = "(?:" + "|".join(
    rf"{q}([^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+){q}" for q in "\"'`") + ")"
_TS_CALL = r"(?<![A-Za-z0-9_$])(?:require|import)\s*\([^\"'`\n]*" + _TS_STRING
_TS_BODY = r"(?:[^\"'`;\n]*\n){0,60}[^\"'`;\n]*"
_TS_FROM = r"(?=[^\"'`;]*(?<![A-Za-z0-9_$])from(?![A-Za-z0-9_$]))"
_TS_STATIC = (r"(?:(?<=\n)|\A)[ \t]*(?:import(?![A-Za-z0-9_$])(?!\s*\()|export(?![A-Za-z0-9_$])" + _TS_FROM
              + r")" + _TS_BODY + _TS_STRING)
_TS_FILE = r"\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$"


def ts_import_specs(files: DataFrame) -> DataFrame:
    """Module specifiers of TypeScript and JavaScript: repo_id, rel, ord, spec, line, snippet, type_only.

    Dynamic and static forms are read; on one line the dynamic ones come first.
    """
    clean = drop_tokens(unix_lines(F.col("content")), _TS_DROPPED, _TS_KEPT, _COMMENT, _LONG_COMMENT,
                        lambda t: t.rlike(r"^/[/*]"), ("//", "/*"))
    # without a string or a word there is no specifier; a comment may stand inside the word
    rows = files.where(F.col("rel").rlike(_TS_FILE) & F.col("content").rlike("[\"'`]")
                       & F.col("content").rlike(r"import|export|require|/\*")).select(
        "repo_id", "rel", number_lines(clean).alias("text"))

    def spec(text: Column, pattern: str) -> Column:
        # the text is one whole match
        return drop_marks(F.regexp_replace(F.regexp_replace(text, pattern, "$1$2$3"), r"\\.", ""), "")

    def calls(line: Column) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(_TS_CALL), F.lit(0)), lambda m: F.struct(
            first_line_number(line).alias("line"), F.lit(0).alias("form"), spec(m, _TS_CALL).alias("spec"),
            strip(F.substring_index(line, MARK, 1)).alias("snippet"), F.lit(False).alias("type_only")))

    dynamic = F.flatten(F.transform(F.filter(F.split("text", "\n"), lambda t: t.rlike(r"(?:require|import)\s*\(")), calls))
    # the string may end a line further down, so the rest of the head line is added back for the snippet
    found = F.regexp_extract_all("text", F.lit(_TS_STATIC + "[^\\n]*"), F.lit(0))
    static = F.transform(found, lambda m: F.struct(
        first_line_number(m).alias("line"), F.lit(1).alias("form"), spec(m, _TS_STATIC + "[^\\n]*").alias("spec"),
        head_line(m).alias("snippet"),
        (strip(m).rlike(r"^(import|export) type(?![A-Za-z0-9_$])") | drop_marks(m).contains(" type "))
        .alias("type_only")))
    placed = F.array_sort(F.transform(F.concat(dynamic, static), lambda s, i: F.struct(
        s["line"].alias("line"), s["form"].alias("form"), i.alias("at"), s["spec"].alias("spec"),
        s["snippet"].alias("snippet"), s["type_only"].alias("type_only"))))
    return (rows.select("repo_id", "rel", F.posexplode(placed).alias("at", "s"))
            .where("s.spec <> ''")
            .select("repo_id", "rel", F.col("at").cast("long").alias("ord"),
                    "s.spec", "s.line", "s.snippet", "s.type_only"))


# ---- c and c++ ------------------------------------------------------------------------

_CPP_DROPPED = (r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|"
                r"(?<![A-Za-z0-9_])(?:u8|[uUL])?R\"(?<mark>[^(\n]*)\([\s\S]*?(?:\)\k<mark>\"|\z)")
_CPP_KEPT = (r'"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+\\?"?|' r"(?<![A-Za-z0-9_])'[^'\\\n]*+(?:\\[^\n][^'\\\n]*+)*+\\?'?|"
               r"[A-Za-z0-9_]+'?|[^/\"'A-Za-z0-9_]+|/|'")
_CPP_GAP = r"[ \t]*+(?:\\[ \t]*+" + MARK + r"\d+\n[ \t]*+)*+"
_CPP_INCLUDE = (r"(?:(?<=\n)|\A)[ \t]*#" + _CPP_GAP + r"include(?![A-Za-z0-9_])" + _CPP_GAP
                + r"(?:\"([^\"\n]+)\"|<([^>\n]+)>)[^\n]*")
_CPP_FILE = r"\.(c|cc|cpp|cxx|h|hh|hpp|hxx|inl|ipp)$"


def cpp_includes(files: DataFrame) -> DataFrame:
    """Include directives: repo_id, rel, ord, path, angled, line, snippet."""
    raw_string = r"^(u8|[uUL])?R\""
    clean = drop_tokens(unix_lines(F.col("content")), _CPP_DROPPED, _CPP_KEPT, _COMMENT + '|R"', _LONG_COMMENT + '|R"',
                        lambda t: t.rlike(r"^/[/*]") | t.rlike(raw_string), ("//", "/*", 'R"'))
    # a comment or a raw string may stand inside the word
    rows = files.where(F.col("rel").rlike(_CPP_FILE) & F.col("content").contains("#")
                       & (F.col("content").contains("include") | F.col("content").contains("/*") | F.col("content").contains('R"'))).select(
        "repo_id", "rel", number_lines(clean).alias("text"))
    found = F.posexplode(F.regexp_extract_all("text", F.lit(_CPP_INCLUDE), F.lit(0))).alias("ord", "m")
    quoted = F.col("quoted")
    # one row a directive: what its two names need is worked out once
    return rows.select("repo_id", "rel", found).withColumn("quoted", F.regexp_extract("m", _CPP_INCLUDE, 1)).select(
        "repo_id", "rel", F.col("ord").cast("long").alias("ord"),
        F.when(quoted != "", quoted).otherwise(F.regexp_extract("m", _CPP_INCLUDE, 2)).alias("path"),
        (quoted == "").alias("angled"), first_line_number(F.col("m")).alias("line"),
        strip(F.regexp_replace(head_line(F.col("m")), r"\\$", "")).alias("snippet"))


# ---- readers --------------------------------------------------------------------------

_READERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "python": lambda files: python_import_stmts(parse_python(files)),
    "typescript": ts_import_specs,
    "cpp": cpp_includes,
}


def register_reader(language: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    """Add or replace the statement reader of a language (files → statements)."""
    _READERS[language] = reader


def statements(files: DataFrame, language: str) -> DataFrame:
    return _READERS[language](files)
