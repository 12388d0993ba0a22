"""Column functions on source text: checksums, normalisation, arity, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grades by the score they end below: fixed values.
GRADES = [(5.0, "Excellent"), (15.0, "Good"), (30.0, "Fair"), (50.0, "Poor")]
WORST_GRADE = "Critical"
#: Patterns of comments, white space, the first parentheses and accessors: fixed values.
BLOCK_COMMENT, LINE_COMMENT, WHITE_SPACE = r"(?s)/\*.*?\*/", r"//[^\r\n]*", r"\s+"
FIRST_PARENTHESES = r"(?s)^[^{]*?\(([^)]*)\)"
GETTER, SETTER = "^(get|is)[A-Z]", "^set[A-Z]"


def normalize_code(code: Column) -> Column:
    """Code without comments and white space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(code, BLOCK_COMMENT, ""), LINE_COMMENT, ""), WHITE_SPACE, "")


def arity(code: Column) -> Column:
    """Number of comma-separated names in the first parentheses before any brace; 0 without."""
    inside = F.regexp_extract(code, FIRST_PARENTHESES, 1)
    return F.size(F.filter(F.split(inside, ","), lambda p: F.trim(F.regexp_replace(p, WHITE_SPACE, " ")) != ""))


def supported(path: Column, extensions: tuple[str, ...] = (".java",)) -> Column:
    found = F.lit(False)
    for e in extensions:
        found = found | F.endswith(F.lower(path), F.lit(e))
    return found


def simple_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def trivial_accessor(name: Column, parameters: Column) -> Column:
    """Getters and is-methods without parameters, setters with one at most."""
    last = simple_name(name)
    return (last.rlike(GETTER) & (parameters == 0)) | (last.rlike(SETTER) & (parameters <= 1))


def grade(score: Column) -> Column:
    found = F.when(score < GRADES[0][0], GRADES[0][1])
    for below, name in GRADES[1:]:
        found = found.when(score < below, name)
    return found.otherwise(WORST_GRADE)


def relative_path(path: Column) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")


def snippet(code: Column, lines: int = 15) -> Column:
    """The first lines, with a note of how many more there are."""
    parts = F.split(code, "\n")
    more = F.size(parts) - lines
    return F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.when(more > 0, F.concat(F.lit("\n... ("), more.cast("string"), F.lit(" more lines)"))).otherwise(F.lit("")))


def _alternatives(glob: str, i: int) -> tuple[list[str], int] | None:
    """What the brace at ``i`` offers, and the place after its end; None if it is not closed. Braces may hold braces."""
    parts, depth, at = [], 0, i + 1
    for j in range(i, len(glob)):
        depth += (glob[j] == "{") - (glob[j] == "}")
        if depth == 0 or (depth == 1 and glob[j] == ","):
            parts.append(glob[at:j])
            at = j + 1
        if depth == 0:
            return parts, at
    return None


def glob_regex(glob: str) -> str:
    """A path glob as an anchored regular expression: ``**`` crosses slashes, ``*`` and ``?`` do not, ``[...]`` and ``{a,{b,c}}`` as usual; dot files match."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]*/)*", i + 3
        elif glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/") and i + 2 == len(glob):
            out, i = out + ".*", i + 2
        elif c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (j := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : j]
            negated = inner[0] in "!^"
            out, i = out + "[" + ("^" if negated else "") + re.sub(r"([\\\[&])", r"\\\1", inner[negated:]) + "]", j + 1
        elif c == "{" and (found := _alternatives(glob, i)):
            out, i = out + "(?:" + "|".join(glob_regex(p)[1:-1] for p in found[0]) + ")", found[1]
        else:
            out, i = out + re.sub(r"([^\w/ -])", r"\\\1", c), i + 1
    return f"^{out}$"


def matches_glob(path: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_regex(g))
    return found
