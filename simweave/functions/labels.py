"""Unit ids, labels and pair keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from simweave.functions.text import arity, normalize_code

UNIT_TYPES = ("class", "function", "block")


def path_key(path: Column) -> Column:
    """Forward slashes, last extension dropped."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"\.[^./]+$", "")


def scoped_name(unit_type: Column, name: Column, path: Column) -> Column:
    """A class is its path; a name that begins with the path's leaf takes the path in its place; others are put below it."""
    key = path_key(path)
    leaf = F.substring_index(key, "/", -1)
    inside = F.concat(leaf, F.lit("."))
    return F.when((unit_type == "class") | (name == leaf), key).when(F.startswith(name, inside), F.concat(key, F.lit("."), F.substr(name, F.length(inside) + 1))).otherwise(F.concat(key, F.lit("."), name))


def unit_id(unit_type: Column, name: Column, path: Column, start: Column, end: Column) -> Column:
    return F.concat(unit_type, F.lit(":"), scoped_name(unit_type, name, path), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def unit_label(unit_type: Column, name: Column, path: Column, code: Column) -> Column:
    """Class: path. Function: name and arity. Block: hash of the normalised code. Else the name."""
    return F.when(unit_type == "class", path).when(unit_type == "function", F.concat(name, F.lit("(arity:"), arity(code).cast("string"), F.lit(")"))).when(unit_type == "block", F.sha1(normalize_code(code))).otherwise(name)


def pair_key(unit_type: Column, left: Column, right: Column) -> Column:
    return F.concat_ws("|", unit_type, F.least(left, right), F.greatest(left, right))


def id_key(left: Column, right: Column) -> Column:
    """The same for either order of two ids."""
    return F.concat_ws("::", F.least(left, right), F.greatest(left, right))


def short_id(key: Column) -> Column:
    return F.substring(F.sha1(key), 1, 12)


def parse_pair_key(key: Column) -> Column:
    """struct(type, left, right, key) with sorted labels, or null if there are not three parts with a known type first."""
    parts = F.split(key, r"\|", -1)
    kind, a, b = (F.get(parts, F.lit(i)) for i in range(3))
    return F.when((F.size(parts) == 3) & kind.isin(*UNIT_TYPES), F.struct(kind.alias("type"), F.least(a, b).alias("left"), F.greatest(a, b).alias("right"), pair_key(kind, a, b).alias("key")))
