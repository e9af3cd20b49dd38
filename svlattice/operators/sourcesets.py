"""Set and boolean queries over the source files of merged events."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svlattice.functions import fields


def names(sources: Column) -> Column:
    """Base names of an array of paths."""
    return F.array_distinct(F.transform(sources, fields.base_name))


def _lits(values) -> Column:
    return F.array(*map(F.lit, values))


def union(sources: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(names(sources), _lits(wanted)) if wanted else F.lit(False)


def intersection(sources: Column, wanted: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.array_contains(names(sources), w) for w in wanted), F.lit(True))


def specific(sources: Column, wanted: str, all_files: list[str]) -> Column:
    """In the wanted file (the first given one) and in none of the other inputs."""
    others = [f for f in all_files if f != wanted]
    return F.array_contains(names(sources), wanted) & ~union(sources, others)


def exact_support(sources: Column, n: int) -> Column:
    return F.size(F.array_distinct(sources)) == n


def support_range(sources: Column, low: int | None = None, high: int | None = None) -> Column:
    n = F.size(F.array_distinct(sources))
    out = F.lit(True)
    if low is not None:
        out = out & (n >= low)
    return out & (n <= high) if high is not None else out


class ExpressionError(ValueError):
    pass


def parse_expression(text: str, known: list[str], stems: bool = True):
    """A tree of ('or'|'and', a, b), ('not', a) and ('name', file).

    Grammar: or := and (OR and)*; and := not (AND not)*; not := NOT not | '(' or ')' | NAME. A name is a known file's base
    name, the longest that fits, or with `stems` its stem; operators are whole words, so file names may hold them.
    """
    spelled = {n: n for n in known}
    if stems:
        for n in known:
            spelled.setdefault(re.sub(r"(?<=.)\.[^.]*$", "", n), n)
    by_length = sorted(spelled, key=len, reverse=True)
    tokens, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        if text[at] in "()":
            tokens.append((text[at], None))
            at += 1
            continue
        name = next((n for n in by_length if text.startswith(n, at) and (at + len(n) == len(text) or text[at + len(n)] in "() \t\n")), None)
        word = re.match(r"(?:AND|OR|NOT)(?=[\s()]|$)", text[at:])
        if name is not None:
            tokens.append(("name", spelled[name]))
            at += len(name)
        elif word:
            tokens.append((word.group().lower(), None))
            at += len(word.group())
        else:
            raise ExpressionError(f"unknown name in expression at {text[at : at + 40]!r}")
    place = 0

    def peek():
        return tokens[place][0] if place < len(tokens) else None

    def take():
        nonlocal place
        place += 1
        return tokens[place - 1]

    def either():
        left = both()
        while peek() == "or":
            take()
            left = ("or", left, both())
        return left

    def both():
        left = unary()
        while peek() == "and":
            take()
            left = ("and", left, unary())
        return left

    def unary():
        kind = peek()
        if kind == "not":
            take()
            return ("not", unary())
        if kind == "(":
            take()
            inner = either()
            if peek() != ")":
                raise ExpressionError("a bracket isn't closed")
            take()
            return inner
        if kind == "name":
            return take()
        raise ExpressionError(f"unexpected {kind or 'end'} in expression")

    tree = either()
    if place < len(tokens):
        raise ExpressionError(f"unexpected {tokens[place][0]} in expression")
    return tree


def expression(sources: Column, text: str, known: list[str]) -> Column:
    """A boolean expression over file names as a column of array tests."""
    held = names(sources)

    def build(tree) -> Column:
        if tree[0] == "name":
            return F.array_contains(held, tree[1])
        if tree[0] == "not":
            return ~build(tree[1])
        a, b = build(tree[1]), build(tree[2])
        return a & b if tree[0] == "and" else a | b

    return build(parse_expression(text, known))


def selected(
    merged: DataFrame, files: list[str], *, expr: str | None = None, intersect: bool = False, union_: bool = False, only: list[str] | None = None,
    exact: int | None = None, low: int | None = None, high: int | None = None,
) -> DataFrame:
    """Merged events by the first given strategy: expression, intersect, union, specific, exact support, support range."""
    s, base = F.col("sources"), [f.rpartition("/")[2] for f in files]
    if expr:
        return merged.where(expression(s, expr, base))
    if intersect:
        return merged.where(intersection(s, base))
    if union_:
        return merged.where(union(s, base))
    if only:
        return merged.where(specific(s, only[0].rpartition("/")[2], base))
    if exact is not None:
        return merged.where(exact_support(s, exact))
    if low is not None or high is not None:
        return merged.where(support_range(s, low, high))
    raise ValueError("no merge strategy given")


def touching(merged: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """Merged events with a member of any of the files, which may be many: the union by joins, without a literal per file.

    members: cluster_id, source_file; files: base.
    """
    held = members.select("cluster_id", fields.base_name(F.col("source_file")).alias("base")).join(files, "base", "left_semi")
    return merged.join(held.select("cluster_id").distinct(), "cluster_id", "left_semi")


def intersections(merged: DataFrame) -> DataFrame:
    """sources_text, n_files, n: merged events by their exact set of files, the largest first."""
    held = F.array_sort(names(F.col("sources")))
    df = merged.groupBy(F.array_join(held, ",").alias("sources_text"), F.size(held).alias("n_files")).agg(F.count("*").alias("n"))
    return df.orderBy(F.desc("n"), F.desc("n_files"), "sources_text")


def file_totals(merged: DataFrame, files: DataFrame) -> DataFrame:
    """file, n: merged events that touch each file; files without any keep 0. files: one column, file."""
    n = merged.select(F.explode(names(F.col("sources"))).alias("file")).groupBy("file").agg(F.count("*").alias("n"))
    return files.select("file").distinct().join(n, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "file")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def display_names(files: list[str], custom: list[str] | None = None) -> list[str]:
    """A file's given name by position, else its stem; the numbers must agree."""
    if custom is not None and len(custom) != len(files):
        raise ValueError(f"{len(custom)} names were given for {len(files)} files")
    return list(custom) if custom is not None else [re.sub(r"(?<=.)\.[^.]*$", "", f.rpartition("/")[2]) for f in files]
