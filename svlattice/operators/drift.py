"""Schemas that drift between the files of a series: every change listed, and one table that is alike for all files.

Method: a file's schema is a tree: root, the branches info and format, and under them its keys, each labelled with its
kind. `edit_script` is the top-down tree edit distance between two such trees (a subtree is matched, deleted or added as
a whole; labels are relabelled, siblings aligned at least cost), whose script holds keep, add, delete, rename, retype and
move steps. A rename costs less than a delete and an add only for keys whose headers describe them alike, so the
cheapest script is the wanted one; `moves` joins a delete and an add of one name in the two branches. Scripts of a series
compile into one projection per file (branch and key -> lasting branch and key, common kind), which `unified_records`
applies. The list of changes keeps a move as a removal and an addition.

Keys and kinds of a file come from one aggregate over the unpacked fields, keyed by (file, field, key) and combined
before the shuffle; trees and scripts are of the size of schemas, never of the data.

Defined results: the first file of a series has no changes; a file without records has an empty schema; files without
a series are compared with nothing; null fields have no keys; keys without a value have no kind and are never retyped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svlattice.operators.packed import info_items, info_pairs, sample_items, sample_pairs
from svlattice.session import cut_lineage

INTEGER = r"^[+-]?[0-9]+\z"
DECIMAL = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
#: Kinds from narrow to wide; a key that drifts gets the widest it ever had.
KINDS = ("flag", "integer", "float", "string")
RENAME_COST, RETYPE_COST, EDIT_COST = 0.5, 0.25, 1.0
BRANCHES = ("info", "format")
PAIRS = "array<struct<fld: string, key: string, val: string, vals: array<string>>>"
#: Projections of up to so many keys in all are broadcast; at some hundred bytes a key this is about 100 MB.
MOST_RULES = 1_000_000


@dataclass
class Node:
    """A schema node; `alike` names what must agree for a rename (None: the node can't be renamed)."""

    name: str
    kind: str | None = None
    alike: str | None = None
    children: list[Node] = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


def _relabel(a: Node, b: Node) -> float | None:
    """The cost of turning one node into the other, children aside; None where that isn't allowed."""
    retype = RETYPE_COST if a.kind and b.kind and a.kind != b.kind else 0.0
    if a.name == b.name:
        return retype
    return RENAME_COST + retype if a.alike is not None and a.alike == b.alike else None


def edit_script(a: Node, b: Node, path: str = "") -> tuple[float, list[tuple[str, str, str, str]]]:
    """Cost and steps (step, path, old, new) of the cheapest script between two trees whose roots are matched.

    Sibling order has no meaning in a schema: both sides are ordered so that nodes that may be matched come to lie in
    the same order, equal names first, after which aligning them as sequences is optimal.
    """
    here = f"{path}/{b.name}" if path else b.name
    both = {c.name for c in a.children} & {c.name for c in b.children}
    rank = {n: i for i, n in enumerate(sorted({c.alike for c in (*a.children, *b.children) if c.alike is not None and c.name not in both}))}
    order = lambda c: (0, 0, c.name) if c.name in both else (1, rank.get(c.alike, -1), c.name)
    left, right = sorted(a.children, key=order), sorted(b.children, key=order)
    cost, steps = 0.0, []
    k = len(both)
    for x, y in zip(left[:k], right[:k]):  # equal names align at their relabelling cost, for which no other step is cheaper
        extra, inner = edit_script(x, y, here) if x.children or y.children else (0.0, [])
        cost += _relabel(x, y) + extra
        steps += [("retype", here, x.name, y.name)] if x.kind and y.kind and x.kind != y.kind else []
        steps += inner
    left, right = left[k:], right[k:]
    n, m = len(left), len(right)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    matched = {}
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            if i == n and j == m:
                continue
            options = []
            if i < n:
                options.append(best[i + 1][j] + EDIT_COST * left[i].size())
            if j < m:
                options.append(best[i][j + 1] + EDIT_COST * right[j].size())
            if i < n and j < m and (c := _relabel(left[i], right[j])) is not None:
                matched[i, j] = c + (edit_script(left[i], right[j], here)[0] if left[i].children or right[j].children else 0.0)
                options.append(best[i + 1][j + 1] + matched[i, j])
            best[i][j] = min(options)
    i = j = 0
    while i < n or j < m:
        if (i, j) in matched and best[i][j] == best[i + 1][j + 1] + matched[i, j]:
            x, y = left[i], right[j]
            steps.append(("rename", here, x.name, y.name))
            steps += [("retype", here, x.name, y.name)] if x.kind and y.kind and x.kind != y.kind else []
            steps += edit_script(x, y, here)[1]
            i, j = i + 1, j + 1
        elif i < n and best[i][j] == best[i + 1][j] + EDIT_COST * left[i].size():
            steps.append(("delete", here, left[i].name, ""))
            i += 1
        else:
            steps.append(("add", here, "", right[j].name))
            j += 1
    return cost + best[0][0], steps


def moves(steps: list[tuple[str, str, str, str]]) -> list[tuple[str, str, str, str]]:
    """Steps with a delete and an add of one name under different branches joined to a move (path is 'from>to')."""
    gone, new = {}, {}
    for s in steps:
        if s[0] in ("delete", "add"):
            (gone if s[0] == "delete" else new).setdefault(s[2] or s[3], []).append(s)
    out = list(steps)
    for name in gone.keys() & new.keys():
        for d, a in zip(gone[name], new[name]):
            out.remove(d)
            out[out.index(a)] = ("move", f"{d[1]}>{a[1]}", name, name)
    return out


def schema_tree(entries: list) -> Node:
    """entries: (fld, key, kind, description) of one file."""
    root = Node("schema")
    branch = {}
    for fld in BRANCHES:
        branch[fld] = Node(fld)
        root.children.append(branch[fld])
    for e in entries if entries is not None else []:
        branch[e["fld"]].children.append(Node(e["key"], e["kind"], e["description"]))
    return root


def file_keys(events: DataFrame) -> DataFrame:
    """file_id, fld, key, kind, fits (no value is longer than 18 characters) of every key in the records of a file."""
    info = info_items(events, "info_raw", ["file_id"]).select("file_id", F.lit("info").alias("fld"), F.col("item_key").alias("key"), "has_value", "val")
    fmt = sample_items(events, "sample_raw", "format_raw", ["file_id"], keys=True)
    fmt = fmt.select("file_id", F.lit("format").alias("fld"), F.col("item_key").alias("key"), F.lit(True).alias("has_value"), "val")
    given = F.when(~F.col("val").isin("", "."), F.col("val"))
    per_key = (
        info.unionByName(fmt).withColumn("_v", given).groupBy("file_id", "fld", "key")
        .agg(
            F.bool_or("has_value").alias("valued"), F.count("_v").alias("n"), F.bool_and(F.col("_v").rlike(INTEGER)).alias("ints"), F.bool_and(F.col("_v").rlike(DECIMAL)).alias("decimals"),
            F.coalesce(F.max(F.length("_v")) <= 18, F.lit(True)).alias("fits"),
        )
    )
    kind = F.when(~F.col("valued"), "flag").when(F.col("n") == 0, None).when(F.col("ints"), "integer").when(F.col("decimals"), "float").otherwise("string")
    return per_key.select("file_id", "fld", "key", kind.alias("kind"), "fits")


def same_words(text: Column) -> Column:
    """A description apart from case, runs of spaces and final full stops."""
    return F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), r"[. ]+\z", ""))


def declared_keys(headers: DataFrame) -> DataFrame:
    """file_id, fld, key, description of the INFO and FORMAT declarations; of repeated ones the first."""
    line = F.col("line")
    df = headers.where(line.rlike(r"^##(INFO|FORMAT)=<")).select(
        "file_id", "line_no", F.lower(F.regexp_extract(line, r"^##(INFO|FORMAT)=<", 1)).alias("fld"),
        F.regexp_extract(line, r"[<,]\s*ID=([^,>\"]+)", 1).alias("key"), same_words(F.regexp_extract(line, r'Description="([^"]*)', 1)).alias("description"),
    )
    return df.where("key <> '' and description <> ''").groupBy("file_id", "fld", "key").agg(F.min_by("description", "line_no").alias("description"))


def file_schemas(events: DataFrame, headers: DataFrame) -> DataFrame:
    """file_id, entries: an array of (fld, key, kind, description, fits) as long as the file's schema."""
    keys = file_keys(events).join(declared_keys(headers), ["file_id", "fld", "key"], "left")
    return keys.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("fld", "key", "kind", "description", "fits"))).alias("entries"))


def _scripts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for file_id, before, after in zip(p["file_id"], p["before"], p["entries"]):
            _, steps = edit_script(schema_tree(before), schema_tree(after))
            rows += [(file_id, path.rpartition("/")[2], step, old, new) for step, path, old, new in steps]
        yield pd.DataFrame(rows, columns=["file_id", "fld", "step", "old_key", "new_key"])


def schema_changes(events: DataFrame, headers: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, fld, drift, old_key, new_key: each file against the one before it in its series."""
    order = Window.partitionBy("series_id").orderBy("produced_at", "file_id")
    pairs = files.where(F.col("series_id").isNotNull()).select("file_id", F.lag("file_id").over(order).alias("prev_id")).where("prev_id is not null")
    schemas = file_schemas(events, headers)
    pairs = pairs.join(schemas, "file_id", "left").join(schemas.select(F.col("file_id").alias("prev_id"), F.col("entries").alias("before")), "prev_id", "left")
    steps = pairs.select("file_id", "before", "entries").mapInPandas(_scripts, "file_id long, fld string, step string, old_key string, new_key string")
    named = F.when(F.col("step") == "add", "added").when(F.col("step") == "delete", "removed").when(F.col("step") == "rename", "renamed").otherwise("retyped")
    return steps.select("file_id", "fld", named.alias("drift"), "old_key", "new_key")


@dataclass
class _Column:
    """A key's identity along a series: its branch and name in the newest file that has it, and the widest kind it ever had."""

    fld: str
    name: str
    kind: str | None = None


def _projections(series: pd.DataFrame) -> pd.DataFrame:
    """Compiles a series' scripts: of each file and key the lasting branch and key, and the widest kind.

    Renames and moves carry a key's identity on. Two keys never share a lasting name: where an older key's name was later
    taken over by another, it gets the next free one of name~1, name~2 and so on.
    """
    series = series.sort_values(["produced_at", "file_id"])
    current: dict[tuple[str, str], _Column] = {}
    every: list[_Column] = []
    rows, before = [], None
    for file_id, entries in zip(series["file_id"], series["entries"]):
        entries = entries if entries is not None else []
        if before is not None:
            carried = []
            for step, path, old, new in moves(edit_script(schema_tree(before), schema_tree(entries))[1]):
                if step == "rename":
                    fld = path.rpartition("/")[2]
                    carried.append(((fld, new), current.pop((fld, old))))
                elif step == "move":
                    source, target = (p.rpartition("/")[2] for p in path.split(">"))
                    carried.append(((target, new), current.pop((source, old))))
            current |= dict(carried)
        for e in entries:
            place = (e["fld"], e["key"])
            if place not in current:
                current[place] = _Column(*place)
                every.append(current[place])
            column = current[place]
            column.fld, column.name = place
            kind = e["kind"] if e["kind"] != "integer" or e["fits"] else "string"
            if kind and (column.kind is None or KINDS.index(kind) > KINDS.index(column.kind)):
                column.kind = kind
            rows.append((file_id, *place, column))
        before = entries
    names = {id(c): place for place, c in current.items()}
    taken = set(current)
    for column in every:
        if id(column) not in names:
            name, n = column.name, 0
            while (column.fld, name) in taken:
                n += 1
                name = f"{column.name}~{n}"
            names[id(column)] = (column.fld, name)
            taken.add((column.fld, name))
    return pd.DataFrame([(f, fld, k, *names[id(c)], c.kind) for f, fld, k, c in rows], columns=["file_id", "fld", "key", "lasting_fld", "lasting_key", "kind"])


def projections(events: DataFrame, headers: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, fld, key, lasting_fld, lasting_key, kind. A series has few files (one group holds schemas, not records).

    The kind is the widest that the lasting key has in any file of any series, so that it is one for the whole table;
    integers beyond 18 digits count as strings here.
    """
    df = files.select("file_id", "produced_at", F.coalesce("series_id", F.concat(F.lit("file "), F.col("file_id").cast("string"))).alias("series_id"))
    df = df.join(file_schemas(events, headers), "file_id", "left")
    df = df.groupBy("series_id").applyInPandas(_projections, "file_id long, fld string, key string, lasting_fld string, lasting_key string, kind string")
    df = cut_lineage(df)
    order = F.array(*map(F.lit, KINDS))
    width = F.max(F.array_position(order, F.col("kind")))
    common = df.groupBy("lasting_fld", "lasting_key").agg(F.get(order, (width - 1).cast("int")).alias("kind"))
    return df.drop("kind").join(common, ["lasting_fld", "lasting_key"])


def unified_records(events: DataFrame, headers: DataFrame, files: DataFrame) -> DataFrame:
    """ord, file_id, chrom, pos, sv_id and of info and format: all records with their keys' lasting names and types.

    info and format are maps of lasting key -> values joined by ','; of a key that a row repeats the last counts, and a
    flag is 'true'. info_values and format_values are maps of lasting key -> array of the single values, of a repeated key
    all in order; a flag's is empty. info_numbers and format_numbers hold the same arrays as numbers, of the keys whose
    common kind is integer or float; '' and '.' are null. The kinds are maps of the file's lasting keys -> that common kind,
    null where no file has a value. A key that moved between info and format is in the map of its newest place.

    Each file's projection is one row. They are written once and counted: up to `MOST_RULES` keys they are broadcast, so
    the records aren't shuffled; beyond that they join by file, and the adaptive skew join splits a hot file's side.
    """
    rules = projections(events, headers, files)
    target = F.struct(F.col("lasting_fld").alias("fld"), F.col("lasting_key").alias("key"))
    changed = (F.col("fld") != F.col("lasting_fld")) | (F.col("key") != F.col("lasting_key"))
    rules = rules.groupBy("file_id").agg(
        *(F.map_from_entries(F.collect_list(F.when((F.col("fld") == f) & changed, F.struct(F.col("key"), target)))).alias(f"_{f}") for f in BRANCHES),
        *(_kinds(F.collect_list(F.when(F.col("lasting_fld") == f, F.struct("lasting_key", "kind")))).alias(f"{f}_kinds") for f in BRANCHES),
        F.bool_or(F.col("fld") != F.col("lasting_fld")).alias("_moved"), F.count("*").alias("_n"),
    )
    rules = cut_lineage(rules)
    if (rules.agg(F.sum("_n")).first()[0] or 0) <= MOST_RULES:
        rules = F.broadcast(rules)
    rows = events.select("ord", "file_id", "chrom", "pos", "sv_id", "info_raw", "format_raw", "sample_raw").join(rules, "file_id", "left")
    rows = sample_pairs(info_pairs(rows, "info_raw", "_ip"), "sample_raw", "format_raw", "_fp")
    same, kinds = ["ord", "file_id", "chrom", "pos", "sv_id"], ["info_kinds", "format_kinds"]
    rows = rows.select(*same, *kinds, "_moved", _renamed("_ip", "_info", "info").alias("_ir"), _renamed("_fp", "_format", "format").alias("_fr"))
    rows = rows.select(*same, *kinds, _placed("_ir", "_fr", "info").alias("_i"), _placed("_fr", "_ir", "format").alias("_f"))
    rows = rows.select(*same, _last_of_each("_i").alias("info"), _last_of_each("_f").alias("format"), _all_of_each("_i").alias("info_values"), _all_of_each("_f").alias("format_values"), *kinds)
    return rows.select("*", *(_numbers(f"{f}_values", f"{f}_kinds").alias(f"{f}_numbers") for f in BRANCHES))


def _kinds(rules: Column) -> Column:
    """A map of lasting key -> kind, the widest one of keys that share a lasting name."""
    order = F.array(*map(F.lit, KINDS))
    widest = lambda k: F.array_max(F.transform(F.filter(rules, lambda x: x["lasting_key"] == k), lambda x: F.array_position(order, x["kind"])))
    keys = F.array_distinct(F.transform(rules, lambda x: x["lasting_key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(order, (widest(k) - 1).cast("int"))))


def _renamed(pairs: str, rules: str, fld: str) -> Column:
    """The pairs with their lasting branch and key; rules hold only the keys that change."""
    found = F.transform(pairs, lambda x: F.struct(F.try_element_at(F.col(rules), x["key"]).alias("to"), x.alias("x")))
    moved = lambda y: F.struct(F.coalesce(y["to"]["fld"], F.lit(fld)).alias("fld"), F.coalesce(y["to"]["key"], y["x"]["key"]).alias("key"), y["x"]["val"].alias("val"), y["x"]["vals"].alias("vals"))
    same = F.transform(pairs, lambda x: F.struct(F.lit(fld).alias("fld"), x["key"].alias("key"), x["val"].alias("val"), x["vals"].alias("vals")))
    return F.when(F.coalesce(F.size(rules), F.lit(0)) > 0, F.transform(found, moved)).otherwise(same)


def _placed(own: str, other: str, fld: str) -> Column:
    """The pairs whose lasting place is `fld`: a field's own, and those that moved there; null for a null field to which none moved."""
    of = lambda pairs: F.filter(F.coalesce(pairs, F.array().cast(PAIRS)), lambda x: x["fld"] == fld)
    both = F.concat(of(F.col(own)), of(F.col(other)))
    return F.when(~F.coalesce("_moved", F.lit(False)), F.col(own)).when(F.col(own).isNotNull() | (F.size(both) > 0), both)


def _numbers(values: str, kinds: str) -> Column:
    """The keys of a numeric kind with their values as numbers."""
    numeric = F.map_filter(F.col(values), lambda k, _: F.coalesce(F.try_element_at(F.col(kinds), k).isin("integer", "float"), F.lit(False)))
    return F.transform_values(numeric, lambda _, vs: F.transform(vs, lambda v: v.try_cast("double")))


def _last_of_each(pairs: str) -> Column:
    """A map of the pairs, the last one of equal keys; rows whose keys differ, nearly all, take the short way."""
    keys = F.array_distinct(F.col(pairs)["key"])
    last = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda x: x["key"] == k), -1)["val"])
    return F.when(F.size(keys) == F.size(pairs), F.map_from_arrays(keys, F.col(pairs)["val"])).otherwise(F.map_from_arrays(keys, last))


def _all_of_each(pairs: str) -> Column:
    """A map of the pairs' single values, those of equal keys one after another."""
    keys = F.array_distinct(F.col(pairs)["key"])
    every = F.transform(keys, lambda k: F.flatten(F.filter(pairs, lambda x: x["key"] == k)["vals"]))
    return F.when(F.size(keys) == F.size(pairs), F.map_from_arrays(keys, F.col(pairs)["vals"])).otherwise(F.map_from_arrays(keys, every))
