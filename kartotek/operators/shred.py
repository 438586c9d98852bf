"""A nested table as linked flat tables, one per array or map at any depth, and back again."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartotek.operators.nested import quoted

# Signs with a meaning in the names of flat columns; they are escaped in field names.
_SIGNS = re.compile(r"([\\.?#@^\[\]])")
THERE, LENGTH, ELEMENT = "?", "#", "[]"


@dataclass
class _Table:
    """What one flat table holds: its leaves, flags and lengths by name with their path, and the tables below it."""

    name: str
    kind: T.DataType
    columns: list[tuple[str, tuple[str, ...], str]] = field(default_factory=list)
    below: list[tuple[tuple[str, ...], "_Table"]] = field(default_factory=list)


def _joined(parts: tuple[str, ...]) -> str:
    return ".".join(_SIGNS.sub(r"\\\1", p) for p in parts)


def _element(kind: T.DataType) -> T.DataType | None:
    """The type of an array's elements or of a map's entries."""
    if isinstance(kind, T.ArrayType):
        return kind.elementType
    if isinstance(kind, T.MapType):
        return T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
    return None


def _tree(kind: T.DataType, name: str, rooted: tuple[str, ...] = ()) -> _Table:
    """The tables of a type; columns in ``rooted`` are keys and no part of the content."""
    table = _Table(name, kind)

    def walk(inner: T.DataType, path: tuple[str, ...]) -> None:
        if isinstance(inner, T.StructType):
            if path or name:
                table.columns.append((_joined(path) + THERE, path, THERE))
            for f in inner.fields:
                if path or name or f.name not in rooted:
                    walk(f.dataType, (*path, f.name))
        elif (element := _element(inner)) is not None:
            table.columns.append((_joined(path) + LENGTH, path, LENGTH))
            table.below.append((path, _tree(element, ".".join(n for n in (name, _joined(path)) if n) + ELEMENT)))
        else:
            table.columns.append((_joined(path) or "value", path, ""))

    walk(kind, ())
    return table


def _at(base: Column | None, path: tuple[str, ...]) -> Column:
    if base is None:
        base, path = F.col(quoted(path[0])), path[1:]
    return reduce(lambda c, part: c.getField(part), path, base)


def _positions(depth: int) -> list[str]:
    return [f"@{i}" for i in range(1, depth + 1)]


def _links(key: list[str], depth: int) -> list[str]:
    """The columns that name a row: the key in the top table; below it the key with a sign in front, and positions."""
    return [*[f"^{k}" if depth else k for k in key], *_positions(depth)]


def _of_path(kind: T.DataType, path: tuple[str, ...]) -> T.DataType:
    for part in path:
        kind = kind[part].dataType
    return kind


def shred(frame: DataFrame, key: list[str]) -> dict[str, DataFrame]:
    """The table without its arrays and maps under the name ``""``, and one table for each of these by its path.

    ``key`` names flat columns that tell the rows apart. A table at depth n has them as ``^key`` and the positions ``@1`` to
    ``@<n>`` (from 0) of its elements, so these without the last position link a row to the one it belongs to. Structs
    become columns with dotted names; ``x?`` says whether a struct is there and ``x#`` how long an array or map is, null
    where it is null itself; so null, empty and null-filled values stay apart. An element that is no struct is
    the column ``value``, one that is has its own flag ``?``, and the entries of a map are rows with ``key`` and ``value``. Signs of this
    notation in field names get a backslash, so names from the data clash neither with links nor with each other; only
    a key that has the very name of a nested column, as ``x.y``, is an error.

    No row is joined or shuffled, and a table made from a Parquet file reads only its own leaves.
    """
    tree = _tree(frame.schema, "", tuple(key))
    out: dict[str, DataFrame] = {}
    clash = set(key) & {name for name, _, _ in tree.columns}
    if clash:
        raise ValueError(f"key columns have the names of nested columns: {sorted(clash)}")

    def build(table: _Table, rows: DataFrame, base: Column | None, depth: int) -> None:
        content = []
        for name, path, what in table.columns:
            value = _at(base, path)
            if what == THERE:
                value = value.isNotNull()
            elif what == LENGTH:
                value = F.when(value.isNotNull(), F.size(value))
            content.append(value.alias(name))
        out[table.name] = rows.select(*[F.col(quoted(c)) for c in _links(key, depth)], *content)
        for path, child in table.below:
            value = _at(base, path)
            if isinstance(_of_path(table.kind, path), T.MapType):
                value = F.map_entries(value)
            held = [F.col(quoted(c)).alias(n) for c, n in zip(_links(key, depth), _links(key, depth + 1))]
            opened = rows.select(*held, F.posexplode(value).alias(f"@{depth + 1}", "@element"))
            build(child, opened, F.col("`@element`"), depth + 1)

    build(tree, frame, None, 0)
    return out


def restore(tables: dict[str, DataFrame], schema: T.StructType, key: list[str]) -> DataFrame:
    """The nested table of ``schema`` from the tables that :func:`shred` made, whatever order their rows are in.

    Elements are gathered by (key, positions) into the array they came from, so no task holds more than the rows had.
    Rows of a lower table without a row above them are left out. A null key equals a null key.
    """
    tree = _tree(schema, "", tuple(key))

    def built(table: _Table, depth: int) -> DataFrame:
        """The links and ``@value``, or the nested columns themselves at the top."""
        links = _links(key, depth)
        rows = tables[table.name]
        names = {(path, what): name for name, path, what in table.columns}
        gathered: dict[tuple[str, ...], str] = {}
        for i, (path, child) in enumerate(table.below):
            lists = built(child, depth + 1)
            column = f"@list{i}"
            items = F.collect_list(F.struct(F.col(f"`@{depth + 1}`").alias("at"), F.col("`@value`").alias("v")))
            ordered = F.array_sort(items, lambda a, b: a["at"] - b["at"])
            lists = lists.groupBy(*[F.col(quoted(k)).alias(f"@k{j}") for j, k in enumerate(_links(key, depth + 1)[:-1])]).agg(
                F.transform(ordered, lambda e: e["v"]).alias(column)
            )
            same = [F.col(quoted(k)).eqNullSafe(F.col(f"`@k{j}`")) for j, k in enumerate(links)]
            rows = rows.join(lists, reduce(lambda a, b: a & b, same), "left").drop(*[f"@k{j}" for j in range(len(links))])
            gathered[path] = column

        def value(kind: T.DataType, path: tuple[str, ...]) -> Column:
            if isinstance(kind, T.StructType):
                whole = F.struct(*[value(f.dataType, (*path, f.name)).alias(f.name) for f in kind.fields])
                return F.when(F.col(quoted(names[path, THERE])), whole)
            element = _element(kind)
            if element is None:
                return F.col(quoted(names[path, ""]))
            listed, length = F.col(quoted(gathered[path])), F.col(quoted(names[path, LENGTH]))
            empty = F.array().cast(T.ArrayType(element))
            if isinstance(kind, T.MapType):
                listed, empty = F.map_from_entries(listed), F.map_from_entries(empty)
            return F.when(length == 0, empty).when(length > 0, listed)

        if depth:
            return rows.select(*[F.col(quoted(k)) for k in links], value(table.kind, ()).alias("@value"))
        columns = [F.col(quoted(f.name)) if f.name in key else value(f.dataType, (f.name,)).alias(f.name) for f in schema.fields]
        return rows.select(*columns)

    return built(tree, 0)
