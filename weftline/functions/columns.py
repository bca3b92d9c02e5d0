"""Functions on columns: identity, sums, maps and nested JSON values."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.docquery import json_path


def bypass(*columns: Column) -> Column:
    """One column as it is, several as a struct."""
    return columns[0] if len(columns) == 1 else F.struct(*columns)


def summation(*columns: Column) -> Column:
    """The sum; NULL if any is."""
    return reduce(operator.add, columns)


def combine_maps(*maps: Column) -> Column:
    """All entries; of a key in several maps the last one holds."""
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b), maps)


def rename_keys(value: Column, names: dict[str, str]) -> Column:
    """A map with some keys renamed."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_keys(value, lambda k, v: F.coalesce(F.try_element_at(table, k), k))


def select_except(value: Column, keys: list[str]) -> Column:
    """A map without some keys."""
    return F.map_filter(value, lambda k, v: ~k.isin(keys))


def key_names(*names: str | dict, **renamed: str) -> dict[str, str]:
    """``{name: name}`` of plain names, and what mappings and keywords say; a key twice is an error."""
    out: dict[str, str] = {}
    for part in (*names, renamed):
        for k, v in (part.items() if isinstance(part, dict) else [(part, part)]):
            if k in out:
                raise ValueError(f"key {k!r} twice")
            out[k] = v
    return out


def name_values(names: list[str | list], value: Column) -> Column:
    """An array's values under names, as a struct; a list of names takes apart the array in its place."""
    fields = []
    for i, name in enumerate(names):
        item = F.get(value, F.lit(i))
        fields += [item.alias(name)] if isinstance(name, str) else [F.get(item, F.lit(k)).alias(n) for k, n in enumerate(name)]
    return F.struct(*fields)


def select_keys(value: Column, keys: list[str], as_: str = "map", allow_missing: bool = False) -> Column:
    """Some entries of a map, as a map or an array in the order of ``keys``; NULL if one is missing and may not be."""
    found = F.map_filter(value, lambda k, v: k.isin(keys)) if as_ == "map" else F.array(*[F.try_element_at(value, F.lit(k)) for k in keys])
    every = reduce(operator.and_, [F.map_contains_key(value, k) for k in keys], F.lit(True))
    return found if allow_missing else F.when(every, found)


def replicate(value: Column, n: int) -> Column:
    return F.array_repeat(value, n)


def path_value(value: Column, path: str | list[str], kind: str = "string") -> Column:
    """The value at a dotted path of a JSON text, NULL where there is none or it is of another kind. A list of keys may have dots in them."""
    return F.try_variant_get(F.try_parse_json(value), json_path(*_keys(path)), kind)


def _keys(path: str | list[str]) -> list[str]:
    return path.split(".") if isinstance(path, str) else path


def path_exists(value: Column, path: str | list[str]) -> Column:
    """Whether the path is there, be it with a null."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(value), json_path(*_keys(path)), "variant").isNotNull(), F.lit(False))


def stack_nested(df: DataFrame, column: str, depth: int = 1) -> DataFrame:
    """A row for each path of at most ``depth`` keys of a JSON object, with ``path`` (array) and ``value`` (JSON text).

    Paths end early where the value is not an object. Level by level, so each level is one generator.
    """
    level = df.withColumn("path", F.expr("cast(array() as array<string>)")).withColumn("__v", F.try_parse_json(column)).where("__v is not null")
    done = None
    for _ in range(depth):
        is_object = F.schema_of_variant("__v").startswith("OBJECT") & (F.schema_of_variant("__v") != "OBJECT<>")
        leaves = level.where(~is_object)
        done = leaves if done is None else done.unionByName(leaves)
        grown = level.where(is_object).lateralJoin(_children())
        level = grown.withColumn("path", F.concat("path", F.array("key"))).withColumn("__v", F.col("child")).drop("key", "child")
    done = level if done is None else done.unionByName(level)
    return done.withColumn("value", F.to_json("__v")).drop("__v")


def _children() -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().tvf.variant_explode(F.col("__v").outer()).select("key", F.col("value").alias("child"))


def merge_json(*columns: Column, depth: int = 12) -> Column:
    """JSON objects merged deeply; of two values at one path the right one holds, a right null takes the key away.

    A value that is not an object replaces what was there, an array does so as a whole, and an object replaces a value
    that is not one. A NULL column is passed over, so that the first text there is stays as it is, its nulls included.
    The result is canonical JSON: keys sorted, numbers of up to 38 digits exact. Text that isn't JSON, and an object with
    a key twice, end the query with an error; so do right objects that are nested deeper than ``depth``, as each
    level is written out once.
    """
    def both(left: Column, right: Column) -> Column:
        return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(merge_variants(left, right, depth))

    first, *others = [F.parse_json(c) for c in columns]
    if len(others) > 1:  # written out once, however many there are
        return F.to_json(F.aggregate(F.array(*others), first, both))
    return F.to_json(both(first, *others) if others else first)


#: The keys and values of an empty object.
_NOTHING = "cast(map() as map<string,variant>)"


def _entries(value: Column) -> Column:
    """The keys and values of a variant that is an object, NULL for any other."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def merge_variants(left: Column, right: Column, depth: int = 12) -> Column:
    """Two variants merged as ``merge_json`` does, ``right`` not NULL: key by key where both are objects, level by level.

    A left variant that is NULL or no object counts as an empty one, so that the nulls of a new object go too.
    """
    if depth == 0:
        return F.when(_entries(right).isNull(), right).otherwise(F.raise_error(F.lit("objects are nested deeper than the merge is written out")).cast("variant"))

    def value(_: Column, x: Column, y: Column) -> Column:
        return F.when(y.isNull(), x).when(F.is_variant_null(y), F.lit(None)).otherwise(merge_variants(x, y, depth - 1))

    old = F.coalesce(_entries(left), F.expr(_NOTHING))
    merged = F.map_filter(F.map_zip_with(old, _entries(right), value), lambda k, v: v.isNotNull())
    return F.when(_entries(right).isNull(), right).otherwise(F.to_variant_object(merged))


def path_or_create(value: Column, path: str | list[str], default: Column) -> Column:
    """``(document, value)``: a JSON object with a path made where it wasn't there, and the JSON text at that path.

    ``default`` is JSON text for a path that is missing, whose missing objects on the way are made, too. What is there stays, be it
    a null. Where something on the way is no object nothing is made: the document stays and the value is NULL; a NULL document stays, too.
    """
    keys = _keys(path)
    doc, made = F.parse_json(value), F.parse_json(default)
    on_the_way = [doc, *[F.try_variant_get(doc, json_path(*keys[:i]), "variant") for i in range(1, len(keys))]]
    for k, x in reversed(list(zip(keys, on_the_way))):
        others = F.map_filter(F.coalesce(_entries(x), F.expr(_NOTHING)), lambda name, _: name != k)
        made = F.to_variant_object(F.map_concat(others, F.create_map(F.lit(k), made)))
    blocked = reduce(operator.or_, [x.isNotNull() & _entries(x).isNull() for x in on_the_way])
    new = F.when(doc.isNull() | blocked | path_exists(value, keys), doc).otherwise(made)
    return F.struct(F.to_json(new).alias("document"), F.to_json(F.try_variant_get(new, json_path(*keys), "variant")).alias("value"))


#: A whole JSON string; from its opening quote on, so that no search begins within one.
_STRING = r'"(?:[^"\\]|\\.)*+"'


def prune_nulls(value: Column) -> Column:
    """JSON text without null fields and null array elements at any level; NULL where it isn't JSON.

    Works on the canonical text that a variant gives, in which nulls, strings and commas are the only tokens that matter;
    so no schema is needed and nothing else is lost.
    """
    text = F.to_json(F.try_parse_json(value))
    without = F.regexp_replace(text, rf"({_STRING})(?!:null)|{_STRING}:null,?+|null,?+", "$1")
    return F.regexp_replace(without, rf"({_STRING})|,(?=[\]}}])", "$1")


def merge_known(left: Column, right: Column, fields: dict[str, dict | str]) -> Column:
    """Deep merge of two structs of a known shape, all in built-in functions: right values hold where there are any."""
    out = []
    for name, kind in fields.items():
        a, b = left[name], right[name]
        out.append((merge_known(a, b, kind) if isinstance(kind, dict) else F.coalesce(b, a)).alias(name))
    return F.struct(*out)
