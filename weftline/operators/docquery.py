"""A document query service: JSON filters, access rules, sorting and paging over a table of documents.

Documents have ``_id``, ``category``, ``data`` (JSON text), ``user_id``, ``is_public``, ``created_at``,
``updated_at``. A filter is checked as plain data first and then becomes one predicate for Catalyst.
"""

from __future__ import annotations

import json
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import scan

# The limits and names of the query language.
MAX_DEPTH, MAX_KEYS, MAX_REGEX = 10, 200, 128
LOGIC = ("$and", "$or", "$nor")
COMPARISONS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")
OPERATORS = (*LOGIC, *COMPARISONS, "$in", "$nin", "$exists", "$regex", "$options")
PROTECTED = ("category", "user_id", "_id", "is_public")
SORTS = ("_id", "created_at", "updated_at")
DEFAULT_LIMIT, MAX_LIMIT = 50, 200
TRUE_WORDS = ("1", "true", "yes", "y", "on", "data", "full")
FILE_NAME = r"^[a-zA-Z0-9][a-zA-Z0-9._-]{0,127}$"


class QueryError(ValueError):
    """A filter, sort or page that the service rejects."""


def sanitize(query: object, depth: int = 0, keys: list[int] | None = None) -> object:
    """The filter without protected fields; too deep, too many keys, unknown operators or long patterns are errors."""
    keys = [0] if keys is None else keys
    if depth > MAX_DEPTH:
        raise QueryError("the filter is too deep")
    if isinstance(query, list):
        return [sanitize(x, depth + 1, keys) for x in query]
    if not isinstance(query, dict):
        return query
    out = {}
    for k, v in query.items():
        keys[0] += 1
        if keys[0] > MAX_KEYS:
            raise QueryError("the filter has too many keys")
        if k.startswith("$"):
            if k not in OPERATORS:
                raise QueryError(f"unknown operator {k}")
            if k == "$regex" and (not isinstance(v, str) or len(v) > MAX_REGEX):
                raise QueryError("the pattern is too long")
        elif k.split(".")[0] in PROTECTED:
            continue
        out[k] = sanitize(v, depth + 1, keys)
    return out


@dataclass(frozen=True)
class Field:
    """How a field is tested: ``some(op, literal)``, whether a value of it passes the test, and whether it is there at all; never NULL."""

    some: Callable[[str, object], Column]
    exists: Column


_TESTS = {"$eq": operator.eq, "$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


def json_path(*keys: str) -> str:
    """The path of nested keys of a variant, whatever dots or quotes of one kind they have."""
    out = "$"
    for k in keys:
        if "'" in k and '"' in k:
            raise QueryError(f"a key with both kinds of quotes: {k!r}")
        out += f'["{k}"]' if "'" in k else f"['{k}']"
    return out


def _variant_test(x: Column, op: str, v: object) -> Column:
    """A test of one variant, within the literal's type; whole numbers exactly, as decimals where the value is one; never NULL."""
    kind, value = F.schema_of_variant(x), lambda t: F.try_variant_get(x, "$", t)
    if op == "$regex":
        return F.coalesce((kind == "STRING") & value("string").rlike(v), F.lit(False))
    test = _TESTS[op]
    if v is None:
        return F.coalesce(kind == "VOID", F.lit(False)) if op == "$eq" else F.lit(False)
    if isinstance(v, (dict, list)):
        if op != "$eq":
            raise QueryError(f"{op} needs a plain value")
        return F.coalesce(F.to_json(x) == json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False), F.lit(False))
    if _kind(v) != "number":
        return F.coalesce((kind == _kind(v).upper()) & test(value(_kind(v)), v), F.lit(False))
    same = test(value("double"), float(v))
    if isinstance(v, int) and abs(v) < 10**28:
        same = F.coalesce(test(value("decimal(38,9)"), F.lit(str(v)).cast("decimal(38,9)")), same)
    return F.coalesce(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & same, F.lit(False))


def json_field(column: str) -> Callable[[str], Field]:
    """Fields of a JSON text column by dotted path, as a document store reads them.

    A part of a path is a key or, in an array, the number of an element; a key of an array is that of its objects. A test
    holds for an array if it holds for the array or one of its elements. Values are compared within their type.
    """
    v = F.try_parse_json(F.col(column))
    is_a = lambda x, what: F.coalesce(F.schema_of_variant(x).startswith(what), F.lit(False))
    items = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.expr("cast(array() as array<variant>)"))

    def behind(found: Column, part: str) -> Column:
        """All values behind one part of a path, from an array of variants."""
        inner = lambda x: F.try_variant_get(x, json_path(part), "variant")
        place = F.try_variant_get if part.isdigit() else None

        def of(x: Column) -> Column:
            many = F.filter(F.transform(items(x), inner), lambda y: y.isNotNull())
            if place is not None:
                many = F.concat(F.filter(F.array(place(x, f"$[{int(part)}]", "variant")), lambda y: y.isNotNull()), many)
            return F.when(is_a(x, "ARRAY"), many).otherwise(F.filter(F.array(inner(x)), lambda y: y.isNotNull()))

        return F.flatten(F.transform(found, of))

    def find(path: str) -> Field:
        parts = path.split(".")
        direct = F.try_variant_get(v, json_path(*parts), "variant")
        plain = direct.isNotNull() & ~is_a(direct, "ARRAY")
        found = reduce(behind, parts, F.array(v))

        def some(op: str, value: object) -> Column:
            each = lambda x: _variant_test(x, op, value) | (is_a(x, "ARRAY") & F.exists(items(x), lambda y: _variant_test(y, op, value)))
            there = F.coalesce(F.exists(found, each), F.lit(False))
            if value is None and op == "$eq":
                there = there | (F.coalesce(F.size(found), F.lit(0)) == 0)
            return F.when(plain, _variant_test(direct, op, value)).otherwise(there)

        return Field(some, F.when(plain, True).otherwise(F.coalesce(F.size(found), F.lit(0)) > 0))

    return find


def _column_test(c: Column, kind: T.DataType | None, op: str, v: object) -> Column:
    """A test of a plain column in a form that reaches the scan; values of another type than the column's pass none."""
    if op == "$regex":
        return c.isNotNull() & c.rlike(v) if kind is None or isinstance(kind, T.StringType) else F.lit(False)
    if v is None:
        return c.isNull() if op == "$eq" else F.lit(False)
    if isinstance(v, (dict, list)):
        if op != "$eq":
            raise QueryError(f"{op} needs a plain value")
        return F.lit(False)
    is_number, test = _kind(v) == "number", lambda a, b: a.isNotNull() & _TESTS[op](a, b)
    if kind is None:
        return test(c, F.lit(v))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) and isinstance(v, str):
        return F.lit(v).try_cast(kind).isNotNull() & test(c, F.lit(v).try_cast(kind))
    if isinstance(kind, T.BooleanType) != isinstance(v, bool) or isinstance(kind, T.StringType) != isinstance(v, str) or isinstance(kind, T.NumericType) != is_number:
        return F.lit(False)
    if not is_number:
        return test(c, F.lit(v))
    if isinstance(kind, T.IntegralType):
        if isinstance(v, float):
            if math.isinf(v):
                return c.isNotNull() & F.lit((v > 0) == (op in ("$lt", "$lte")) and op != "$eq")
            if math.isnan(v) or (op == "$eq" and v != math.floor(v)):
                return F.lit(False)
            op, v = ("$gte", math.floor(v) + 1) if op == "$gt" else ("$gte", math.ceil(v)) if op == "$gte" else ("$lte", math.ceil(v) - 1) if op == "$lt" else ("$lte", math.floor(v)) if op == "$lte" else (op, int(v))
        least, most = -(1 << 63), (1 << 63) - 1
        if not least <= v <= most:  # no such number can be stored
            return c.isNotNull() & F.lit(op in ("$lt", "$lte") if v > 0 else op in ("$gt", "$gte"))
        return test(c, F.lit(v))
    if isinstance(kind, T.DecimalType):
        return test(c, F.lit(v) if isinstance(v, float) else F.lit(Decimal(v)) if abs(v) < 10**38 else F.lit(float(v)))
    return test(c, F.lit(float(v)))


def column_field(names: dict[str, str] | None = None, of: DataFrame | None = None) -> Callable[[str], Field]:
    """Fields that are columns of a table; tests are pushed down to its scan where Parquet can.

    With the table, ``of``, values are compared within their columns' types: one of another type passes no test. Without it the
    query has to compare each column with values of its type. Dates and times are compared with texts in ISO form.
    """
    def find(path: str) -> Field:
        name = (names or {}).get(path, path)
        kind = of.schema[name].dataType if of is not None else None
        c = F.col(f"`{name}`") if of is not None else F.col(name)
        return Field(lambda op, v: _column_test(c, kind, op, v), c.isNotNull())

    return find


def _kind(value: object) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"


def _parts(op: str, value: object) -> list[dict]:
    if not isinstance(value, list) or not value or not all(isinstance(x, dict) for x in value):
        raise QueryError(f"{op} needs a list of filters")
    return value


def predicate(query: dict, field: Callable[[str], Field]) -> Column:
    """The filter as a Column that is never NULL; a malformed one is a ``QueryError``."""
    parts = []
    for k, v in query.items():
        if k == "$and":
            parts.append(reduce(lambda a, b: a & b, [predicate(x, field) for x in _parts(k, v)]))
        elif k == "$or":
            parts.append(reduce(lambda a, b: a | b, [predicate(x, field) for x in _parts(k, v)]))
        elif k == "$nor":
            parts.append(~reduce(lambda a, b: a | b, [predicate(x, field) for x in _parts(k, v)]))
        elif k.startswith("$"):
            raise QueryError(f"{k} needs a field")
        else:
            parts.append(_condition(field(k), v if isinstance(v, dict) and any(x.startswith("$") for x in v) else {"$eq": v}))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _pattern(text: object, options: object) -> str:
    if not isinstance(text, str) or not isinstance(options or "", str) or set(options or "") - set("imsx"):
        raise QueryError("not a pattern")
    full = f"(?{options}){text}" if options else text
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(full)
    except Exception as wrong:
        raise QueryError(f"not a pattern: {text!r}") from wrong
    return full


def _condition(f: Field, tests: dict) -> Column:
    """All tests of one field; what has no such field passes none but those for null, and differs from any value."""
    out = []
    some = f.some
    for op, v in tests.items():
        if op == "$options":
            continue
        if op == "$exists":
            out.append(f.exists if v else ~f.exists)
        elif op == "$regex":
            out.append(f.some("$regex", _pattern(v, tests.get("$options"))))
        elif op in ("$in", "$nin"):
            if not isinstance(v, list):
                raise QueryError(f"{op} needs a list")
            found = reduce(lambda a, b: a | b, [some("$eq", x) for x in v], F.lit(False))
            out.append(found if op == "$in" else ~found)
        elif op not in COMPARISONS:
            raise QueryError(f"{op} is no test of a field")
        elif op == "$ne":
            out.append(~some("$eq", v))
        else:
            out.append(f.some(op, v))
    return reduce(lambda a, b: a & b, out) if out else F.lit(True)


@dataclass(frozen=True)
class User:
    """Who asks: no id for strangers; ``roles`` may widen or narrow what they may do; ``admin`` is the role of that name."""

    id: str | int | None = None
    roles: tuple[str, ...] = ()
    admin: bool = False


# The rules of a category that has none.
ACTIONS = ("create", "list", "read", "update", "delete")
DEFAULT_ACL = {"roles": {"admin": dict.fromkeys(ACTIONS, "all"), "user": dict.fromkeys(ACTIONS, "own")}, "default_role": "user"}


def scope(user: User, acl: dict | None, action: str) -> str:
    """``all``, ``own`` or ``none``, as ``{"roles": {role: {action: scope}}, "default_role": role}`` says.

    One role decides: ``admin`` before the others, these in the user's order; users without any have the default role.
    A role that isn't configured is passed over; an action that a role doesn't name is ``all`` to ``admin``, else ``none``.
    """
    acl = acl or DEFAULT_ACL
    rules, held = acl.get("roles") or {}, list(user.roles)
    if user.admin or "admin" in held:
        held = ["admin", *(r for r in held if r != "admin")]
    decides = next((r for r in held or [acl.get("default_role", "user")] if r in rules), None)
    return "none" if decides is None else rules[decides].get(action, "all" if decides == "admin" else "none")


def access(user: User, acl: dict | None = None, action: str = "list") -> Column:
    """The row-level rule: strangers see public rows alone; ``own`` means own or public ones to read, own ones to write."""
    own, public, reads = F.coalesce(F.col("user_id") == F.lit(user.id), F.lit(False)), F.coalesce(F.col("is_public"), F.lit(False)), action in ("list", "read")
    if user.id is None and not user.admin:
        return public if reads else F.lit(False)
    allowed = scope(user, acl, action)
    return F.lit(True) if allowed == "all" else F.lit(False) if allowed == "none" else own | public if reads else own


def category_config(requests: DataFrame, configs: DataFrame, default: dict) -> DataFrame:
    """Each request with its category's configuration, or the default one."""
    joined = requests.join(configs, "category", "left")
    return joined.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in default.items()})


def sort_columns(sort: str | None) -> list[Column]:
    """``-`` is descending; newest first by default; ids break ties."""
    sort = sort or "-updated_at"
    name = sort.removeprefix("-")
    if name not in SORTS:
        raise QueryError(f"can't sort by {name}")
    down = sort.startswith("-")
    first = F.col(name).desc() if down else F.col(name).asc()
    return [first] if name == "_id" else [first, F.col("_id").desc() if down else F.col("_id").asc()]


def page_bounds(args: dict) -> tuple[int, int]:
    """``(limit, offset)`` from limit and offset, or page and page_size; out-of-range values are brought into range."""
    def number(name: str, default: int) -> int:
        try:
            return int(args.get(name, default))
        except (TypeError, ValueError):
            raise QueryError(f"{name} is not a number") from None

    paged = "page" in args or "page_size" in args
    limit = min(MAX_LIMIT, max(1, number("page_size" if paged else "limit", DEFAULT_LIMIT)))
    return limit, (max(1, number("page", 1)) - 1) * limit if paged else max(0, number("offset", 0))


def query(docs: DataFrame, user: User, category: str | None = None, where: dict | str | None = None, acl: dict | None = None, sort: str | None = None,
          after: str | int | None = None, field: Callable[[str], Field] | None = None, **page) -> tuple[DataFrame, DataFrame]:
    """``(rows of the page, a one-row table with total)``: filter, access rule, sort, then offset or cursor, then limit.

    A cursor goes with a sort by ``_id`` and without an offset. The total ignores paging.
    """
    asked = sanitize(json.loads(where) if isinstance(where, str) else where or {})
    rows = docs.where(access(user, acl)).where(predicate(asked, field or json_field("data")))
    rows = rows if category is None else rows.where(F.col("category") == category)
    total = rows.agg(F.count("*").alias("total"))
    limit, offset = page_bounds(page)
    if after is not None:
        if (sort or "").removeprefix("-") != "_id" or "offset" in page or "page" in page:
            raise QueryError("a cursor needs a sort by _id and no offset")
        rows = rows.where(F.col("_id") < after if sort.startswith("-") else F.col("_id") > after)
    return rows.orderBy(*sort_columns(sort)).offset(offset).limit(limit), total


def next_cursor(page: DataFrame, sort: str = "_id") -> DataFrame:
    """A one-row table with ``next_after``: the ``_id`` of the last row of a page in its order, NULL for an empty page."""
    if sort.removeprefix("-") != "_id":
        raise QueryError("a cursor needs a sort by _id")
    return page.agg((F.min if sort.startswith("-") else F.max)("_id").alias("next_after"))


def cursor_walk(rows: DataFrame, limit: int, sort: str = "_id") -> DataFrame:
    """``page, n, next_after`` of all pages that a client would get by following cursors, at once and whatever their number.

    Ids are numbered in ranges (see ``ranges.scan``); nothing goes through one task or the driver.
    """
    if sort.removeprefix("-") != "_id":
        raise QueryError("a cursor needs a sort by _id")
    down = sort.startswith("-")
    ordered = rows.select("_id", F.lit(0).alias("__all"), (-F.col("_id") if down else F.col("_id")).alias("__by"))
    placed = scan(ordered, ["__all"], ["__by"], {"__at": F.lit(1).cast("long")}, window_rows=0)
    return placed.groupBy(F.expr(f"(__at - 1) div {limit} + 1").alias("page")).agg(F.count("*").alias("n"), (F.min if down else F.max)("_id").alias("next_after"))


def next_page(total: int, limit: int, offset: int) -> int | None:
    return offset + limit if offset + limit < total else None


def shown(rows: DataFrame, user: User, include_data: str | bool = True) -> DataFrame:
    """The columns to show: ``data`` if asked for, ``user_id`` to owners and administrators alone."""
    with_data = include_data if isinstance(include_data, bool) else include_data.lower() in TRUE_WORDS
    rows = rows if with_data else rows.drop("data")
    return rows if user.admin else rows.withColumn("user_id", F.when(F.col("user_id") == F.lit(user.id), F.col("user_id")))


# SQL types of a variant by JSON-Schema type.
_TYPES = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"}


_PLAIN_RULES = {"title", "description", "default", "$schema", "$id", "examples", "$defs", "definitions", "$comment", "then", "else"}


def _referred(root: dict, ref: str) -> dict:
    """The schema that a reference within the document (``#``, ``#/$defs/name``) points to."""
    if not ref.startswith("#"):
        raise QueryError(f"a reference to another document: {ref}")
    found: object = root
    for part in filter(None, ref[1:].split("/")):
        part = part.replace("~1", "/").replace("~0", "~")
        if not isinstance(found, dict) or part not in found:
            raise QueryError(f"a reference to nothing: {ref}")
        found = found[part]
    return found


def valid(value: Column, schema: dict | bool, path: str = "$", root: dict | None = None, depth: int = 6) -> Column:
    """Whether the value at a path of a variant column fits a JSON schema; true where there is no such value.

    Knows ``type``, ``required``, ``properties``, ``patternProperties``, ``additionalProperties``, ``items``, ``enum``, ``const``, ``minimum``,
    ``maximum``, ``exclusiveMinimum``, ``exclusiveMaximum``, ``multipleOf``, ``minLength``, ``maxLength``, ``pattern``, ``minItems``, ``maxItems``, ``uniqueItems``,
    ``contains``, ``minProperties``, ``maxProperties``, ``allOf``, ``anyOf``, ``oneOf``, ``not``, ``if``/``then``/``else`` and ``$ref`` within the document; any
    other rule is a ``QueryError``, so that none is passed over.

    References are written out. A recursive schema is, ``depth`` times: a value that is nested deeper than that ends
    the query with an error, so that none is judged by a part of its rules.
    """
    if isinstance(schema, bool):
        return F.lit(True) if schema else F.try_variant_get(value, path, "variant").isNull()
    root = schema if root is None else root
    here = F.try_variant_get(value, path, "variant") if path != "$" else value
    inner = lambda x, at=path: valid(value, x, at, root, depth)
    kind, text = F.schema_of_variant(here), F.try_variant_get(value, path, "string")
    number, rules = F.try_variant_get(value, path, "double"), []
    is_a = lambda *names: reduce(lambda a, b: a | b, [kind.rlike(_TYPES[n]) for n in names])
    every = lambda parts: reduce(lambda a, b: a & b, parts)
    known = {"type", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems", "items", "contains",
             "minProperties", "maxProperties", "const", "enum", "required", "properties", "patternProperties", "additionalProperties", "allOf", "anyOf", "oneOf", "not", "if", "$ref"}
    if unknown := sorted(set(schema) - known - _PLAIN_RULES):
        raise QueryError(f"rules of a schema that aren't known: {unknown}")
    if "$ref" in schema:
        if depth == 0:
            return here.isNull() | F.raise_error(F.lit("a document is nested deeper than its schema is written out")).cast("boolean")
        rules.append(valid(value, _referred(root, schema["$ref"]), path, root, depth - 1))
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        rules.append(is_a(*names) | ((number == F.floor(number)) & is_a("number") if "integer" in names else F.lit(False)))
    for k, test in (("minimum", operator.ge), ("maximum", operator.le), ("exclusiveMinimum", operator.gt), ("exclusiveMaximum", operator.lt)):
        if k in schema:
            rules.append(~is_a("number") | test(number, float(schema[k])))
    if "multipleOf" in schema:
        share = F.try_variant_get(value, path, "decimal(38,9)") % F.lit(str(schema["multipleOf"])).cast("decimal(38,9)")
        rules.append(~is_a("number") | (share == 0))
    for k, test in (("minLength", lambda v: F.char_length(text) >= v), ("maxLength", lambda v: F.char_length(text) <= v), ("pattern", lambda v: text.rlike(_pattern(v, None)))):
        if k in schema:
            rules.append(~is_a("string") | test(schema[k]))
    items = F.try_variant_get(value, path, "array<variant>")
    for k, test in (("minItems", lambda v: F.size(items) >= v), ("maxItems", lambda v: F.size(items) <= v)):
        if k in schema:
            rules.append(~is_a("array") | test(schema[k]))
    if schema.get("uniqueItems"):
        texts = F.transform(items, lambda x: F.to_json(x))
        rules.append(~is_a("array") | (F.size(F.array_distinct(texts)) == F.size(texts)))
    if "items" in schema:
        rules.append(~is_a("array") | F.forall(items, lambda x: valid(x, schema["items"], "$", root, depth)))
    if "contains" in schema:
        rules.append(~is_a("array") | F.exists(items, lambda x: valid(x, schema["contains"], "$", root, depth)))
    some = [schema["const"]] if "const" in schema else schema.get("enum")
    if some is not None:
        rules.append(F.to_json(here).isin([json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in some]))
    for name in schema.get("required", ()):
        rules.append(~is_a("object") | F.try_variant_get(value, path + json_path(name)[1:], "variant").isNotNull())
    for name, rule in schema.get("properties", {}).items():
        rules.append(~is_a("object") | inner(rule, path + json_path(name)[1:]))
    entries = F.map_entries(F.try_variant_get(value, path, "map<string,variant>"))
    for k, test in (("minProperties", operator.ge), ("maxProperties", operator.le)):
        if k in schema:
            rules.append(~is_a("object") | test(F.size(entries), schema[k]))
    patterns = {_pattern(k, None): v for k, v in schema.get("patternProperties", {}).items()}

    def under(pattern: str, rule: dict) -> Callable[[Column], Column]:
        return lambda e: ~e["key"].rlike(pattern) | valid(e["value"], rule, "$", root, depth)

    rules += [~is_a("object") | F.forall(entries, under(*x)) for x in patterns.items()]
    rest = schema.get("additionalProperties", True)
    if rest is not True:
        def listed(e: Column) -> Column:
            return reduce(lambda a, b: a | b, [e["key"].rlike(p) for p in patterns], e["key"].isin(list(schema.get("properties", {}))) if schema.get("properties") else F.lit(False))

        rules.append(~is_a("object") | F.forall(entries, lambda e: listed(e) | (F.lit(False) if rest is False else valid(e["value"], rest, "$", root, depth))))
    rules += [inner(x) for x in schema.get("allOf", ())]
    if "anyOf" in schema:
        rules.append(reduce(lambda a, b: a | b, [inner(x) for x in schema["anyOf"]]))
    if "oneOf" in schema:
        rules.append(reduce(operator.add, [inner(x).cast("int") for x in schema["oneOf"]]) == 1)
    if "not" in schema:
        rules.append(~inner(schema["not"]))
    if "if" in schema:
        rules.append(F.when(inner(schema["if"]), inner(schema.get("then", True))).otherwise(inner(schema.get("else", True))))
    return here.isNull() | F.coalesce(every(rules) if rules else F.lit(True), F.lit(False))


def valid_documents(data: Column, category: Column, schemas: dict[str, dict], default: dict | None = None) -> Column:
    """Whether JSON text fits its category's schema, or the default one; text that isn't JSON fits none."""
    value = F.try_parse_json(data)
    out = None
    for name, schema in schemas.items():
        out = F.when(category == name, valid(value, schema)) if out is None else out.when(category == name, valid(value, schema))
    rest = valid(value, default) if default is not None else F.lit(True)
    return value.isNotNull() & (rest if out is None else out.otherwise(rest))


def file_refs(data: Column) -> Column:
    """Names that ``$ref`` values of a document's JSON text point to, without repeats, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(data, F.lit(r'"\$ref"\s*:\s*"/files/([^"]+)"'), F.lit(1))))


def ref_errors(refs: Column, files: Column) -> Column:
    """``(missing, orphan)``: names referred to without a file, files that nothing refers to."""
    return F.struct(F.array_sort(F.array_except(refs, files)).alias("missing"), F.array_sort(F.array_except(files, refs)).alias("orphan"))


def valid_name(name: Column) -> Column:
    return name.rlike(FILE_NAME)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose keys it lacks."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def content_hash(*columns: Column, bits: int = 256) -> Column:
    """A digest of the values as JSON; equal content gives equal digests."""
    return F.sha2(F.to_json(F.struct(*columns)), bits)


def deduplicate_files(files: DataFrame, content: str, order: str, bits: int = 512) -> DataFrame:
    """Each file with the first file of the same content (by ``order``); hot contents are reduced before the join. Null contents are equal."""
    hashed = files.withColumn("hash", F.sha2(F.col(content).cast("binary"), bits))
    first = hashed.groupBy(F.col("hash").alias("__same")).agg(F.min(order).alias("first_file"), F.count("*").alias("copies"))
    return hashed.join(first, F.col("hash").eqNullSafe(F.col("__same"))).select("hash", *files.columns, "first_file", "copies")


def latest(rows: DataFrame, keys: list[str], time: str, before: Column | None = None) -> DataFrame:
    """Each key's last row (before a time)."""
    rows = rows if before is None else rows.where(F.col(time) < before)
    other = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(time, *[c for c in other if c != time])).alias("__last"))
    return best.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in other])
