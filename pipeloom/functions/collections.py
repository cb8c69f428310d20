"""Array, map and JSON functions that Spark lacks or spells differently."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType


def array_remove_at(a: Column, i: Column | int) -> Column:
    """Without the element at a position from 0; negative ones count from the end."""
    n = F.size(a)
    at = F.when(F.lit(i) < 0, n + i).otherwise(F.lit(i))
    return F.filter(a, lambda _, k: k != at)


def array_slice0(a: Column, start: int, stop: int) -> Column:
    """Positions start to stop (excluded) from 0."""
    return F.slice(a, start + 1, max(0, stop - start))


def array_concat_agg(a: str, order: str) -> Column:
    return F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(a).alias("v")))), lambda x: x["v"]))


def array_agg_nulls(x: str, order: str) -> Column:
    """array_agg in order that keeps nulls."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).alias("v")))), lambda s: s["v"])


def array_sum(a: Column) -> Column:
    """Null elements count as zero; null for an empty array."""
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, x: t + F.coalesce(x.cast("double"), F.lit(0.0))))


def array_avg(a: Column) -> Column:
    known = F.filter(a, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda t, x: t + x.cast("double")), F.size(known).cast("double"))


def array_any(a: Column, f) -> Column:  # noqa: ANN001
    return F.exists(a, f)


def array_all(a: Column, f) -> Column:  # noqa: ANN001
    return F.forall(a, f)


def comprehension(a: Column, f, where=None) -> Column:  # noqa: ANN001
    """[f(x) for x in a if where(x)]."""
    return F.transform(F.filter(a, where) if where else a, f)


def to_array(x: Column, is_array: bool) -> Column:
    return x if is_array else F.when(x.isNotNull(), F.array(x))


def array_windows(a: Column, n: int) -> Column:
    """All runs of n neighbouring elements."""
    return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.slice(a, i, n))).otherwise(F.slice(F.array(a), 1, 0))


def get_ignore_case(m: Column, key: str) -> Column:
    found = F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == key.lower())
    return F.get(found, F.lit(0))["value"]


def map_without(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def map_pick(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def minhash(a: Column, n: int = 16) -> Column:
    """The least hash of the elements under each of n hash functions."""
    return F.array(*[F.array_min(F.transform(a, lambda x, i=i: F.xxhash64(F.lit(i), x))) for i in range(n)])


def minhash_similarity(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda t, x: t + x) / F.size(a)


def check_json(s: Column) -> Column:
    """Null for valid JSON, else a message."""
    return F.when(s.isNotNull() & F.try_parse_json(s).isNull(), F.lit("invalid JSON"))


def json_exists(s: Column, path: str) -> Column:
    """Whether there is a value, null included, at the path."""
    v = F.try_parse_json(s)
    return F.coalesce(F.try_variant_get(v, path, "variant").isNotNull(), F.lit(False))


def json_array(s: Column, path: str = "$") -> Column:
    """The elements of an array at the path, as JSON texts (strings as they are)."""
    return F.from_json(F.get_json_object(s, path), ArrayType(StringType()))


def json_array_contains(s: Column, value: object, path: str = "$") -> Column:
    text = value if isinstance(value, str) else json.dumps(value)
    return F.array_contains(json_array(s, path), text)


def json_has_all_keys(s: Column, *keys: str) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(s))) == 0


def json_has_any_key(s: Column, *keys: str) -> Column:
    return F.arrays_overlap(F.array(*map(F.lit, keys)), F.json_object_keys(s))


def _edited(edit, kind=StringType()):  # noqa: ANN001, ANN202
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> object:
            if x is None:
                return None
            try:
                v = json.loads(x)
            except ValueError:
                return None
            out = edit(v)
            return out if not isinstance(kind, StringType) else json.dumps(out, separators=(",", ":"), ensure_ascii=False)

        return s.map(one)

    return run


def _steps(path: str) -> list[str | int]:
    """'$.a.b[0]' as ['a', 'b', 0]."""
    out: list[str | int] = []
    for part in path.removeprefix("$").replace("[", ".[").split("."):
        if part.startswith("["):
            out.append(int(part[1:-1]) if part[1:-1].lstrip("-").isdigit() else part[1:-1].strip("'\""))
        elif part:
            out.append(part)
    return out


def _parent(v: object, steps: Sequence[str | int]) -> object:
    for s in steps[:-1]:
        if isinstance(v, dict) and s in v or isinstance(v, list) and isinstance(s, int) and -len(v) <= s < len(v):
            v = v[s]
        else:
            return None
    return v


def json_set(s: Column, path: str, value: object, create: bool = True) -> Column:
    """Put a value at a path; absent keys are made if create."""

    def edit(v: object) -> object:
        steps = _steps(path)
        if not steps:
            return value
        at = _parent(v, steps)
        if isinstance(at, dict) and (create or steps[-1] in at):
            at[steps[-1]] = value
        elif isinstance(at, list) and isinstance(steps[-1], int):
            if -len(at) <= steps[-1] < len(at):
                at[steps[-1]] = value
            elif create:
                at.append(value)
        return v

    return _edited(edit)(s)


def json_remove(s: Column, *paths: str) -> Column:
    def edit(v: object) -> object:
        for p in paths:
            steps = _steps(p)
            at = _parent(v, steps)
            if isinstance(at, dict):
                at.pop(steps[-1], None)
            elif isinstance(at, list) and isinstance(steps[-1], int) and -len(at) <= steps[-1] < len(at):
                del at[steps[-1]]
        return v

    return _edited(edit)(s)


def json_strip_nulls(s: Column, arrays: bool = False) -> Column:
    """Without object fields (and array elements) that are null, at any depth."""

    def strip(v: object) -> object:
        if isinstance(v, dict):
            return {k: strip(x) for k, x in v.items() if x is not None}
        if isinstance(v, list):
            return [strip(x) for x in v if not (arrays and x is None)]
        return v

    return _edited(strip)(s)


def json_keys_at_depth(s: Column, depth: int) -> Column:
    """Dotted keys of objects down to a depth, sorted."""

    def keys(v: object) -> list[str]:
        out, level = [], [("", v)]
        for _ in range(depth):
            level = [(f"{p}.{k}" if p else k, x) for p, o in level if isinstance(o, dict) for k, x in o.items()]
            out += [k for k, _ in level]
        return sorted(out)

    return _edited(keys, ArrayType(StringType()))(s)


def json_contains(s: Column, other: str) -> Column:
    """Whether a JSON value holds another: objects by their keys, arrays by their elements."""
    want = json.loads(other)

    def holds(a: object, b: object) -> bool:
        if isinstance(a, dict) and isinstance(b, dict):
            return all(k in a and holds(a[k], x) for k, x in b.items())
        if isinstance(a, list):
            return all(any(holds(y, x) for y in a) for x in (b if isinstance(b, list) else [b]))
        return a == b and isinstance(a, bool) == isinstance(b, bool)

    return _edited(lambda v: holds(v, want), BooleanType())(s)


def json_array_append(s: Column, path: str, value: object) -> Column:
    def edit(v: object) -> object:
        at = v
        for k in _steps(path):
            at = at[k] if isinstance(at, dict) and k in at or isinstance(at, list) and isinstance(k, int) and k < len(at) else None
        if isinstance(at, list):
            at.append(value)
        return v

    return _edited(edit)(s)
