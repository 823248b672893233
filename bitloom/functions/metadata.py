"""Schemaless metadata: MAP<STRING,STRING> of canonical JSON values, compared as Python compares."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: Any) -> str | None:
    """JSON text such that equal Python values give equal texts: true is 1, integral floats are ints, keys are sorted; None is null."""

    def plain(x: Any) -> Any:
        if isinstance(x, bool):
            return int(x)
        if isinstance(x, float) and x.is_integer() and abs(x) < 1e37:
            return int(x)
        if isinstance(x, Mapping):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return None if value is None else json.dumps(plain(value), sort_keys=True, ensure_ascii=False)


def own_json(value: Any) -> str | None:
    return None if value is None else json.dumps(value, sort_keys=True, ensure_ascii=False)


def encode(metadata: Mapping[str, Any] | None, form: Callable[[Any], str | None] = own_json) -> dict[str, str | None]:
    """The stored form: each value's own JSON, which keeps true apart from 1 on read-back; with `canonical`, the form that is compared."""
    return {str(k): form(v) for k, v in (metadata or {}).items()}


def decode(stored: Mapping[str, str | None] | None) -> dict[str, Any]:
    return {k: None if v is None else json.loads(v) for k, v in (stored or {}).items()}


def canonical_column(v: Column) -> Column:
    """Canonical form of a stored value: booleans and integral numbers, also with an exponent, are ints. Lists and objects stay as they are."""
    whole = F.regexp_extract(v, r"^(-?[0-9]+)(?:\.0+)?$", 1)
    number = F.when(v.rlike(r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)$"), v.cast("double"))
    integral = F.when((number == F.floor(number)) & (F.abs(number) < 1e37), F.format_string("%.0f", number))
    return F.when(v == "true", "1").when(v == "false", "0").when(whole != "", F.when(whole == "-0", "0").otherwise(whole)).otherwise(F.coalesce(integral, v))


def matches(canon: Column, where: Mapping[str, Any] | None) -> Column:
    """All keys equal in canonical form; a missing key is null, so a wanted None matches rows without the key; nothing wanted matches all."""
    terms = [canonical_column(F.try_element_at(canon, F.lit(k))).eqNullSafe(F.lit(canonical(v))) for k, v in (where or {}).items()]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def merge(left: Column, right: Column) -> Column:
    """Both maps; the right one wins."""
    rest = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(rest, right)
