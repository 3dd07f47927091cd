"""YAML and TOML as JSON text; all that follows is column expressions over variants."""

from __future__ import annotations

import contextlib
import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _json(load, text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(load(text), default=str)
    except Exception:  # whatever a malformed file raises: it yields nothing
        return None


#: Levels of nesting for which libyaml is used, at most; it has no guard of its own.
DEEPEST = 1000


def load_yaml(text: str) -> object:
    """As safe_load gives it, by libyaml where it is at hand and the text can't nest deeply; what that doesn't take is left to the plain loader.

    A block lies farther to the right than the one around it, but for a list in a map; so lines and brackets bound the levels.
    """
    import yaml

    fast = getattr(yaml, "CSafeLoader", None)
    if fast and text.count("[") + text.count("{") + 2 * max(map(len, text.splitlines()), default=0) <= DEEPEST:
        with contextlib.suppress(Exception):
            return yaml.load(text, Loader=fast)  # a safe loader
    return yaml.safe_load(text)


@F.pandas_udf(T.StringType())
def yaml_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _json(load_yaml, t))


@F.pandas_udf(T.StringType())
def toml_json(text: pd.Series) -> pd.Series:
    import tomllib

    return text.map(lambda t: _json(tomllib.loads, t))


def structured(content: Column) -> Column:
    """A variant of JSON where the text starts with a brace, else of YAML; null for malformed texts."""
    return F.try_parse_json(F.when(F.regexp_replace(content, r"^\s+", "").startswith("{"), content).otherwise(yaml_json(content)))


def entries(value: Column, path: str) -> Column:
    """Entries (key, value) of the object at a path, in key order; none where there is no object."""
    found = F.map_entries(F.try_variant_get(value, path, "map<string,variant>"))
    return F.coalesce(found, F.array().cast("array<struct<key:string,value:variant>>"))


def text_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")
