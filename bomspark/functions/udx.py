"""Functions that need Python: version orders of other schemes as Arrow-batched
pandas UDFs, and a document walk as a table function."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import udtf

_KEY = "struct<n array<struct<size int, digits string>>, p array<string>>"
_SCHEMES: dict[str, Callable[[str], tuple[list[int], list[str]] | None]] = {}


def register_scheme(name: str, key: Callable[[str], tuple[list[int], list[str]] | None]) -> None:
    """``key`` maps a version text to (numbers, words); the pair sorts the versions."""
    _SCHEMES[name] = key


def version_key_scheme(scheme: str) -> Callable[[Column], Column]:
    """Column function for the version order of a registered scheme."""
    key = _SCHEMES[scheme]

    @F.pandas_udf(_KEY)
    def run(versions: pd.Series) -> pd.DataFrame:
        got = {v: key(v) if v is not None else None for v in versions.unique()}
        pairs = [got[v] or (None, None) for v in versions]
        sized = lambda n: None if n is None else [{"size": len(str(x)) if x >= 0 else x, "digits": str(x) if x >= 0 else ""} for x in n]
        return pd.DataFrame({"n": [sized(p[0]) for p in pairs], "p": [p[1] for p in pairs]})

    return run


@udtf(returnType="pointer string, key string, kind string, value string", useArrow=True)
class WalkDocument:
    """Every node of a JSON document, one row each."""

    def eval(self, content):
        try:
            stack = [("", None, json.loads(content))]
        except (TypeError, ValueError):
            return
        while stack:
            pointer, key, node = stack.pop()
            if isinstance(node, dict):
                yield pointer, key, "object", None
                stack.extend((f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", k, v) for k, v in node.items())
            elif isinstance(node, list):
                yield pointer, key, "array", None
                stack.extend((f"{pointer}/{i}", None, v) for i, v in enumerate(node))
            else:
                yield pointer, key, "scalar", node if isinstance(node, str) else json.dumps(node)


def register_table_functions(spark) -> None:
    spark.udtf.register("walk_document", WalkDocument)
