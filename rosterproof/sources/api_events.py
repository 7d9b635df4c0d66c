"""API response events: filter by address and type, file links in any JSON body."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterproof.functions.urls import is_api_url, is_json
from rosterproof.sources import schemas
from rosterproof.sources.tables import read_table

# Superset test on the raw text: a body failing it cannot hold a file link. A backslash
# may hide one behind an escape.
_MAYBE = r"(?i)\.(pdf|jpg|jpeg|png)\"|/storage/|/files/|upload|\\"
_LINKS = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
)


def read_api_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed API events with their declared schema."""
    return read_table(spark, path, schemas.API_EVENTS, fmt)


def api_responses(events: DataFrame) -> DataFrame:
    """Events from the addresses of interest that carry JSON."""
    return events.where(is_api_url(F.col("url")) & is_json(F.col("content_type")))


def _walker():
    """The body walk as a closure, so that tasks need no copy of this package."""
    import json
    import re

    extension = re.compile(r"\.(pdf|jpg|jpeg|png)\Z", re.IGNORECASE)
    index = re.compile(r"0|[1-9][0-9]{0,9}")

    def is_file(v):
        if len(v) <= 5:
            return False
        return bool(extension.search(v)) or "/storage/" in v or "/files/" in v or "upload" in v

    def entries(node):
        if isinstance(node, list):
            return iter([(str(i), v) for i, v in enumerate(node)])
        # Integer-like keys come first, in numeric order.
        return iter(
            sorted(
                node.items(), key=lambda e: (0, int(e[0])) if index.fullmatch(e[0]) else (1, 0)
            )
        )

    def none(_):
        return None

    def refuse(constant):
        raise ValueError(constant)  # NaN and Infinity are not JSON

    token = re.compile(
        r'[ \t\r\n]*([{}\[\]:,]|"(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)'
    )

    def deep(body):
        """The value of a body nested too deeply for the parser, without recursion."""
        done, stack, at = [], [], 0
        want = "value"
        body = body.rstrip(" \t\r\n")
        while at < len(body):
            m = token.match(body, at)
            if not m:
                raise ValueError(at)
            at, t = m.end(), m.group(1)
            top = stack[-1] if stack else None
            if want in ("value", "first") and t in "[{":
                new = [] if t == "[" else {}
                stack.append([new, None])
                want = "first" if t == "[" else "key or end"
                continue
            if t in "]}":
                fits = top is not None and isinstance(top[0], list) == (t == "]")
                if not fits or want not in ("first", "key or end", "more"):
                    raise ValueError(at)
                value = stack.pop()[0]
            elif want in ("key", "key or end") and t[0] == '"':
                top[1], want = json.loads(t), "colon"
                continue
            elif (want, t) == ("colon", ":"):
                want = "value"
                continue
            elif (want, t) == ("more", ",") and top is not None:
                want = "value" if isinstance(top[0], list) else "key"
                continue
            elif want in ("value", "first") and t not in ":,":
                value = json.loads(t) if t[0] == '"' else None  # only texts can be links
            else:
                raise ValueError(at)
            if not stack:
                done.append(value)
                want = "end"
            elif isinstance(stack[-1][0], list):
                stack[-1][0].append(value)
                want = "more"
            else:
                stack[-1][0][stack[-1][1]] = value
                want = "more"
        if stack or len(done) != 1:
            raise ValueError(at)
        return done[0]

    def parse(body):
        try:
            # Numbers cannot be links, so their value, of any length, is not needed.
            return json.loads(body, parse_int=none, parse_float=none, parse_constant=refuse)
        except RecursionError:
            return deep(body)

    def links(body):
        try:
            root = parse(body) if body else None
        except ValueError:
            return None
        found, stack = [], [entries(root)] if isinstance(root, (dict, list)) else []
        while stack:
            for key, value in stack[-1]:
                if isinstance(value, str):
                    if is_file(value):
                        found.append({"key": key, "value": value})
                elif isinstance(value, (dict, list)):
                    stack.append(entries(value))
                    break
            else:
                stack.pop()
        return found

    def walk(bodies: pd.Series) -> pd.Series:
        return bodies.map(links)

    return walk


def file_links(body: Column) -> Column:
    """(key, value) of every file-like string at any depth of a JSON body, in order.

    Bodies of any depth are walked, which no column expression can; bodies that cannot
    hold a link are nulled in the JVM first, so they are not shipped to Python.
    """
    walk = F.pandas_udf(_walker(), _LINKS)
    return walk(F.when(body.rlike(_MAYBE), body))


def event_links(events: DataFrame, keep: list[str]) -> DataFrame:
    """One row per file link of the API responses: kept columns, pos, key, value."""
    return (
        api_responses(events)
        .select(*keep, file_links(F.col("body")).alias("links"))
        .select(*keep, F.posexplode("links").alias("pos", "l"))
        .select(*keep, "pos", "l.key", "l.value")
    )
