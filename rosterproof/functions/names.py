"""Tolerant comparison of two person or facility names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.functions import fixed
from rosterproof.functions.keys import given
from rosterproof.functions.text import squeeze_blanks, thai_skeleton, trim_blanks

_TITLES = f"^(?i:{'|'.join(fixed.NAME_TITLES)}){fixed.WS}*"
_THAI_TITLES = f"^(?:{'|'.join(fixed.THAI_TITLES)}){fixed.WS}*"


def comparable_name(c: Column) -> Column:
    """Name without its title, blanks collapsed, lower case."""
    return F.lower(trim_blanks(squeeze_blanks(F.regexp_replace(c, _TITLES, ""))))


def name_skeleton(c: Column) -> Column:
    return thai_skeleton(F.regexp_replace(c, _THAI_TITLES, ""))


def _overlap(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def add_name_similarity(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Add ``out``: struct(match, score, via) comparing two name columns.

    Equal names score 1, containment 0.9, equal or contained Thai skeletons of four
    letters or more 0.85; otherwise the share of tokens that overlap, matching from
    one half on. A missing name never matches.

    The normalised forms are columns of their own so each regex runs once per row.
    """
    tmp = {k: f"__{out}_{k}" for k in ("a", "b", "sa", "sb", "pa", "pb")}
    left_c, right_c = F.col(left), F.col(right)
    both = given(left_c) & given(right_c)
    df = df.withColumns(
        {
            tmp["a"]: F.when(both, comparable_name(left_c)),
            tmp["b"]: F.when(both, comparable_name(right_c)),
        }
    )
    a, b = F.col(tmp["a"]), F.col(tmp["b"])
    # Skeletons and tokens are needed only where plain comparison failed.
    undecided = ~_overlap(a, b)
    df = df.withColumns(
        {
            tmp["sa"]: F.when(undecided, name_skeleton(left_c)),
            tmp["sb"]: F.when(undecided, name_skeleton(right_c)),
            tmp["pa"]: F.when(undecided, F.filter(F.split(a, " "), lambda x: x != "")),
            tmp["pb"]: F.when(undecided, F.filter(F.split(b, " "), lambda x: x != "")),
        }
    )
    sa, sb, pa, pb = (F.col(tmp[k]) for k in ("sa", "sb", "pa", "pb"))
    skeleton = (F.length(sa) >= 4) & (F.length(sb) >= 4) & _overlap(sa, sb)
    shared = F.size(F.filter(pa, lambda x: F.exists(pb, lambda y: _overlap(x, y))))
    share = shared / F.greatest(F.size(pa), F.size(pb))
    score = (
        F.when(~both, 0.0)
        .when(a == b, 1.0)
        .when(_overlap(a, b), 0.9)
        .when(skeleton, 0.85)
        .otherwise(share)
    )
    via = F.when(both & undecided & skeleton, "skeleton")
    df = df.withColumn(f"__{out}_score", score)
    s = F.col(f"__{out}_score")
    result = F.struct((both & (s >= 0.5)).alias("match"), s.alias("score"), via.alias("via"))
    return df.withColumn(out, result).drop(f"__{out}_score", *tmp.values())
