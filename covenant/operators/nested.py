"""Merging arrays of structs by a key, in place: no row is exploded and none is grouped again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(old: Column, new: Column, key: str, both: Callable[[Column, Column], Column] | None = None) -> Column:
    """The structs of two arrays of one type, one for each key, in order of key.

    Where both arrays have a key, ``both(old, new)`` says what stays, the old one if it isn't given; of structs of
    one key in one array the first stays, and of null keys one. A null array is empty. The arrays are sorted once
    and neighbours compared, so the work is that of sorting.
    """
    tag = lambda x, n: F.transform(F.coalesce(x, F.array()), lambda s, i: F.struct(s[key].alias("k"), F.lit(n).alias("n"), i.alias("i"), s.alias("s")))
    every = F.array_sort(F.concat(tag(old, 0), tag(new, 1)), _in_order)
    # the first of each key and array
    firsts = F.filter(every, lambda x, i: (i == 0) | ~(_is(F.get(every, i - 1), x, "k") & _is(F.get(every, i - 1), x, "n")))
    merge = both or (lambda o, n: o)
    paired = F.transform(firsts, lambda x, i: F.struct(x.alias("x"), F.when(_is(F.get(firsts, i + 1), x, "k") & (i + 1 < F.size(firsts)), F.get(firsts, i + 1)).alias("y"), (_is(F.get(firsts, i - 1), x, "k") & (i > 0)).alias("second")))
    return F.transform(F.filter(paired, lambda p: ~p["second"]), lambda p: F.when(p["y"].isNull(), p["x"]["s"]).otherwise(merge(p["x"]["s"], p["y"]["s"])))


def _is(a: Column, b: Column, name: str) -> Column:
    return a[name].eqNullSafe(b[name])


def _in_order(a: Column, b: Column) -> Column:
    """By key, nulls first, then array, then place."""
    by = lambda name: F.when(a[name].isNull() & b[name].isNotNull() | (a[name] < b[name]), -1).when(b[name].isNull() & a[name].isNotNull() | (a[name] > b[name]), 1)
    return F.coalesce(by("k"), by("n"), by("i"), F.lit(0))
