"""Addresses as they stand in headers."""

from __future__ import annotations

from collections.abc import Iterator
from email.utils import getaddresses

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_list(header: str | None) -> list[tuple[str | None, str]]:
    """(name, address) of every address in a header; quotes and angle brackets are understood."""
    return [(n.strip() or None, a.strip().lower()) for n, a in getaddresses([header or ""]) if a.strip()]


def address_list(header: Column) -> Column:
    """array<struct(name, addr)> of a column of headers."""

    @F.pandas_udf("array<struct<name:string,addr:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for headers in batches:
            yield headers.map(lambda h: [{"name": n, "addr": a} for n, a in parse_list(h)])

    return run(header)


def format_address(name: Column, addr: Column) -> Column:
    """Name <addr>, or what there is of both."""
    some = F.when((F.coalesce(name, F.lit("")) != "") & ~name.eqNullSafe(addr), name)
    return F.when(some.isNull(), F.coalesce(addr, F.lit(""))).when(F.coalesce(addr, F.lit("")) == "", some).otherwise(F.concat(some, F.lit(" <"), addr, F.lit(">")))


def people_text(*lists: Column) -> Column:
    """The different names and addresses of several JSON lists, in order, as one text."""
    parsed = [F.coalesce(F.from_json(x, "array<struct<name:string,addr:string>>"), F.array().cast("array<struct<name:string,addr:string>>")) for x in lists]
    words = F.flatten(F.transform(F.concat(*parsed), lambda p: F.array(p["name"], p["addr"])))
    return F.array_join(F.array_distinct(F.filter(words, lambda w: w.isNotNull() & (w != ""))), " ")
