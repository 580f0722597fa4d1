"""Packing items of varying length into containers of fixed capacity, balanced by estimated cost.

The cost of an item is linear plus quadratic in its length (attention).  Items in descending order go to the
container of lowest cost that still has room; the number of containers starts at the least possible and grows only
when an item finds no room.  An item longer than the capacity is cut into full pieces, which are containers of their
own, and a rest.

Items are spread by hash over groups of about ``group_containers`` containers' worth, whose number follows the
data, so every task packs a bounded number of tokens however large the input; each group leaves at most a fraction
of a container unused.

Defined results: items of length 0 (empty or null texts) get a container and use no space; equal items are placed in
order of key; repeated keys are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(sizes: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> np.ndarray:
    """Container number of each item; ``sizes`` in descending order, none above ``capacity``."""
    n = len(sizes)
    out = np.empty(n, np.int64)
    least = max(1, -(-int(sizes.sum()) // capacity))
    room = np.full(least + n + 1, capacity, np.int64)
    cost = np.full(least + n + 1, np.inf)
    cost[:least] = 0.0
    used = least
    for i, s in enumerate(sizes):
        fits = np.where(room[:used] >= s, cost[:used], np.inf)
        k = int(fits.argmin())
        if fits[k] == np.inf:
            k, used = used, used + 1
            cost[k] = 0.0
        out[i] = k
        room[k] -= s
        cost[k] += linear * s + quadratic * float(s) * float(s)
    return out


def pack_items(items: DataFrame, key: str, size: str, capacity: int, group_containers: int = 512, group_items: int = 20_000) -> DataFrame:
    """(key, piece_no, start, n_tokens, container_id) of every item or piece.

    ``container_id`` is unique over all groups.  ``items`` is read twice (once to count), so it should be cheap or
    materialised.
    """
    kind = items.schema[key].dataType.simpleString()
    n, total = items.agg(F.count(F.lit(1)), F.sum(size)).first()
    groups = max(1, round((total or 0) / capacity / group_containers), round((n or 0) / group_items))
    pieces = items.select(
        F.col(key), F.col(size).cast("bigint").alias("_n"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col(size) / F.lit(capacity)) - 1, F.lit(0).cast("bigint")))).alias("piece_no"),
    ).select(
        key, "piece_no", (F.col("piece_no") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("_n") - F.col("piece_no") * capacity).alias("n_tokens")
    )
    grouped = pieces.withColumn("_g", F.pmod(F.xxhash64(key, "piece_no", F.lit(9)), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", key, "piece_no"], ascending=[False, True, True], kind="stable")
        local = pack(pdf["n_tokens"].to_numpy(np.int64), capacity)
        return pdf.assign(container_id=pdf["_g"].to_numpy() + local * groups)[[key, "piece_no", "start", "n_tokens", "container_id"]]

    return grouped.groupBy("_g").applyInPandas(run, f"`{key}` {kind}, piece_no bigint, start bigint, n_tokens bigint, container_id bigint")

