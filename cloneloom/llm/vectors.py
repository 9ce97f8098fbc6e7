"""Vector tables as rows dealt to segments, and the stream of (segment, candidates, queries) that two searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_vectors(df: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(vec_id long, v array<double>) of usable rows: id and vector there, not empty, all components there and finite,
    and, if asked, one not 0. Rows that share an id count once, with the smallest vector."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        ok = ok & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return rows.where(ok).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """A list column whose lists are equally long as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def segments(batches, chunk: int = 1024):
    """Of batches sorted by (seg, dim, is_query, ...) whose vectors have dim components: yields (key, candidates, queries)
    once for each segment and each chunk of its queries. Both are lists of record batches; only one segment's candidates
    and one chunk of queries are held."""
    key, held, waiting = None, [], []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        seg, dim, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seg", "dim", "is_query"))
        borders = np.flatnonzero((np.diff(seg) != 0) | (np.diff(dim) != 0) | (np.diff(query) != 0)) + 1
        for a, b in zip([0, *borders], [*borders, batch.num_rows], strict=True):
            now = (seg[a], dim[a])
            if now != key:
                if waiting:
                    yield key, held, waiting
                key, held, waiting, n = now, [], [], 0
            if not query[a]:
                held.append(batch.slice(a, b - a))
                continue
            for x in range(a, b, chunk):
                waiting.append(batch.slice(x, min(chunk, b - x)))
                n += waiting[-1].num_rows
                if n >= chunk:
                    yield key, held, waiting
                    waiting, n = [], 0
    if waiting:
        yield key, held, waiting
