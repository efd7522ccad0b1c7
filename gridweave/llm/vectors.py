"""Helpers for operators on vectors: spreading them over groups of near ones of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

MOST_PIVOTS = 256


def finite(vector: Column) -> Column:
    """Whether a vector is there, not empty, and holds neither null nor a non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of a list column of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return values.reshape(len(column), -1)


def in_cells(rows: DataFrame, group: list[str], size: int) -> DataFrame:
    """``rows`` (``id, vector`` and group columns) with ``cell``: near vectors of one group, about ``size`` at most.

    A vector goes to the nearest of a bounded sample of pivots, and the rows of a pivot are dealt by a hash of the id over as
    many cells as they need. Equal vectors can thus fill many cells, and no cell grows with the table.
    """
    total = rows.count()
    n = max(1, min(MOST_PIVOTS, total // (4 * size)))
    drawn = rows.select("vector").orderBy(F.xxhash64("id"), "vector").limit(n).collect()
    pivots: dict[int, np.ndarray] = {}
    for d in {len(r[0]) for r in drawn}:
        pivots[d] = np.array([r[0] for r in drawn if len(r[0]) == d], np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int32)
            lengths = batch.column("vector").value_lengths().to_numpy()
            for d, p in pivots.items():
                mine = np.flatnonzero(lengths == d)
                for at in range(0, len(mine), 4096):
                    part = mine[at : at + 4096]
                    x = matrix(batch.column("vector").take(pa.array(part)))
                    found[part] = ((p * p).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "pivot"])

    placed = rows.mapInArrow(nearest, StructType([*rows.schema, StructField("pivot", IntegerType())]))
    counts = placed.groupBy(*group, "pivot").agg(F.ceil(F.count("*") / size).alias("cells"))
    keys = [F.col(f"placed.{c}").eqNullSafe(F.col(f"counts.{c}")) for c in [*group, "pivot"]]
    joined = placed.alias("placed").join(counts.alias("counts"), keys)
    part = F.pmod(F.xxhash64("id", F.lit("cell")), F.col("cells"))
    cell = F.concat_ws(":", *[F.col(f"placed.{c}").cast("string") for c in group], F.col("placed.pivot").cast("string"), part.cast("string"))
    return joined.select("placed.*", cell.alias("cell")).drop("pivot")
