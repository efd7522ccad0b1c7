"""Near-duplicate vectors by tiles of int8 products with error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import pick, stored
from .components import components
from .vectors import finite, in_cells, matrix

TILE = 1024
SLACK = 1e-9  # far above rounding of doubles, far below what int8 loses
BLOCK = 64  # tiles on one side of a block of pairs, about
ROWS = 256  # of a tile whose products are held at once

_TILE = "label string, tile string, n int, ids binary, copies binary, vectors binary, codes binary, scales binary, errors binary, centre array<double>, radius double"
_TILE_SCHEMA = pa.schema(
    [("label", pa.string()), ("tile", pa.string()), ("n", pa.int32())]
    + [(n, pa.binary()) for n in "ids copies vectors codes scales errors".split()]
    + [("centre", pa.list_(pa.float64())), ("radius", pa.float64())]
)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, the scale of each, and the length of what the codes leave out."""
    scales = np.maximum(np.abs(unit).max(1), 1e-300) / 127
    codes = np.rint(unit / scales[:, None]).astype(np.int8)
    return codes, scales, np.sqrt(((unit - codes * scales[:, None]) ** 2).sum(1))


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _halved(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each that brings their largest component near 1: no rounding, and squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0))[1][:, None])


def _tile(rows: pa.Table) -> pa.Table:
    given = rows.column("vector").type.value_type
    vectors = matrix(rows.column("vector"), np.float32 if pa.types.is_float32(given) else np.float64)
    wide = _halved(vectors.astype(np.float64))
    unit = wide / np.sqrt((wide * wide).sum(1))[:, None]
    codes, scales, errors = quantise(unit)
    centre = unit.mean(0)
    length = np.sqrt((centre * centre).sum())
    centre = centre / length if length > 1e-6 else np.eye(1, unit.shape[1])[0]
    row = {
        "label": rows.column("label")[0].as_py(), "tile": rows.column("cell")[0].as_py(), "n": len(vectors),
        "ids": rows.column("id").to_numpy().astype("<i8").tobytes(), "copies": rows.column("copies").to_numpy().astype("<i8").tobytes(),
        "vectors": vectors.astype(f"<f{vectors.itemsize}").tobytes(), "codes": codes.tobytes(), "scales": scales.tobytes(), "errors": errors.tobytes(),
        "centre": centre.tolist(), "radius": float(_angles(unit @ centre).max()) + SLACK,
    }
    return pa.Table.from_pylist([row], _TILE_SCHEMA)


class _Side:
    def __init__(self, row: dict):
        n = row["n"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.copies = np.frombuffer(row["copies"], "<i8")
        kind = "<f4" if len(row["vectors"]) == 4 * len(row["codes"]) else "<f8"
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(n, -1)
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(n, -1).astype(np.float32)
        self.scales = np.frombuffer(row["scales"])
        self.errors = np.frombuffer(row["errors"])
        wide = _halved(self.vectors.astype(np.float64))
        self.lengths = np.sqrt((wide * wide).sum(1))


def linked(a: _Side, b: _Side, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) whose cosine in double precision reaches the threshold.

    With u = s q + e for either side, the product of codes is off by |e_v| (1 + |e_u|) + |e_u| at most; float32
    adds up whole numbers under 2 ** 24 without rounding for up to 1,040 components, and longer vectors are summed in parts.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(a.ids), ROWS):
        rows = slice(at, at + ROWS)
        product = np.zeros((len(a.ids[rows]), len(b.ids)))
        for d in range(0, a.codes.shape[1], 1024):
            product += a.codes[rows, d : d + 1024] @ b.codes[:, d : d + 1024].T
        product *= a.scales[rows, None]
        product *= b.scales[None, :]
        product += b.errors[None, :] * (1 + a.errors[rows, None]) + a.errors[rows, None]
        i, j = np.nonzero(product >= threshold - SLACK)
        i += at
        for p in range(0, len(i), 1 << 16):
            x, y = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
            exact = np.einsum("ij,ij->i", _halved(a.vectors[x].astype(np.float64)), _halved(b.vectors[y].astype(np.float64)))
            fine = exact / (a.lengths[x] * b.lengths[y]) >= threshold
            left.append(x[fine])
            right.append(y[fine])
    return np.concatenate(left), np.concatenate(right)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        sides = [_Side(r) for r in rows.sort_by("tile").to_pylist()]
        a, b = sides[0], sides[-1]
        i, j = linked(a, b, threshold)
        if len(sides) == 1:
            keep = i < j
            i, j = i[keep], j[keep]
            ids, copies = a.ids, a.copies
        else:
            j = j + len(a.ids)
            ids, copies = np.concatenate([a.ids, b.ids]), np.concatenate([a.copies, b.copies])
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ids, copies, i, j = ids[order], copies[order], place[i], place[j]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        root = _roots(len(ids), i, j)
        hit = np.flatnonzero(links > 0)
        return pa.Table.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(ids[root[hit]])], schema=schema)

    return run


def near_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93
) -> DataFrame:
    """Links between vectors of one label with a cosine of ``threshold`` or more: ``key, n_links, component_id, kept``.

    Equal vectors of a label are one member with a count, so copies make no pairs. Members fall into tiles of near ones of about
    ``TILE``. A pair of tiles is compared if the angle between their centres less both radii lets a cosine reach the threshold. In
    it, int8 codes are multiplied as matrices; only pairs that may reach the threshold by the bound on what
    the codes leave out are computed again in double precision. A pair of tiles returns for each member how many vectors it
    links with and the smallest member it reaches there, never the pairs. Components over these give the classes.

    Work in a label is at most quadratic in its different vectors, in blocks, and pairs of tiles spread over all tasks. A vector that is null, empty,
    zero or holds null or non-finite components, or whose label or key is null, links with nothing: no links, its own key as component, kept. Vectors of
    different length don't link. Labels are equal if their texts are; components keep the precision they are given in. Repeated rows with one key are vectors of their own. An empty table gives an empty result.
    """
    base = pick(rows, id=key, vector=vector, label=label)
    numbers = base.schema["vector"].dataType.elementType
    kind = "array<float>" if isinstance(numbers, FloatType) else "array<double>"
    base = base.select(F.col("id").cast("long").alias("id"), F.col("vector").cast(kind).alias("vector"), F.col("label").cast("string").alias("label"))
    fits = F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    base = base.withColumn("fits", F.coalesce(fits, F.lit(False)))
    valid = base.where("fits").withColumn("dim", F.size("vector"))
    members = stored(valid.groupBy("label", "dim", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "members")
    tiles = in_cells(members, ["label", "dim"], TILE)
    tiles = stored(tiles.groupBy("cell").applyInArrow(_tile, _TILE), "tiles")
    # Tiles of one label meet in a grid: one side is dealt to blocks, the other goes to each, so no task has all pairs of a label.
    blocks = tiles.count() // BLOCK + 1
    heads = tiles.select("label", "tile", "centre", "radius").withColumn("block", F.pmod(F.xxhash64("tile"), F.lit(blocks)))
    other = heads.drop("block").toDF("label", "tile2", "centre2", "radius2")
    other = other.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    met = heads.join(other, ["label", "block"]).where((F.col("tile") <= F.col("tile2")) & (F.size("centre") == F.size("centre2")))
    inner = F.aggregate(F.zip_with("centre", "centre2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner))) - F.col("radius") - F.col("radius2")
    met = met.where(apart <= float(np.arccos(threshold)) + 1e-6)
    ends = met.select(F.concat_ws("|", "tile", "tile2").alias("pair"), F.explode(F.array_distinct(F.array("tile", "tile2"))).alias("tile"))
    found = ends.join(tiles.drop("label", "centre", "radius"), "tile").groupBy("pair").applyInArrow(_compare(threshold), "id long, links long, root long")
    found = stored(found, "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = members.join(links, "id", "left").join(reach, F.col("id") == F.col("node"), "left").select(
        F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    joined = base.join(classes, F.col("fits") & (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
