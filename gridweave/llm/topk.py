"""Exact top-k by inner product with M-trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored
from .vectors import finite, in_cells, matrix

LEAF = 64
FANOUT = 16
PAGE = 4096  # vectors of a tree
QUERIES = 512  # of a block


class MTree:
    """Nodes in arrays. A node has a centre, the radius that covers what is below, the distance to its parent's centre, and the
    largest norm below; it holds either nodes or entries, which lie one after the other. Entries have their distance to the leaf's centre."""

    FIELDS = ("ids", "vectors", "near", "centres", "radius", "parent", "norm", "leaf", "first", "count")

    def __init__(self, **fields: np.ndarray):
        self.__dict__.update(fields)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> MTree:
        points = vectors.astype(np.float64)
        norms = np.sqrt((points * points).sum(1))
        nodes: list[dict] = []
        entries: list[np.ndarray] = []
        near: list[np.ndarray] = []
        waiting = [(np.arange(len(ids)), None)]
        stored_entries = 0
        for members, above in _growing(waiting):
            x = points[members]
            centre = x[((x - x.mean(0)) ** 2).sum(1).argmin()]
            away = np.sqrt(((x - centre) ** 2).sum(1))
            parent = 0.0 if above is None else float(np.sqrt(((centre - nodes[above]["centre"]) ** 2).sum()))
            node = {"centre": centre, "radius": away.max(), "parent": parent, "norm": norms[members].max(), "leaf": len(members) <= LEAF}
            number = len(nodes)
            nodes.append(node)
            if above is not None and "first" not in nodes[above]:
                nodes[above]["first"] = number
            if node["leaf"]:
                order = np.argsort(away, kind="stable")
                node["first"], node["count"] = stored_entries, len(members)
                entries.append(members[order])
                near.append(away[order])
                stored_entries += len(members)
            else:
                groups = _split(x, away)
                node["count"] = len(groups)
                waiting.extend((members[g], number) for g in groups)
        of = np.concatenate(entries)
        pick_all = lambda name, kind: np.array([n[name] for n in nodes], kind)
        return cls(
            ids=ids[of], vectors=vectors[of], near=np.concatenate(near), centres=np.stack([n["centre"] for n in nodes]), radius=pick_all("radius", np.float64),
            parent=pick_all("parent", np.float64), norm=pick_all("norm", np.float64), leaf=pick_all("leaf", bool), first=pick_all("first", np.int64), count=pick_all("count", np.int64),
        )

    def search(self, query: np.ndarray, k: int, least: int | None, skip: int | None = None) -> list[tuple[int, int]]:
        """The k best ``(score, id)`` of at least ``least``, ties to smaller ids; the node with the best bound first.

        By the triangle inequality no point of a node is nearer than the distance to its centre less its radius, and with the largest norm
        that bounds the inner product. The stored distance to the parent's centre gives such a bound before anything is computed.
        """
        q = query.astype(np.float64)
        square = float(q @ q)
        slack = 1e-9 * (1 + square + float(self.norm[0]) ** 2)

        def bound(distance: np.ndarray, norm: np.ndarray) -> np.ndarray:
            return (square + norm**2 - np.maximum(0, distance) ** 2) / 2 + slack

        best: list[tuple[int, int]] = []  # heap of (score, -id)
        floor = -(1 << 62) if least is None else least
        root = float(np.sqrt(((q - self.centres[0]) ** 2).sum()))
        queue = [(-float(bound(np.array(root - self.radius[0]), self.norm[0])), 0, root)]
        while queue and -queue[0][0] >= floor:
            _, node, distance = heapq.heappop(queue)
            a, b = self.first[node], self.first[node] + self.count[node]
            if self.leaf[node]:
                hit = a + np.flatnonzero(bound(np.abs(distance - self.near[a:b]), self.norm[node]) >= floor)
                scores = self.vectors[hit] @ query
                for i in np.flatnonzero(scores >= floor):
                    one = (int(scores[i]), -int(self.ids[hit[i]]))
                    if -one[1] == skip:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, one)
                    elif one > best[0]:
                        heapq.heapreplace(best, one)
                    if len(best) == k:
                        floor = max(floor, best[0][0])
            else:
                child = np.arange(a, b)
                child = child[bound(np.abs(distance - self.parent[a:b]) - self.radius[a:b], self.norm[a:b]) >= floor]
                away = np.sqrt(((self.centres[child] - q) ** 2).sum(1))
                limits = bound(away - self.radius[child], self.norm[child])
                for c, limit, d in zip(child.tolist(), limits.tolist(), away.tolist(), strict=True):
                    if limit >= floor:
                        heapq.heappush(queue, (-limit, c, d))
        return [(score, -number) for score, number in sorted(best, reverse=True)]

    def packed(self) -> dict[str, bytes]:
        return {n: np.ascontiguousarray(getattr(self, n)).tobytes() for n in self.FIELDS}

    @classmethod
    def unpacked(cls, row: dict) -> MTree:
        kinds = dict.fromkeys(cls.FIELDS, np.float64) | {"ids": np.int64, "vectors": np.int64, "leaf": bool, "first": np.int64, "count": np.int64}
        fields = {n: np.frombuffer(row[n], kinds[n]) for n in cls.FIELDS}
        fields["vectors"] = fields["vectors"].reshape(len(fields["ids"]), -1)
        fields["centres"] = fields["centres"].reshape(len(fields["radius"]), -1)
        return cls(**fields)


def _growing(waiting: list) -> Iterator:
    at = 0
    while at < len(waiting):
        yield waiting[at]
        at += 1


def _split(x: np.ndarray, away: np.ndarray) -> list[np.ndarray]:
    """Members by the nearest of points far from each other; equal points are dealt out evenly."""
    n = min(FANOUT, -(-len(x) // LEAF))
    if away.max() == 0:
        return np.array_split(np.arange(len(x)), n)
    chosen, gap = [int(away.argmax())], np.full(len(x), np.inf)
    nearest = np.zeros(len(x), np.int64)
    for c in range(n):
        d = ((x - x[chosen[c]]) ** 2).sum(1)
        closer = d < gap
        nearest[closer], gap[closer] = c, d[closer]
        if gap.max() == 0:
            break
        chosen.append(int(gap.argmax()))
    return [g for c in range(n) if len(g := np.flatnonzero(nearest == c))]


_TREE = ", ".join(f"{n} binary" for n in MTree.FIELDS)
_BUILT = f"kind int, page string, query long, q binary, rank_score long, vec long, {_TREE}"


def _built_schema() -> pa.Schema:
    return pa.schema(
        [("kind", pa.int32()), ("page", pa.string()), ("query", pa.int64()), ("q", pa.binary()), ("rank_score", pa.int64()), ("vec", pa.int64())]
        + [(n, pa.binary()) for n in MTree.FIELDS]
    )


def _build(k: int):
    """Per page: its tree (kind 0), its own queries with the worst score they need beat (1), and their best there (2)."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, vectors = rows.column("id").to_numpy().astype(np.int64), matrix(rows.column("vector"), np.int64)
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        tree, page = MTree.build(ids, vectors), rows.column("cell")[0].as_py()
        out = [{"kind": 0, "page": page} | tree.packed()]
        for i in np.flatnonzero(asks):
            found = tree.search(vectors[i], k, None, int(ids[i]))
            out.append({"kind": 1, "page": page, "query": int(ids[i]), "q": vectors[i].tobytes(), "rank_score": found[-1][0] if len(found) == k else None})
            out += [{"kind": 2, "query": int(ids[i]), "rank_score": s, "vec": v} for s, v in found]
        return pa.Table.from_pylist(out, _built_schema())

    return run


def _route(queries: pa.Table, pages: pa.Table) -> pa.Table:
    """Per block of queries and block of pages: the pairs whose bound reaches the query's floor."""
    out: dict[str, list] = {"page": [], "query": [], "q": [], "rank_score": []}
    if queries.num_rows and pages.num_rows:
        q = np.stack([np.frombuffer(b, np.int64) for b in queries.column("q").to_pylist()]).astype(np.float64)
        floors = np.array([-(1 << 62) if s is None else s for s in queries.column("rank_score").to_pylist()], np.float64)
        homes = np.array(queries.column("page").to_pylist(), object)
        for page in pages.to_pylist():
            centre = np.frombuffer(page["centre"])
            square = (q * q).sum(1)
            near = np.maximum(0, np.sqrt(((q - centre) ** 2).sum(1)) - page["radius"])
            limit = (square + page["norm"] ** 2 - near**2) / 2 + 1e-9 * (1 + square + page["norm"] ** 2)
            for i in np.flatnonzero((limit >= floors) & (homes != page["page"])).tolist():
                out["page"].append(page["page"])
                for name in ("query", "q", "rank_score"):
                    out[name].append(queries.column(name)[i].as_py())
    return pa.table(out, schema=pa.schema([("page", pa.string()), ("query", pa.int64()), ("q", pa.binary()), ("rank_score", pa.int64())]))


def _search(k: int):
    schema = pa.schema([("query", pa.int64()), ("score", pa.int64()), ("vec", pa.int64())])

    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if pages.num_rows:
            tree = MTree.unpacked(pages.to_pylist()[0])
            for row in queries.to_pylist():
                best = tree.search(np.frombuffer(row["q"], np.int64), k, row["rank_score"], row["query"])
                found += [{"query": row["query"], "score": s, "vec": v} for s, v in best]
        return pa.Table.from_pylist(found, schema)

    return run


def scaled(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def top_scores(
    rows: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024
) -> DataFrame:
    """The k rows with the highest inner product of floor(scale * x) for each row that ``asks``: ``query_id, rank, vec_id, score``.

    ``asks`` is a condition on the columns of ``rows``. Vectors fall into pages of about ``PAGE`` near ones, and each page is an M-tree, stored as one row. A query is
    first searched in its own page, which gives a score that others must reach. Blocks of queries then meet blocks of
    page centres, and a query goes on only to pages whose bound reaches that score. Results are exact: ties go to the smaller id and
    bounds only leave out what is worse than the k-th. A query is not its own candidate, nor is another row of its key. Scores are 64-bit whole numbers.

    A vector that is null, empty, or holds null or non-finite components takes no part, nor does a null key. Only vectors of one length
    meet. With fewer than k candidates all are returned. Rows of one key are candidates of their own; as queries they share its k places,
    and a row that is best for several of them is there as often. An empty table gives an empty result.
    """
    pick(rows, id=key, vector=vector)
    valid = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    valid = valid.where(F.col("id").isNotNull() & finite(F.col("vector"))).withColumn("vector", scaled(F.col("vector"), scale))
    valid = stored(valid.withColumn("dim", F.size("vector")), "whole-vectors")
    built = stored(in_cells(valid, ["dim"], PAGE).groupBy("cell").applyInArrow(_build(k), _BUILT), "pages")
    trees = built.where("kind = 0").drop("kind", "query", "q", "rank_score", "vec")
    queries = built.where("kind = 1").select("page", "query", "q", "rank_score")

    heads = trees.mapInArrow(_heads, "page string, centre binary, radius double, norm double")
    n_pages, n_queries = trees.select("page").count(), queries.count()
    if not n_pages:
        return _ranked(built.where("kind = 2").select("query", F.col("rank_score").alias("score"), "vec"), k)
    page_blocks, query_blocks = n_pages // 1024 + 1, n_queries // QUERIES + 1
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    asked = queries.withColumn("dim", F.length("q")).withColumn("qb", spread("query", query_blocks)).withColumn("pb", every(page_blocks))
    shown = heads.withColumn("dim", F.length("centre")).withColumn("pb", spread("page", page_blocks)).withColumn("qb", every(query_blocks))
    visits = asked.groupBy("dim", "qb", "pb").cogroup(shown.groupBy("dim", "qb", "pb")).applyInArrow(
        _route, "page string, query long, q binary, rank_score long"
    )
    visits = stored(visits.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(query_blocks))), "visits")
    wanted = visits.groupBy(F.col("page").alias("at"), F.col("part").alias("for")).agg(F.count("*").alias("n"))
    copies = trees.join(wanted.drop("n"), F.col("page") == F.col("at"))
    found = copies.groupBy("at", "for").cogroup(visits.groupBy("page", "part")).applyInArrow(_search(k), "query long, score long, vec long")
    home = built.where("kind = 2").select("query", F.col("rank_score").alias("score"), "vec")
    return _ranked(home.union(found), k)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [MTree.unpacked(r) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page"), pa.array([t.centres[0].tobytes() for t in trees], pa.binary()),
                pa.array([float(t.radius[0]) for t in trees], pa.float64()), pa.array([float(t.norm[0]) for t in trees], pa.float64()),
            ],
            names=["page", "centre", "radius", "norm"],
        )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int"), F.col("vec").alias("vec_id"), "score")
