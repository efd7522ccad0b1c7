"""Column classification: score every semantic type for every column, in one job.

Cells are unpivoted and matched where they are read; a row of counts per column leaves each task. Distinct
values are counted by hashes, so no cell is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.numbers import normalize_number
from gridweave.functions.text import PY_FLAGS, free_name, quoted
from gridweave.operators.checks import Cells, Check, Kinds, column_cells, measured_columns
from gridweave.operators.dedupe import order_value
from gridweave.operators.detectors import DETECTORS, Detector, lineage
from gridweave.operators.positions import head
from gridweave.operators.sampling import unpivot_text

# Fixed values of the scoring rule.
KEYWORD_BOOST = 0.1
NAME_LIKENESS_WEIGHT = 0.05
LOW_SCORE = 0.3
PARENT_SHARE = 5
BEST_THRESHOLD = 0.1
EXAMPLES = 3


def name_boost(column: str, detector: Detector) -> float:
    """What a column's name adds to a type's score: a keyword, or likeness to the type's name."""
    name = column.lower()
    if any(word in name for word in detector.keywords):
        return KEYWORD_BOOST
    return NAME_LIKENESS_WEIGHT * SequenceMatcher(None, name, detector.name).ratio()


def _sampled(df: DataFrame, sample: int | None, order_by: str | Sequence[str] | None) -> DataFrame:
    if sample is None:
        return df
    if order_by is None:
        raise ValueError("a sample needs order_by; sample=None reads all rows")
    return head(df, sample, order_by, free_name(df, "__position"))


def _spec(detectors: Sequence[Detector], checks: Sequence[Check]) -> Column:
    """The detectors as a constant array, their checks as positions in ``checks``."""
    at = {d.name: i for i, d in enumerate(detectors)}
    return F.array(
        *[
            F.struct(
                F.lit(d.name).alias("type"),
                F.array(*[F.lit(checks.index(c)) for c in d.checks]).cast("array<int>").alias("checks"),
                F.lit(len(lineage(detectors, d.name)) - 1).alias("depth"),
                F.lit(at.get(d.parent)).cast("int").alias("parent"),
            )
            for d in detectors
        ]
    )


def _raw_score(detector: Column, gate: Column) -> Column:
    """Mean of the checks that apply, favoured for depth and for the number of checks."""
    run = F.filter(F.transform(detector["checks"], lambda k: F.get("results", k)), lambda r: r["applies"])
    done = F.size(F.array_distinct(F.transform(run, lambda r: r["name"])))
    total = F.reduce(run, F.lit(0.0), lambda sum_, r: sum_ + r["weighted"])
    mean = F.when(done > 0, total / done).otherwise(0.0)
    raised = F.pow(mean * F.greatest(F.lit(1), detector["depth"]), F.lit(1.0) + done / F.lit(10.0))
    return F.when(~gate, 0.0).when(mean <= LOW_SCORE, mean).otherwise(normalize_number(raised))


def classify(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    detectors: Sequence[Detector] = DETECTORS,
    sample: int | None = None,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """``(column_name, candidates)``: per column the candidate types, best first.

    A candidate is ``(type, score, depth, rank)``. All rows are judged; ``sample`` names a
    number of leading rows to judge by instead (under ``order_by``).
    """
    chosen = list(columns or df.columns)
    rows = _sampled(df, sample, order_by).select(*[quoted(c) for c in chosen])
    checks = list(dict.fromkeys(c for d in detectors for c in d.checks))
    cells = Cells(F.col("shown"), Kinds.of(rows, chosen))
    measured, m = measured_columns(rows, chosen, checks, column_cells(rows, chosen), cells)
    # One row per column and detector of metadata: bounded by the schema, not by the data.
    boosts = df.sparkSession.createDataFrame(
        [(c, [name_boost(c, d) for d in detectors]) for c in chosen], "__column string, __boosts array<double>"
    )
    spec = _spec(detectors, checks)
    results = [
        F.struct(F.lit(c.name).alias("name"), c.applies(m).alias("applies"), c.weighted(m).alias("weighted"))
        for c in checks
    ]
    judged = measured.select(
        "column_name",
        F.array(*results).alias("results"),
        F.array(*[d.gate(m) for d in detectors]).alias("gates"),
    )
    scored = judged.join(F.broadcast(boosts), F.col("column_name") == F.col("__column")).select(
        "column_name",
        "__boosts",
        F.transform(spec, lambda d, i: _raw_score(d, F.get("gates", i))).alias("scores"),
    )
    scored = scored.withColumn(
        "scores",
        F.transform("scores", lambda s, i: F.when(s != 0, normalize_number(s + F.get("__boosts", i)))),
    )
    # A parent may have a parent: bonuses go one level at a time.
    for level in range(1, max(len(lineage(detectors, d.name)) for d in detectors)):
        scored = scored.withColumn("scores", _with_parent_bonus(spec, level))
    candidates = F.transform(
        spec,
        lambda d, i: F.struct(
            (-F.get("scores", i)).alias("minus"),
            i.alias("place"),
            d["type"].alias("type"),
            F.get("scores", i).alias("score"),
            d["depth"].alias("depth"),
        ),
    )
    candidates = F.filter(candidates, lambda c: c["score"] > 0)
    ranked = F.transform(
        F.sort_array(candidates),
        lambda c, i: F.struct(
            c["type"].alias("type"), c["score"].alias("score"), c["depth"].alias("depth"), (i + 1).alias("rank")
        ),
    )
    return scored.select("column_name", ranked.alias("candidates"))


def _with_parent_bonus(spec: Column, level: int) -> Column:
    def score(d: Column, i: Column) -> Column:
        own = F.get("scores", i)
        bonus = F.coalesce(F.get("scores", d["parent"]) / PARENT_SHARE, F.lit(0.0))
        return F.when(d["depth"] == level, own + bonus).otherwise(own)

    return F.transform(spec, score)


def detector_scores(classified: DataFrame) -> DataFrame:
    """``(column_name, type, score, rank)``: one row per candidate."""
    rows = classified.select("column_name", F.inline("candidates"))
    return rows.select("column_name", "type", "score", "rank")


def _best(threshold: float) -> Column:
    """The candidate with the top score; among equals the deepest, then the first ranked."""
    top = F.get("candidates", F.lit(0))["score"]
    equals = F.filter("candidates", lambda c: (c["score"] == top) & (top >= threshold))
    keyed = F.transform(equals, lambda c: F.struct((-c["depth"]).alias("d"), c["rank"].alias("r"), c.alias("c")))
    return F.get(F.sort_array(keyed), F.lit(0))["c"]


def best_types(classified: DataFrame, threshold: float = BEST_THRESHOLD) -> DataFrame:
    """``(column_name, type, score)``; null where no candidate reaches the threshold."""
    best = classified.select("column_name", _best(threshold).alias("best"))
    return best.select("column_name", F.col("best.type").alias("type"), F.col("best.score").alias("score"))


def root_types(
    classified: DataFrame,
    detectors: Sequence[Detector] = DETECTORS,
    threshold: float = BEST_THRESHOLD,
) -> DataFrame:
    """``(column_name, type, root)``: the best type and its most generic ancestor."""
    roots = F.create_map(*[F.lit(x) for d in detectors for x in (d.name, lineage(detectors, d.name)[-1])])
    best = best_types(classified, threshold)
    return best.select("column_name", "type", F.try_element_at(roots, F.col("type")).alias("root"))


def column_examples(
    df: DataFrame,
    order_by: str | Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``(column_name, examples)``: the first non-blank values of each column, over all rows.

    The rank limit is applied in each task first, so a few rows per task and column meet.
    """
    chosen = list(columns or df.columns)
    place = free_name(df, "__order")
    cells = unpivot_text(df.withColumn(place, order_value(order_by)), chosen, [place])
    cells = cells.select("column_name", quoted(place).alias("place"), "value")
    shown = cells.where(F.col("value").rlike(f"{PY_FLAGS}[^\\s\\x1c-\\x1f]"))
    order = Window.partitionBy("column_name").orderBy("place", "value")
    first = shown.withColumn("n", F.row_number().over(order)).where(F.col("n") <= EXAMPLES)
    found = first.groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("cells"))
    return found.select("column_name", F.transform("cells", lambda c: c["value"]).alias("examples"))
