"""Recognising dates written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts, tried in this order, each with the shape
# the text must have (Spark's parser alone is stricter on names and laxer on years).
DATE_LAYOUTS = [
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy-M-d'T'H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("d MMM yyyy", r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]+\s+\d{1,2},\s+\d{4}$"),
]


def parse_date_text(col: Column) -> Column:
    """Timestamp of the first layout that fits the text, else null. Month names in any case."""
    spaced = F.initcap(F.regexp_replace(col, r"\s+", " "))
    fits = []
    for layout, shape in DATE_LAYOUTS:
        text = spaced if "MMM" in layout else col
        # A cheap shape test keeps the parser off text that cannot be a date.
        fits.append(F.when(col.rlike(shape), F.try_to_timestamp(text, F.lit(layout))))
    return F.coalesce(*fits)
