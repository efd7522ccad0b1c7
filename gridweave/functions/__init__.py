"""Scalar functions built from native Spark expressions."""

from .dates import parse_date_text
from .numbers import HALF_SATURATION, normalize_number, normalize_number_list
from .text import fold_nan, normalize_text, normalize_text_list, py_str, quoted

__all__ = [
    "HALF_SATURATION",
    "fold_nan",
    "normalize_number",
    "normalize_number_list",
    "normalize_text",
    "normalize_text_list",
    "parse_date_text",
    "py_str",
    "quoted",
]
