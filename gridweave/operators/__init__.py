"""DataFrame operators."""

from .checks import (
    Check,
    alpha_check,
    boolean_check,
    date_check,
    length_check,
    length_variance_check,
    match_ratio,
    numeric_check,
    pattern_check,
    predicate_check,
    run_checks,
    run_folded_check,
    run_list_check,
    string_check,
    uniqueness_check,
    variance_check,
)
from .classify import best_types, classify, column_examples, detector_scores, root_types
from .dedupe import (
    Dedupe,
    dedupe_and_map,
    dedupe_increment,
    distinct_values,
    exclude_seen,
    keep_first,
    merge_values,
)
from .detectors import DETECTORS, ZIP_CODE, Detector
from .layout import Layout, apply_layout, load_layout, with_sections
from .mapping import (
    Slot,
    apply_mapping,
    as_slots,
    combine,
    missing_columns,
    missing_report,
    output_columns,
    used_sources,
)
from .positions import head, is_valid_skip, parse_skip, skip_rows, with_row_index
from .sampling import column_sample, preview
from .tables import append_rows, infer_types, row_count, schema_report, text_columns, validate_columns

__all__ = [name for name in dir() if not name.startswith("_")]
