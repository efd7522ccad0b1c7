"""SQL that gives the same rows as each query, for DuckDB over the same tables."""

from __future__ import annotations

from difflib import SequenceMatcher

ORACLES: dict[str, str] = {}

_ORDER_TEXTS = """CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
    o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice, o_orderpriority"""

# Mapping

ORACLES["map_single"] = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders"
ORACLES["map_combine"] = """
    SELECT c_name || '-' || c_mktsegment AS "Combined_1", CAST(c_custkey AS VARCHAR) AS c_custkey,
           c_nationkey || ' / ' || c_custkey || ' / ' || c_name AS "Combined_3" FROM customer"""
ORACLES["map_default_separator"] = """
    SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand || ' ' || p_type AS "Combined_2" FROM part"""
ORACLES["map_legacy_string"] = """
    SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part"""
ORACLES["map_duplicate_slot"] = """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'later ' || c_name AS "Combined_2",
           CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer"""
ORACLES["map_empty_slot"] = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, '' AS "Combined_2" FROM customer"""
ORACLES["map_empty_input"] = """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ' ' || c_mktsegment AS "Combined_2"
    FROM customer WHERE c_mktsegment = 'no such segment'"""
ORACLES["map_null_slot"] = """
    SELECT CAST(event_id AS VARCHAR) AS event_id,
           user_id || '|' || coalesce(nullif(event_type, 'error'), '') || '|' || event_id AS "Combined_2",
           coalesce(nullif(event_type, 'error'), '') AS event_type FROM events"""
ORACLES["missing_columns"] = """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || '--' || c_nationkey AS "Combined_2", '' AS absent
    FROM customer"""
ORACLES["map_strict"] = """
    SELECT 'lenient' AS case, count(*) AS rows,
           sum(length(c_custkey || c_name || ' ' || ' ' || c_nationkey || ' ')) AS letters, NULL AS refused FROM customer
    UNION ALL SELECT 'all there', count(*), sum(length(c_custkey || c_name || ' ' || c_nationkey)), NULL FROM customer
    UNION ALL SELECT 'strict', 0, 0, 'missing columns: [''absent'', ''gone'']'
    UNION ALL SELECT 'per slot', 0, 0, 'mapping slots miss columns: [(1, [''absent'']), (2, [''absent'', ''gone''])]'
    UNION ALL SELECT 'no slot', 0, 0, 'the mapping has no slots'"""
ORACLES["map_used_sources"] = "SELECT o_orderpriority, o_custkey, o_orderkey FROM orders"
ORACLES["validate_names"] = """
    SELECT 'fine' AS case, count(*) AS rows, sum(length(o_orderkey || '' || o_custkey)) AS letters, NULL AS refused FROM orders
    UNION ALL SELECT 'repeated', 0, 0, 'repeated column names: [''o_orderkey'']'
    UNION ALL SELECT 'empty', 0, 0, 'a column has an empty name'"""
ORACLES["render_text"] = """
    SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_quantity AS VARCHAR) AS l_quantity,
           CAST(l_extendedprice AS VARCHAR) AS l_extendedprice, CAST(l_discount AS VARCHAR) AS l_discount,
           CAST(l_extendedprice * 100000000 AS VARCHAR) AS wide, CAST(l_discount / 1000 AS VARCHAR) AS narrow,
           CASE WHEN l_tax > 0.04 THEN 'True' ELSE 'False' END AS taxed,
           strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM lineitem"""

# Deduplication

ORACLES["dedupe_drop"] = """
    SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, event_id || ' ' || props AS "Combined_3"
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1"""
ORACLES["dedupe_concat"] = """
    SELECT CAST(user_id AS VARCHAR) AS user_id, string_agg(event_type, '; ' ORDER BY seen) AS event_type
    FROM (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY user_id, event_type)
    GROUP BY user_id"""
ORACLES["dedupe_concat_columns"] = """
    WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS nth FROM orders),
    s AS (SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY seen) AS statuses
          FROM (SELECT o_custkey, o_orderstatus, min(nth) AS seen FROM o GROUP BY ALL) GROUP BY o_custkey),
    p AS (SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY seen) AS priorities
          FROM (SELECT o_custkey, o_orderpriority, min(nth) AS seen FROM o GROUP BY ALL) GROUP BY o_custkey)
    SELECT CAST(s.o_custkey AS VARCHAR) AS o_custkey, statuses AS o_orderstatus,
           priorities || ' # ' || statuses AS "Combined_3" FROM s JOIN p ON s.o_custkey = p.o_custkey"""
ORACLES["dedupe_concat_rows"] = """
    SELECT o_custkey, 'o_orderstatus' AS column_name, o_orderstatus AS value, min(o_orderkey) AS first_seen
    FROM orders GROUP BY o_custkey, o_orderstatus
    UNION ALL
    SELECT o_custkey, 'o_orderpriority', o_orderpriority, min(o_orderkey)
    FROM orders GROUP BY o_custkey, o_orderpriority"""
ORACLES["dedupe_concat_key_only"] = "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS l_suppkey FROM lineitem"
ORACLES["dedupe_null_keys"] = """
    WITH e AS (SELECT *, CASE WHEN value > 20 THEN NULL WHEN event_type <> 'error' THEN CAST(user_id AS DOUBLE) END AS k
               FROM events)
    SELECT CAST(k AS VARCHAR) AS k, CAST(event_id AS VARCHAR) AS event_id, event_type
    FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id) AS n FROM e WHERE k IS NOT NULL)
    WHERE n = 1"""
ORACLES["dedupe_concat_blanks"] = """
    WITH e AS (SELECT props, CASE WHEN event_type NOT IN ('error', 'view') THEN event_type END AS t,
                      min(event_id) AS seen FROM events GROUP BY ALL)
    SELECT props, coalesce(string_agg(t, '+' ORDER BY seen), '') AS event_type FROM e GROUP BY props"""
ORACLES["dedupe_disabled"] = """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders"""
ORACLES["incremental_dedupe"] = """
    SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n
          FROM orders WHERE o_orderpriority <> '1-URGENT') f
    WHERE n = 1 AND NOT EXISTS (
        SELECT 1 FROM orders u WHERE u.o_orderpriority = '1-URGENT' AND u.o_custkey = f.o_custkey)"""
ORACLES["stream_dedupe"] = """
    SELECT o_custkey, o_orderkey, o_orderstatus
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
    WHERE n = 1"""
ORACLES["stream_dedupe_replay"] = ORACLES["stream_dedupe"]
ORACLES["stream_metrics"] = """
    SELECT count(*) AS n_rows, true AS timed FROM orders
    WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01' AND o_orderstatus <> 'P' GROUP BY month(o_orderdate)"""
ORACLES["stream_dedupe_keys"] = "SELECT DISTINCT user_id FROM events"

# Row positions and samples

_ORDERS_AT = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders)"

ORACLES["row_index"] = """
    SELECT row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS idx, event_id, user_id FROM events"""
ORACLES["skip_rows"] = f"""
    SELECT o_orderkey, o_custkey, o_orderpriority FROM {_ORDERS_AT} WHERE idx NOT IN (0, 1, 3, 17)"""
ORACLES["row_index_many_ranges"] = ORACLES["row_index"]
ORACLES["skip_rows_named_idx"] = """
    SELECT o_orderkey, o_custkey AS idx FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)
    WHERE p <> 0 AND p NOT BETWEEN 3 AND 5"""
ORACLES["preview_named_idx"] = """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS idx FROM orders ORDER BY orders.o_orderkey LIMIT 5"""
ORACLES["dedupe_concat_key_named_value"] = """
    WITH firsts AS (SELECT CAST(floor(value) AS BIGINT) AS value, event_type, min(event_id) AS first FROM events GROUP BY 1, 2)
    SELECT value, string_agg(event_type, '; ' ORDER BY first) AS event_type FROM firsts GROUP BY value"""
ORACLES["scan_csv_headers_differ"] = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer"
ORACLES["append_csv"] = """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL FROM supplier"""
ORACLES["skip_prefix"] = f"SELECT o_orderkey, o_custkey FROM {_ORDERS_AT} WHERE idx >= 250"
ORACLES["skip_rows_expr"] = """
    SELECT o_orderkey, o_custkey, o_orderdate
    FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders)
    WHERE NOT (idx = 0 OR idx BETWEEN 4 AND 6 OR idx BETWEEN 9 AND 11 OR idx BETWEEN 12000 AND 13000)"""
ORACLES["preview"] = f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_custkey || ':' || o_orderpriority AS "Combined_2"
    FROM {_ORDERS_AT} WHERE idx < 5"""


def _sample(where: str) -> str:
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, idx, CAST({c} AS VARCHAR) AS value FROM {_ORDERS_AT} WHERE {where}"
        for c in columns
    )


ORACLES["column_sample"] = _sample("idx < 100")
ORACLES["column_sample_chunked"] = _sample("idx % 1000 < 3")

# Tables

ORACLES["append_rows"] = """
    SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier"""
ORACLES["row_count"] = "SELECT count(*) AS row_count FROM lineitem"
ORACLES["schema_report"] = """
    WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS a,
                      CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS b,
                      CAST(o_totalprice AS VARCHAR) AS c, o_orderpriority AS d,
                      CASE WHEN o_totalprice > 1000 THEN 'True' ELSE 'False' END AS e FROM orders),
    c AS (SELECT 0 AS position, 'o_orderkey' AS column_name, a AS v FROM t UNION ALL
          SELECT 1, 'o_custkey', b FROM t UNION ALL SELECT 2, 'o_totalprice', c FROM t UNION ALL
          SELECT 3, 'o_orderpriority', d FROM t UNION ALL SELECT 4, 'large', e FROM t)
    SELECT position, column_name,
           CASE WHEN bool_and(regexp_full_match(v, '[0-9]+')) AND count(v) = count(*) THEN 'int64'
                WHEN bool_and(regexp_full_match(v, '[0-9.]+')) THEN 'float64'
                WHEN bool_and(v IN ('True', 'False')) THEN 'bool' ELSE 'object' END AS dtype
    FROM c GROUP BY position, column_name"""
ORACLES["file_metadata"] = "SELECT 'lineitem.parquet' AS file_name, count(*) AS row_count FROM lineitem"
ORACLES["apply_layout"] = """
    SELECT c_name AS company, CAST(c_custkey AS VARCHAR) AS number, CAST(c_nationkey AS VARCHAR) AS country
    FROM customer"""
ORACLES["layout_sections"] = """
    SELECT 1 AS section, CAST(NULL AS INTEGER) AS section_row, c_name AS company, CAST(c_custkey AS VARCHAR) AS number
    FROM customer
    UNION ALL SELECT 0, 0, 'Customers', '' UNION ALL SELECT 2, 0, 'end of list', NULL"""

# Files

ORACLES["scan_csv"] = f"SELECT {_ORDER_TEXTS} FROM orders"
ORACLES["scan_csv_types"] = """
    SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus,
           o_totalprice, o_orderpriority FROM orders"""
ORACLES["scan_csv_skip"] = f"""
    SELECT {_ORDER_TEXTS} FROM (
        SELECT *, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS n FROM orders)
    WHERE n > 2"""
ORACLES["scan_csv_bad_rows"] = """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
           CAST(o_totalprice AS VARCHAR) AS o_totalprice,
           CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority
    FROM orders WHERE o_orderstatus <> 'P'"""
ORACLES["scan_csv_missing_values"] = """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'none' END AS word,
           ',"quoted"' AS marks FROM orders"""
ORACLES["scan_csv_multi_line"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, text FROM documents"
ORACLES["scan_csv_records_skip"] = """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'a "b", ' || chr(13) || chr(10) || coalesce(text, '') AS text FROM (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL)
    WHERE n > 2"""
ORACLES["scan_csv_case_names"] = """
    SELECT CAST(n_nationkey AS VARCHAR) AS "Key", n_name AS name, CAST(n_regionkey AS VARCHAR) AS key_1, n_name AS name_1 FROM nation"""
ORACLES["scan_csv_other_headers"] = """
    SELECT f AS first, s AS second, CASE WHEN f = s THEN (SELECT count(*) FROM nation) END AS n_rows
    FROM (VALUES ('a,b', 'a,b'), ('a,b', 'b,a'), ('a,a', 'a,a'), ('a,a', 'x,y'), ('a,', 'a,x'), ('A,a', 'a,A')) AS t(f, s)"""
ORACLES["own_format_roundtrip"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
ORACLES["scan_directory"] = ORACLES["scan_csv"]
ORACLES["roundtrip_csv"] = ORACLES["scan_csv"]
ORACLES["reshape_job"] = """
    SELECT CAST(o_custkey AS VARCHAR) AS customer, o_orderkey || ' ' || o_orderpriority AS "Combined_2"
    FROM (SELECT *, row_number() OVER (
              PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m'), o_orderkey) AS n FROM orders)
    WHERE n = 1"""
ORACLES["reshape_default_output"] = """
    SELECT CAST(o_orderkey AS VARCHAR) AS "order", o_orderpriority AS priority, true AS beside FROM orders"""

# Checks. Cells: one row per value with its text and what it counts as.


def _cells(source: str, columns: dict[str, str]) -> str:
    parts = []
    for name, kind in columns.items():
        number = f"CAST({name} AS DOUBLE)" if kind == "number" else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{name}' AS column_name, '{kind}' AS kind, CAST({name} AS VARCHAR) AS shown, {number} AS number "
            f"FROM {source}"
        )
    return " UNION ALL ".join(parts)


_TEXT = "(kind = 'text' AND shown IS NOT NULL)"
_NUMBER = "(kind = 'number' AND shown IS NOT NULL)"


def _share(test: str) -> str:
    return f"avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END)"


def _check(name: str, source: str, columns: dict[str, str], score: str, applies: str = "true") -> str:
    return f"""
    SELECT column_name, '{name}' AS check_name, {applies} AS applies, round(CAST({score} AS DOUBLE), 6) AS score
    FROM ({_cells(source, columns)}) GROUP BY column_name"""


ORACLES["check_match_ratio"] = """
    SELECT lang, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM documents GROUP BY lang"""
ORACLES["check_string"] = _check(
    "string_check",
    "customer",
    {"c_name": "text", "c_acctbal": "number"},
    f"0.5 * CASE WHEN count_if({_TEXT}) = count(shown) THEN 1 WHEN count_if({_TEXT}) > 0 THEN 0.25 ELSE 0 END",
    f"count_if({_TEXT}) > 0",
)
ORACLES["check_numeric"] = _check(
    "numeric_check",
    "(SELECT c_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS c_acctbal FROM customer)",
    {"c_name": "text", "c_acctbal": "number"},
    f"0.5 * {_share(_NUMBER)}",
    f"count_if({_NUMBER}) > 0",
)
ORACLES["check_variance"] = _check(
    "variance_check",
    "lineitem",
    {"l_discount": "number", "l_quantity": "number"},
    "CASE WHEN var_pop(number) BETWEEN 0 AND 0.2 THEN 1 ELSE 0 END",
)
ORACLES["check_pattern"] = _check(
    "pattern_check",
    "documents",
    {"text": "text", "lang": "text"},
    "2 * " + _share(f"{_TEXT} AND regexp_matches(shown, '[0-9]{{3}}-[0-9]{{4}}|en')"),
)
ORACLES["check_length"] = _check(
    "length_check",
    "documents",
    {"text": "text", "lang": "text"},
    _share(f"{_TEXT} AND length(shown) BETWEEN 2 AND 400"),
)
ORACLES["check_length_variance"] = _check(
    "length_variance_check",
    "part",
    {"p_name": "text", "p_partkey": "number"},
    f"""CASE WHEN count_if({_TEXT}) = 0 THEN 0
             WHEN var_pop(CASE WHEN {_TEXT} THEN length(shown) END) >= 3 THEN 1 ELSE 0.25 END""",
)
ORACLES["check_uniqueness"] = _check(
    "uniqueness_check",
    "(SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand END AS p_brand FROM part)",
    {"p_brand": "text", "p_partkey": "number"},
    """1.5 * CASE WHEN (count(DISTINCT shown) + max(CASE WHEN shown IS NULL THEN 1 ELSE 0 END)) / count(*) >= 0.8
                  THEN 1 ELSE 0.25 END""",
)
ORACLES["check_date"] = _check(
    "date_check",
    """(SELECT o_custkey, o_orderdate, CASE left(o_orderpriority, 1)
               WHEN '1' THEN 'date' WHEN '2' THEN 'date' WHEN '3' THEN 'date' WHEN '5' THEN 'other' END AS written
        FROM orders)""",
    {"written": "text", "o_orderdate": "moment", "o_custkey": "number"},
    _share("kind = 'moment' OR (kind = 'text' AND shown = 'date')"),
    "count_if(kind IN ('text', 'moment') AND shown IS NOT NULL) > 0",
)
ORACLES["check_boolean"] = _check(
    "boolean_check",
    """(SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 'Yes' WHEN quality = 1 THEN 'no' ELSE 'maybe' END AS answer
        FROM labels)""",
    {"quality": "number", "answer": "text", "doc_id": "number"},
    "0.5 * " + _share("lower(shown) IN ('true', 'false', '1', '0', 'yes', 'no')"),
)
ORACLES["check_alpha"] = _check(
    "name_alpha_check",
    "part",
    {"p_name": "text", "p_brand": "text", "p_size": "number"},
    _share(f"{_TEXT} AND regexp_full_match(shown, '[a-zA-Z ]*')"),
)
ORACLES["check_custom"] = _check(
    "shout",
    "customer",
    {"c_name": "text", "c_mktsegment": "text"},
    _share(f"{_TEXT} AND shown = upper(shown)"),
)

ORACLES["check_list_function"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'repeats' AS check_name, "
    f"round(1 - count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), 6) AS score "
    "FROM customer"
    for c in ("c_nationkey", "c_mktsegment")
)
ORACLES["check_folded_function"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'shortest' AS check_name, "
    f"round(count_if(n = least) / CAST(count(*) AS DOUBLE), 6) AS score "
    f"FROM (SELECT length(CAST({c} AS VARCHAR)) AS n, min(length(CAST({c} AS VARCHAR))) OVER () AS least FROM orders)"
    for c in ("o_orderpriority", "o_orderkey")
)

# Classification. Each type: parent, gate, keywords and its checks as (score, applies).


def _pattern(regex: str, weight: float) -> tuple[str, str]:
    return f"{weight} * " + _share(f"{_TEXT} AND regexp_matches(shown, '{regex}')"), "true"


def _length(low: int, high: int, weight: float = 1.0) -> tuple[str, str]:
    return f"{weight} * " + _share(f"{_TEXT} AND length(shown) BETWEEN {low} AND {high}"), "true"


def _even(high: float) -> tuple[str, str]:
    variance = f"var_pop(CASE WHEN {_TEXT} THEN length(shown) END)"
    return f"1.1 * CASE WHEN count_if({_TEXT}) = 0 OR {variance} > {high} THEN 0 ELSE 1 END", "true"


_UNIQUE = "((count(DISTINCT shown) + max(CASE WHEN shown IS NULL THEN 1 ELSE 0 END)) / count(*))"
_MOSTLY_UNIQUE = (f"CASE WHEN {_UNIQUE} >= 0.8 THEN 1 ELSE 0.25 END", "true")
_STRING = (
    f"0.5 * CASE WHEN count_if({_TEXT}) = count(shown) THEN 1 WHEN count_if({_TEXT}) > 0 THEN 0.25 ELSE 0 END",
    f"count_if({_TEXT}) > 0",
)
_NUMERIC = (f"0.5 * {_share(_NUMBER)}", f"count_if({_NUMBER}) > 0")
_MOSTLY_TEXT = f"count_if({_TEXT}) / count(*) > 0.1"
_SOME_NUMBER = f"count_if({_NUMBER} OR ({_TEXT} AND regexp_full_match(shown, '\\s*\\d+\\s*'))) > 0"


def _words(*checks: tuple[str, str]) -> tuple[str, str, list]:
    return "text", _MOSTLY_TEXT, [_STRING, *checks]


def _codes(*checks: tuple[str, str], even: float = 0.1) -> tuple[str, str, list]:
    return "numeric", _SOME_NUMBER, [_NUMERIC, *checks, _even(even), _MOSTLY_UNIQUE]


_TYPES: list[tuple[str, tuple[str | None, str, list], list[str]]] = [
    ("text", (None, _MOSTLY_TEXT, [_STRING]), []),
    (
        "boolean",
        (None, "true", [("0.5 * " + _share("lower(shown) IN ('true', 'false', '1', '0', 'yes', 'no')"), "true")]),
        [],
    ),
    ("numeric", (None, _SOME_NUMBER, [_NUMERIC]), []),
    (
        "name",
        (None, "true", [(_share(f"{_TEXT} AND regexp_full_match(shown, '[\\p{{L}}\\s]*')"), "true"), _length(3, 50)]),
        ["name"],
    ),
    (
        "companyname",
        _words(_pattern(r"^[A-Za-z0-9\s&.,-]+$", 1.5), _length(3, 100)),
        ["company", "business", "organization"],
    ),
    ("duns", _codes(_pattern(r"^\d{9}$", 1.0), _pattern(r"^\d{2}-\d{3}-\d{4}$", 1.6)), []),
    ("countrycode", _words(_pattern(r"^[A-Z]{2}$", 2.0), _length(2, 2, 1.5)), ["country", "iso"]),
    (
        "numericalcategory",
        (
            "numeric",
            _SOME_NUMBER,
            [
                _NUMERIC,
                ("CASE WHEN var_pop(number) BETWEEN 0 AND 0.2 THEN 1 ELSE 0 END", "true"),
                (f"CASE WHEN {_UNIQUE} > 0.1 THEN 0 ELSE 1 END", "true"),
            ],
        ),
        [],
    ),
    (
        "textcategory",
        _words(_pattern(r"^[A-Za-z\s]+$", 1.5), _length(3, 50)),
        ["category", "type", "classification"],
    ),
    ("countryname", _words(_pattern(r"^[A-Za-z\s-]+$", 1.5), _length(3, 50)), ["country", "nation", "state"]),
    ("currencycode", _words(_pattern(r"^[A-Z]{3}$", 2.0), _length(3, 3, 1.5)), ["currency", "iso4217"]),
    (
        "phonenumber",
        _codes(_pattern(r"^(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?)?\d{3,4}[-.\s]?\d{4}$", 0.75)),
        [],
    ),
    (
        "nordicregistrationnumber",
        _codes(_pattern(r"^(?:\d{7}-\d|\d{8}|\d{9}|\d{10}|(16|[2-9]\d)\d{6}-?\d{4})$", 0.5)),
        [],
    ),
    ("swedishregistrationnumber", _codes(_pattern(r"^(16)?\d{6}(-)?\d{4}$", 1.0)), []),
    ("norwegianregistrationnumber", _codes(_pattern(r"^\d{9}$", 0.75)), []),
    ("danishregistrationnumber", _codes(_pattern(r"^\d{8}$", 0.75), even=0.01), []),
    ("finnishregistrationnumber", _codes(_pattern(r"^\d{7}-\d$", 1.0), even=0.01), []),
]


def _classified(source: str, columns: dict[str, str], types: list = _TYPES) -> str:
    """CTEs that end in ``candidates(column_name, type, place, depth, score)``."""
    rows, boosts = [], []
    for place, (name, (parent, gate, checks), keywords) in enumerate(types):
        done = " + ".join(f"CASE WHEN {applies} THEN 1 ELSE 0 END" for _, applies in checks)
        total = " + ".join(f"CASE WHEN {applies} THEN {score} ELSE 0 END" for score, applies in checks)
        parent_name = f"'{parent}'" if parent else "CAST(NULL AS VARCHAR)"
        rows.append(
            f"SELECT column_name, '{name}' AS type, {place} AS place, {parent_name} AS parent, ({done}) AS done, "
            f"CAST({total} AS DOUBLE) AS total, {gate} AS gate FROM cells GROUP BY column_name"
        )
        for column in columns:
            likeness = SequenceMatcher(None, column.lower(), name).ratio()
            boost = 0.1 if any(k in column.lower() for k in keywords) else 0.05 * likeness
            boosts.append(f"('{column}', '{name}', CAST({boost!r} AS DOUBLE))")
    a = "(2 * (1 - 0.9) / CAST(0.9 AS DOUBLE))"
    return f"""
    WITH cells AS ({_cells(source, columns)}),
    boosts(column_name, type, boost) AS (VALUES {", ".join(boosts)}),
    judged AS ({" UNION ALL ".join(rows)}),
    means AS (SELECT *, CASE WHEN done > 0 THEN total / done ELSE 0 END AS mean FROM judged WHERE gate),
    raw AS (SELECT *, CASE WHEN mean <= 0.3 THEN mean
                           ELSE pow(mean, 1 + done / 10.0) / (pow(mean, 1 + done / 10.0) + {a}) END AS raw FROM means),
    own AS (SELECT column_name, type, place, parent, (raw + boost) / (raw + boost + {a}) AS score
            FROM raw JOIN boosts USING (column_name, type) WHERE raw <> 0),
    candidates AS (SELECT o.column_name, o.type, o.place, o.parent, CASE WHEN o.parent IS NULL THEN 0 ELSE 1 END AS depth,
                          o.score + coalesce(p.score, 0) / 5 AS score
                   FROM own o LEFT JOIN own p ON p.column_name = o.column_name AND p.type = o.parent)"""


def _best(source: str, columns: dict[str, str], final: str, types: list = _TYPES) -> str:
    # Scores are compared to 12 places: sums in another order may differ past those.
    return f"""{_classified(source, columns, types)},
    ranked AS (SELECT *, row_number() OVER (
                   PARTITION BY column_name ORDER BY round(score, 12) DESC, depth DESC, place) AS n FROM candidates)
    SELECT {final} FROM ranked WHERE n = 1"""


_CUSTOMER = {
    "c_custkey": "number",
    "c_name": "text",
    "c_nationkey": "number",
    "c_acctbal": "number",
    "c_mktsegment": "text",
}
_ORDERS = {
    "o_orderkey": "number",
    "o_custkey": "number",
    "o_orderstatus": "text",
    "o_totalprice": "number",
    "o_orderdate": "moment",
    "o_orderpriority": "text",
}
_PART = {
    "p_partkey": "number",
    "p_name": "text",
    "p_brand": "text",
    "p_type": "text",
    "p_size": "number",
    "p_retailprice": "number",
}

ORACLES["detector_scores"] = (
    _classified("customer", _CUSTOMER) + " SELECT column_name, type, round(score, 6) AS score FROM candidates"
)
# A column of moments has no candidate at all.
ORACLES["column_types"] = (
    "SELECT * FROM ("
    + _best("orders", _ORDERS, "column_name, type, round(score, 6) AS score")
    + ") UNION ALL SELECT 'o_orderdate', NULL, NULL FROM (SELECT count(*) FROM orders)"
)
ORACLES["column_root_types"] = _best("part", _PART, "column_name, type, coalesce(parent, type) AS root")
ORACLES["column_types_sampled"] = _best(
    "(SELECT * FROM customer ORDER BY c_custkey LIMIT 100)",
    _CUSTOMER,
    "column_name, type, round(score, 6) AS score",
)
ORACLES["column_types_own"] = _best(
    "(SELECT lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zip, upper(c_mktsegment) AS segment, c_acctbal FROM customer)",
    {"zip": "text", "segment": "text", "c_acctbal": "number"},
    "column_name, type, round(score, 6) AS score",
    [
        *_TYPES,
        ("zipcode", _codes(_pattern(r"^\d{5}(-\d{4})?$", 1.0), _pattern(r"^\d{5}$", 1.2)), []),
        ("marketsegment", _words(_pattern("^[A-Z]+$", 2.0)), ["segment"]),
    ],
)
ORACLES["column_examples"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, string_agg(CAST({c} AS VARCHAR), ' | ' ORDER BY c_custkey) AS examples "
    "FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 3)"
    for c in _CUSTOMER
)

# Scalar functions

_A = "(2 * (1 - 0.9) / CAST(0.9 AS DOUBLE))"

ORACLES["normalize_numbers"] = f"""
    SELECT l_orderkey, l_linenumber,
           round(CASE WHEN l_discount <= 0 THEN 0 ELSE l_discount / (l_discount + {_A}) END, 6) AS discount,
           round(CASE WHEN l_quantity <= 25 THEN 0 ELSE (l_quantity - 25) / (l_quantity - 15) END, 6) AS quantity
    FROM lineitem"""
ORACLES["normalize_texts"] = r"""
    SELECT doc_id, CASE WHEN lang = 'fr' THEN ''
                        ELSE regexp_replace(lower(text), '^\s+|\s+$', '', 'g') END AS text FROM documents"""
ORACLES["normalize_number_lists"] = f"""
    WITH l AS (SELECT vec_id, list_filter(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda x: x >= 0) AS v
               FROM embeddings),
    e AS (SELECT vec_id, unnest(range(len(v))) AS place, unnest(v) AS x FROM l)
    SELECT vec_id, CAST(place AS INTEGER) AS place,
           round(CASE WHEN x <= 0 THEN 0 ELSE x / (x + {_A}) END, 6) AS value FROM e"""
ORACLES["normalize_text_lists"] = r"""
    WITH l AS (SELECT conv_id, turn, list_filter(string_split(text, '.'), lambda s: s <> '') AS v FROM conversations),
    e AS (SELECT conv_id, turn, unnest(range(len(v))) AS place, unnest(v) AS s FROM l)
    SELECT conv_id, turn, CAST(place AS INTEGER) AS place,
           regexp_replace(lower(s), '^\s+|\s+$', '', 'g') AS part FROM e"""
