"""Registered queries and their DuckDB twins.

``@query(name, views, sql)`` registers a function of (spark, sf_dir). The SQL
may name the stand-in views v_dict, v_records, ...; ``views`` lists those to be
put before it as common table expressions.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_RAW: dict[str, str] = {}
_MODULES = ("labels", "scoring", "subgroups", "checks", "serial", "populations", "feedback", "retrieval", "signals", "streams", "systems", "reports", "exports", "distances", "regions", "narratives", "changes", "beats", "documents")

_U = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_PK = "(record_id::VARCHAR || ':' || code_idx::VARCHAR)"
_RK = "(record_id::VARCHAR || ':' || label)"


def _clip(x: str) -> str:
    return f"least(greatest({x}, 0.000001::DOUBLE), 1.0::DOUBLE - 0.000001::DOUBLE)"


#: The stand-in views in DuckDB, in an order in which each may use those before it.
VIEWS = {
    "v_dict": "SELECT n_name AS code, n_nationkey AS code_idx, r_name AS superclass, n_nationkey % 5 <> 4 AS diagnostic, n_nationkey % 5 = 4 AS rhythm FROM nation JOIN region ON n_regionkey = r_regionkey",
    "v_records": """SELECT o_orderkey AS record_id, o_custkey AS patient_id, o_orderdate AS rec_ts, (1 + o_custkey % 10)::INT AS fold, (o_custkey % 2)::INT AS sex,
        CASE WHEN o_custkey % 50 = 0 THEN 300.0::DOUBLE WHEN o_custkey % 37 = 0 THEN NULL ELSE (15 + o_custkey % 75)::DOUBLE END AS age,
        CASE WHEN o_custkey % 97 = 0 THEN 'rare' || (o_custkey % 3)::VARCHAR ELSE c_mktsegment END AS device, c_nationkey AS site, o_totalprice AS measure
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_codes": """SELECT DISTINCT l_orderkey AS record_id, n_name AS code FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""",
    "v_two": f"""SELECT record_id, label, y, p, ln(p / (1 - p)) AS z, p2 FROM (SELECT record_id, label, y,
        {_clip(f"round(0.65::DOUBLE * {_U.format(_PK)} + 0.3::DOUBLE * y, 6)")} AS p,
        {_clip(f"round(0.7::DOUBLE * {_U.format("'b:' || " + _PK)} + 0.2::DOUBLE * y, 6)")} AS p2
        FROM (SELECT r.record_id, d.code AS label, d.code_idx, CASE WHEN c.code IS NULL THEN 0 ELSE 1 END AS y
              FROM v_records r CROSS JOIN v_dict d LEFT JOIN v_codes c ON c.record_id = r.record_id AND c.code = d.code))""",
    "v_pred": "SELECT record_id, label, y, p, z FROM v_two",
    "v_pairs": """SELECT * FROM (SELECT patient_id, record_id AS prior_id, lead(record_id) OVER w AS current_id, rec_ts AS prior_ts, lead(rec_ts) OVER w AS current_ts
        FROM v_records WINDOW w AS (PARTITION BY patient_id ORDER BY rec_ts, record_id)) WHERE current_id IS NOT NULL""",
    "v_obs": """SELECT *, 60000.0::DOUBLE / hr AS rr FROM (SELECT l_orderkey AS record_id, (40 + sum(l_quantity::BIGINT) % 100)::DOUBLE AS hr,
        CASE WHEN bool_or(l_returnflag = 'R') THEN 120 + 10.0::DOUBLE * sum(round(l_discount * 100)::BIGINT) / count(*) END AS pr,
        (60 + count(*) * 10)::DOUBLE AS qrs, (300 + sum(round(l_tax * 100)::BIGINT))::DOUBLE AS qt, bool_or(l_returnflag = 'R') AS p_detected FROM lineitem GROUP BY l_orderkey)""",
    "v_samples": """SELECT * FROM (SELECT vec_id AS record_id, 'I' AS lead, (unnest(range(len(embedding))))::INT AS t, unnest(embedding)::DOUBLE AS value FROM embeddings
        UNION ALL SELECT vec_id, 'II', ((unnest(range(len(embedding))) + 8) % 64)::INT, unnest(embedding)::DOUBLE FROM embeddings)""",
    "v_stream": "SELECT user_id AS source, ts::DATE AS hop, event_type AS code, max(value) AS value, max(value) >= 60 AS fired FROM events GROUP BY ALL",
    "v_ratings": f"""SELECT * FROM (WITH f AS (SELECT {_RK} AS finding_id, record_id, label, p AS confidence, p < 0.5 AS exploratory, y FROM v_pred
          WHERE p >= 0.5 OR (p >= 0.2 AND {_U.format("'x:' || " + _RK)} < 0.1)),
        g AS (SELECT finding_id, record_id, label, confidence, exploratory, CASE WHEN exploratory THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS sampling_rate,
          CASE WHEN record_id % 10 = 0 THEN 'uncertain' WHEN y = 1 THEN 'correct' ELSE 'incorrect' END AS verdict, 'r1' AS reviewer_id FROM f)
        SELECT * FROM g UNION ALL SELECT finding_id, record_id, label, confidence, exploratory, sampling_rate,
          CASE WHEN record_id % 3 = 0 THEN 'uncertain' ELSE verdict END, 'r2' FROM g WHERE record_id % 7 = 0)""",
    "v_missed": f"SELECT record_id, label, p AS confidence FROM v_pred WHERE y = 1 AND p < 0.5 AND {_U.format("'m:' || " + _RK)} < 0.2",
    "v_texts": """SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS id, text AS hypothesis, prev_text AS reference FROM (SELECT *, lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND prev_role = 'user'""",
    "v_calls": """SELECT o_orderpriority AS system, o_orderkey AS record_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'hosted' ELSE 'local' END AS hosting,
        CASE WHEN o_orderkey % 2 = 0 THEN 'model-a' ELSE 'model-b' END AS model, o_totalprice / 100000.0::DOUBLE AS latency_s, o_orderkey % 900 + 100 AS tokens_in,
        o_orderkey % 300 + 20 AS tokens_out, o_orderstatus <> 'P' AS ok FROM orders""",
}
_NEEDS = {
    "v_two": {"v_records", "v_dict", "v_codes"}, "v_pred": {"v_two"}, "v_pairs": {"v_records"}, "v_ratings": {"v_pred"}, "v_missed": {"v_pred"},
}


def with_views(sql: str) -> str:
    """``sql`` behind the views that it names."""
    need = {v for v in VIEWS if v in sql}
    while more := {n for v in need for n in _NEEDS.get(v, ())} - need:
        need |= more
    if not need:
        return sql
    ctes = ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in VIEWS if v in need)
    return f"WITH {ctes} SELECT * FROM ({sql})"


def query(name: str, sql: str | None = None):
    def register(f: Callable) -> Callable:
        _QUERIES[name] = f
        if sql is not None:
            _RAW[name] = sql
            _SQL[name] = with_views(sql)
        return f

    return register


def oracle_text(name: str) -> str:
    """The SQL of a query registered before, for use within another."""
    return _RAW[name]


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}_queries")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
