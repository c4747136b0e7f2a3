"""All registered queries of the engine, gathered from the plan modules."""

from __future__ import annotations

from tidewright.plans import evaluation_q, evidence_q, folds_q, gates_q, intervals_q, joins_q, lines_q, metrics_q, planning_q, recovery_q, routing_q, sequences_q, sources_q, text_q, timing_q

MODULES = [evaluation_q, evidence_q, folds_q, gates_q, intervals_q, joins_q, lines_q, metrics_q, planning_q, recovery_q, routing_q, sequences_q, sources_q, text_q, timing_q]


def queries() -> dict:
    return {k: q for m in MODULES for k, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: sql for m in MODULES for k, (_, sql) in m.QUERIES.items() if sql}
