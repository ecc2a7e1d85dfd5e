"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from . import benchmark_queries, frame_queries, gate_queries, inference_queries, interval_queries, model_queries, quality_queries, repair_queries, report_queries, study_queries, tuning_queries

MODULES = (benchmark_queries, interval_queries, frame_queries, gate_queries, inference_queries, quality_queries, model_queries, repair_queries, report_queries, study_queries, tuning_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
