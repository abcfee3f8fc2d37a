"""Queries of the roster analytics operators on the given tables, with their SQL twins.

The tables are not sports data, so each operator runs with its columns mapped: customers are players, nations are
schools, order years are seasons, line items are events, and so on.
"""

from __future__ import annotations

from lineup.plans import aggregate_queries, destination_queries, fit_queries, fits_queries, flow_queries, growing_queries, identity_queries, join_queries, learn_queries, model_queries, more_queries, opportunity_queries, playing_queries, scalar_queries, state_queries, stream_queries, success_queries, window_queries

FLAGSHIP = "C06_fit_calibration"
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (window_queries, scalar_queries, join_queries, aggregate_queries, model_queries, more_queries, fit_queries, growing_queries, playing_queries, identity_queries, state_queries, fits_queries, learn_queries, flow_queries, opportunity_queries, success_queries, destination_queries, stream_queries):
    QUERIES |= _module.R.queries
    SQL |= _module.R.sql
