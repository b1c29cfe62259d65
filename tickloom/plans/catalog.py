"""Every query of the analytics engine with its DuckDB counterpart."""

from tickloom.plans import baseline, imf, imf_post, jobs, leaderboard, learning, metrics, regime, rules, timeseries

_PARTS = (leaderboard, timeseries, metrics, baseline, regime, rules, imf_post, imf, learning, jobs)
QUERIES: dict = {}
SQL: dict = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
