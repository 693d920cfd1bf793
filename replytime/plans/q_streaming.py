"""Streaming query: the per-trust daily tally of returns, built incrementally."""

from __future__ import annotations

from ..sources.fixture import inpatient_path
from ..sources.scan import scratch_path
from ..streaming.returns import read_daily_returns, run_daily_returns
from .oracle_base import with_derived
from .registry import query


@query("stream_daily_returns", sql=with_derived(
    "SELECT trustcode, date_rec AS day, count(*) AS returns FROM d "
    "WHERE outcome = 'Returned useable questionnaire' AND date_rec IS NOT NULL GROUP BY trustcode, date_rec"))
def stream_daily_returns(spark, sf_dir):
    """Usable returns per trust and day, tallied by a streaming query over the wave's files."""
    src = inpatient_path(spark, sf_dir)
    sink = scratch_path(spark, "daily-returns")
    run_daily_returns(spark, src, sink, scratch_path(spark, "daily-returns-ckpt"))
    return read_daily_returns(spark, sink)
