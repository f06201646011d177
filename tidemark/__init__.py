"""tidemark: event-pattern matching on Spark.

Build a pattern from steps (``step``, ``lit``, ``>>``, ``|``, ``optional``,
``repeated``, ``one_or_more``, ``map``), then run it over a keyed, ordered
DataFrame: ``match_cut`` (one row per match), ``match_events`` (one status
row per event), ``match_whole`` (does each key's whole input match),
``match_chain`` (matches of one pattern as events of the next).  See the
README for the plans behind them.
"""

from tidemark.functions.pattern import alt, completed, fail, lit, seq, step
from tidemark.operators.matcher import (
    failure_summary, failures, match_chain, match_cut, match_events, match_whole, successes,
)

__all__ = [
    "alt", "completed", "fail", "lit", "seq", "step", "failure_summary", "failures",
    "match_chain", "match_cut", "match_events", "match_whole", "successes",
]
