"""Spark-native tick, bar, indicator, label and signal-backtest library."""

from barloom.session import materialize, prepare_session, work_scope

__all__ = ["materialize", "prepare_session", "work_scope"]
