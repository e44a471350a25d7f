"""gapkit: recurrence-gap analytics on Spark DataFrames."""

from gapkit.spec import Bundle, GapSpec, PRESETS, register, registered

__all__ = ["Bundle", "GapSpec", "PRESETS", "register", "registered"]
