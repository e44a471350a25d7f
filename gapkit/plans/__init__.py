"""Composite plans: history, rankings, reports, calendars and text parsing."""
