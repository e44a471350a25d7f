"""The library's operators run over the driver tables, each with its SQL twin."""

from importlib import import_module

MODULES = ("q_rankings", "q_windows", "q_relational", "q_text", "q_incremental")


def load_all() -> None:
    for module in MODULES:
        import_module(f"driver_queries.{module}")
