"""What a ranking needs to know about a source: tables, keys and policies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame

REPEAT_POLICIES = ("flag_after", "dedupe_before")
LAST_SEQ_POLICIES = ("max", "max_minus_one", "max_played", "last_past")
FLAG_SOURCES = (None, "item", "play")

# An item has at most this many distinct sequence numbers per window group.
SEQ_BUCKET = 65536


@dataclass(frozen=True)
class Bundle:
    """The tables of one source; optional ones may be absent.

    plays      occasion_id, item_id, position, is_repeat?, is_original? + anything else
    occasions  occasion_id, occ_seq, occ_date, exclude_from_stats?, venue_id? + anything else
    items      item_id, item, is_original?
    """

    plays: DataFrame
    occasions: DataFrame
    items: DataFrame | None = None
    venues: DataFrame | None = None
    tours: DataFrame | None = None
    transitions: DataFrame | None = None


@dataclass(frozen=True)
class GapSpec:
    """Policies of the history and the two rankings.

    ``min_plays``, ``active_days``, ``window_days``, ``min_current_gap`` and ``seq_offset`` may be
    columns of a policy table, see :func:`gapkit.plans.rankings.rank_groups`.
    """

    name: str
    group: tuple[str, ...] = ()
    repeat_policy: str = "dedupe_before"
    last_seq: str = "max"
    flag_source: str | None = None
    by_item_name: bool = False
    originals_only: bool = False
    exclude_flagged: bool = False
    title_case: bool = False
    history_blacklist: tuple[str, ...] = ()
    result_blacklist: tuple[str, ...] = ()
    min_plays: int | Column = 10
    active_days: int | Column | None = 5 * 365
    window_days: int | Column = 366
    min_current_gap: int | Column = 3
    # Sequence numbers rise with the date, so plays before a cut-off date precede all later ones.
    seq_follows_date: bool = True
    # Upper bound of the sequence numbers when known; lets short calendars use one window per item.
    seq_span: int | None = None
    rotation_date_format: str | None = None

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a spec needs a name")
        if self.repeat_policy not in REPEAT_POLICIES:
            raise ValueError(f"repeat_policy must be one of {REPEAT_POLICIES}: {self.repeat_policy!r}")
        if self.last_seq not in LAST_SEQ_POLICIES:
            raise ValueError(f"last_seq must be one of {LAST_SEQ_POLICIES}: {self.last_seq!r}")
        if self.flag_source not in FLAG_SOURCES:
            raise ValueError(f"flag_source must be one of {FLAG_SOURCES}: {self.flag_source!r}")
        if self.originals_only and self.flag_source is None:
            raise ValueError("originals_only needs a flag_source")

    def with_options(self, **changes) -> "GapSpec":
        return replace(self, **changes)

    def check(self, bundle: Bundle) -> None:
        """Fail early when a needed table or column is missing."""
        _require(bundle.plays, "plays", {"occasion_id", "item_id", *self.group})
        _require(bundle.occasions, "occasions", {"occasion_id", "occ_seq", "occ_date", *self.group})
        if self.repeat_policy == "flag_after":
            _require(bundle.plays, "plays", {"is_repeat", "position"})
        if self.flag_source == "play":
            _require(bundle.plays, "plays", {"is_original"})
        if self.by_item_name or self.flag_source == "item":
            wanted = {"item_id", "item"} | ({"is_original"} if self.flag_source == "item" else set())
            _require(bundle.items, "items", wanted)


def _require(table: DataFrame | None, name: str, columns: set[str]) -> None:
    if table is None:
        raise ValueError(f"table {name!r} must be loaded first")
    missing = sorted(columns - set(table.columns))
    if missing:
        raise ValueError(f"table {name!r} lacks columns {missing}")


# Policies of the four known source layouts. Fixed values.
PRESETS: dict[str, GapSpec] = {
    "keyed_with_repeats": GapSpec(
        name="keyed_with_repeats", repeat_policy="flag_after", last_seq="max_minus_one",
        flag_source="item", by_item_name=True, originals_only=True, active_days=None,
    ),
    "keyed_with_exclusions": GapSpec(
        name="keyed_with_exclusions", repeat_policy="flag_after", last_seq="max_minus_one",
        flag_source="play", by_item_name=True, originals_only=True, exclude_flagged=True,
    ),
    # its occasions are the days with plays, so the last of them is the last played one
    "named_by_date": GapSpec(name="named_by_date", seq_span=SEQ_BUCKET),
    "named_by_link": GapSpec(
        name="named_by_link", title_case=True, history_blacklist=("Jam",),
        result_blacklist=("Drums",), window_days=732, rotation_date_format="MM/dd/yy",
        # undated occasions keep their place in the sequence
        seq_follows_date=False,
    ),
}


@dataclass
class Registry:
    """Sources to run together: a spec and a function that loads its tables."""

    entries: dict[str, tuple[GapSpec, Callable[..., Bundle]]] = field(default_factory=dict)

    def add(self, spec: GapSpec, loader: Callable[..., Bundle]) -> None:
        if not isinstance(spec, GapSpec):
            raise TypeError(f"expected a GapSpec, got {type(spec).__name__}")
        if not callable(loader):
            raise TypeError("the loader must be callable")
        self.entries[spec.name] = (spec, loader)


_REGISTRY = Registry()


def register(spec: GapSpec, loader: Callable[..., Bundle]) -> None:
    _REGISTRY.add(spec, loader)


def registered() -> dict[str, tuple[GapSpec, Callable[..., Bundle]]]:
    return dict(_REGISTRY.entries)


def as_day(value: date | str) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)
