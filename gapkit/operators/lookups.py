"""Value corrections from condition lists and lookup tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def first_match(rules: Sequence[tuple[Column, object]], default: Column) -> Column:
    """Value of the first rule that holds, else the default."""
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, value if isinstance(value, Column) else F.lit(value))
    return chain.otherwise(default) if rules else default


def map_or_self(value: Column, mapping: Mapping[str, str]) -> Column:
    """Dictionary lookup that keeps values it does not know. For literal dictionaries only."""
    if not mapping:
        return value
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), value)


def lookup_or_self(df: DataFrame, column: str, table: DataFrame, key: str, new: str) -> DataFrame:
    """As :func:`map_or_self` with a table of corrections; its keys are unique."""
    side = table.select(F.col(key).alias(column), F.col(new).alias("__new"))
    joined = df.join(side, column, "left")
    return joined.withColumn(column, F.coalesce("__new", column)).select(*df.columns)


def correct_place(
    df: DataFrame, corrections: DataFrame, target: str = "venue", first: str = "state",
    second: str = "city", out: str | None = None,
) -> DataFrame:
    """Replace ``target`` by the rule for (target, first), else for (target, second), else keep it.

    ``corrections`` has ``target``, ``first``, ``second`` and ``new_<target>``; a rule fills one of the two
    qualifiers. Several rules for one pair would repeat rows, so they are folded to one.
    """
    new = f"new_{target}"

    def side(qualifier: str, name: str) -> DataFrame:
        rules = corrections.where(F.col(qualifier).isNotNull())
        return rules.groupBy(target, qualifier).agg(F.min(new).alias(name))

    joined = df.join(side(first, "__n1"), [target, first], "left").join(
        side(second, "__n2"), [target, second], "left"
    )
    out = out or target
    columns = df.columns if out in df.columns else [*df.columns, out]
    return joined.withColumn(out, F.coalesce("__n1", "__n2", target)).select(*columns)


def override_keys(
    df: DataFrame, overrides: DataFrame, keys: Sequence[str], target: str, tombstone: str = "NODATA"
) -> DataFrame:
    """Take ``target`` from the override row of the same keys; tombstoned rows are left out."""
    side = overrides.select(*keys, F.col(target).alias("__override"))
    joined = df.join(side, list(keys), "left").withColumn(target, F.coalesce("__override", target))
    return joined.where(~F.col(target).eqNullSafe(tombstone)).select(*df.columns)


def point_lookup(df: DataFrame, dimension: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Dimension columns of each row's key, null when the key is unknown."""
    return df.join(dimension.select(key, *columns), key, "left")


# Corrections of the venue and city of one source. Fixed values.
VENUE_RULES = (
    # venue, qualifier, qualifier value, corrected venue
    ("ADAMS CENTER", "state", "MT", "ADAMS FIELDHOUSE, UNIVERSITY OF MONTANA"),
    ("AUDITORIUM THEATRE", "city", "CHICAGO", "AUDITORIUM THEATER, ROOSEVELT UNIVERSITY"),
    ("BAYFRONT ARENA", "state", "FL", "BAYFRONT AUDITORIUM"),
    ("FLEET PAVILION", "city", "BOSTON", "CAESAR'S TAHOE"),
    ("CAESAR'S TAHOE SHOWROOM", "state", "NV", "CAESAR'S TAHOE"),
)
CITY_BY_VENUE = (
    # venue, state if it matters, corrected city
    ("23 EAST CABARET", "PA", "PHILADELPHIA"),
    ("CAESAR'S TAHOE", None, "LAKE TAHOE"),
    ("CYNTHIA WOODS MITCHELL PAVILLION", None, "THE WOODLANDS"),
)
CITY_BY_CITY = {
    "N. LITTLE ROCK": "LITTLE ROCK",
    "NORTH LITTLE ROCK": "LITTLE ROCK",
    "MT. CRESTED BUTTE": "CRESTED BUTTE",
    "SNOWMASS VILLAGE": "SNOWMASS",
    "ELON COLLEGE": "ELON",
    "N. MYRTLE BEACH": "MYRTLE BEACH",
}


def venue_rules() -> list[tuple[Column, str]]:
    return [
        ((F.col("venue") == venue) & (F.col(qualifier) == value), new)
        for venue, qualifier, value, new in VENUE_RULES
    ]


def city_rules() -> list[tuple[Column, str]]:
    """City rules look at the venue as it was before venue rules."""
    by_venue = [
        ((F.col("venue") == venue) & (F.lit(True) if state is None else F.col("state") == state), new)
        for venue, state, new in CITY_BY_VENUE
    ]
    return by_venue + [(F.col("city") == old, new) for old, new in CITY_BY_CITY.items()]


def correct_venue_and_city(df: DataFrame) -> DataFrame:
    """Both corrections read the original columns."""
    return df.withColumns({
        "venue": first_match(venue_rules(), F.col("venue")),
        "city": first_match(city_rules(), F.col("city")),
    })
