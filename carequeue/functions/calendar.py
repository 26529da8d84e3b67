"""Seasons of dates and their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carequeue.functions.fixed_values import SEASONS


def season_of_date(date: str) -> Column:
    """Season of a date column: December to February is winter, and so on by quarters."""
    return F.expr(
        f"""case when month({date}) in (12, 1, 2) then '{SEASONS[0]}'
            when month({date}) <= 5 then '{SEASONS[1]}'
            when month({date}) <= 8 then '{SEASONS[2]}'
            when month({date}) <= 11 then '{SEASONS[3]}' end"""
    )


def previous_season(season: Column) -> Column:
    names = F.array(*[F.lit(s) for s in SEASONS])
    at = F.array_position(names, season).cast("int")
    return F.when(at > 0, F.element_at(names, F.pmod(at - 2, F.lit(len(SEASONS))) + 1))
