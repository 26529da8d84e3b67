"""Capacity and staffing what-ifs, and schedules by week.

Week figures of a whole backlog depend on the number of patients only, whatever their
order: position p falls into week ceil(p / capacity) for p = 1..n. So every what-if below
is one aggregate over the patients followed by arithmetic per scenario, and only the
per-patient schedules rank anybody.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carequeue.functions import fixed_values as V
from carequeue.functions.exact import mean
from carequeue.functions.scoring import combined_score
from carequeue.operators.rank import rank_rows
from carequeue.schema import has_staffing


class Scenario(NamedTuple):
    scenario_id: int
    baseline_capacity: int = V.DEFAULT_BASELINE
    uplift_percentage: int = 20


DEFAULT_SCENARIOS = (Scenario(1),)
#: Weeks that one row of a block stands for before it is spread out.
WEEKS_IN_BLOCK = 1000


def _new_capacity(baseline: Column, uplift: Column) -> Column:
    # truncated in doubles: 100 at 15% is 114
    return (baseline * (F.lit(1) + uplift / 100)).try_cast("long")


def _over_scenarios(
    df: DataFrame, scenarios: Sequence[Scenario], by: Sequence[str], *aggregates: Column
) -> DataFrame:
    """One row per group and scenario with its capacities and the group's aggregates."""
    for s in scenarios:
        if s.baseline_capacity < 1 or s.uplift_percentage < 0:
            raise ValueError(f"capacity must be positive and uplift not negative: {s}")
    rows = F.array(
        *[F.struct(*[F.lit(v).alias(k) for k, v in s._asdict().items()]) for s in scenarios]
    )
    return (
        df.groupBy(*by)
        .agg(F.count("*").alias("total_patients"), *aggregates)
        .select("*", F.inline(rows))
        .withColumn(
            "new_capacity", _new_capacity(F.col("baseline_capacity"), F.col("uplift_percentage"))
        )
        .withColumn("additional_capacity", F.col("new_capacity") - F.col("baseline_capacity"))
    )


def _weeks(total: str, capacity: str) -> Column:
    return F.expr(f"{total} div {capacity} + if({total} % {capacity} > 0, 1, 0)")


def _sum_of_weeks(total: str, capacity: str) -> Column:
    """Sum over all positions of their week, in doubles."""
    full = F.expr(f"{total} div {capacity}").cast("double")
    rest = F.expr(f"{total} % {capacity}").cast("double")
    return F.col(capacity) * full * (full + 1) / 2 + rest * (full + 1)


def _moved_earlier() -> Column:
    """Patients whose week under the new capacity is before their baseline week.

    Of the full baseline week j = 0, 1, ... the first j x additional places move, at most
    the whole week; the last, partly filled week follows the same rule.
    """
    full = "(total_patients div baseline_capacity)"
    # weeks before the first that moves as a whole
    ramp = (
        f"least({full}, (baseline_capacity + additional_capacity - 1) div additional_capacity)"
    )
    moved = F.expr(
        f"additional_capacity * ({ramp} * ({ramp} - 1) div 2)"
        f" + baseline_capacity * ({full} - {ramp})"
        f" + least(total_patients % baseline_capacity, {full} * additional_capacity)"
    )
    return F.when(F.col("additional_capacity") > 0, moved).otherwise(F.lit(0)).cast("long")


def _moved_places() -> Column:
    """Places gained week by week over the baseline, counted from the patients left."""
    full = "(total_patients div new_capacity)"
    rest = "(total_patients % new_capacity)"
    return F.expr(
        f"{full} * additional_capacity + greatest(0, {rest}"
        f" - least(baseline_capacity, total_patients - {full} * baseline_capacity))"
    ).cast("long")


def _staff_cost(doctors: Column, nurses: Column) -> Column:
    return doctors * V.DOCTOR_SALARY + nurses * V.NURSE_SALARY


def capacity_impact(
    df: DataFrame,
    scenarios: Sequence[Scenario] = DEFAULT_SCENARIOS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Weeks and staff needed before and after a capacity uplift, one row per scenario."""
    staffing = has_staffing(df)
    aggregates = (
        [
            mean("doctors_fte").alias("current_doctors"),
            mean("nurses_fte").alias("current_nurses"),
            F.coalesce(F.sum("planned_count"), F.lit(0)).alias("planned"),
        ]
        if staffing
        else []
    )
    rows = _over_scenarios(df, scenarios, by, *aggregates).withColumns(
        {
            "baseline_weeks": _weeks("total_patients", "baseline_capacity"),
            "new_weeks": _weeks("total_patients", "new_capacity"),
            "patients_moved_earlier": _moved_earlier(),
            "avg_weeks_saved": F.when(F.col("total_patients") == 0, 0.0).otherwise(
                (
                    _sum_of_weeks("total_patients", "baseline_capacity")
                    - _sum_of_weeks("total_patients", "new_capacity")
                )
                / F.col("total_patients")
            ),
        }
    )
    columns = [
        *by,
        "scenario_id",
        "total_patients",
        "baseline_capacity",
        "new_capacity",
        "additional_capacity",
        "baseline_weeks",
        "new_weeks",
        (F.col("baseline_weeks") - F.col("new_weeks")).alias("weeks_saved"),
        "patients_moved_earlier",
        "avg_weeks_saved",
    ]
    if not staffing:
        return rows.select(*columns)

    def ratio(staff: str, default: float) -> Column:
        heads = F.col(staff)
        return F.when(heads > 0, F.col("planned") / heads).otherwise(F.lit(default))

    rows = rows.withColumns(
        {
            "patients_per_doctor": ratio("current_doctors", 50.0),
            "patients_per_nurse": ratio("current_nurses", 25.0),
        }
    )
    add, per_doctor = F.col("additional_capacity"), F.col("patients_per_doctor")
    per_nurse = F.col("patients_per_nurse")

    def needed(places: Column, per_head: Column) -> Column:
        return F.when(per_head != 0, places / per_head)

    rows = rows.withColumns(
        {
            "additional_doctors_needed": needed(add, per_doctor),
            "additional_nurses_needed": needed(add, per_nurse),
            "mixed_scenario_doctors": needed(add * 0.6, per_doctor),
            "mixed_scenario_nurses": needed(add * 0.4, per_nurse),
        }
    )
    none = F.lit(0)
    return rows.select(
        *columns,
        "current_doctors",
        "current_nurses",
        "patients_per_doctor",
        "patients_per_nurse",
        "additional_doctors_needed",
        "additional_nurses_needed",
        "mixed_scenario_doctors",
        "mixed_scenario_nurses",
        _staff_cost(F.col("additional_doctors_needed"), none).alias("cost_doctors_only"),
        _staff_cost(none, F.col("additional_nurses_needed")).alias("cost_nurses_only"),
        _staff_cost(F.col("mixed_scenario_doctors"), F.col("mixed_scenario_nurses")).alias(
            "cost_mixed_scenario"
        ),
    )


def _week_rows(rows: DataFrame, weeks: Column, max_weeks: int | None) -> DataFrame:
    """A row for each week up to the last. Blocks of weeks are dealt out before they are
    spread, so that a long horizon does not come from one task."""
    last = weeks if max_weeks is None else F.least(weeks, F.lit(max_weeks))
    rows = rows.withColumn("_last", F.greatest(last, F.lit(0)).cast("int"))
    blocks = F.sequence(F.lit(0), F.expr(f"(_last - 1) div {WEEKS_IN_BLOCK}").cast("int"))
    dealt = (
        rows.where("_last > 0")
        .withColumn("_block", F.explode(blocks))
        .repartition("_block", *[f"`{c}`" for c in rows.columns])
    )
    first = F.col("_block") * WEEKS_IN_BLOCK
    numbers = F.sequence(first + 1, F.least(first + WEEKS_IN_BLOCK, F.col("_last")))
    return dealt.withColumn("week", F.explode(numbers)).drop("_last", "_block")


def _left_after(capacity: str) -> Column:
    return F.greatest(
        F.lit(0).cast("long"), F.col("total_patients") - F.col("week") * F.col(capacity)
    )


def weekly_backlog(
    df: DataFrame,
    scenarios: Sequence[Scenario] = DEFAULT_SCENARIOS,
    by: Sequence[str] = (),
    max_weeks: int | None = None,
) -> DataFrame:
    """Patients still waiting after each week, before and after the uplift.

    All weeks until the backlog is cleared; ``max_weeks`` shortens what is shown.
    """
    rows = _over_scenarios(df, scenarios, by)
    weeks = _weeks("total_patients", "baseline_capacity")
    return _week_rows(rows, weeks, max_weeks).select(
        *by,
        "scenario_id",
        "week",
        _left_after("baseline_capacity").alias("baseline_backlog"),
        _left_after("new_capacity").alias("new_backlog"),
    )


def backlog_timeline(
    df: DataFrame,
    scenarios: Sequence[Scenario] = DEFAULT_SCENARIOS,
    by: Sequence[str] = (),
    max_weeks: int | None = None,
) -> DataFrame:
    """As the weekly backlog, up to five weeks past clearance."""
    rows = _over_scenarios(df, scenarios, by)
    weeks = _weeks("total_patients", "baseline_capacity") + 5
    return _week_rows(rows, weeks, max_weeks).select(
        *by,
        "scenario_id",
        "week",
        _left_after("baseline_capacity").alias("current_remaining"),
        _left_after("new_capacity").alias("new_remaining"),
    )


def capacity_answer_columns(rows: DataFrame) -> DataFrame:
    """Answer figures for rows with total_patients, baseline_capacity, uplift_percentage."""
    rows = (
        rows.withColumn(
            "new_capacity", _new_capacity(F.col("baseline_capacity"), F.col("uplift_percentage"))
        )
        .withColumn("additional_capacity", F.col("new_capacity") - F.col("baseline_capacity"))
        .withColumns(
            {
                "baseline_weeks": _weeks("total_patients", "baseline_capacity"),
                "new_weeks": _weeks("total_patients", "new_capacity"),
                "patients_moved_earlier": _moved_places(),
            }
        )
    )
    base, add = F.col("baseline_capacity"), F.col("additional_capacity")
    saved = F.col("baseline_weeks") - F.col("new_weeks")
    doctors, nurses = add / V.PATIENTS_PER_DOCTOR, add / V.PATIENTS_PER_NURSE
    mixed_doctors = add / (V.PATIENTS_PER_DOCTOR * 1.2)
    mixed_nurses = add / (V.PATIENTS_PER_NURSE * 0.8)
    none = F.lit(0)
    return rows.withColumns(
        {
            "weeks_saved": saved,
            "efficiency_gain": F.when(
                F.col("baseline_weeks") > 0, F.bround(saved / F.col("baseline_weeks") * 100, 1)
            ).otherwise(F.lit(0.0)),
            "current_doctors": F.bround(base / V.PATIENTS_PER_DOCTOR, 1),
            "current_nurses": F.bround(base / V.PATIENTS_PER_NURSE, 1),
            "patients_per_doctor": F.lit(V.PATIENTS_PER_DOCTOR),
            "patients_per_nurse": F.lit(V.PATIENTS_PER_NURSE),
            "additional_doctors_needed": F.bround(doctors, 1),
            "additional_nurses_needed": F.bround(nurses, 1),
            "mixed_doctors": F.bround(mixed_doctors, 1),
            "mixed_nurses": F.bround(mixed_nurses, 1),
            "cost_doctors_only": F.bround(_staff_cost(doctors, none), 0),
            "cost_nurses_only": F.bround(_staff_cost(none, nurses), 0),
            "cost_mixed": F.bround(_staff_cost(mixed_doctors, mixed_nurses), 0),
        }
    )


def capacity_answer(
    df: DataFrame,
    scenarios: Sequence[Scenario] = DEFAULT_SCENARIOS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Uplift figures with fixed staffing ratios, as given in answers to questions."""
    rows = _over_scenarios(df, scenarios, by).drop("new_capacity", "additional_capacity")
    return capacity_answer_columns(rows)


def _heads(places: Column, per_head: float) -> Column:
    return F.ceil(places / per_head)


def _with_mixed_team(rows: DataFrame) -> DataFrame:
    """Whole heads of the later staffing rules, with the yearly cost of a mixed team."""
    add = F.col("additional_capacity")
    rows = rows.withColumns(
        {
            "doctors_only": _heads(add, V.PATIENTS_PER_DOCTOR),
            "nurses_only": _heads(add, V.PATIENTS_PER_NURSE * 0.8),
            "mixed_doctors": F.greatest(F.lit(1), _heads(add, V.PATIENTS_PER_DOCTOR * 1.5)),
            "mixed_nurses": F.greatest(F.lit(2), _heads(add, V.PATIENTS_PER_NURSE * 1.2)),
        }
    )
    return rows.withColumn(
        "cost_mixed", _staff_cost(F.col("mixed_doctors"), F.col("mixed_nurses"))
    )


def _with_mixed_team_v1(rows: DataFrame) -> DataFrame:
    add = F.col("additional_capacity")
    rows = rows.withColumns(
        {
            "doctors_only": _heads(add, V.PATIENTS_PER_DOCTOR),
            "nurses_only": _heads(add, V.PATIENTS_PER_NURSE),
            "mixed_doctors": _heads(add, V.PATIENTS_PER_DOCTOR * 1.2),
            "mixed_nurses": _heads(add, V.PATIENTS_PER_NURSE * 0.8),
        }
    )
    return rows.withColumn(
        "cost_mixed", _staff_cost(F.col("mixed_doctors"), F.col("mixed_nurses"))
    )


def _option_rows(rows: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Three alternatives per row: doctors only, nurses only and a mixed team."""
    none = F.lit(0).cast("long")
    heads = [
        (F.col("doctors_only"), none),
        (none, F.col("nurses_only")),
        (F.col("mixed_doctors"), F.col("mixed_nurses")),
    ]
    options = F.array(
        *[
            F.struct(
                F.lit(name).alias("approach"),
                doctors.alias("doctors_added"),
                nurses.alias("nurses_added"),
                _staff_cost(doctors, nurses).alias("annual_cost"),
            )
            for name, (doctors, nurses) in zip(names, heads)
        ]
    )
    return rows.select(*keep, F.inline(options)).withColumn(
        "monthly_cost", F.col("annual_cost") / 12
    )


def _mean_staff(df: DataFrame) -> list[Column]:
    if not {"doctors_fte", "nurses_fte"} <= set(df.columns):
        nothing = F.lit(None).cast("double")
        return [F.first(nothing).alias("mean_doctors"), F.first(nothing).alias("mean_nurses")]
    return [mean("doctors_fte").alias("mean_doctors"), mean("nurses_fte").alias("mean_nurses")]


def staffing_options_v1(
    df: DataFrame,
    scenarios: Sequence[Scenario] = DEFAULT_SCENARIOS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Staffing alternatives by the earlier rules; current need from rows per mean FTE."""

    def need(mean: str, default: int) -> Column:
        per_head = F.when(F.col(mean) > 0, F.col("total_patients") / F.col(mean)).otherwise(
            F.lit(float(default))
        )
        return F.ceil(F.col("baseline_capacity") / per_head)

    rows = _with_mixed_team_v1(_over_scenarios(df, scenarios, by, *_mean_staff(df))).withColumns(
        {
            "current_doctors_needed": need("mean_doctors", V.PATIENTS_PER_DOCTOR),
            "current_nurses_needed": need("mean_nurses", V.PATIENTS_PER_NURSE),
        }
    )
    rows = rows.withColumns(
        {
            "total_doctors_needed": F.col("current_doctors_needed") + F.col("doctors_only"),
            "total_nurses_needed": F.col("current_nurses_needed") + F.col("nurses_only"),
            "actual_doctors": F.bround("mean_doctors", 0).cast("long"),
            "actual_nurses": F.bround("mean_nurses", 0).cast("long"),
        }
    )
    names = ["Doctors Only", "Nurses Only", "Mixed Approach (Recommended)"]
    keep = [
        *by,
        "scenario_id",
        "additional_capacity",
        "current_doctors_needed",
        "current_nurses_needed",
        "total_doctors_needed",
        "total_nurses_needed",
        "actual_doctors",
        "actual_nurses",
    ]
    return _option_rows(rows, names, keep)


def staffing_options(
    df: DataFrame,
    scenarios: Sequence[Scenario] = DEFAULT_SCENARIOS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Staffing alternatives by the later rules; current need from fixed ratios."""
    base, add = F.col("baseline_capacity"), F.col("additional_capacity")
    rows = _with_mixed_team(_over_scenarios(df, scenarios, by, *_mean_staff(df))).withColumns(
        {
            "current_doctors_needed": _heads(base, V.PATIENTS_PER_DOCTOR),
            "current_nurses_needed": _heads(base, V.PATIENTS_PER_NURSE),
        }
    )

    def actual(mean: str, need: str) -> Column:
        return F.coalesce(F.bround(mean, 0).cast("long"), F.col(need))

    rows = rows.withColumns(
        {
            "total_doctors_needed": F.col("current_doctors_needed")
            + _heads(add, V.PATIENTS_PER_DOCTOR),
            "total_nurses_needed": F.col("current_nurses_needed")
            + _heads(add, V.PATIENTS_PER_NURSE),
            "actual_doctors": actual("mean_doctors", "current_doctors_needed"),
            "actual_nurses": actual("mean_nurses", "current_nurses_needed"),
        }
    )
    names = ["Doctors Only", "Nurses Only", "Mixed Team (Recommended)"]
    keep = [
        *by,
        "scenario_id",
        "additional_capacity",
        "current_doctors_needed",
        "current_nurses_needed",
        "total_doctors_needed",
        "total_nurses_needed",
        "actual_doctors",
        "actual_nurses",
    ]
    return _option_rows(rows, names, keep)


def capacity_roi(
    df: DataFrame,
    scenarios: Sequence[Scenario] = DEFAULT_SCENARIOS,
    by: Sequence[str] = (),
    earlier_rules: bool = False,
) -> DataFrame:
    """Revenue of the added places less the mixed team; no payback while net is not positive."""
    rows = _over_scenarios(df, scenarios, by, mean("cost_estimate").alias("avg_cost"))
    rows = (_with_mixed_team_v1 if earlier_rules else _with_mixed_team)(rows)
    added, cost = F.col("additional_capacity"), F.col("cost_mixed")
    rows = rows.withColumns(
        {
            "monthly_revenue": added * 4 * F.col("avg_cost"),
            "annual_revenue": added * 52 * F.col("avg_cost"),
            "annual_staff_cost": cost,
            "monthly_staff_cost": cost / 12,
        }
    ).withColumns(
        {
            "monthly_net_benefit": F.col("monthly_revenue") - F.col("monthly_staff_cost"),
            "annual_net_benefit": F.col("annual_revenue") - F.col("annual_staff_cost"),
        }
    )
    net = F.col("monthly_net_benefit")
    return rows.select(
        *by,
        "scenario_id",
        "additional_capacity",
        "avg_cost",
        "monthly_revenue",
        "annual_revenue",
        "annual_staff_cost",
        "monthly_staff_cost",
        "monthly_net_benefit",
        "annual_net_benefit",
        F.when(net > 0, cost / net).alias("payback_months"),
    )


# -- per-patient schedules -----------------------------------------------------------


def _week_of(position: Column, capacity: int) -> Column:
    return F.ceil(position / capacity)


def queue_positions(df: DataFrame) -> DataFrame:
    """Positions by priority, then by days waited, then by id."""
    return rank_rows(
        df,
        F.desc_nulls_last("priority_score"),
        F.desc_nulls_last("wait_days"),
        F.asc("patient_id"),
    )


def capacity_schedule(df: DataFrame, scenario: Scenario = Scenario(1)) -> DataFrame:
    """Treatment week of every patient at the baseline and at the raised capacity."""
    new = int(scenario.baseline_capacity * (1 + scenario.uplift_percentage / 100))
    position = F.col("queue_position")
    return queue_positions(df).withColumns(
        {
            "baseline_week": _week_of(position, scenario.baseline_capacity),
            "new_week": _week_of(position, new),
        }
    )


def optimize_schedule(
    df: DataFrame, weekly_capacity: int = V.DEFAULT_BASELINE, risk_weight: float = 0.3
) -> DataFrame:
    """Weeks by a blend of priority and readmission risk, then by days waited."""
    ranked = rank_rows(
        df.withColumn("combined_score", combined_score(risk_weight)),
        F.desc_nulls_last("combined_score"),
        F.desc_nulls_last("wait_days"),
        F.asc("patient_id"),
    )
    return ranked.withColumn("scheduled_week", _week_of(F.col("queue_position"), weekly_capacity))
