"""The SQL each registered query is checked against, in the DuckDB dialect.

Written from the meaning of each result, row by row over the tables, without the
shortcuts the Spark side takes: ranks are plain windows, weeks are counted per patient,
and questions are paired with patients.
"""

from __future__ import annotations

import re

from carequeue.functions import fixed_values as V
from carequeue.operators.lookup import SUGGESTIONS_SHOWN
from carequeue.operators.sampling import MULTIPLIER, PRIME
from carequeue.plans.asked import QUESTION_FORMS, SEARCH_FORMS, WORD
from carequeue.plans.registry import REDUCTIONS, SCENARIOS

RAW = """
raw as (
  select o.o_orderkey as patient_id,
    cast((o.o_orderkey * 31 + o.o_custkey * 17) % 96 as int) as age,
    case cast(o.o_custkey % 18 as int)
      when 0 then 'Breast Surgery' when 1 then 'Cardiology' when 2 then 'Colorectal Surgery'
      when 3 then 'Dermatology' when 4 then 'ENT' when 5 then 'Gastroenterology'
      when 6 then 'General Surgery' when 7 then 'Gynaecology'
      when 8 then 'Maxillofacial Surgery' when 9 then 'Neurosurgery'
      when 10 then 'Ophthalmology' when 11 then 'Trauma & Orthopaedics'
      when 12 then 'Plastic Surgery' when 13 then 'Respiratory Medicine'
      when 14 then 'Rheumatology' when 15 then 'Urology' when 16 then 'Vascular Surgery'
      else 'Hepatobiliary & Pancreatic Surgery' end as specialty_raw,
    case when o.o_orderkey % 2 = 0 then 'F' else 'M' end as gender,
    case when month(o.o_orderdate) in (12, 1, 2) then 'Winter'
         when month(o.o_orderdate) in (3, 4, 5) then 'Spring'
         when month(o.o_orderdate) in (6, 7, 8) then 'Summer' else 'Autumn' end as season,
    cast(coalesce(l.n_lines, 0) as double) as los,
    o.o_totalprice / cast(50 as double) as cost_estimate,
    coalesce(l.avg_disc, cast(0.03 as double)) as cancel_risk,
    cast(20 + o.o_custkey % 200 as int) as planned_count,
    cast(1 + c.c_nationkey % 10 as double) as doctors_fte,
    cast(2 + c.c_nationkey % 23 as double) as nurses_fte,
    cast(3 + c.c_nationkey % 10 + c.c_nationkey % 23 as double) as total_fte
  from orders o
  join customer c on o.o_custkey = c.c_custkey
  left join (select l_orderkey, count(*) as n_lines, round(avg(l_discount), 6) as avg_disc
             from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey
),
patients as (
  select * exclude (specialty_raw),
    case specialty_raw when 'Trauma & Orthopaedics' then 'Orthopedics'
      when 'Hepatobiliary & Pancreatic Surgery' then 'Hepatobiliary Surgery'
      else specialty_raw end as specialty
  from raw
)"""

# In the texts below <sum x> and <avg x> stand for sums and means of doubles that do not
# depend on the order of the rows: in units of 2^-52, the least fraction that is added.
_UNITS = "4503599627370496"


def _sum(value: str) -> str:
    """Whole units are added exactly and rounded once. No value here is negative."""
    units = f"sum(cast(floor(({value}) * {_UNITS}e0) as hugeint))"
    return f"(cast({units} // {_UNITS} as double) + cast({units} % {_UNITS} as double) / {_UNITS}e0)"


def _expanded(sql: str) -> str:
    sql = re.sub(r"<avg ([^>]+)>", r"(<sum \1> / count(\1))", sql)
    return re.sub(r"<sum ([^>]+)>", lambda m: _sum(m[1]), sql)


SCORED = (
    RAW
    + """,
ratios as (
  select *, planned_count / (doctors_fte + 0.1e0) as patients_per_doctor,
    planned_count / (nurses_fte + 0.1e0) as patients_per_nurse,
    planned_count / (total_fte + 0.1e0) as total_staff_efficiency
  from patients
),
sums as (
  select *,
    case when age > 70 then 0.15e0 else 0e0 end
    + case when los > 3 then 0.15e0 else 0e0 end
    + case when cost_estimate > 5000 then 0.15e0 else 0e0 end
    + case specialty when 'Cardiology' then 0.15e0 when 'General Surgery' then 0.13e0
        when 'Urology' then 0.11e0 when 'Gynaecology' then 0.09e0
        when 'Ophthalmology' then 0.07e0 when 'Orthopedics' then 0.05e0
        when 'ENT' then 0.03e0 else 0e0 end
    + case season when 'Winter' then 0.07e0 when 'Autumn' then 0.03e0 else 0e0 end
      as priority_sum,
    case when age > 70 then 0.2e0 else 0e0 end
    + case when los > 5 then 0.2e0 else 0e0 end
    + 0.2e0 * cancel_risk
    + case when cost_estimate > 6000 then 0.2e0 else 0e0 end
    + case when season = 'Winter' then 0.2e0 else 0e0 end
    + case when patients_per_doctor > 60 then 0.1e0 else 0e0 end
    + case when patients_per_nurse > 30 then 0.1e0 else 0e0 end as risk_sum
  from ratios
),
capped as (
  select *, case when priority_sum > 1 then 1e0 else priority_sum end as priority_score,
    case when risk_sum > 1 then 1e0 else risk_sum end as readmit_risk
  from sums
),
scored as (
  select *,
    cast(trunc(100 - priority_score * 100) as int)
      + cast((patient_id % 31 * 7919 + 42) % 31 as int) as wait_days,
    case when cancel_risk < 0.05e0 and patients_per_doctor < 70 and patients_per_nurse < 35
      then 1 else 0 end as efficiency_label,
    case when age > 0 and age <= 17 then 'Child' when age > 17 and age <= 35 then 'Young Adult'
      when age > 35 and age <= 60 then 'Adult' when age > 60 and age <= 120 then 'Elderly'
      end as age_group
  from capped
)"""
)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"cast({value!r} as double)"
    return str(value)


def _list(values) -> str:
    return "[" + ", ".join(_literal(v) for v in values) + "]"


SCENARIO_ROWS = f"""
scenario(scenario_id, baseline_capacity, uplift_percentage) as (values {_values(SCENARIOS)}),
scenarios as (
  select scenario_id, baseline_capacity, new_capacity,
    new_capacity - baseline_capacity as additional_capacity, uplift_percentage
  from (select *, cast(trunc(baseline_capacity * (1 + uplift_percentage / 100e0)) as bigint)
          as new_capacity from scenario)
)"""

RANKED = """
ranked as (
  select *, row_number() over (
    order by priority_score desc, wait_days desc, patient_id) as queue_position
  from scored
)"""

# -- questions -----------------------------------------------------------------------


def _filled(forms: list[str], row: str) -> str:
    text = f"({_list(forms)})[1 + cast({row} as int)]"
    for mark, value in {
        "{specialty}": "specialty",
        "{SPECIALTY}": "upper(specialty)",
        "{season}": "season",
        "{n}": "cast(5 + patient_id % 85 as varchar)",
        "{cap}": "cast(50 + patient_id % 9 * 50 as varchar)",
        "{age}": "cast(age as varchar)",
    }.items():
        text = f"replace({text}, '{mark}', {value})"
    return text


QUESTIONS = f"""
questions as (
  select patient_id as question_id,
    {_filled(QUESTION_FORMS, f"patient_id % {len(QUESTION_FORMS)}")} as question
  from patients
)"""

# Whole texts as questions.
SAID = "questions as (select conv_id * 100000 + turn as question_id, text as question from conversations)"
WRITTEN = "questions as (select doc_id as question_id, text as question from documents)"

TYPED = (
    "typed_as as (select *, case "
    + " ".join(
        f"when regexp_matches(lower(question), {_literal(p)}) then '{name}'"
        for name, p in V.QUESTION_PATTERNS
    )
    + f" else '{V.DEFAULT_QUESTION_TYPE}' end as question_type from questions)"
)

ROUTED = """
routed as (
  select *, case
    when question_type in ('cancellation_reduction', 'capacity_analysis', 'capacity_staffing')
      then case when contains(lower(question), 'cancel') then 'cancellation_whatif'
        when contains(lower(question), 'capacity') or contains(lower(question), 'increase')
          then 'capacity_answer' else 'preview' end
    when question_type in ('seasonal_analysis', 'seasonal_readmission', 'seasonal_cost',
      'seasonal_comparison') then 'seasonal_analysis'
    when question_type in ('average_wait_time', 'specialty_analysis', 'high_risk_patients',
      'cost_impact', 'age_based_risk', 'age_based_cancellation', 'age_based_cost')
      then question_type
    else 'preview' end as report
  from typed_as
)"""


def _word(name: str) -> str:
    if " " in name:
        return f"contains(lower(question), {_literal(name.lower())})"
    return rf"regexp_matches(lower(question), '\b{name.lower()}\b')"


def _names(values) -> str:
    flags = ", ".join(f"case when {_word(v)} then {_literal(v)} end" for v in values)
    return f"[x for x in [{flags}] if x is not null]"


def _last_word(at: int, otherwise: str) -> str:
    cases = " ".join(
        rf"when regexp_matches(lower(question), '\b{row[0]}\b') then {_literal(row[at])}"
        for row in reversed(V.AGE_WORDS)
    )
    return f"case {cases} else {otherwise} end"


def _first(pattern: str, text: str, kind: str, group: int = 1) -> str:
    return f"try_cast(nullif(regexp_extract({text}, {_literal(pattern)}, {group}), '') as {kind})"


PARAMETERS = f"""
parameters as (
  select *,
    {_first(V.PERCENT_PATTERN, "question", "double")} as percentage,
    [cast(x as double) for x in regexp_extract_all(question, {_literal(V.NUMBER_PATTERN)}, 1)]
      as number_list,
    coalesce({_first(V.BASELINE_PATTERN, "lower(question)", "bigint")},
      case when contains(lower(question), 'capacity') or contains(lower(question), 'increase')
        then 100 end) as baseline_capacity,
    {_first(V.RISK_WEIGHT_PATTERN, "lower(question)", "double")} as risk_weight,
    {_first(V.THRESHOLD_PATTERN, "lower(question)", "double")} as threshold,
    {_names(V.QUESTION_SPECIALTIES)} as specialty_list,
    {_names(V.SEASONS)} as season_list,
    {_first(V.AGE_PATTERN, "lower(question)", "int")} as age,
    {_last_word(1, _first(V.AGE_RANGE_PATTERN, "lower(question)", "int", 1))} as age_min,
    {_last_word(2, _first(V.AGE_RANGE_PATTERN, "lower(question)", "int", 2))} as age_max,
    {_last_word(0, "null")} as age_group
  from routed
)"""

ASKED = f"""{QUESTIONS}, {TYPED}, {ROUTED}, {PARAMETERS}"""

# What a report reads from a question; equal rows are answered once.
REQUESTS = """
asked as (
  select question_id, question_type, report,
    case when report in ('cancellation_whatif', 'capacity_answer', 'preview') then []
      else specialty_list end as specialties,
    case when report = 'seasonal_analysis' then season_list else [] end as seasons,
    case when report like 'age_based%' then coalesce(age, age_min) end as low,
    case when report like 'age_based%' then coalesce(age, age_max) end as high,
    case when report = 'high_risk_patients' then coalesce(percentage, 70)
      when report in ('cancellation_whatif', 'capacity_answer') then coalesce(percentage, 20)
      end as percentage,
    case when report = 'capacity_answer' then coalesce(baseline_capacity, 100) end as baseline
  from parameters
),
requests as (
  select row_number() over () as request, *
  from (select distinct report, specialties, seasons, low, high, percentage, baseline
        from asked)
),
asked_for as (
  select a.question_id, a.question_type, r.request, r.report
  from asked a join requests r on a.report = r.report and a.specialties = r.specialties
    and a.seasons = r.seasons and a.low is not distinct from r.low
    and a.high is not distinct from r.high
    and a.percentage is not distinct from r.percentage
    and a.baseline is not distinct from r.baseline
),
pairs as (
  select r.*, p.specialty, p.season, p.age_group, p.patient_id, p.wait_days, p.cost_estimate,
    p.cancel_risk, p.readmit_risk
  from requests r join scored p
    on (len(r.specialties) = 0 or list_contains(r.specialties, p.specialty))
   and (len(r.seasons) = 0 or list_contains(r.seasons, p.season))
   and (r.low is null or (p.age >= r.low and p.age <= r.high))
   and (r.report <> 'high_risk_patients' or p.readmit_risk > r.percentage / 100)
  where r.report not in ('cancellation_whatif', 'capacity_answer', 'preview')
),
grouped as (
  select request, report,
    case when report = 'seasonal_analysis' then season
      when report like 'age_based%' then age_group else specialty end as key,
    count(*) as n, avg(wait_days) as wait, <avg cost_estimate> as cost,
    <avg cancel_risk> as cancel, <avg readmit_risk> as readmit, <sum cost_estimate> as total,
    <sum cost_estimate * cancel_risk> as loss
  from pairs group by all
),
totals as (
  select count(*) as total_patients, <sum cancel_risk> as expected, <avg cost_estimate> as cost,
    <avg los> as los from scored
),
whatif as (
  select request, report, percentage, expected, expected * (percentage / 100) as prevented,
    cost, los from requests, totals where report = 'cancellation_whatif'
),
uplift as (
  select request, report, percentage, baseline as base, total_patients as n,
    cast(trunc(baseline * (1 + percentage / 100)) as bigint) as new
  from requests, totals where report = 'capacity_answer'
),
weeks as (
  select request, sum(greatest(0, least(new, n - (w - 1) * new) - least(base, n - (w - 1) * base)))
    as moved
  from (select *, unnest(range(1, cast(ceil(n / base) as bigint) + 1)) as w from uplift)
  group by request
),
capacity as (
  select u.*, new - base as added, w.moved, ceil(n / base) as old_weeks, ceil(n / new) as new_weeks
  from uplift u join weeks w using (request)
),
first_ten as (select * from scored order by patient_id limit 10),
metrics as (
  select request, report, key, unnest(case report
    when 'average_wait_time' then [('avg_wait_days', wait), ('patient_count', n)]
    when 'specialty_analysis' then [('patient_count', n), ('avg_wait_days', wait),
      ('avg_cost', cost), ('avg_cancel_risk', cancel), ('avg_readmit_risk', readmit)]
    when 'cost_impact' then [('total_cost', total), ('avg_cost', cost), ('patient_count', n),
      ('potential_loss_from_cancellations', loss)]
    when 'high_risk_patients' then [('high_risk_count', n), ('avg_risk', readmit),
      ('avg_cost', cost)]
    when 'seasonal_analysis' then [('avg_cancel_risk', cancel), ('avg_readmit_risk', readmit),
      ('avg_cost', cost), ('total_cases', n)]
    when 'age_based_risk' then [('avg_readmit_risk', readmit), ('total_patients', n)]
    when 'age_based_cancellation' then [('avg_cancel_risk', cancel), ('total_patients', n)]
    when 'age_based_cost' then [('avg_cost', cost), ('total_cost', total),
      ('patient_count', n)] end) as pair
  from grouped where key is not null
  union all
  select request, report, '', unnest([('reduction_percentage', percentage),
    ('current_expected_cancellations', round_even(expected, 2)),
    ('cancellations_prevented', round_even(prevented, 2)),
    ('cost_savings', round_even(prevented * cost, 2)),
    ('bed_days_freed', round_even(prevented * los, 2)),
    ('weekly_capacity_freed', round_even(prevented * los / 7 * 5, 2))])
  from whatif
  union all
  select request, report, '', unnest([('weeks_saved', old_weeks - new_weeks),
    ('patients_moved_earlier', moved), ('baseline_weeks', old_weeks), ('new_weeks', new_weeks),
    ('baseline_capacity', base), ('new_capacity', new), ('additional_capacity', added),
    ('uplift_percentage', percentage), ('efficiency_gain', round_even((old_weeks - new_weeks) / old_weeks * 100, 1)),
    ('total_patients', n), ('current_doctors', round_even(base / 25e0, 1)),
    ('current_nurses', round_even(base / 12e0, 1)), ('patients_per_doctor', 25),
    ('patients_per_nurse', 12), ('additional_doctors_needed', round_even(added / 25e0, 1)),
    ('additional_nurses_needed', round_even(added / 12e0, 1)),
    ('mixed_doctors', round_even(added / (25e0 * 1.2e0), 1)),
    ('mixed_nurses', round_even(added / (12e0 * 0.8e0), 1)),
    ('cost_doctors_only', round_even(added / 25e0 * 80000, 0)),
    ('cost_nurses_only', round_even(added / 12e0 * 35000, 0)),
    ('cost_mixed', round_even(added / (25e0 * 1.2e0) * 80000 + added / (12e0 * 0.8e0) * 35000, 0))])
  from capacity
  union all
  select request, report, cast(p.patient_id as varchar), unnest([('age', p.age), ('los', p.los),
    ('cost_estimate', p.cost_estimate), ('cancel_risk', p.cancel_risk),
    ('priority_score', p.priority_score), ('readmit_risk', p.readmit_risk),
    ('wait_days', p.wait_days)])
  from requests, first_ten p where report = 'preview'
),
answers as (
  select request, report, key, pair[1] as metric, cast(pair[2] as double) as value from metrics
)"""

FORMATTED = """
lines as (
  select request, report, key, string_agg(metric || '=' || shown, ', '
      order by metric || '=' || shown) as line
  from (select *, coalesce(format('{:.4f}', value), 'missing') as shown from answers)
  where report not in ('cancellation_whatif', 'capacity_answer') group by all
),
tables as (
  select request, 'Found ' || count(*) || ' records. '
    || string_agg(key || ': ' || line, '; ' order by key || ': ' || line) as answer
  from lines group by request
),
cancel_text as (
  select request, format('Reducing cancellations by {:.1f}% saves £{:,.2f}, frees {:.0f} bed days '
      || 'and {:.1f} procedures a week, and prevents {:.0f} cancellations.',
    percentage, round_even(prevented * cost, 2), round_even(prevented * los, 2),
    round_even(prevented * los / 7 * 5, 2), round_even(prevented, 2)) as answer
  from whatif
),
capacity_text as (
  select request, format('Raising weekly capacity from {} to {} (+{}) clears the backlog in {:.0f} '
      || 'instead of {:.0f} weeks ({:.0f} saved, {:.1f}%) and moves {:.0f} patients to earlier '
      || 'slots. Current need: {:.1f} doctors, {:.1f} nurses (25 and 12 patients each). '
      || 'Doctors only: +{:.1f} doctors for £{:,.0f} a year. '
      || 'Nurses only: +{:.1f} nurses for £{:,.0f} a year. '
      || 'Mixed (recommended): +{:.1f} doctors +{:.1f} nurses for £{:,.0f} a year.',
    base, new, added, new_weeks, old_weeks, old_weeks - new_weeks,
    round_even((old_weeks - new_weeks) / old_weeks * 100, 1), cast(moved as double),
    round_even(base / 25e0, 1), round_even(base / 12e0, 1), round_even(added / 25e0, 1),
    round_even(added / 25e0 * 80000, 0), round_even(added / 12e0, 1),
    round_even(added / 12e0 * 35000, 0), round_even(added / (25e0 * 1.2e0), 1),
    round_even(added / (12e0 * 0.8e0), 1),
    round_even(added / (25e0 * 1.2e0) * 80000 + added / (12e0 * 0.8e0) * 35000, 0)) as answer
  from capacity
),
texts as (
  select * from tables union all select * from cancel_text union all select * from capacity_text
)"""


def _glossary() -> str:
    return _values(
        (i, term, title, V.ENCYCLOPEDIA + page)
        for i, (term, title, page) in enumerate(V.MEDICAL_TERMS)
    )


FIXED_TERMS = f"fixed_terms(position, term, title, url) as (values {_glossary()})"

# Whole texts against the table glossary: the exact term first, else the first partial one.
LOOKED_UP = """
looked_up as (
  select q.question_id, g.* from questions q left join (
    select wanted, unnest(min_by(g, (case when g.term = wanted then 0 else 1 end, g.position)))
    from (select distinct trim(lower(question)) as wanted from questions) d
    join glossary g on d.wanted <> '' and (contains(g.term, d.wanted)
      or contains(d.wanted, g.term) or contains(lower(g.title), d.wanted))
    group by wanted) g on g.wanted = trim(lower(q.question))
)"""

# What is typed, beginnings and whole questions, against the table offered.
SUGGESTED = f"""
typing as (
  select question_id, substring(question, 1, cast(1 + question_id * 7 % 20 as int)) as typed
  from questions
  union all select question_id, question from questions
),
matching as (
  select typed, suggestion, row_number() over (partition by typed order by position) as nth
  from (select distinct typed from typing where length(typed) >= 2) join offered
    on contains(lower(suggestion), lower(typed)) and lower(suggestion) <> lower(typed)
),
suggested as (
  select question_id, typed, cast(nth as int) as rank, suggestion
  from typing join matching using (typed) where nth <= {SUGGESTIONS_SHOWN}
)"""


def _over(*parts: str, select: str) -> str:
    return "with " + ", ".join(p.strip() for p in parts) + "\n" + select.strip()


def _scored(select: str) -> str:
    return _over(SCORED, select=select)


def _patients(select: str) -> str:
    return _over(RAW, select=select)


def _capacity(select: str) -> str:
    return _over(SCORED, SCENARIO_ROWS, select=select)


ONE_HOT = ",\n".join(
    f"""cast(specialty = {_literal(s)} as int) as "specialty_{s}" """
    for s in sorted({*V.QUESTION_SPECIALTIES, "Hepatobiliary Surgery"})[1:]
)

STAFF_BASE = """
base as (
  select s.*, t.* from scenarios s,
    (select count(*) as n, <avg doctors_fte> as doctors, <avg nurses_fte> as nurses,
       <avg cost_estimate> as avg_cost from scored) t
)"""

ORACLE: dict[str, str] = {
    "normalize_patients": _patients(
        """select patient_id, age, age as age_min, age as age_max, specialty, gender, season,
             los, cost_estimate, cancel_risk, planned_count from patients"""
    ),
    "parse_age_band": _patients(
        """select patient_id, band as age_band, low as age_min, high as age_max,
             cast(low + (patient_id % 1000003 * 7919 + 42) % (high - low + 1) as int) as age
           from (select patient_id,
             case when age < 18 then '0-17' when age < 35 then '18-34' when age < 65 then '35-64'
               when age < 85 then '65-84' else '85+' end as band,
             case when age < 18 then 0 when age < 35 then 18 when age < 65 then 35
               when age < 85 then 65 else 85 end as low,
             case when age < 18 then 17 when age < 35 then 34 when age < 65 then 64
               when age < 85 then 84 else 95 end as high from raw)"""
    ),
    "onehot_to_label": _patients(
        """select patient_id,
             case when specialty_raw = 'Breast Surgery' then 'General Surgery'
               else specialty_raw end as specialty, gender, season from raw"""
    ),
    "sql_passthrough": _scored(
        """select specialty, gender, count(*) as patient_count,
             avg(wait_days) as avg_wait_days
           from scored group by specialty, gender"""
    ),
    "season_of_date": """select o_orderkey,
        case when month(o_orderdate) in (12, 1, 2) then 'Winter'
          when month(o_orderdate) in (3, 4, 5) then 'Spring'
          when month(o_orderdate) in (6, 7, 8) then 'Summer' else 'Autumn' end as season
        from orders""",
    "priority_score": _scored("select patient_id, priority_score from scored"),
    "readmit_risk": _scored("select patient_id, readmit_risk from scored"),
    "staffing_ratios": _scored(
        """select patient_id, patients_per_doctor, patients_per_nurse, total_staff_efficiency
           from scored"""
    ),
    "efficiency_label": _scored("select patient_id, efficiency_label from scored"),
    "wait_days": _scored("select patient_id, wait_days from scored"),
    "age_group": _scored("select patient_id, age, age_group from scored"),
    "high_risk_patients_list": _scored(
        """select patient_id, specialty, readmit_risk, cost_estimate from scored
           where readmit_risk > 0.7e0"""
    ),
    "avg_wait_filtered": _scored(
        """select specialty, avg(wait_days) as avg_wait_days, count(*) as patient_count
           from scored where specialty in ('Cardiology', 'ENT', 'Orthopedics')
           group by specialty"""
    ),
    "seasonal_filtered": _scored(
        """select season, <avg cancel_risk> as avg_cancel_risk,
             <avg readmit_risk> as avg_readmit_risk,
             <avg cost_estimate> as avg_cost, count(*) as total_cases
           from scored where season in ('Winter', 'Summer')
             and specialty in ('Cardiology', 'Urology') group by season"""
    ),
    "age_filter": _scored(
        """select patient_id, age, specialty from scored
           where age between 40 and 60 and specialty in ('ENT', 'Urology')"""
    ),
    "specialty_dim_join": _patients(
        """select r.specialty_raw as specialty, p.specialty as name,
             case p.specialty when 'Cardiology' then 0.15e0 when 'General Surgery' then 0.13e0
               when 'Urology' then 0.11e0 when 'Gynaecology' then 0.09e0
               when 'Ophthalmology' then 0.07e0 when 'Orthopedics' then 0.05e0
               when 'ENT' then 0.03e0 else 0e0 end as weight, count(*) as patient_count
           from raw r join patients p using (patient_id) group by all"""
    ),
    "season_counts_dense": _patients(
        """select s.season, count(p.patient_id) as patient_count
           from (values ('Autumn'), ('Spring'), ('Summer'), ('Winter')) s(season)
           left join patients p using (season) group by s.season"""
    ),
    "season_risk": _scored(
        """select s.season, coalesce(round_even(<avg cancel_risk>, 3), 0) as avg_cancel_risk,
             coalesce(round_even(<avg readmit_risk>, 3), 0) as avg_readmit_risk
           from (values ('Autumn'), ('Spring'), ('Summer'), ('Winter')) s(season)
           left join scored p using (season) group by s.season"""
    ),
    "term_lookup": _over(
        RAW,
        f"glossary(position, term, title, url) as (values {_glossary()})",
        f"""searches as (select patient_id,
          {_filled(SEARCH_FORMS, f"patient_id % {len(SEARCH_FORMS)}")} as search from patients)""",
        """distinct_searches as (
          select distinct search, trim(lower(search)) as wanted from searches)""",
        """found as (
          select d.search, g.*, row_number() over (partition by d.search
            order by case when g.term = d.wanted then 0 else 1 end, g.position) as nth
          from distinct_searches d join glossary g on contains(g.term, d.wanted)
            or contains(d.wanted, g.term) or contains(lower(g.title), d.wanted)
          where d.wanted <> '')""",
        select="""select s.patient_id, s.search, f.term, f.title, f.url
          from searches s left join found f on f.search = s.search and f.nth = 1""",
    ),
    "term_lookup_conversations": _over(
        SAID,
        FIXED_TERMS,
        "glossary as (select * from fixed_terms)",
        LOOKED_UP,
        select="""select question_id, cast(position as bigint) as position, term, title, url
          from looked_up""",
    ),
    "term_lookup_documents": _over(
        WRITTEN,
        FIXED_TERMS,
        f"""words as (select distinct unnest(regexp_extract_all(lower(text), {_literal(WORD)})) as term
          from benchmark)""",
        f"""glossary as (select * from fixed_terms union all
          select {len(V.MEDICAL_TERMS)} - 1 + row_number() over (order by term), term,
            'The word ' || term, null from words)""",
        LOOKED_UP,
        select="""select question_id, cast(position as bigint) as position, term, title, url
          from looked_up""",
    ),
    "suggest_queries": _over(
        RAW,
        QUESTIONS,
        f"""offered(position, suggestion) as (
          values {_values((i + 1, s) for i, s in enumerate(V.SUGGESTIONS))})""",
        SUGGESTED,
        select="select question_id, typed, rank, suggestion from suggested",
    ),
    "suggest_asked": _over(
        RAW,
        QUESTIONS,
        """offered as (select row_number() over (order by count(*) desc, question) as position,
          question as suggestion from questions group by question)""",
        SUGGESTED,
        select="select question_id, typed, rank, suggestion from suggested",
    ),
    "average_wait_time": _scored(
        """select specialty, avg(wait_days) as avg_wait_days, count(*) as patient_count
           from scored group by specialty"""
    ),
    "specialty_analysis": _scored(
        """select specialty, count(*) as patient_count, avg(wait_days) as avg_wait_days,
             <avg cost_estimate> as avg_cost,
             <avg cancel_risk> as avg_cancel_risk,
             <avg readmit_risk> as avg_readmit_risk
           from scored group by specialty"""
    ),
    "high_risk_by_specialty": _scored(
        """select specialty, count(*) as high_risk_count, <avg readmit_risk> as avg_risk,
             <avg cost_estimate> as avg_cost
           from scored where readmit_risk > 70 / 100e0 group by specialty"""
    ),
    "cost_impact": _scored(
        """select specialty, <sum cost_estimate> as total_cost,
             <avg cost_estimate> as avg_cost, count(cost_estimate) as patient_count,
             <sum cost_estimate * cancel_risk> as potential_loss_from_cancellations
           from scored group by specialty"""
    ),
    "seasonal_analysis_basic": _scored(
        """select season, <avg cancel_risk> as avg_cancel_risk, count(*) as total_cases
           from scored group by season"""
    ),
    "seasonal_analysis": _scored(
        """select season, <avg cancel_risk> as avg_cancel_risk,
             <avg readmit_risk> as avg_readmit_risk,
             <avg cost_estimate> as avg_cost, count(*) as total_cases
           from scored group by season"""
    ),
    "age_based_risk": _scored(
        """select age_group, <avg readmit_risk> as avg_readmit_risk,
             count(*) as total_patients
           from scored where age_group is not null group by age_group"""
    ),
    "age_based_cancellation": _scored(
        """select age_group, <avg cancel_risk> as avg_cancel_risk,
             count(*) as total_patients
           from scored where age_group is not null group by age_group"""
    ),
    "age_based_cost": _scored(
        """select age_group, <avg cost_estimate> as avg_cost,
             <sum cost_estimate> as total_cost, count(cost_estimate) as patient_count
           from scored where age_group is not null group by age_group"""
    ),
    "overview_kpis": _scored(
        """select count(*) as total_patients, avg(wait_days) as avg_wait_days,
             count(*) filter (readmit_risk > 0.7e0) as high_risk_patients,
             <sum cost_estimate> as total_cost, avg(age) as avg_age,
             count(*) filter (season = 'Winter') as winter_patients from scored"""
    ),
    "season_cost_delta": _over(
        SCORED,
        "costs as (select season, <sum cost_estimate> as cost from scored group by season)",
        """pairs(current_season, previous_season) as (values ('Winter', 'Autumn'),
          ('Spring', 'Winter'), ('Summer', 'Spring'), ('Autumn', 'Summer'))""",
        """deltas as (
          select p.*, c.cost as current_cost, b.cost as previous_cost,
            c.cost is null or b.cost is null as is_fallback,
            case when c.cost is null or b.cost is null
              then (select <sum cost_estimate> from scored) / 10
              else c.cost - b.cost end as cost_delta
          from pairs p left join costs c on c.season = p.current_season
            left join costs b on b.season = p.previous_season)""",
        select="""select current_season, previous_season, current_cost,
            previous_cost, cost_delta,
            is_fallback, case when cost_delta >= 0 then '+£' else '£' end
              || format('{:.1f}', cost_delta / 1000000) || 'M '
              || case when is_fallback then 'this quarter'
                   else 'from ' || previous_season end as delta_text
          from deltas""",
    ),
    "specialty_counts": _patients(
        "select specialty, count(*) as patient_count from patients group by specialty"
    ),
    "wait_ranking": _scored(
        "select specialty, avg(wait_days) as avg_wait_days from scored group by specialty"
    ),
    "specialty_performance": _scored(
        """select specialty, count(*) as patient_count,
             round_even(avg(wait_days), 2) as avg_wait_days,
             round_even(<avg cost_estimate>, 2) as avg_cost,
             round_even(<avg cancel_risk>, 2) as avg_cancel_risk,
             round_even(<avg readmit_risk>, 2) as avg_readmit_risk
           from scored group by specialty"""
    ),
    "risk_histogram": _scored(
        """select bin, bin * 0.05e0 as bin_start, count(*) as patient_count,
             count(*) filter (readmit_risk > 0.7e0) as above_threshold
           from (select *, least(cast(floor(readmit_risk / 0.05e0) as int), 19) as bin
                 from scored) group by bin"""
    ),
    "cancel_ranking": _scored(
        """select specialty, <avg cancel_risk> as avg_cancel_risk from scored
           group by specialty"""
    ),
    "top_specialty": _patients(
        """select specialty, count(*) as patient_count from patients group by specialty
           order by patient_count desc, specialty limit 1"""
    ),
    "highest_risk_specialty": _scored(
        """select specialty, <avg readmit_risk> as avg_readmit_risk from scored
           group by specialty order by <avg readmit_risk> desc, specialty limit 1"""
    ),
    "column_profile": _patients(
        """select 'specialty' as column, count(distinct specialty) as distinct_values,
             count(specialty) as non_null, count(specialty) = 0 as all_null from patients
           union all select 'gender', count(distinct gender), count(gender), count(gender) = 0
             from patients
           union all select 'season', count(distinct season), count(season), count(season) = 0
             from patients"""
    ),
    "label_rate": _scored(
        """select avg(efficiency_label) as efficiency_rate, count(*) as patient_count
           from scored"""
    ),
    "cancellation_whatif": _over(
        SCORED,
        f"r(reduction_percentage) as (values {_values((p,) for p in REDUCTIONS)})",
        """t as (select <sum cancel_risk> as expected, <avg cost_estimate> as cost, <avg los> as los
          from scored)""",
        """p as (select *, expected * (reduction_percentage / 100) as prevented from r, t)""",
        select="""select reduction_percentage,
            round_even(expected, 2) as current_expected_cancellations,
            round_even(prevented, 2) as cancellations_prevented,
            round_even(prevented * cost, 2) as cost_savings,
            round_even(prevented * los, 2) as bed_days_freed,
            round_even(prevented * los / 7 * 5, 2) as weekly_capacity_freed from p""",
    ),
    "high_risk_summary": _scored(
        """select count(*) as high_risk_patient_count, 0.7e0 as risk_threshold,
             coalesce(round_even(<avg cost_estimate>, 2), 0) as avg_cost_high_risk,
             count(*) > 0 as potential_intervention_needed
           from scored where readmit_risk > 0.7e0"""
    ),
    "queue_position": _over(
        SCORED,
        RANKED,
        select="select patient_id, priority_score, wait_days, queue_position from ranked",
    ),
    "queue_after_batches": _over(
        SCORED,
        "after(batches) as (values (1), (2), (3))",
        select="""select patient_id, priority_score, wait_days, row_number() over (
            partition by batches order by priority_score desc, wait_days desc, patient_id)
            as queue_position, batches
          from scored join after on patient_id % 3 < batches""",
    ),
    "capacity_schedule": _over(
        SCORED,
        RANKED,
        select="""select patient_id, priority_score, wait_days, queue_position,
            cast(ceil(queue_position / 100) as bigint) as baseline_week,
            cast(ceil(queue_position / 120) as bigint) as new_week from ranked""",
    ),
    "optimize_schedule": _over(
        SCORED,
        """blended as (select patient_id, priority_score, wait_days, readmit_risk,
          priority_score * (1e0 - 0.3e0) + readmit_risk * 0.3e0 as combined_score from scored)""",
        """ordered as (select *, row_number() over (
          order by combined_score desc, wait_days desc, patient_id) as queue_position
          from blended)""",
        select="""select *, cast(ceil(queue_position / 100) as bigint) as scheduled_week
          from ordered""",
    ),
    "preview": _scored(
        """select patient_id, specialty, age, los, cost_estimate, cancel_risk, priority_score,
             readmit_risk, wait_days from scored order by patient_id limit 10"""
    ),
    "fixed_sample": _patients(
        f"""select patient_id, specialty, cost_estimate
            from (select *, (patient_id % {PRIME} + 42) * {MULTIPLIER} % {PRIME} as k from patients)
            order by (k * k + k) % {PRIME}, patient_id limit 5000"""
    ),
    "capacity_impact": _over(
        SCORED,
        RANKED,
        SCENARIO_ROWS,
        """weeks as (
          select s.scenario_id, count(*) as total_patients, max(s.baseline_capacity) as base,
            max(s.new_capacity) as new, max(s.additional_capacity) as added,
            cast(max(ceil(queue_position / baseline_capacity)) as bigint) as baseline_weeks,
            cast(max(ceil(queue_position / new_capacity)) as bigint) as new_weeks,
            count(*) filter (ceil(queue_position / new_capacity)
              < ceil(queue_position / baseline_capacity)) as moved,
            avg(ceil(queue_position / baseline_capacity)
              - ceil(queue_position / new_capacity)) as avg_saved,
            <avg doctors_fte> as doctors, <avg nurses_fte> as nurses,
            cast(sum(planned_count) as bigint) as planned
          from ranked, scenarios s group by s.scenario_id)""",
        """staffed as (select *, planned / doctors as per_doctor, planned / nurses as per_nurse
          from weeks)""",
        select="""select scenario_id, total_patients, base as baseline_capacity,
            new as new_capacity, added as additional_capacity, baseline_weeks, new_weeks,
            baseline_weeks - new_weeks as weeks_saved, moved as patients_moved_earlier,
            avg_saved as avg_weeks_saved, doctors as current_doctors,
            nurses as current_nurses, per_doctor as patients_per_doctor,
            per_nurse as patients_per_nurse,
            added / per_doctor as additional_doctors_needed,
            added / per_nurse as additional_nurses_needed,
            added * 0.6e0 / per_doctor as mixed_scenario_doctors,
            added * 0.4e0 / per_nurse as mixed_scenario_nurses,
            added / per_doctor * 80000 as cost_doctors_only,
            added / per_nurse * 35000 as cost_nurses_only,
            added * 0.6e0 / per_doctor * 80000 + added * 0.4e0 / per_nurse * 35000
              as cost_mixed_scenario
          from staffed""",
    ),
    "weekly_backlog": _over(
        SCORED,
        RANKED,
        SCENARIO_ROWS,
        """placed as (
          select s.scenario_id, ceil(queue_position / baseline_capacity) as old_week,
            ceil(queue_position / new_capacity) as new_week from ranked, scenarios s)""",
        """lengths as (select scenario_id, max(old_week) as last_week from placed group by all)""",
        """numbered as (select scenario_id,
          unnest(range(1, cast(last_week as int) + 1)) as week from lengths)""",
        select="""select n.scenario_id, cast(n.week as int) as week,
            count(*) filter (p.old_week > n.week) as baseline_backlog,
            count(*) filter (p.new_week > n.week) as new_backlog
          from numbered n join placed p using (scenario_id) group by all""",
    ),
    "capacity_answer": _capacity(
        """select specialty, n as total_patients, scenario_id, baseline_capacity,
             uplift_percentage, new_capacity, additional_capacity, old_weeks as baseline_weeks,
             new_weeks, moved as patients_moved_earlier, old_weeks - new_weeks as weeks_saved,
             round_even((old_weeks - new_weeks) / old_weeks * 100, 1) as efficiency_gain,
             round_even(baseline_capacity / 25e0, 1) as current_doctors,
             round_even(baseline_capacity / 12e0, 1) as current_nurses,
             25 as patients_per_doctor, 12 as patients_per_nurse,
             round_even(additional_capacity / 25e0, 1) as additional_doctors_needed,
             round_even(additional_capacity / 12e0, 1) as additional_nurses_needed,
             round_even(additional_capacity / (25e0 * 1.2e0), 1) as mixed_doctors,
             round_even(additional_capacity / (12e0 * 0.8e0), 1) as mixed_nurses,
             round_even(additional_capacity / 25e0 * 80000, 0) as cost_doctors_only,
             round_even(additional_capacity / 12e0 * 35000, 0) as cost_nurses_only,
             round_even(additional_capacity / (25e0 * 1.2e0) * 80000
               + additional_capacity / (12e0 * 0.8e0) * 35000, 0) as cost_mixed
           from (
             select *, cast(ceil(n / baseline_capacity) as bigint) as old_weeks,
               cast(ceil(n / new_capacity) as bigint) as new_weeks,
               cast((select sum(greatest(0, least(new_capacity, n - (w - 1) * new_capacity)
                   - least(baseline_capacity, n - (w - 1) * baseline_capacity)))
                 from range(1, cast(ceil(n / baseline_capacity) as bigint) + 1) r(w)) as bigint)
                 as moved
             from (select specialty, count(*) as n from scored group by specialty), scenarios)"""
    ),
    "staffing_options_v1": _over(
        SCORED,
        SCENARIO_ROWS,
        STAFF_BASE,
        """needs as (select *,
          cast(ceil(baseline_capacity / (n / doctors)) as bigint) as doctors_now,
          cast(ceil(baseline_capacity / (n / nurses)) as bigint) as nurses_now,
          cast(ceil(additional_capacity / 25e0) as bigint) as d,
          cast(ceil(additional_capacity / 12e0) as bigint) as s,
          cast(ceil(additional_capacity / (25e0 * 1.2e0)) as bigint) as md,
          cast(ceil(additional_capacity / (12e0 * 0.8e0)) as bigint) as ms from base)""",
        """options as (
          select *, 'Doctors Only' as approach, d as doctors_added, 0 as nurses_added from needs
          union all select *, 'Nurses Only', 0, s from needs
          union all select *, 'Mixed Approach (Recommended)', md, ms from needs)""",
        select="""select scenario_id, additional_capacity, doctors_now as current_doctors_needed,
            nurses_now as current_nurses_needed, doctors_now + d as total_doctors_needed,
            nurses_now + s as total_nurses_needed,
            cast(round_even(doctors, 0) as bigint) as actual_doctors,
            cast(round_even(nurses, 0) as bigint) as actual_nurses, approach, doctors_added,
            nurses_added, doctors_added * 80000 + nurses_added * 35000 as annual_cost,
            (doctors_added * 80000 + nurses_added * 35000) / 12e0 as monthly_cost
          from options""",
    ),
    "staffing_options": _over(
        SCORED,
        SCENARIO_ROWS,
        STAFF_BASE,
        """needs as (select *, cast(ceil(baseline_capacity / 25e0) as bigint) as doctors_now,
          cast(ceil(baseline_capacity / 12e0) as bigint) as nurses_now,
          cast(ceil(additional_capacity / 25e0) as bigint) as d,
          cast(ceil(additional_capacity / 12e0) as bigint) as s,
          cast(ceil(additional_capacity / (12e0 * 0.8e0)) as bigint) as nurses_only,
          cast(greatest(1, ceil(additional_capacity / (25e0 * 1.5e0))) as bigint) as md,
          cast(greatest(2, ceil(additional_capacity / (12e0 * 1.2e0))) as bigint) as ms
          from base)""",
        """options as (
          select *, 'Doctors Only' as approach, d as doctors_added, 0 as nurses_added from needs
          union all select *, 'Nurses Only', 0, nurses_only from needs
          union all select *, 'Mixed Team (Recommended)', md, ms from needs)""",
        select="""select scenario_id, additional_capacity, doctors_now as current_doctors_needed,
            nurses_now as current_nurses_needed, doctors_now + d as total_doctors_needed,
            nurses_now + s as total_nurses_needed,
            cast(round_even(doctors, 0) as bigint) as actual_doctors,
            cast(round_even(nurses, 0) as bigint) as actual_nurses, approach, doctors_added,
            nurses_added, doctors_added * 80000 + nurses_added * 35000 as annual_cost,
            (doctors_added * 80000 + nurses_added * 35000) / 12e0 as monthly_cost
          from options""",
    ),
    "backlog_timeline": _capacity(
        """select specialty, scenario_id, cast(week as int) as week,
             greatest(0, n - week * baseline_capacity) as current_remaining,
             greatest(0, n - week * new_capacity) as new_remaining
           from (select *, unnest(range(1, cast(ceil(n / baseline_capacity) as bigint) + 6)) as week
                 from (select specialty, count(*) as n from scored group by specialty),
                   scenarios)"""
    ),
    "capacity_roi": _over(
        SCORED,
        SCENARIO_ROWS,
        STAFF_BASE,
        """costs as (select *,
          cast(greatest(1, ceil(additional_capacity / (25e0 * 1.5e0))) * 80000
            + greatest(2, ceil(additional_capacity / (12e0 * 1.2e0))) * 35000 as bigint) as staff
          from base)""",
        """net as (select *, additional_capacity * 4 * avg_cost as monthly,
          additional_capacity * 52 * avg_cost as annual,
          additional_capacity * 4 * avg_cost - staff / 12e0 as monthly_net from costs)""",
        select="""select scenario_id, additional_capacity, avg_cost,
            monthly as monthly_revenue, annual as annual_revenue,
            staff as annual_staff_cost, staff / 12e0 as monthly_staff_cost,
            monthly_net as monthly_net_benefit,
            annual - staff as annual_net_benefit,
            case when monthly_net > 0 then staff / monthly_net end as payback_months
          from net""",
    ),
    "classify_questions": _over(
        RAW, QUESTIONS, TYPED, select="select question_id, question, question_type from typed_as"
    ),
    "extract_parameters": _over(
        RAW,
        ASKED,
        select="""select question_id, percentage,
            nullif(array_to_string(number_list, '|'), '') as numbers,
            baseline_capacity, baseline_capacity as weekly_capacity, risk_weight, threshold,
            nullif(array_to_string(specialty_list, '|'), '') as specialties,
            nullif(array_to_string(season_list, '|'), '') as seasons,
            age, age_min, age_max, age_group from parameters""",
    ),
    "route_questions": _over(
        RAW,
        QUESTIONS,
        TYPED,
        ROUTED,
        select="select question_id, question, question_type, report from routed",
    ),
    "route_conversations": _over(
        SAID, TYPED, ROUTED, select="select question_id, question_type, report from routed"
    ),
    "extract_conversations": _over(
        SAID,
        TYPED,
        ROUTED,
        PARAMETERS,
        select="""select question_id, percentage,
            nullif(array_to_string(number_list, '|'), '') as numbers,
            baseline_capacity, risk_weight, threshold,
            nullif(array_to_string(specialty_list, '|'), '') as specialties,
            nullif(array_to_string(season_list, '|'), '') as seasons,
            age, age_min, age_max, age_group from parameters""",
    ),
    "extract_documents": _over(
        WRITTEN,
        TYPED,
        ROUTED,
        PARAMETERS,
        select="""select question_id, percentage,
            nullif(array_to_string([try_cast(floor(x) as bigint) || '+'
              || cast(x - floor(x) as decimal(9, 6)) for x in number_list], '|'), '')
              as numbers,
            baseline_capacity, risk_weight, threshold,
            nullif(array_to_string(specialty_list, '|'), '') as specialties,
            nullif(array_to_string(season_list, '|'), '') as seasons,
            age, age_min, age_max, age_group from parameters""",
    ),
    "route_documents": _over(
        WRITTEN, TYPED, ROUTED, select="select question_id, question_type, report from routed"
    ),
    "answers_by_request": _over(
        SCORED,
        ASKED,
        REQUESTS,
        """keys as (select request, any_value(key) as key, count(*) as asked from (
          select r.request, concat_ws('|', r.report,
            case when len(r.specialties) > 0 then array_to_string(r.specialties, ',') else '-' end,
            case when len(r.seasons) > 0 then array_to_string(r.seasons, ',') else '-' end,
            coalesce(cast(r.low as varchar), '-'), coalesce(cast(r.high as varchar), '-'),
            coalesce(cast(cast(r.percentage as double) as varchar), '-'),
            coalesce(cast(r.baseline as varchar), '-')) as key
          from asked_for a join requests r using (request)) group by request)""",
        select="""select k.key as request, a.report, k.asked, a.key, a.metric, a.value
          from answers a join keys k using (request)""",
    ),
    "answer_questions": _over(
        SCORED,
        ASKED,
        REQUESTS,
        select="""select q.question_id, a.report, a.key, a.metric, a.value
          from asked_for q join answers a using (request)""",
    ),
    "format_answers": _over(
        SCORED,
        ASKED,
        REQUESTS,
        FORMATTED,
        select="""select q.question_id, q.question_type, q.report,
            coalesce(t.answer, 'No results found for this question.') as answer
          from asked_for q left join texts t using (request)""",
    ),
    "onehot_features": _patients(
        f"""select patient_id, cast(gender = 'M' as int) as "gender_M", {ONE_HOT},
             cast(season = 'Spring' as int) as "season_Spring",
             cast(season = 'Summer' as int) as "season_Summer",
             cast(season = 'Winter' as int) as "season_Winter" from patients"""
    ),
}

ORACLE = {name: _expanded(sql) for name, sql in ORACLE.items()}
