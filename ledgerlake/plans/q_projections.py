"""Registered projection queries (X1-X5) over the derived scenario tables."""

from __future__ import annotations

from ..operators import projections as PJ
from ..sources import fixtures as X
from .registry import register


def _bal(p: str, q: str, r: str, m: str) -> str:
    m = f"({m})"
    return f"(case when {r} = 0 then {p} - {q} * {m} else {p} * pow(1 + {r}, {m}) - {q} * (pow(1 + {r}, {m}) - 1) / {r} end)"


def _fv(p0: str, c: str, r: str, m: str) -> str:
    m = f"({m})"
    return f"(case when {r} = 0 then {p0} + {c} * {m} else {p0} * pow(1 + {r}, {m}) + {c} * (pow(1 + {r}, {m}) - 1) / {r} end)"


LOAN_K = """select *, least(greatest(case when r = 0 then ceil(principal / q)
    else ceil(-ln(1 - r * principal / q) / ln(1 + r)) end, 1), n) as k
from (select *, m + extra_payment as q
      from (select *, case when r = 0 then principal / n else principal * (r * pow(1 + r, n)) / (pow(1 + r, n) - 1) end as m
            from (select *, annual_rate / 100 / 12 as r, term_years * 12 as n from loans) a) b) c"""


@register("x1_loan_terms", f"""
select loan_id, principal, annual_rate, term_years, extra_payment, round(m, 2) as monthly_payment,
  round(si, 0) as total_interest_standard, round(ai, 0) as total_interest_accelerated, round(si - ai, 0) as interest_saved,
  cast(k as bigint) as payoff_month, cast(term_years - ceil(k / 12) as bigint) as years_saved
from (select *, m * (n - 1) + {_bal('principal', 'm', 'r', 'n - 1')} * (1 + r) - principal as si,
        q * (k - 1) + {_bal('principal', 'q', 'r', 'k - 1')} * (1 + r) - principal as ai from lk) t""",
          ctes=[("lk", LOAN_K)])
def x1(spark, d):
    return PJ.loan_terms(X.loans(spark, d))


@register("x1b_loan_schedules", f"""
select loan_id, cast(year as bigint) as year,
  round(greatest(0.0, {_bal('principal', 'm', 'r', 'mo')}), 0) as standard_balance,
  round(case when mo >= k then 0.0 else greatest(0.0, {_bal('principal', 'q', 'r', 'am')}) end, 0) as accelerated_balance,
  round(m * mo - (principal - {_bal('principal', 'm', 'r', 'mo')}), 0) as standard_interest,
  round(case when mo >= k then q * (am - 1) + {_bal('principal', 'q', 'r', 'am - 1')} * (1 + r) - principal
    else q * am - (principal - {_bal('principal', 'q', 'r', 'am')}) end, 0) as accelerated_interest
from (select *, least(mo, k) as am from (select *, least(year * 12, n) as mo
      from (select *, unnest(generate_series(1, term_years)) as year from lk) y) z) w""", ctes=[("lk", LOAN_K)])
def x1b(spark, d):
    return PJ.loan_schedules(X.loans(spark, d))


@register("x2_savings_projection", f"""
select plan_id, cast(year as bigint) as year, round(v, 0) as total_value, round(c, 0) as contributions,
  round(v - c, 0) as interest_earned
from (select plan_id, year, {_fv('initial_deposit', 'monthly_contribution', 'r', 'year * 12')} as v,
        initial_deposit + monthly_contribution * (year * 12) as c
      from (select *, annual_return / 100 / 12 as r, unnest(generate_series(0, years)) as year from savings_plans) s) t""")
def x2(spark, d):
    return PJ.savings_projection(X.savings_plans(spark, d))


@register("x3_budget_allocation", """
select plan_id, e.name as name, e.percent as percent, round(income * e.percent / 100, 2) as value,
  total_allocated > 100 as is_over_budget, round(income * savings / 100 * 12, 2) as annual_savings,
  round(income * savings / 100 * 12 * 5 * 1.05, 2) as five_year_projection
from (select *, housing + transportation + food + savings as total_allocated,
        unnest([{'name': 'Housing', 'percent': cast(housing as double)},
                {'name': 'Transport', 'percent': cast(transportation as double)},
                {'name': 'Food', 'percent': cast(food as double)},
                {'name': 'Savings', 'percent': cast(savings as double)},
                {'name': 'Other', 'percent': cast(100 - (housing + transportation + food + savings) as double)}]) as e
      from budget_plans) b""")
def x3(spark, d):
    return PJ.budget_allocation(X.budget_plans(spark, d))


@register("x4_retirement_projection", f"""
select plan_id, cast(current_age + year as bigint) as age,
  round({_fv('current_savings', 'monthly_contribution', 'r', 'year * 12')}, 0) as savings,
  round({_fv('current_savings', 'monthly_contribution', 'r', 'yrs * 12')}, 2) as final_balance,
  round(current_savings + monthly_contribution * yrs * 12, 2) as total_contributions,
  round({_fv('current_savings', 'monthly_contribution', 'r', 'yrs * 12')} * 0.04 / 12, 2) as monthly_retirement_income
from (select *, unnest(generate_series(0, yrs)) as year
      from (select *, expected_return / 100 / 12 as r, retirement_age - current_age as yrs from retirement_plans) a) b""")
def x4(spark, d):
    return PJ.retirement_projection(X.retirement_plans(spark, d))


@register("x5_emergency_fund", """
select plan_id, cast(month as bigint) as month, round(least(cur + month * ms, t * 1.2), 2) as savings,
  round(t, 2) as target_amount, round(rem, 2) as remaining, cast(months as bigint) as months_to_goal,
  round(case when t > 0 then least(100.0, cur / t * 100) when cur > 0 then 100.0 end, 4) as progress
from (select *, unnest(generate_series(0, cast(coalesce(least(months + 6, 36), 36) as bigint))) as month
      from (select *, case when ms > 0 then ceil(rem / ms) end as months
            from (select plan_id, monthly_expenses * target_months as t, current_savings as cur, monthly_savings as ms,
                    greatest(0.0, monthly_expenses * target_months - current_savings) as rem
                  from emergency_plans) a) b) c""")
def x5(spark, d):
    return PJ.emergency_fund(X.emergency_plans(spark, d))
