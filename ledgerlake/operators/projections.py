"""Portfolio projections (X1-X5): the reference's one-slider calculators as table jobs.

A table of scenarios goes in; yearly (or monthly) schedule rows come out via
``explode(sequence(...))``.  Balances use closed forms of the month-by-month
loops, so every row is an independent expression inside whole-stage codegen:
no iteration, no state, no per-scenario Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the calculators: 4 % withdrawal rule, budget projection
# factor, emergency-fund chart cap and headroom.
WITHDRAWAL_RATE = 0.04
FIVE_YEARS, COMPOUND_FACTOR = 5, 1.05
EMERGENCY_CAP_MONTHS = 36
EMERGENCY_EXTRA_MONTHS = 6
EMERGENCY_CHART_HEADROOM = 1.2


def _growth(r: Column, m: Column) -> Column:
    return F.pow(F.lit(1.0) + r, m)


def _annuity_balance(p: Column, q: Column, r: Column, m: Column) -> Column:
    """Balance after m payments q on principal p at monthly rate r (r = 0 handled)."""
    g = _growth(r, m)
    return F.when(r == 0, p - q * m).otherwise(p * g - q * (g - 1) / r)


def _future_value(p0: Column, c: Column, r: Column, m: Column) -> Column:
    """Value after m months of compounding p0 at r plus c added each month."""
    g = _growth(r, m)
    return F.when(r == 0, p0 + c * m).otherwise(p0 * g + c * (g - 1) / r)


def loan_terms(loans: DataFrame) -> DataFrame:
    """X1 (summary): payment, payoff month, interest with and without the extra payment.

    loans: loan_id, principal, annual_rate (percent), term_years, extra_payment.
    Payoff month k = ceil(-ln(1 - rP/Q) / ln(1 + r)) for payment Q; interest =
    Q(k-1) + B_{k-1}(1+r) - P.  Rate 0 pays P/n a month (the reference divides 0/0).
    """
    p, r, n, extra = F.col("principal").cast("double"), F.col("annual_rate") / 100 / 12, F.col("term_years") * 12, \
        F.col("extra_payment").cast("double")
    g = _growth(r, n)
    m = F.when(r == 0, p / n).otherwise(p * (r * g) / (g - 1))
    base = loans.select("*", r.alias("_r"), n.alias("_n"), m.alias("_m"), (m + extra).alias("_q"))
    r, n, m, q = F.col("_r"), F.col("_n"), F.col("_m"), F.col("_q")
    k_raw = F.when(r == 0, F.ceil(p / q)).otherwise(F.ceil(-F.log(F.lit(1.0) - r * p / q) / F.log(F.lit(1.0) + r)))
    k = F.least(F.greatest(k_raw, F.lit(1)), n)
    with_k = base.withColumn("_k", k)
    k = F.col("_k")

    def total_interest(q_: Column, k_: Column) -> Column:
        prev = _annuity_balance(p, q_, r, k_ - 1)
        return q_ * (k_ - 1) + prev * (F.lit(1.0) + r) - p

    std_int = total_interest(m, n)
    acc_int = total_interest(q, k)
    return with_k.select(
        "loan_id", "principal", "annual_rate", "term_years", "extra_payment",
        F.round(m, 2).alias("monthly_payment"),
        F.round(std_int, 0).alias("total_interest_standard"),
        F.round(acc_int, 0).alias("total_interest_accelerated"),
        F.round(std_int - acc_int, 0).alias("interest_saved"),
        k.cast("bigint").alias("payoff_month"),
        (F.col("term_years") - F.ceil(k / 12)).cast("bigint").alias("years_saved"),
    )


def loan_schedules(loans: DataFrame) -> DataFrame:
    """X1 (schedule): year-end balances and cumulative interest, standard vs with extra payment."""
    t = loan_terms(loans).select("loan_id", "principal", "annual_rate", "term_years", "extra_payment",
                                 "payoff_month")
    p, r = F.col("principal").cast("double"), F.col("annual_rate") / 100 / 12
    n = F.col("term_years") * 12
    g = _growth(r, n)
    m = F.when(r == 0, p / n).otherwise(p * (r * g) / (g - 1))
    q = m + F.col("extra_payment")
    rows = t.select("*", F.explode(F.sequence(F.lit(1), F.col("term_years").cast("int"))).alias("year"))
    month = F.least(F.col("year") * 12, n)
    acc_month = F.least(month, F.col("payoff_month"))
    std_bal = F.greatest(F.lit(0.0), _annuity_balance(p, m, r, month))
    acc_bal = F.when(month >= F.col("payoff_month"), F.lit(0.0)) \
        .otherwise(F.greatest(F.lit(0.0), _annuity_balance(p, q, r, acc_month)))
    # cumulative interest = payments made - principal repaid
    std_int = m * month - (p - _annuity_balance(p, m, r, month))
    acc_prev = _annuity_balance(p, q, r, acc_month - 1)
    acc_int = F.when(month >= F.col("payoff_month"),
                     q * (acc_month - 1) + acc_prev * (F.lit(1.0) + r) - p) \
        .otherwise(q * acc_month - (p - _annuity_balance(p, q, r, acc_month)))
    return rows.select("loan_id", F.col("year").cast("bigint").alias("year"),
                       F.round(std_bal, 0).alias("standard_balance"), F.round(acc_bal, 0).alias("accelerated_balance"),
                       F.round(std_int, 0).alias("standard_interest"), F.round(acc_int, 0).alias("accelerated_interest"))


def savings_projection(plans: DataFrame) -> DataFrame:
    """Value, contributions and interest at each year end (year 0 included)."""
    p0, c = F.col("initial_deposit").cast("double"), F.col("monthly_contribution").cast("double")
    r = F.col("annual_return") / 100 / 12
    rows = plans.select("*", F.explode(F.sequence(F.lit(0), F.col("years").cast("int"))).alias("year"))
    m = F.col("year") * 12
    value = _future_value(p0, c, r, m)
    contrib = p0 + c * m
    return rows.select("plan_id", F.col("year").cast("bigint").alias("year"), F.round(value, 0).alias("total_value"),
                       F.round(contrib, 0).alias("contributions"), F.round(value - contrib, 0).alias("interest_earned"))


# The budget categories in display order.
BUDGET_PARTS = ["housing", "transportation", "food", "savings"]
BUDGET_LABELS = {"housing": "Housing", "transportation": "Transport", "food": "Food", "savings": "Savings"}


def budget_allocation(plans: DataFrame) -> DataFrame:
    """Amount per category and remainder (long form via stack), over-budget flag, projections."""
    inc = F.col("income").cast("double")
    total = sum((F.col(c) for c in BUDGET_PARTS), F.lit(0))
    remaining = F.lit(100) - total
    entries = [F.struct(F.lit(BUDGET_LABELS[c]).alias("name"), F.col(c).cast("double").alias("percent"))
               for c in BUDGET_PARTS] + [F.struct(F.lit("Other").alias("name"), remaining.cast("double").alias("percent"))]
    rows = plans.select("plan_id", "income", "savings", total.alias("total_allocated"),
                        F.explode(F.array(*entries)).alias("e"))
    annual = inc * F.col("savings") / 100 * 12
    return rows.select("plan_id", F.col("e.name").alias("name"), F.col("e.percent").alias("percent"),
                       F.round(inc * F.col("e.percent") / 100, 2).alias("value"),
                       (F.col("total_allocated") > 100).alias("is_over_budget"),
                       F.round(annual, 2).alias("annual_savings"),
                       F.round(annual * FIVE_YEARS * COMPOUND_FACTOR, 2).alias("five_year_projection"))


def retirement_projection(plans: DataFrame) -> DataFrame:
    """Savings at each age until retirement, final balance, 4 % rule monthly income."""
    p0, c = F.col("current_savings").cast("double"), F.col("monthly_contribution").cast("double")
    r = F.col("expected_return") / 100 / 12
    yrs = F.col("retirement_age") - F.col("current_age")
    rows = plans.select("*", F.explode(F.sequence(F.lit(0), yrs.cast("int"))).alias("year"))
    bal = _future_value(p0, c, r, F.col("year") * 12)
    final = _future_value(p0, c, r, yrs * 12)
    return rows.select("plan_id", (F.col("current_age") + F.col("year")).cast("bigint").alias("age"),
                       F.round(bal, 0).alias("savings"), F.round(final, 2).alias("final_balance"),
                       F.round(p0 + c * yrs * 12, 2).alias("total_contributions"),
                       F.round(final * WITHDRAWAL_RATE / 12, 2).alias("monthly_retirement_income"))


def emergency_fund(plans: DataFrame) -> DataFrame:
    """Target, remaining, months to goal (NULL = never), progress, and the capped monthly series."""
    target = F.col("monthly_expenses").cast("double") * F.col("target_months")
    cur, ms = F.col("current_savings").cast("double"), F.col("monthly_savings").cast("double")
    remaining = F.greatest(F.lit(0.0), target - cur)
    months = F.when(ms > 0, F.ceil(remaining / ms))
    horizon = F.coalesce(F.least(months + EMERGENCY_EXTRA_MONTHS, F.lit(EMERGENCY_CAP_MONTHS)),
                         F.lit(EMERGENCY_CAP_MONTHS))
    rows = plans.select("*", target.alias("_t"), remaining.alias("_rem"), months.alias("_months"),
                        F.explode(F.sequence(F.lit(0), horizon.cast("int"))).alias("month"))
    return rows.select("plan_id", F.col("month").cast("bigint").alias("month"),
                       F.round(F.least(cur + F.col("month") * ms, F.col("_t") * EMERGENCY_CHART_HEADROOM), 2)
                       .alias("savings"),
                       F.round("_t", 2).alias("target_amount"), F.round("_rem", 2).alias("remaining"),
                       F.col("_months").cast("bigint").alias("months_to_goal"),
                       F.round(F.when(F.col("_t") > 0, F.least(F.lit(100.0), cur / F.col("_t") * 100))
                               .when(cur > 0, F.lit(100.0)), 4).alias("progress"))
