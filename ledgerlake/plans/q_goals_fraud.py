"""Registered goal and fraud queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.common import sql_ts, time_range
from ..operators import banking as B
from ..operators import fraud as FR
from ..operators import goals as G
from ..sources import fixtures as X
from .registry import register

AS_OF = X.BANK_AS_OF
SINCE30 = AS_OF - timedelta(days=30)
S3, E = time_range("last_3_months", AS_OF)

LINKED = """(select n.u, n.name, n.linked_id, a.balance as bal
  from (select user_id as u, name, min(account_id) as linked_id from accounts group by 1, 2) n
  join accounts a on a.account_id = n.linked_id)"""


A14_SQL = f"""
select goal_id, user_id, round(cast(cur as double), 2) as current_amount, round(cast(target_amount as double), 2) as target_amount,
  round(case when target_amount > 0 then least(100.0, cast(cur as double) / cast(target_amount as double) * 100) else 0.0 end, 1)
    as progress_percent,
  round(cast(greatest(0, target_amount - cur) as double), 2) as remaining,
  coalesce(linked_account_name, 'All Savings') as account_name,
  round(cast(case when linked_account_name is not null and linked_id is not null then coalesce(contrib, 0) else 0 end as double), 2)
    as recent_contributions
from (select g.*, l.linked_id, c.contrib,
        case when g.linked_account_name is not null then coalesce(l.bal, 0) else coalesce(s.tot, 0) end as cur
      from goals g
      left join {LINKED} l on l.u = g.user_id and l.name = g.linked_account_name
      left join (select user_id, sum(balance) as tot from accounts where account_type = 'savings' group by 1) s
        on s.user_id = g.user_id
      left join (select to_account_id, sum(amount) as contrib from transactions
                 where type in ('deposit', 'transfer') and created_at between {sql_ts(SINCE30)} and {sql_ts(AS_OF)}
                 group by 1) c on c.to_account_id = l.linked_id
      where g.goal_type = 'savings') x"""


@register("a14_goal_savings", A14_SQL)
def a14(spark, d):
    return G.goal_savings(X.goals(spark, d), X.accounts(spark, d), X.transactions(spark, d), AS_OF)


A15_SQL = f"""
select goal_id, user_id, round(cast(cur as double), 2) as current_debt, round(cast(original_debt as double), 2) as original_debt,
  round(cast(greatest(0, original_debt - cur) as double), 2) as amount_paid,
  round(case when original_debt > 0 then least(100.0, cast(greatest(0, original_debt - cur) as double)
    / cast(original_debt as double) * 100) else 0.0 end, 1) as progress_percent,
  coalesce(linked_account_name, 'All Credit') as account_name
from (select g.*, case when g.linked_account_name is not null then coalesce(abs(l.bal), 0) else coalesce(s.tot, 0) end as cur
      from goals g
      left join {LINKED} l on l.u = g.user_id and l.name = g.linked_account_name
      left join (select user_id, sum(abs(balance)) as tot from accounts where account_type = 'credit' group by 1) s
        on s.user_id = g.user_id
      where g.goal_type = 'debt_payoff') x"""


@register("a15_goal_debt", A15_SQL)
def a15(spark, d):
    return G.goal_debt(X.goals(spark, d), X.accounts(spark, d))


SPEND_CAT = f"""(select a.user_id, t.category, sum(t.amount) as s from transactions t
  join accounts a on t.from_account_id = a.account_id
  where t.type = 'payment' and t.created_at between {sql_ts(S3)} and {sql_ts(E)} group by 1, 2)"""


A16_SQL = f"""
select goal_id, user_id, round(cast(spent as double), 2) as current_spending,
  round(cast(spending_limit as double), 2) as spending_limit,
  round(cast(greatest(0, spending_limit - spent) as double), 2) as remaining,
  round(case when spending_limit > 0 then least(100.0, cast(spent as double) / cast(spending_limit as double) * 100)
    else 0.0 end, 1) as progress_percent,
  coalesce(category, 'All Categories') as category, spent > spending_limit as is_over_budget
from (select g.*, case when g.category is not null then coalesce(c.s, 0) else coalesce(u.s, 0) end as spent
      from goals g
      left join (select user_id, sum(s) as s from {SPEND_CAT} sc group by 1) u on u.user_id = g.user_id
      left join {SPEND_CAT} c on c.user_id = g.user_id and c.category = g.category
      where g.goal_type = 'spending_limit') x"""


@register("a16_goal_spending_limit", A16_SQL)
def a16(spark, d):
    return G.goal_spending_limit(X.goals(spark, d), X.transactions(spark, d), X.accounts(spark, d), AS_OF,
                                 "last_3_months")


def _all_progress(spark, d):
    goals, acc, tx = X.goals(spark, d), X.accounts(spark, d), X.transactions(spark, d)
    cols = ["goal_id", "user_id", "progress_percent"]
    return (G.goal_savings(goals, acc, tx, AS_OF).select(*cols)
            .unionByName(G.goal_debt(goals, acc).select(*cols))
            .unionByName(G.goal_spending_limit(goals, tx, acc, AS_OF, "last_3_months").select(*cols)))


def _strip(sql: str) -> str:
    return sql.strip()


@register("a17_goal_status", f"""
select p.goal_id, p.user_id, g.goal_type, p.progress_percent,
  case when g.deadline is not null then
    cast(ceil((epoch(cast(g.deadline as timestamp)) - epoch({sql_ts(AS_OF)})) / 86400.0) as bigint) end as days_remaining,
  case when g.goal_type = 'spending_limit' then
         case when p.progress_percent >= 100 then 'red' when p.progress_percent >= 80 then 'amber' else 'green' end
       else case when p.progress_percent >= 100 then 'green' when p.progress_percent >= 50 then 'blue' else 'indigo' end
  end as band
from (select goal_id, user_id, progress_percent from ({_strip(A14_SQL)}) s
      union all select goal_id, user_id, progress_percent from ({_strip(A15_SQL)}) t
      union all select goal_id, user_id, progress_percent from ({_strip(A16_SQL)}) u) p
join goals g on g.goal_id = p.goal_id""")
def a17(spark, d):
    return G.goal_status(_all_progress(spark, d), X.goals(spark, d), AS_OF)


# ---------------------------------------------------------------- fraud on timed transactions
TAS = X.TIMED_AS_OF
P7 = FR.FraudParams(lookback_days=7, amount_floor=100.0)
P30 = FR.FraudParams(lookback_days=30, amount_floor=100.0, rapid_bucket="hour", round_unit=10)


def _fw(p: FR.FraudParams) -> str:
    s, e = p.window(TAS)
    return (f"select * from timed_transactions where status = 'completed' "
            f"and created_at between {sql_ts(s)} and {sql_ts(e)}")


def _findings_sql(p: FR.FraudParams, which=("UNUSUAL_AMOUNT", "RAPID_TRANSACTIONS", "UNUSUAL_TIME", "ROUND_AMOUNT")) -> str:
    parts = {
        "UNUSUAL_AMOUNT": f"""select user_id, 'UNUSUAL_AMOUNT' as type, id as transaction_id, round(cast(amount as double), 2) as amount,
  created_at as event_at, strftime(created_at, '%Y-%m-%d %H:%M') as time, description, 2 as risk_points, cast(null as bigint) as count,
  0 as check_order
from fw join (select user_id as u, sum(amount) as s, count(*) as n from fw group by 1) st on st.u = fw.user_id
where amount * n > s * {p.amount_multiple} and amount > {p.amount_floor}""",
        "RAPID_TRANSACTIONS": f"""select user_id, 'RAPID_TRANSACTIONS' as type, cast(null as bigint) as transaction_id,
  round(cast(sum(amount) as double), 2) as amount, date_trunc('{p.rapid_bucket}', created_at) as event_at,
  strftime(date_trunc('{p.rapid_bucket}', created_at), '%Y-%m-%d %H:%M') as time, cast(null as varchar) as description,
  3 as risk_points, count(*) as count, 1 as check_order
from fw group by user_id, date_trunc('{p.rapid_bucket}', created_at) having count(*) >= {p.rapid_min}""",
        "UNUSUAL_TIME": f"""select user_id, 'UNUSUAL_TIME' as type, id as transaction_id, round(cast(amount as double), 2) as amount,
  created_at as event_at, strftime(created_at, '%Y-%m-%d %H:%M') as time, description, 1 as risk_points, cast(null as bigint) as count,
  2 as check_order
from fw where (hour(created_at) >= {p.night_start} or hour(created_at) <= {p.night_end}) and amount > {p.night_amount}""",
        "ROUND_AMOUNT": f"""select user_id, 'ROUND_AMOUNT' as type, id as transaction_id, round(cast(amount as double), 2) as amount,
  created_at as event_at, strftime(created_at, '%Y-%m-%d') as time, description, 1 as risk_points, cast(null as bigint) as count,
  3 as check_order
from fw where amount >= {p.round_min} and amount % {p.round_unit} = 0""",
    }
    return "\nunion all\n".join(parts[w] for w in which)


def _timed(spark, d, p):
    return FR.in_window(X.timed_transactions(spark, d), TAS, p)


@register("a18_fraud_unusual_amount", _findings_sql(P7, ["UNUSUAL_AMOUNT"]).replace(", cast(null as bigint) as count,\n  0 as check_order", ""),
          ctes=[("fw", _fw(P7))])
def a18(spark, d):
    return FR.fraud_unusual_amount(_timed(spark, d, P7), P7)


@register("a19_fraud_rapid", _findings_sql(P30, ["RAPID_TRANSACTIONS"]).replace(", 1 as check_order", ""),
          ctes=[("fw", _fw(P30))])
def a19(spark, d):
    return FR.fraud_rapid(_timed(spark, d, P30), P30)


@register("a20_fraud_unusual_time", _findings_sql(P7, ["UNUSUAL_TIME"]).replace(", cast(null as bigint) as count,\n  2 as check_order", ""),
          ctes=[("fw", _fw(P7))])
def a20(spark, d):
    return FR.fraud_unusual_time(_timed(spark, d, P7), P7)


@register("a21_fraud_round_amount", _findings_sql(P30, ["ROUND_AMOUNT"]).replace(", cast(null as bigint) as count,\n  3 as check_order", ""),
          ctes=[("fw", _fw(P30))])
def a21(spark, d):
    return FR.fraud_round_amount(_timed(spark, d, P30), P30)


def _reasons_sql(p: FR.FraudParams, columns: str) -> str:
    """``ff`` with the reason of each finding; the mean is in ``st``."""
    r = FR.REASONS
    return f"""select {columns}, case ff.type
  when 'UNUSUAL_AMOUNT' then 'Amount $' || cast(cast(ff.amount as decimal(18,2)) as varchar) || ' is {p.amount_multiple}x higher than your average $'
    || cast(cast(st.average_amount as decimal(18,2)) as varchar)
  when 'RAPID_TRANSACTIONS' then cast(ff.count as varchar) || ' {r["RAPID_TRANSACTIONS"]}'
  when 'UNUSUAL_TIME' then '{r["UNUSUAL_TIME"]}' else '{r["ROUND_AMOUNT"]}' end as reason
from ff join st on st.user_id = ff.user_id"""


@register("u1_fraud_findings", _reasons_sql(P30, "ff.*"),
          ctes=[("fw", _fw(P30)), ("ff", _findings_sql(P30)), ("st", """select user_id, round(avg(cast(amount as double)), 2) as average_amount
from fw group by 1""")])
def u1(spark, d):
    return FR.fraud_findings(_timed(spark, d, P30), P30)


def _report_sql(p: FR.FraudParams, users_sql: str | None = None) -> str:
    rec = FR.RECOMMENDATIONS
    days = min(max(1, p.lookback_days), 30)
    base = (f"({users_sql}) uu left join st on st.user_id = uu.user_id" if users_sql
            else "st")
    uid = "uu.user_id" if users_sql else "st.user_id"
    return f"""select {uid} as user_id, coalesce(sc.score, 0) as risk_score,
  case when coalesce(sc.score, 0) >= 10 then 'HIGH' when coalesce(sc.score, 0) >= 5 then 'MEDIUM'
       when coalesce(sc.score, 0) > 0 then 'LOW' else 'NONE' end as risk_level,
  case when coalesce(sc.score, 0) >= 10 then '{rec["HIGH"]}' when coalesce(sc.score, 0) >= 5 then '{rec["MEDIUM"]}'
       when coalesce(sc.score, 0) > 0 then '{rec["LOW"]}' else '{rec["NONE"]}' end as recommendation,
  '{days} days' as period_analyzed,
  coalesce(sc.cnt, 0) as suspicious_count, coalesce(ft.findings, '') as findings,
  st.average_amount, st.highest_amount, coalesce(st.transaction_count, 0) as transaction_count,
  case when st.transaction_count is null then '{FR.NO_TRANSACTIONS}' end as message
from {base}
left join (select user_id, cast(sum(risk_points) as bigint) as score, count(*) as cnt from ff group by 1) sc
  on sc.user_id = {uid}
left join (select user_id, string_agg(k, ',' order by r) as findings from (
    select user_id, type || ':' || coalesce(cast(transaction_id as varchar), time) as k,
      row_number() over (partition by user_id order by check_order, event_at desc, transaction_id asc nulls last) as r
    from ff) z where r <= 10 group by 1) ft on ft.user_id = {uid}"""


ST_SQL = """select user_id, round(avg(cast(amount as double)), 2) as average_amount,
  round(cast(max(amount) as double), 2) as highest_amount, count(*) as transaction_count from fw group by 1"""


def _with_keys(report):
    """Findings as type:transaction (rapid ones: their time), one text per report."""
    key = lambda f: F.concat_ws(":", f["type"], F.coalesce(f["transaction_id"].cast("string"), f["time"]))
    return report.withColumn("findings", F.array_join(F.transform("findings", key), ","))


@register("a22_fraud_report", _report_sql(P30),
          ctes=[("fw", _fw(P30)), ("ff", _findings_sql(P30)), ("st", ST_SQL)])
def a22(spark, d):
    return _with_keys(FR.fraud_report(X.timed_transactions(spark, d), TAS, P30))


@register("a22c_fraud_report_details", f"""select user_id, type, transaction_id, amount, time, description, count, reason, risk_points,
  cast(row_number() over (partition by user_id order by check_order, event_at desc, transaction_id asc nulls last) as int) as position
from ({_reasons_sql(P30, "ff.*")}) z
qualify position <= 10""", ctes=[("fw", _fw(P30)), ("ff", _findings_sql(P30)), ("st", ST_SQL)])
def a22c(spark, d):
    """The findings that the reports hold, with their details and reasons."""
    return FR.report_findings(FR.fraud_report(X.timed_transactions(spark, d), TAS, P30))


PB = FR.FraudParams(lookback_days=30)
SB, EB = PB.window(AS_OF)


@register("a22b_fraud_report_bank", _report_sql(PB, "select distinct user_id from accounts"), ctes=[
    ("fw", f"""select t.*, a.user_id from transactions t join accounts a on t.from_account_id = a.account_id
where t.status = 'completed' and t.created_at between {sql_ts(SB)} and {sql_ts(EB)}"""),
    ("ff", _findings_sql(PB)), ("st", ST_SQL)])
def a22b(spark, d):
    """Every user with accounts; users without completed transactions in the window get the NONE row."""
    acc = X.accounts(spark, d)
    scoped = B.user_scope(X.transactions(spark, d), acc, "from")
    return _with_keys(FR.fraud_report(scoped, AS_OF, PB, users=acc.select("user_id")))
