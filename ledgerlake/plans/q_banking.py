"""Registered money-analytics queries."""

from __future__ import annotations

from datetime import datetime

from dateutil.relativedelta import relativedelta
from pyspark.sql import functions as F

from ..functions.common import largest_period, money, sql_month_spine, sql_ts, summary_period, time_range
from ..operators import banking as B
from ..sources import fixtures as X
from .registry import register

AS_OF = X.BANK_AS_OF
S6, E = time_range("last_6_months", AS_OF)
S3, _ = time_range("last_3_months", AS_OF)
FM6 = datetime(S6.year, S6.month, 1)
SPINE6 = sql_month_spine(S6, E)
M0 = datetime(AS_OF.year, AS_OF.month, 1)
SY, _ = summary_period("this year", AS_OF)
SL, _ = largest_period("all time", AS_OF)
M_FIRST6 = M0 - relativedelta(months=5)
M_PREV = M0 - relativedelta(months=1)


def _tx_acc(spark, d):
    return X.transactions(spark, d), X.accounts(spark, d)


PAY_FROM = "transactions t join accounts a on t.from_account_id = a.account_id"
EITHER = ("(select distinct t.*, a.user_id from transactions t join accounts a "
          "on a.account_id = t.from_account_id or a.account_id = t.to_account_id)")
USERS = "(select distinct user_id from accounts)"


@register("a1_spending_by_category", f"""
select a.user_id, coalesce(nullif(t.category, ''), 'Uncategorized') as name, round(cast(sum(t.amount) as double), 2) as value
from {PAY_FROM}
where t.type = 'payment' and t.created_at between {sql_ts(S6)} and {sql_ts(E)}
group by a.user_id, t.category""")
def a1(spark, d):
    return B.spending_by_category(*_tx_acc(spark, d), AS_OF, "last_6_months")


@register("a2_monthly_trend", f"""
select u.user_id, m.month, strftime(m.month, '%b %Y') as name, round(cast(coalesce(s.v, 0) as double), 2) as value
from {USERS} u cross join {SPINE6} m
left join (select a.user_id, date_trunc('month', t.created_at) as month, sum(t.amount) as v from {PAY_FROM}
           where t.type = 'payment' and t.created_at between {sql_ts(FM6)} and {sql_ts(E)} group by 1, 2) s
  on s.user_id = u.user_id and s.month = m.month""")
def a2(spark, d):
    return B.monthly_trend(*_tx_acc(spark, d), AS_OF, "last_6_months")


@register("a3_monthly_income_expenses", f"""
select u.user_id, m.month, strftime(m.month, '%b %Y') as name,
  round(cast(coalesce(s.inc, 0) as double), 2) as income, round(cast(coalesce(s.exp, 0) as double), 2) as expenses
from {USERS} u cross join {SPINE6} m
left join (select a.user_id, date_trunc('month', t.created_at) as month,
             sum(case when t.type = 'deposit' then t.amount end) as inc, sum(case when t.type = 'payment' then t.amount end) as exp
           from transactions t join accounts a
             on a.account_id = case when t.type = 'deposit' then t.to_account_id else t.from_account_id end
           where t.type in ('deposit', 'payment') and t.created_at between {sql_ts(FM6)} and {sql_ts(E)} group by 1, 2) s
  on s.user_id = u.user_id and s.month = m.month""")
def a3(spark, d):
    return B.monthly_income_expenses(*_tx_acc(spark, d), AS_OF, "last_6_months")


@register("a4_account_balances", """
select user_id, account_id, name, round(cast(balance as double), 2) as value, account_type as type from accounts""")
def a4(spark, d):
    return B.account_balances(X.accounts(spark, d))


@register("a5_top_merchants", f"""
select user_id, rank, coalesce(nullif(description, ''), 'Unknown') as name, round(cast(value as double), 2) as value, transactions
from (select a.user_id, t.description, sum(t.amount) as value, count(t.id) as transactions,
        row_number() over (partition by a.user_id order by sum(t.amount) desc, t.description asc nulls last) as rank
      from {PAY_FROM} where t.type = 'payment' and t.created_at between {sql_ts(S6)} and {sql_ts(E)}
      group by a.user_id, t.description) x
where rank <= 10""")
def a5(spark, d):
    return B.top_merchants(*_tx_acc(spark, d), AS_OF, "last_6_months", limit=10)


@register("a6_daily_spending", f"""
select a.user_id, cast(t.created_at as date) as date, strftime(cast(t.created_at as date), '%Y-%m-%d') as name,
  round(cast(sum(t.amount) as double), 2) as value
from {PAY_FROM} where t.type = 'payment' and t.created_at between {sql_ts(S3)} and {sql_ts(E)}
group by 1, 2""")
def a6(spark, d):
    return B.daily_spending(*_tx_acc(spark, d), AS_OF, "last_3_months")


@register("a7_category_trend", f"""
select g.user_id, g.month, strftime(g.month, '%b %Y') as name, g.category, round(cast(coalesce(s.v, 0) as double), 2) as value
from (select c.user_id, c.category, m.month
      from (select user_id, category from (
              select a.user_id, t.category,
                row_number() over (partition by a.user_id order by sum(t.amount) desc, t.category asc nulls first) as rk
              from {PAY_FROM} where t.type = 'payment' and t.created_at between {sql_ts(S6)} and {sql_ts(E)}
              group by a.user_id, t.category) r
            where rk <= 5 and category is not null and category <> '') c cross join {SPINE6} m) g
left join (select a.user_id, t.category, date_trunc('month', t.created_at) as month, sum(t.amount) as v
           from {PAY_FROM} where t.type = 'payment' and t.created_at between {sql_ts(FM6)} and {sql_ts(E)} group by 1, 2, 3) s
  on s.user_id = g.user_id and s.category = g.category and s.month = g.month""")
def a7(spark, d):
    return B.category_trend(*_tx_acc(spark, d), AS_OF, "last_6_months")


@register("a8_transactions_summary", f"""
select u.user_id, round(cast(coalesce(p.total, 0) as double), 2) as total_spending,
  coalesce(p.n_categories, 0) as n_categories, coalesce(p.top_categories, '') as top_categories,
  coalesce(p.top_amounts, '') as top_amounts,
  'All Accounts' as account_filter,
  case when p.total is null then 'You have no spending for the period ''this year'' in account ''All Accounts''.' end as message
from {USERS} u left join (
  select user_id, sum(amount) as total, count(*) as n_categories,
    string_agg(case when rk <= 3 then coalesce(nullif(category, ''), 'Uncategorized') end, ',' order by rk) as top_categories,
    string_agg(case when rk <= 3 then cast(cast(amount as decimal(38,2)) as varchar) end, ',' order by rk) as top_amounts
  from (select a.user_id, t.category, sum(t.amount) as amount,
          row_number() over (partition by a.user_id order by sum(t.amount) desc, t.category asc nulls first) as rk
        from {PAY_FROM} where t.type = 'payment' and t.created_at between {sql_ts(SY)} and {sql_ts(E)}
        group by a.user_id, t.category) r
  group by user_id) p on p.user_id = u.user_id""")
def a8(spark, d):
    return B.transactions_summary(*_tx_acc(spark, d), AS_OF, "this year")


@register("a9_balance_overview", """
select user_id, round(cast(sum(balance) as double), 2) as net_worth, count(*) as n_accounts from accounts group by user_id""")
def a9(spark, d):
    return B.balance_overview(X.accounts(spark, d))


@register("a10_current_month_spending", f"""
select u.user_id, round(cast(coalesce(s.v, 0) as double), 2) as monthly_spending
from {USERS} u left join (select user_id, sum(amount) as v from {EITHER} e
  where type = 'payment' and created_at between {sql_ts(M0)} and {sql_ts(E)} group by user_id) s on s.user_id = u.user_id""")
def a10(spark, d):
    return B.current_month_spending(*_tx_acc(spark, d), AS_OF)


@register("a11_six_month_cashflow", f"""
select u.user_id, m.month, strftime(m.month, '%b') as name,
  round(cast(coalesce(s.inc, 0) as double), 2) as income, round(cast(coalesce(s.exp, 0) as double), 2) as expenses,
  round(cast(coalesce(s.inc, 0) - coalesce(s.exp, 0) as double), 2) as net
from {USERS} u cross join {sql_month_spine(M_FIRST6, E)} m
left join (select user_id, date_trunc('month', created_at) as month,
             sum(case when type = 'deposit' then amount end) as inc, sum(case when type = 'payment' then amount end) as exp
           from {EITHER} e where type in ('deposit', 'payment') and created_at between {sql_ts(M_FIRST6)} and {sql_ts(E)}
           group by 1, 2) s on s.user_id = u.user_id and s.month = m.month""")
def a11(spark, d):
    return B.six_month_cashflow(*_tx_acc(spark, d), AS_OF)


@register("a12_financial_insights", f"""
select c.user_id, c.income, c.expenses, c.savings_rate,
  case when c.savings_rate > 20 then 'Excellent' when c.savings_rate > 10 then 'Good' else 'Needs Improvement' end as rating,
  case when c.expenses > c.income * 0.8 then 'Consider reducing expenses' else 'On track' end as budget,
  tc.category as top_category, round(cast(tc.amount as double), 2) as top_category_amount
from (select user_id, income, expenses,
        round(case when income > 0 then (income - expenses) / income * 100 else 0.0 end, 6) as savings_rate
      from (select u.user_id, round(cast(coalesce(s.inc, 0) as double), 2) as income,
              round(cast(coalesce(s.exp, 0) as double), 2) as expenses
            from {USERS} u left join (select user_id, sum(case when type = 'deposit' then amount end) as inc,
                sum(case when type = 'payment' then amount end) as exp from {EITHER} e
                where type in ('deposit', 'payment') and created_at between {sql_ts(M0)} and {sql_ts(E)} group by user_id) s
              on s.user_id = u.user_id) i) c
left join (select user_id, category, amount from (
    select user_id, category, sum(amount) as amount,
      row_number() over (partition by user_id order by sum(amount) desc, category asc nulls first) as rk
    from {EITHER} e where type = 'payment' group by user_id, category) r where rk = 1) tc on tc.user_id = c.user_id""")
def a12(spark, d):
    return B.financial_insights(*_tx_acc(spark, d), AS_OF)


@register("a13_totals_by_type", f"""
select user_id,
  round(cast(coalesce(sum(case when type = 'deposit' then amount end), 0) as double), 2) as total_income,
  round(cast(coalesce(sum(case when type = 'payment' then amount end), 0) as double), 2) as total_expenses,
  round(cast(coalesce(sum(case when type = 'transfer' then amount end), 0) as double), 2) as total_transfers
from {EITHER} e group by user_id""")
def a13(spark, d):
    return B.totals_by_type(*_tx_acc(spark, d))


@register("p7_user_transactions", f"""
select user_id, id, from_account_id, to_account_id, round(cast(amount as double), 2) as amount, type, description,
  category, status, created_at from {EITHER} e""")
def p7(spark, d):
    ut = B.user_transactions(*_tx_acc(spark, d))
    return ut.select("user_id", "id", "from_account_id", "to_account_id", money("amount").alias("amount"), "type",
                     "description", "category", "status", "created_at")


@register("p8_search_transactions", f"""
select user_id, id, description, category, type, round(cast(amount as double), 2) as amount from {EITHER} e
where (contains(lower(coalesce(description, '')), 'merchant 1') or contains(lower(coalesce(category, '')), 'merchant 1'))
  and type = 'payment'""")
def p8(spark, d):
    ut = B.user_transactions(*_tx_acc(spark, d))
    r = B.search_transactions(ut, "Merchant 1", tx_type="payment")
    return r.select("user_id", "id", "description", "category", "type", money("amount").alias("amount"))


@register("p9_facets", f"""
select distinct user_id, 'category' as facet, category as value from {EITHER} e
union
select distinct user_id, 'type' as facet, type as value from {EITHER} e2""")
def p9(spark, d):
    return B.facets(B.user_transactions(*_tx_acc(spark, d)))


@register("j8_with_account_names", """
select t.id, coalesce(fa.name, 'External') as from_account, coalesce(ta.name, 'External') as to_account
from transactions t left join accounts fa on fa.account_id = t.from_account_id
left join accounts ta on ta.account_id = t.to_account_id""")
def j8(spark, d):
    return B.with_account_names(*_tx_acc(spark, d)).select("id", "from_account", "to_account")


@register("t3_largest_transaction", f"""
select u.user_id, y.transaction_id, y.amount, y.date, y.description, y.category, y.type, y.from_account, y.to_account,
  y.status, case when y.transaction_id is null then 'No transactions found for the specified criteria' end as message
from {USERS} u left join (
select x.user_id, x.id as transaction_id, round(cast(x.amount as double), 2) as amount,
  strftime(x.created_at, '%Y-%m-%d') as date, x.description, x.category, x.type,
  coalesce(fa.name, 'External') as from_account, coalesce(ta.name, 'External') as to_account, x.status
from (select t.*, a.user_id, row_number() over (partition by a.user_id order by t.amount desc, t.id asc) as rk
      from {PAY_FROM} where t.created_at between {sql_ts(SL)} and {sql_ts(E)}) x
left join accounts fa on fa.account_id = x.from_account_id
left join accounts ta on ta.account_id = x.to_account_id
where x.rk = 1) y on y.user_id = u.user_id""")
def t3(spark, d):
    return B.largest_transaction(*_tx_acc(spark, d), AS_OF, "all time")


@register("t4_recent_transactions", f"""
select user_id, rank, id, created_at, description, category, type,
  round(cast(case when type = 'payment' then -amount else amount end as double), 2) as signed_amount
from (select e.*, row_number() over (partition by user_id order by created_at desc, id desc) as rank from {EITHER} e) r
where rank <= 5""")
def t4(spark, d):
    return B.recent_transactions(*_tx_acc(spark, d), k=5)


@register("t5_top_categories", f"""
select user_id, rank, category, round(cast(amount as double), 2) as amount
from (select user_id, category, sum(amount) as amount,
        row_number() over (partition by user_id order by sum(amount) desc, category asc nulls first) as rank
      from {EITHER} e where type = 'payment' group by user_id, category) r where rank <= 6""")
def t5(spark, d):
    return B.top_categories(*_tx_acc(spark, d), k=6)


@register("a40_spending_insight", f"""
select j.user_id, coalesce(nullif(j.category, ''), 'Uncategorized') as category, round(cast(j.cur as double), 2) as amount,
  round(cast(j.cur / t.tot * 100 as double), 4) as percentage,
  case when j.cur > coalesce(j.prev, 0) then 'up' when j.cur < coalesce(j.prev, 0) then 'down' else 'stable' end as trend
from (select a.user_id, t.category,
        sum(case when t.created_at >= {sql_ts(M0)} then t.amount end) as cur,
        sum(case when t.created_at < {sql_ts(M0)} then t.amount end) as prev
      from {PAY_FROM} where t.type = 'payment' and t.created_at between {sql_ts(M_PREV)} and {sql_ts(E)}
      group by 1, 2) j
join (select a.user_id, sum(t.amount) as tot from {PAY_FROM}
      where t.type = 'payment' and t.created_at between {sql_ts(M0)} and {sql_ts(E)} group by 1) t on t.user_id = j.user_id
where j.cur is not null""")
def a40(spark, d):
    return B.spending_insight(*_tx_acc(spark, d), AS_OF)


TRANSFER_REQ = """select a.user_id, t.id, a.name as from_account_name, b.name as to_account_name, t.amount
from transactions t join accounts a on t.from_account_id = a.account_id
left join accounts b on t.to_account_id = b.account_id where t.type = 'transfer'"""


@register("p18_validate_transfers", """
select r.user_id, r.id, r.from_account_name, r.to_account_name, round(cast(r.amount as double), 2) as amount,
  case when m.msg is null then 'success' else 'error' end as status, coalesce(m.msg, 'Transfer successful') as message
from req r join (
  select r.id, r.user_id, case
    when r.from_account_name is null or r.to_account_name is null or r.amount <= 0 then 'Missing required transfer details.'
    when f.name is null then 'Account ''' || r.from_account_name || ''' not found.'
    when f.bal < r.amount then 'Insufficient funds.'
    when g.name is null then 'Recipient account ''' || r.to_account_name || ''' not found.' end as msg
  from req r
  left join (select user_id, name, min(balance) as bal from accounts group by 1, 2) f
    on f.user_id = r.user_id and f.name = r.from_account_name
  left join (select distinct user_id, name from accounts) g on g.user_id = r.user_id and g.name = r.to_account_name) m
  on m.id = r.id and m.user_id = r.user_id""", ctes=[("req", TRANSFER_REQ)])
def p18(spark, d):
    tx, acc = _tx_acc(spark, d)
    t = tx.filter(F.col("type") == "transfer")
    fa = acc.select(F.col("account_id").alias("_f"), "user_id", F.col("name").alias("from_account_name"))
    ta = acc.select(F.col("account_id").alias("_t"), F.col("name").alias("to_account_name"))
    req = (t.join(fa, t["from_account_id"] == fa["_f"]).join(ta, t["to_account_id"] == ta["_t"], "left")
            .select("user_id", "id", "from_account_name", "to_account_name", "amount"))
    out = B.validate_transfers(req, acc)
    return out.withColumn("amount", money("amount"))


@register("a33_net_cash_flow", """
select a.user_id, round(cast(sum(coalesce(i.v, 0)) as double), 2) as inflow,
  round(cast(sum(coalesce(o.v, 0)) as double), 2) as outflow,
  round(cast(sum(coalesce(i.v, 0)) - sum(coalesce(o.v, 0)) as double), 2) as net_cash_flow
from accounts a
left join (select to_account_id as acct, sum(amount) as v from transactions group by 1) i on i.acct = a.account_id
left join (select from_account_id as acct, sum(amount) as v from transactions group by 1) o on o.acct = a.account_id
group by a.user_id""")
def a33(spark, d):
    return B.net_cash_flow(*_tx_acc(spark, d))


@register("a34_balance_by_type", """
select account_type, round(cast(sum(balance) as double), 2) as total_balance, count(*) as n_accounts
from accounts group by account_type""")
def a34(spark, d):
    return B.balance_by_type(X.accounts(spark, d))


@register("a35_active_users", f"""
select count(distinct a.user_id) as active_users, round(avg(cast(t.amount as double)), 4) as avg_amount,
  count(*) as n_transactions from {PAY_FROM}""")
def a35(spark, d):
    return B.active_users(*_tx_acc(spark, d))


@register("a36_status_totals", """
select status, round(cast(sum(amount) as double), 2) as total_amount, count(*) as n from transactions group by status""")
def a36(spark, d):
    return B.status_totals(X.transactions(spark, d))


@register("a37_credit_outstanding", """
select user_id, round(cast(sum(abs(balance)) as double), 2) as outstanding, count(*) as n_credit,
  round(cast(sum(abs(balance)) as double) / (count(*) * cast(10000.0 as double)) * 100, 6) as utilisation_pct
from accounts where account_type = 'credit' group by user_id""")
def a37(spark, d):
    return B.credit_outstanding(X.accounts(spark, d), credit_limit=10000.0)


@register("a38_spend_by_category_all", """
select category, round(cast(sum(amount) as double), 2) as total_spent, count(*) as n
from transactions where type = 'payment' group by category""")
def a38(spark, d):
    return B.spend_by_category_all(X.transactions(spark, d))


CATS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
WIDE_COLS = ", ".join(
    "round(cast(coalesce(sum(case when s.category = '%s' then s.v end), 0) as double), 2) as \"%s\"" % (c, c)
    for c in CATS)
CAT_LIST = ", ".join("'%s'" % c for c in CATS)


@register("a7b_category_trend_wide", f"""
select g.user_id, g.month, strftime(g.month, '%b %Y') as name, {WIDE_COLS}
from (select user_id, month from {USERS} u cross join {SPINE6} m) g
left join (select a.user_id, t.category, date_trunc('month', t.created_at) as month, sum(t.amount) as v
           from {PAY_FROM} where t.type = 'payment' and t.category in ({CAT_LIST})
             and t.created_at between {sql_ts(FM6)} and {sql_ts(E)} group by 1, 2, 3) s
  on s.user_id = g.user_id and s.month = g.month
group by g.user_id, g.month""")
def a7b(spark, d):
    """A7 with a given category list, in the reference's wide shape (one column per category)."""
    long_df = B.category_trend(*_tx_acc(spark, d), AS_OF, "last_6_months", categories=CATS)
    return B.pivot_category_trend(long_df, CATS)


@register("a33b_highest_net_cash_flow", """
select a.user_id, round(cast(sum(coalesce(i.v, 0)) - sum(coalesce(o.v, 0)) as double), 2) as net_cash_flow
from accounts a
left join (select to_account_id as acct, sum(amount) as v from transactions group by 1) i on i.acct = a.account_id
left join (select from_account_id as acct, sum(amount) as v from transactions group by 1) o on o.acct = a.account_id
group by a.user_id order by net_cash_flow desc, a.user_id limit 1""")
def a33b(spark, d):
    """The user with the highest net cash flow (top-1 is the feature)."""
    net = B.net_cash_flow(*_tx_acc(spark, d)).select("user_id", "net_cash_flow")
    return B.topn(net, 1, [F.col("net_cash_flow").desc(), F.col("user_id").asc()])


@register("a37b_highest_credit_use", """
select user_id, round(cast(sum(abs(balance)) as double), 2) as outstanding,
  round(cast(sum(abs(balance)) as double) / (count(*) * cast(10000.0 as double)) * 100, 6) as utilisation_pct
from accounts where account_type = 'credit' group by user_id
order by utilisation_pct desc, user_id limit 1""")
def a37b(spark, d):
    """The user with the highest credit utilisation (top-1 is the feature)."""
    c = B.credit_outstanding(X.accounts(spark, d), credit_limit=10000.0).select("user_id", "outstanding",
                                                                               "utilisation_pct")
    return B.topn(c, 1, [F.col("utilisation_pct").desc(), F.col("user_id").asc()])
