"""Registered widget refresh and query dispatch with filters and goals (J11, V7): points parsed back from the stored JSON."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions.common import sql_ts, time_range
from ..operators import refresh as R
from ..sources import fixtures as X
from .registry import register

AS_OF = X.BANK_AS_OF

_RANGES = ", ".join(f"('{r}', {sql_ts(s)}, {sql_ts(datetime(s.year, s.month, 1))})" for r in R.RANGES for s in [time_range(r, AS_OF)[0]])


def _ctes(asked: str) -> list[tuple[str, str]]:
    """Points of the requests ``asked``: (id, user_id, query_type, period, account_id, account_type, categories, lim, category,
    target_amount, original_debt, spending_limit, linked_account_name) as (id, k, member, number, txt)."""
    months = f"generate_series(floor_start, {sql_ts(datetime(AS_OF.year, AS_OF.month, 1))}, interval 1 month)"
    pct = "round(case when {1} > 0 then least(100.0, cast({0} as double) / cast({1} as double) * 100) else 0.0 end, 1)"

    def number(name: str, value: str) -> str:
        return f"{{'m': '{name}', 'n': cast({value} as double), 't': cast(null as varchar)}}"

    def text(name: str, value: str) -> str:
        return f"{{'m': '{name}', 'n': cast(null as double), 't': {value}}}"
    limit_of = "spending_limit"
    return [
        ("asked", asked),
        ("ranges", f"select * from (values {_RANGES}) v(period, start, floor_start)"),
        ("wq", "select a.*, r.start, r.floor_start from asked a join ranges r on r.period = case when a.period in (select period from ranges) "
               "then a.period else 'last_6_months' end"),
        ("own", "select w.*, a.account_id as acct from wq w join accounts a on a.user_id = w.user_id "
                "where w.account_id is null or w.account_id = a.account_id"),
        ("moved", "select o.*, t.type, t.category as cat, t.description, t.amount, t.created_at from own o join transactions t "
                  "on (t.type = 'payment' and t.from_account_id = o.acct) or (t.type = 'deposit' and t.to_account_id = o.acct) "
                  f"where t.created_at between floor_start and {sql_ts(AS_OF)}"),
        ("paid", "select * from moved where type = 'payment' and created_at >= start"),
        ("spine", f"select distinct id, query_type, categories, unnest({months}) as month from own"),
        ("by_month", "select id, cat, date_trunc('month', created_at) as month, sum(amount) filter (type = 'deposit') as inc, "
                     "sum(amount) filter (type = 'payment') as exp from moved group by 1, 2, 3"),
        ("month_sum", "select id, month, sum(inc) as inc, sum(exp) as exp from by_month group by 1, 2"),
        ("best5", "select id, cat from (select id, cat, row_number() over (partition by id order by sum(amount) desc, cat nulls first) as r from paid "
                  "where query_type = 'category_trend' and categories is null group by id, cat) where r <= 5 and coalesce(cat, '') <> ''"),
        ("trend_cats", "select id, cat from best5 union select id, unnest(categories) as cat from own "
                       "where query_type = 'category_trend' and categories is not null"),
        ("linked", "select n.u, n.name, n.linked_id, a.balance as bal from (select user_id as u, name, min(account_id) as linked_id "
                   "from accounts group by 1, 2) n join accounts a on a.account_id = n.linked_id"),
        ("gave", "select to_account_id as acct, sum(amount) as s from transactions where type in ('deposit', 'transfer') and created_at "
                 f"between {sql_ts(AS_OF - timedelta(days=30))} and {sql_ts(AS_OF)} group by 1"),
        ("saved", "select w.*, l.linked_id, coalesce(g.s, 0) as s, case when w.linked_account_name is not null then coalesce(l.bal, 0) else coalesce("
                  "(select sum(balance) from accounts a where a.user_id = w.user_id and account_type = 'savings'), 0) end as cur "
                  "from wq w left join linked l on l.u = w.user_id and l.name = w.linked_account_name left join gave g on g.acct = l.linked_id "
                  "where query_type = 'goal_savings_progress'"),
        ("owed", "select w.*, case when w.linked_account_name is not null then coalesce(abs(l.bal), 0) else coalesce("
                 "(select sum(abs(balance)) from accounts a where a.user_id = w.user_id and account_type = 'credit'), 0) end as cur "
                 "from wq w left join linked l on l.u = w.user_id and l.name = w.linked_account_name where query_type = 'goal_debt_payoff_progress'"),
        ("spent", "select w.*, coalesce((select sum(amount) from paid p where p.id = w.id and (w.category is null or p.cat = w.category)), 0) as cur "
                  "from wq w where query_type = 'goal_spending_limit'"),
        ("points", f"""
select id, row_number() over (partition by id order by sum(amount) desc, coalesce(nullif(cat, ''), 'Uncategorized')) as k,
  [{text('name', "coalesce(nullif(cat, ''), 'Uncategorized')")}, {number('value', 'sum(amount)')}] as p
from paid where query_type = 'spending_by_category' and (categories is null or list_contains(categories, cat)) group by id, cat
union all
select id, r, [{text('name', "coalesce(nullif(description, ''), 'Unknown')")}, {number('value', 'v')}, {number('transactions', 'n')}]
from (select id, description, lim, sum(amount) as v, count(*) as n, row_number() over (partition by id order by sum(amount) desc, description nulls last) as r
  from paid where query_type = 'top_merchants' group by id, description, lim) where r <= lim
union all
select id, row_number() over (partition by id order by created_at::date), [{text('name', "strftime(created_at::date, '%Y-%m-%d')")}, {number('value', 'sum(amount)')}]
from paid where query_type = 'daily_spending' group by id, created_at::date
union all
select s.id, row_number() over (partition by s.id order by month), [{text('name', "strftime(month, '%b %Y')")}, {number('value', 'coalesce(exp, 0)')}]
from spine s left join month_sum using (id, month) where query_type = 'monthly_trend'
union all
select s.id, row_number() over (partition by s.id order by month),
  [{text('name', "strftime(month, '%b %Y')")}, {number('income', 'coalesce(inc, 0)')}, {number('expenses', 'coalesce(exp, 0)')}]
from spine s left join month_sum using (id, month) where query_type = 'monthly_income_expenses'
union all
select s.id, dense_rank() over (partition by s.id order by s.month), [{{'m': c.cat, 'n': cast(coalesce(b.exp, 0) as double), 't': null}}]
from spine s join trend_cats c using (id) left join by_month b on b.id = s.id and b.month = s.month and b.cat = c.cat where query_type = 'category_trend'
union all
select id, row_number() over (partition by id order by month), [{text('name', "strftime(month, '%b %Y')")}] from spine where query_type = 'category_trend'
union all
select w.id, row_number() over (partition by w.id order by cast(a.account_id as varchar)), [{text('name', 'a.name')}, {number('value', 'balance')}, {text('type', 'a.account_type')}]
from wq w join accounts a on a.user_id = w.user_id and (w.account_type is null or w.account_type = a.account_type) where query_type = 'account_balances'
union all
select id, 1, [{number('current_amount', 'cur')}, {number('target_amount', 'target_amount')}, {number('progress_percent', pct.format('cur', 'target_amount'))},
  {number('remaining', 'greatest(0, target_amount - cur)')}, {text('account_name', "coalesce(linked_account_name, 'All Savings')")},
  {number('recent_contributions', 'case when linked_id is null then 0 else s end')}] from saved
union all
select id, 1, [{number('current_debt', 'cur')}, {number('original_debt', 'original_debt')}, {number('amount_paid', 'greatest(0, original_debt - cur)')},
  {number('progress_percent', pct.format('greatest(0, original_debt - cur)', 'original_debt'))},
  {text('account_name', "coalesce(linked_account_name, 'All Credit')")}] from owed
union all
select id, 1, [{number('current_spending', 'cur')}, {number('spending_limit', limit_of)}, {number('remaining', f'greatest(0, {limit_of} - cur)')},
  {number('progress_percent', pct.format('cur', limit_of))}, {text('category', "coalesce(category, 'All Categories')")},
  {text('is_over_budget', f"case when cur > {limit_of} then 'true' else 'false' end")}] from spent"""),
        ("members", "select id, k, x.m as member, round(x.n, 2) as number, x.t as txt from (select id, k, unnest(p) as x from points) u"),
    ]


def _periods(names: list[str]) -> str:
    return f"[{', '.join(repr(n) for n in names)}]"


_CHARTS = _periods(X.WIDGET_KINDS[:7])
_GOAL_KIND = ("case goal_type when 'savings' then 'goal_savings_progress' when 'debt_payoff' then 'goal_debt_payoff_progress' "
              "else 'goal_spending_limit' end")
_NO_GOAL = ("null::varchar as category, null::decimal(15,2) as target_amount, null::decimal(15,2) as original_debt, "
            "null::decimal(15,2) as spending_limit, null::varchar as linked_account_name")

FILTERED = f"""select id, user_id, query_type, {_periods(X.QUERY_RANGES)}[k % 7 + 1] as period, account_id, account_type, categories, lim,
  category, target_amount, original_debt, spending_limit, linked_account_name
from (select user_id * 100 + j as id, user_id, query_type, user_id + j as k, case when (user_id + j) % 4 = 1 then user_id * 3 + 1 end as account_id,
    case when user_id % 2 = 0 then 'savings' end as account_type,
    case when (user_id + j) % 3 = 1 then ['3-MEDIUM', '1-URGENT'] end as categories, case when (user_id + j) % 2 = 0 then 3 else 10 end as lim, {_NO_GOAL}
  from (select user_id, unnest(generate_series(0, 6)) as j, unnest({_CHARTS}) as query_type from users)
  union all
  select 10000000 + goal_id, user_id, {_GOAL_KIND}, goal_id, case when goal_id % 7 = 0 then goal_id end, null, null, 10, category, target_amount,
    original_debt, spending_limit, linked_account_name from goals)
where k % 5 <> 0"""


def _members(rows, ident: str, data):
    """One row per member of each point: id, its place, the member, and its value as a number or a text."""
    listed = F.when(data.startswith("{"), F.concat(F.lit("["), data, F.lit("]"))).otherwise(data)
    points = rows.select(F.col(ident), F.posexplode(F.from_json(listed, "array<map<string,string>>")).alias("k", "p"))
    cells = points.select(ident, (F.col("k") + 1).cast("bigint").alias("k"), F.explode("p").alias("member", "v"))
    number = F.expr("try_cast(v as double)")
    return cells.select(ident, "k", "member", F.round(number, 2).alias("number"), F.when(number.isNull(), F.col("v")).alias("txt"))


@register("j11_refresh_widgets", "select id as widget_id, k, member, number, txt from members", ctes=_ctes(FILTERED))
def j11(spark, d):
    """Every dynamic widget refreshed in one job, each with its own filters; the stored points read back."""
    done = R.refresh_widgets(X.widget_queries(spark, d), X.transactions(spark, d), X.accounts(spark, d), AS_OF)
    return _members(done.where("status = 'refreshed'"), "widget_id", F.get_json_object("config", "$.customProps.data"))


PLAIN = f"""select user_id || ' ' || query_type as id, user_id, query_type, cast(null as varchar) as period, null::bigint as account_id,
  null::varchar as account_type, null::varchar[] as categories, 10 as lim, {_NO_GOAL}
from (select user_id, unnest({_CHARTS}) as query_type from users)
union all
select goal_id || ' ' || {_GOAL_KIND}, user_id, {_GOAL_KIND}, null, null, null, null, 10, category, target_amount, original_debt, spending_limit,
  linked_account_name from goals"""


@register("v7_query_data", "select id, k, member, number, txt from members", ctes=_ctes(PLAIN))
def v7_data(spark, d):
    """The dispatcher: all seven chart queries for every user and the goal query of every goal, without filters."""
    charts = X.users(spark, d).select("user_id", F.explode(F.array(*[F.lit(k) for k in X.WIDGET_KINDS[:7]])).alias("query_type")) \
        .select(F.concat_ws(" ", "user_id", "query_type").alias("id"), "user_id", F.to_json(F.struct("query_type")).alias("query_config"))
    kind = F.when(F.col("goal_type") == "savings", "goal_savings_progress").when(
        F.col("goal_type") == "debt_payoff", "goal_debt_payoff_progress").otherwise("goal_spending_limit").alias("query_type")
    goals = X.goals(spark, d).select("goal_id", "user_id", kind, F.struct(
        "category", "target_amount", "original_debt", "spending_limit", "linked_account_name").alias("filters")) \
        .select(F.concat_ws(" ", "goal_id", "query_type").alias("id"), "user_id", F.to_json(F.struct("query_type", "filters")).alias("query_config"))
    asked = R.requests(charts.unionByName(goals))
    data = R.query_data(asked.select("set_id", "q").dropDuplicates(["set_id"]), X.transactions(spark, d), X.accounts(spark, d), AS_OF)
    return _members(asked.join(data, "set_id"), "id", F.col("data"))
