"""DuckDB twins of the fixture tables, inlined as CTEs into oracle SQL.

DuckDB sees only the raw parquet views, so every oracle statement carries the
derivations of FIXTURES.md as a WITH clause.  ``with_fixtures`` adds exactly
the CTEs a statement mentions (and their dependencies), in dependency order.
"""

from __future__ import annotations

import re

# The mapping SQL of FIXTURES.md part 2 (plus the implicit
# tables derived in ledgerlake.sources.fixtures), in dependency order.
FIXTURE_SQL: dict[str, str] = {
    "users": """select cast(floor(c_custkey / 3) as bigint) as user_id, min(c_name) as name, min(c_nationkey) as nation
from customer group by cast(floor(c_custkey / 3) as bigint)""",
    "accounts": """select c_custkey as account_id, cast(floor(c_custkey / 3) as bigint) as user_id,
  case when c_acctbal < 0 then 'credit' when c_custkey % 3 = 0 then 'checking' else 'savings' end as account_type,
  cast(c_acctbal as decimal(15,2)) as balance, concat(c_mktsegment, ' ', cast(c_custkey % 3 as varchar)) as name
from customer""",
    "transactions": """select o_orderkey as id, case when o_orderkey % 5 = 3 then null else o_custkey end as from_account_id,
case when o_orderkey % 5 = 3 then o_custkey when o_orderkey % 5 = 4 then (o_custkey + 1) % (select count(*) from customer) end as to_account_id,
cast(o_totalprice as decimal(15,2)) as amount,
case when o_orderkey % 5 < 3 then 'payment' when o_orderkey % 5 = 3 then 'deposit' else 'transfer' end as type,
concat('Payment to Merchant ', cast(o_orderkey % 25 as varchar)) as description,
case when o_orderpriority = '4-NOT SPECIFIED' then null else o_orderpriority end as category,
case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'failed' end as status, o_orderdate as created_at
from orders""",
    "timed_transactions": """select event_id as id, user_id, cast(value as decimal(15,2)) as amount, 'completed' as status,
event_type as description, ts as created_at from events""",
    "chat_history": """select conv_id * 1000 + turn as message_id, conv_id as session_id,
conv_id * 100 + cast(floor((ask + 1) / 2) as bigint) as trace_id, conv_id % 50 as user_id, turn as routing_step,
case role when 'user' then 'human' when 'assistant' then 'ai' else 'system' end as message_type, text as content,
case when role = 'assistant' then case (conv_id + turn) % 3 when 0 then 'account_agent' when 1 then 'support_agent' else 'visualization_agent' end end as agent_name,
case when role = 'assistant' then cast((conv_id * 7919 + turn * 104729) % 5000 as int) end as response_time_ms,
case when role = 'assistant' then cast(length(text) % 997 as int) end as total_tokens,
case when role = 'assistant' then concat('{"hate":{"filtered":',
  case when (conv_id + turn) % 11 = 0 then 'true' else 'false' end, ',"severity":"',
  case when (conv_id + turn) % 11 = 0 then 'high' else 'safe' end, '"},"jailbreak":{"filtered":',
  case when (conv_id + turn) % 13 = 0 then 'true' else 'false' end, ',"detected":',
  case when (conv_id + turn) % 13 = 0 then 'true' else 'false' end, '}}') end as content_filter_results,
timestamp '2024-01-01 00:00:00' + interval '1' hour * conv_id + interval '30' second * turn as trace_end
from (select *, cast(sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows between unbounded preceding and current row) as bigint) as ask from conversations) t""",
    "agent_traces": """select message_id as trace_step_id, session_id, trace_id, user_id,
coalesce(lag(agent_name) over (partition by session_id order by routing_step), 'system') as from_agent, agent_name as current_agent,
cast(row_number() over (partition by trace_id order by routing_step) as int) as step_order, response_time_ms as execution_duration_ms
from chat_history where message_type = 'ai'""",
    "tool_usage": """select event_id as tool_call_id, user_id as session_id, event_type as tool_name, props as tool_input,
case when event_type = 'error' then '{"message":"Error: tool failed"}' else '{"message":"ok"}' end as tool_output,
cast(event_id % 500 as int) as tokens_used from events""",
    "agentic_events": """select ts as timestamp, event_id as trace_id, user_id,
case event_type when 'signup' then 'jailbreak' when 'purchase' then 'Violence' when 'error' then 'self_harm' else 'None' end as filter_category,
props as message from events""",
    "chunk_source": """select doc_id, source as source_pdf, text from documents""",
    "chat_sessions": """select session_id, min(user_id) as user_id, min(trace_end) as created_at, max(trace_end) as updated_at
from chat_history group by session_id""",
    "goals": """select account_id as goal_id, user_id,
case account_type when 'savings' then 'savings' when 'credit' then 'debt_payoff' else 'spending_limit' end as goal_type,
case when account_id % 2 = 0 then name end as linked_account_name,
cast(abs(balance) * 2 as decimal(15,2)) as target_amount,
cast(abs(balance) * 3 as decimal(15,2)) as original_debt,
cast(abs(balance) + 100 as decimal(15,2)) as spending_limit,
case when account_id % 4 = 1 then '1-URGENT' when account_id % 4 = 3 then '2-HIGH' end as category,
cast(date '2001-08-01' + cast(account_id % 400 - 100 as integer) as date) as deadline
from accounts""",
    "loans": """select c_custkey as loan_id, cast(10000 + (c_custkey % 50) * 5000 as double) as principal,
case when c_custkey % 37 = 0 then 0.0 else cast(c_custkey % 8 as double) + 1.5 end as annual_rate,
case c_custkey % 4 when 0 then 10 when 1 then 15 when 2 then 20 else 30 end as term_years,
cast((c_custkey % 5) * 100 as double) as extra_payment from customer""",
    "savings_plans": """select c_custkey as plan_id, abs(c_acctbal) as initial_deposit,
cast((c_custkey % 10) * 100 as double) as monthly_contribution, cast(c_custkey % 9 as double) as annual_return,
cast(5 + c_custkey % 26 as integer) as years from customer""",
    "budget_plans": """select c_custkey as plan_id, cast(3000 + (c_custkey % 40) * 100 as double) as income,
cast(20 + c_custkey % 20 as integer) as housing, cast(5 + c_custkey % 15 as integer) as transportation,
cast(5 + c_custkey % 12 as integer) as food, cast(5 + c_custkey % 25 as integer) as savings from customer""",
    "retirement_plans": """select c_custkey as plan_id, cast(25 + c_custkey % 30 as integer) as current_age,
65 as retirement_age, abs(c_acctbal) * 10 as current_savings,
cast(200 + (c_custkey % 9) * 100 as double) as monthly_contribution, cast(3 + c_custkey % 6 as double) as expected_return
from customer""",
    "emergency_plans": """select c_custkey as plan_id, cast(2000 + (c_custkey % 30) * 100 as double) as monthly_expenses,
cast(3 + c_custkey % 4 as integer) as target_months, abs(c_acctbal) as current_savings,
cast((c_custkey % 6) * 100 as double) as monthly_savings from customer""",
    "ai_widgets": """select user_id * 100 + j as widget_id, user_id,
case when j >= 7 then 'simulation' else 'chart' end as widget_type,
case when j >= 7 or (user_id + j) % 3 = 0 then 'static' else 'dynamic' end as data_mode, query_type,
['last_6_months', 'this_year', 'last_3_months', 'all_time'][cast((user_id + j) % 4 + 1 as integer)] as time_range,
'{"title":"' || query_type || ' widget","chartType":"bar","customProps":{"colors":["#3B82F6"],"data":[]}}' as config,
timestamp '2001-07-01 00:00:00' + interval '1' hour * ((user_id * 7 + j * 13) % 500) as updated_at
from (select user_id, unnest(generate_series(0, 11)) as j, unnest(['spending_by_category', 'monthly_trend', 'monthly_income_expenses', 'account_balances', 'top_merchants', 'daily_spending', 'category_trend', 'loan_repayment', 'savings_projector', 'budget_planner', 'retirement_calculator', 'emergency_fund']) as query_type from users) w""",
}

_DEPS = {n: [m for m in FIXTURE_SQL if m != n and re.search(rf"\b{m}\b", s)] for n, s in FIXTURE_SQL.items()}


def _needed(sql: str) -> list[str]:
    want: set[str] = set()
    stack = [n for n in FIXTURE_SQL if re.search(rf"\b{n}\b", sql)]
    while stack:
        n = stack.pop()
        if n not in want:
            want.add(n)
            stack.extend(_DEPS[n])
    return [n for n in FIXTURE_SQL if n in want]  # dict order is dependency order


def with_fixtures(sql: str, extra_ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the fixture CTEs it references (plus ``extra_ctes``)."""
    body = sql.strip()
    extra = extra_ctes or []
    scan = body + " " + " ".join(s for _, s in extra)
    ctes = [(n, FIXTURE_SQL[n]) for n in _needed(scan)] + list(extra)
    if not ctes:
        return body
    return "with " + ",\n".join(f"{n} as (\n{s}\n)" for n, s in ctes) + "\n" + body


def sql_iso(col: str) -> str:
    """isoformat() of a TIMESTAMP in DuckDB: the fraction only when microseconds are non-zero."""
    return (f"case when date_part('microseconds', {col}) % 1000000 = 0 then strftime({col}, '%Y-%m-%dT%H:%M:%S') "
            f"else strftime({col}, '%Y-%m-%dT%H:%M:%S.%f') end")
