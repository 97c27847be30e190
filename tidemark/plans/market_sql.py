"""SQL for the queries of market.py. The normal distribution is integrated here (Simpson's rule), not approximated as in the library."""

from __future__ import annotations

from tidemark.plans.registry import _BY, _FEATURES, _PRICES, _REPORT

_CONTRACTS = """c as (select p_partkey, case when p_partkey % 2 = 0 then 'call' else 'put' end as side, p_retailprice as spot, p_retailprice * (0.8::double + (p_partkey % 41) / 100::double) as strike,
 (p_size % 50) / 50::double as years, 0.04::double as rate, 0.01::double as dividend, (p_partkey % 13) * 0.05::double as volatility from part)"""


def _cdf(x: str) -> str:
    z = f"least(greatest({x}, -9::double), 9::double)"
    return f"(0.5 + {z} / 1200 * list_sum([(case when i = 0 or i = 400 then 1 when i % 2 = 1 then 4 else 2 end) * exp(-0.5 * ({z} * i / 400) * ({z} * i / 400)) for i in range(0, 401)]) / sqrt(2 * pi()))"


_GREEKS = f"""with {_CONTRACTS},
d as (select *, case when side = 'call' then 1 else -1 end as w, spot * exp(-dividend * years) as s, strike * exp(-rate * years) as k, case when side = 'call' then greatest(spot - strike, 0) else greatest(strike - spot, 0) end as inner_,
 case when years > 0 and volatility > 0 then (ln(spot / strike) + (rate - dividend + volatility * volatility / 2) * years) / (volatility * sqrt(years)) end as d1 from c),
e as (select *, {_cdf('w * d1')} as n1, {_cdf('w * (d1 - volatility * sqrt(years))')} as n2, exp(-0.5 * d1 * d1) / sqrt(2 * pi()) as f from d),
v as (select p_partkey, inner_,
 case when years = 0 then inner_ when volatility = 0 then greatest(w * (s - k), 0) else w * (s * n1 - k * n2) end as raw,
 case when years = 0 then (case when spot = strike then w * 0.5 when side = 'call' then (spot > strike)::int else -((spot < strike)::int) end) when volatility = 0 then case when w * (s - k) > 0 then w * exp(-dividend * years) else 0 end else w * n1 * exp(-dividend * years) end as delta,
 case when years = 0 or volatility = 0 then 0 else exp(-dividend * years) * f / (spot * volatility * sqrt(years)) end as gamma,
 case when years = 0 then 0 when volatility = 0 then case when w * (s - k) > 0 then w * (dividend * s - rate * k) else 0 end else w * (dividend * s * n1 - rate * k * n2) - s * f * volatility / (2 * sqrt(years)) end as theta,
 case when years = 0 or volatility = 0 then 0 else s * f * sqrt(years) end as vega,
 case when years = 0 then 0 when volatility = 0 then case when w * (s - k) > 0 then w * years * k else 0 end else w * years * k * n2 end as rho from e)
select p_partkey, round(greatest(raw, 0), 5) as price, round(inner_, 5) as intrinsic_value, round(raw - inner_, 5) as time_value, round(delta, 5)::double as delta, round(gamma, 5)::double as gamma, round(theta, 5)::double as theta, round(vega, 5)::double as vega, round(rho, 5)::double as rho from v"""

_HEDGE = """s as (select l_orderkey, l_linenumber, (l_quantity - 25) * 1.3::double as delta, l_extendedprice / l_quantity as spot, l_discount as gamma from lineitem),
b as (select *, least(cbrt(3 * 0.01::double * spot * gamma * gamma / (2 * 2::double)), 20) as width from s),
p as (select *, case policy_id when 'delta_threshold' then -10 when 'constant_band' then -8 when 'whalley_wilmott' then -width when 'forced_reduction' then 0 end as lo,
 case policy_id when 'delta_threshold' then 10 when 'constant_band' then 12 when 'whalley_wilmott' then width when 'forced_reduction' then 0 end as hi
 from b, (values ('no_hedge'), ('fixed_interval'), ('delta_threshold'), ('constant_band'), ('whalley_wilmott'), ('forced_reduction')) as n(policy_id)),
t as (select *, case policy_id when 'no_hedge' then false when 'fixed_interval' then l_linenumber % 3 = 0 when 'forced_reduction' then true else delta < lo or delta > hi end as trades from p),
g as (select *, case when policy_id = 'no_hedge' then delta when policy_id in ('constant_band', 'whalley_wilmott') then case when delta < lo then lo when delta > hi then hi else delta end else 0 end as target from t),
q as (select *, case when trades then round_even((target - delta) / 5, 0) else 0 end::bigint as contracts from g)"""

_STEPS = "n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as step from lineitem)"
_LINES = f"""{_STEPS}, f as (select l_orderkey, step, case when step % 2 = 1 then 'buy' else 'sell' end as side, l_quantity::bigint as quantity, round(l_extendedprice * 100)::bigint as ref, case when l_returnflag = 'R' then 'futures' else 'option' end as kind from n),
g as (select *, ref * quantity * 50 as gross, 25 * quantity * 50 as spread, 10 * quantity * 50 as slip from f),
h as (select *, gross // 10000 + (gross % 10000 > 5000 or (gross % 10000 = 5000 and (gross // 10000) % 2 = 1))::int as prop from g),
x as (select *, spread + slip + prop + 500 as total, case when side = 'buy' then 1 else -1 end as w from h)"""
_ENTRIES = f"""{_LINES}, l as (select l_orderkey, step, 'trade' as entry_type, w * quantity as quantity_change, -w * gross as cash_change, 0 as cost, ref from x
 union all select l_orderkey, step, 'transaction_cost', 0, -total, total, ref from x)"""
_VALUES = f"""{_ENTRIES}, v as (select *, sum(quantity_change) over o as quantity, sum(cash_change) over o as cash, sum(cash_change) over o + ref * 50 * sum(quantity_change) over o as value from l
 window o as (partition by l_orderkey order by step, entry_type desc rows unbounded preceding))"""

_RECORDS = """r0 as (select event_id, user_id || '/' || event_type as scope_id, ts, value, lag(event_id) over (partition by user_id, event_type order by ts, event_id) as b from events),
r as (select event_id, scope_id, ts, value, case when event_id % 29 <> 0 then b end as old from r0)"""

_DIFF = """a as (select p_partkey, p_retailprice as c0 from part where p_partkey % 10 <> 0),
b as (select p_partkey, case when p_partkey % 5 <> 0 then p_retailprice end as c1, case when p_partkey % 11 = 0 then 'b' else 'a' end as m1 from part where p_partkey % 7 <> 0),
d as (select coalesce(a.p_partkey, b.p_partkey) as p_partkey, case when b.p_partkey is null then 'disappeared' when a.p_partkey is null then 'added' when c0 is distinct from c1 then 'metadata_changed' when m1 <> 'a' then 'provider_mapping_changed' else 'unchanged' end as category
 from a full join b on a.p_partkey = b.p_partkey)"""

_QUOTES = "q as (select user_id as instrument, event_id, value as price, ts as received_at from events where value > 0 and event_id % 13 <> 0)"
_FRESH = f"""{_QUOTES}, n as (select max(ts) as now from events), l as (select instrument, max_by(received_at, event_id) as received_at from q group by 1),
s as (select c_custkey as instrument, case when received_at is null then 'awaiting' when received_at >= now - interval 1 day then 'fresh' else 'stale' end as freshness from customer left join l on c_custkey = instrument, n)"""

_ORDER = "case when o_orderkey % 3 = 0 then o_orderkey % 100 end"

ORACLE_SQL = {
    "option_greeks": _GREEKS,
    "option_faults": """select p_partkey, case when p_partkey % 5 = 0 then 'side_unknown' when p_partkey % 7 = 0 then 'spot_not_positive' when p_partkey % 11 = 0 then 'strike_not_positive'
 when p_partkey % 17 = 0 then 'years_negative' when p_partkey % 19 = 0 then 'volatility_negative' end as fault from part""",
    "implied_volatility": "select p_partkey, round((p_partkey % 13 + 2) * 0.05::double, 4) as volatility, true as converged, 'converged' as reason from part",
    "option_forward": f"with {_CONTRACTS} select p_partkey, round(spot * exp(0.03::double * years), 6) as forward from c",
    "synthetic_chain": f"""with {_CONTRACTS}, f as (select p_partkey, round_even(spot * exp((rate - dividend) * years) / 50, 0) as m from c)
select p_partkey, ((m + i) * 50)::double as strike, 0.02::double as spread, 1000 as volume, 5000 as open_interest from f, range(-4, 5) as t(i) where m + i > 0""",
    "straddle_top1": "select l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_orderkey order by abs(l_quantity - 25), l_discount, -l_tax, -l_partkey, l_quantity) = 1",
    "earliest_expiry": "select o_custkey, min(o_orderdate)::date as expiry from orders where o_orderkey % 20 between 7 and 15 group by 1",
    "hedge_decisions": f"""with {_HEDGE} select l_orderkey, l_linenumber, policy_id, round(lo, 6)::double as lower_boundary, round(hi, 6)::double as upper_boundary, round(target, 6)::double as target_net_delta, round(delta + contracts * 5, 6) as net_delta_after,
 round(delta + contracts * 5 - target, 6) as residual_delta, contracts, case when contracts > 0 then 'buy_hedge' when contracts < 0 then 'sell_hedge' else 'hold' end as action, case when trades and contracts = 0 then 'rounded_quantity_zero' when trades then case policy_id when 'fixed_interval' then 'scheduled_rebalance' when 'forced_reduction' then 'absolute_delta_forced_hedge' else policy_id || case when policy_id like 'w%' then '_band' else '' end || '_breached' end
 when policy_id = 'no_hedge' then 'policy_never_hedges' when policy_id = 'fixed_interval' then 'outside_scheduled_step' else 'inside_' || policy_id || case when policy_id like 'w%' then '_band' else '' end end as reason from q""",
    "simulated_fills": f"""with {_LINES} select l_orderkey, step, greatest(ref + w * 35, 0) / 100 as fill_price, gross / 100 as gross_notional, spread / 100 as half_spread_cost, slip / 100 as slippage_cost, prop / 100 as proportional_cost, 5::double as fixed_cost, total / 100 as total_cost from x""",
    "ledger_entries": f"with {_ENTRIES} select l_orderkey, step, entry_type, quantity_change, cash_change / 100 as cash_change, cost / 100 as cost from l",
    "ledger_cash": f"with {_ENTRIES} select l_orderkey, (sum(cash_change) / 100)::double as cash, (sum(cost) / 100)::double as costs from l group by 1",
    "ledger_value": f"with {_VALUES} select l_orderkey, step, entry_type, quantity::bigint as quantity, (cash / 100)::double as cash, (value / 100)::double as value from v",
    "ledger_drawdown": f"""with {_VALUES}, p as (select l_orderkey, max(value) over (partition by l_orderkey order by step, entry_type desc rows unbounded preceding) - value as below from v)
select l_orderkey, (max(below) / 100)::double as maximum_drawdown from p group by 1""",
    "reconciliation": f"""with {_LINES}, s as (select l_orderkey, sum(case when kind = 'option' then -w * gross else 0 end) as op, sum(case when kind = 'option' then total else 0 end) as oc, sum(case when kind = 'futures' then -w * gross else 0 end) as fp, sum(case when kind = 'futures' then total else 0 end) as fc from x group by 1),
t as (select o_orderkey as l_orderkey, coalesce(op, 0) as op, coalesce(oc, 0) as oc, coalesce(fp, 0) as fp, coalesce(fc, 0) as fc, round(o_totalprice * 100)::bigint as pnl from orders left join s on o_orderkey = l_orderkey)
select l_orderkey, (op / 100)::double as option_pnl, (oc / 100)::double as option_costs, (fp / 100)::double as futures_pnl, (fc / 100)::double as futures_costs, pnl / 100 as terminal_pnl, ((pnl - op - fp + oc + fc) / 100)::double as residual, abs(pnl - op - fp + oc + fc) <= 1 as reconciled from t""",
    "premium_at_risk": f"with {_LINES} select l_orderkey, case when count(*) filter (side <> 'buy') = 0 then (sum(gross + total) / 100)::double end as premium_at_risk from x group by 1",
    "greek_attribution": f"""with {_STEPS}, l as (select l_orderkey, step, leg, l_quantity as spot, l_discount as vol, l_tax as years, l_extendedprice * leg / 100 as price, leg * 0.5::double + 0.1::double as delta, l_tax * 0.1::double as gamma, leg * l_discount as theta from n, (values (1), (-1)) as v(leg)),
p as (select *, lag(step) over w as since, spot - lag(spot) over w as ds, vol - lag(vol) over w as dv, price - lag(price) over w as dp, lag(delta) over w as d, lag(gamma) over w as g, lag(theta) over w as th from l window w as (partition by l_orderkey, leg order by step)),
s as (select l_orderkey, since, step, sum(d * ds) as a, sum(g * ds * ds / 2) as b, sum(th * years) as c, sum(2 * dv) as e, sum(dp * 3) as x from p where since is not null group by 1, 2, 3)
select l_orderkey, since, step, round(a, 6) as delta_change, round(b, 6) as gamma_change, round(c, 6) as theta_change, round(e, 6) as vega_change, round(x, 6) as exact_change, round(x - a - b - c - e, 6) as residual from s""",
    "temporal_resolve": f"""with recursive {_RECORDS}, n as (select max(ts) - interval 1 day as known from events), k as materialized (select r.* from r, n where ts <= known),
t as (select event_id, event_id as root from k where old is null union all select k.event_id, t.root from t join k on k.old = t.event_id),
e as (select scope_id, root, max_by(k.event_id, k.ts) as leaf from k join t on t.event_id = k.event_id where value > 40 group by 1, 2)
select scope_id, case when count(*) = 1 then min(leaf) end as record_id, case when count(*) = 1 then 'resolved' else 'ambiguous' end as state from e group by 1""",
    "temporal_audit": f"""with {_RECORDS}, m as (select event_id, scope_id, ts, case when event_id % 97 = 0 then event_id when event_id % 89 = 0 then event_id + 1000000000 when event_id % 83 = 0 then event_id - 1 when event_id % 79 = 0 then old - old % 5 else old end as old from r)
select m.event_id as record_id, case when m.old = m.event_id then 'self_edge' when t.event_id is null then 'missing_target' when t.scope_id <> m.scope_id then 'cross_scope' else 'not_later' end as violation
from m left join m as t on t.event_id = m.old where m.old is not null and (m.old = m.event_id or t.event_id is null or t.scope_id <> m.scope_id or m.ts <= t.ts)
union all select old, 'branch' from m where old is not null group by old having count(*) > 1""",
    "interval_visibility": """with o as (select o_orderkey, o_orderdate as a, case when o_orderkey % 3 <> 0 then o_orderdate + interval 400 day end as b, o_orderdate + interval 10 day as r, case when o_orderkey % 4 <> 0 then o_orderdate + interval 700 day end as g, timestamp '1996-06-01' as m, timestamp '1997-01-01' as k from orders)
select o_orderkey, a <= m and (b is null or m < b) and r <= k and (g is null or k < g) as version_effective, a <= m and (b is null or m < b) and r <= k as catalogue_visible, r <= k as session_visible from o""",
    "latest_assessment": """select o_custkey as event_id, o_orderpriority as policy_id, o_orderkey as assessment_id, o_orderstatus as disposition from orders where o_orderdate <= timestamp '1997-01-01'
qualify row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) = 1""",
    "chain_as_of": f"""with s as (select * from orders where o_orderdate <= timestamp '1996-06-01' and o_orderdate + interval 2 day <= timestamp '1997-01-01')
select o_custkey as contract_id, o_orderkey as event_id, o_orderdate as exchange_timestamp, {_ORDER} as provider_sequence, o_totalprice as bid from s where not exists (select 1 from s as x where x.o_orderkey % 11 = 0 and x.o_orderkey - 1 = s.o_orderkey)
qualify row_number() over (partition by o_custkey order by o_orderdate desc, coalesce({_ORDER}, -1) desc, coalesce(case when o_orderkey % 5 = 0 then o_orderkey % 7 end, -1) desc, o_orderkey desc) = 1""",
    "ordinal_gaps": "select * from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) as expected from lineitem where l_returnflag <> 'R') where l_linenumber <> expected",
    "order_differences": f"""with {_STEPS}, l as (select *, row_number() over (partition by l_orderkey order by step) as p1, row_number() over (partition by l_orderkey order by l_partkey, step) as p2 from n where l_linestatus = 'F' or l_linenumber < 6),
a as (select l_orderkey, p1 as place, step as expected from l), b as (select l_orderkey, p2 as place, step as actual from l where l_tax < 0.08)
select l_orderkey, place, expected, actual from a full join b using (l_orderkey, place) where expected is distinct from actual""",
    "false_duplicates": """with r as (select o_orderkey, case when o_orderkey % 5 = 0 then o_orderkey - o_orderkey % 3 - 1 end as first_key from orders)
select r.o_orderkey, r.first_key from r left join r as t on t.o_orderkey = r.first_key where r.first_key is not null and (t.o_orderkey is null or t.first_key is not null)""",
    "ordered_digests": """select l_orderkey, count(*) as n_rows, min(l_linenumber) as first_ordinal, max(l_linenumber) as last_ordinal, string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey::varchar) as ordered,
string_agg(l_partkey::varchar, ',' order by l_partkey::varchar) as by_bytes, sha256(string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey::varchar)) as digest from lineitem group by 1""",
    "filtered_counts": "select l_suppkey, count(*) as n_rows, count(*) filter (l_returnflag = 'R') as n_marked, count(*) filter (l_returnflag <> 'R') as n_other, count(distinct l_partkey) as n_keys from lineitem group by 1",
    "declared_counts": """select o_orderkey as l_orderkey, o_orderkey % 7 + 1 as declared, coalesce(n, 0) as found from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey where o_orderkey % 7 + 1 <> coalesce(n, 0)""",
    "exclusive_subtypes": """with n as (select o_orderkey, o_orderstatus, count(*) filter (l_linestatus = 'F') as n_F, count(*) filter (l_linestatus = 'O') as n_O from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2)
select * from n where not (n_F = (o_orderstatus = 'F')::int and n_O = (o_orderstatus = 'O')::int)""",
    "catalogue_differences": f"with {_DIFF} select * from d",
    "catalogue_diff_counts": f"with {_DIFF} select category, count(*) as n_keys from d group by 1",
    "catalogue_disappeared": "select p_partkey from part where p_partkey % 10 <> 0 and p_partkey % 7 = 0",
    "conflicting_records": "select l_partkey, count(distinct l_returnflag || '/' || l_linestatus) as n_contents from lineitem group by 1 having count(distinct l_returnflag || '/' || l_linestatus) > 1",
    "quote_changes": f"with {_PRICES}, b as (select *, nullif(lag(price) over ({_BY}), 0) as base from p) select instrument_id, session_date, round(price - base, 6) as change, round((price - base) / base, 8) as relative_change from b",
    "accepted_quotes": f"with {_QUOTES} select event_id, instrument, price from q",
    "latest_quotes": f"with {_QUOTES} select instrument, max(event_id) as event_id, max_by(price, event_id) as price, max_by(received_at, event_id) as received_at from q group by 1",
    "quote_freshness": f"with {_FRESH} select * from s",
    "feed_rollup": f"with {_FRESH} select case when count(*) = 0 then 'unknown' when bool_or(freshness = 'stale') then 'stale' when bool_or(freshness = 'fresh') then 'fresh' else 'awaiting' end as feed from s",
    "keyset_page": "select o_orderkey, o_totalprice from orders where o_orderkey > 1000 order by 1 limit 50",
    "provider_conversions": """with o as (select o_orderkey as k, o_orderkey * 86400000 + 70000000 as m, * from orders)
select o_orderkey, case when k % 8 <> 0 then m end as at_millis, case when k % 26 <> 0 then case when k % 2 = 0 then case when m > 10000000000 then m else m * 1000 end else k * 1000 end end as epoch_millis,
strftime(make_timestamp(m * 1000) + interval 330 minute, '%Y-%m-%d') as expiry, case when k % 9 <> 0 and k % 10 <> 0 and k % 14 <> 0 and k % 22 <> 0 then o_totalprice end as price,
case when k % 9 = 0 then 'negative' when k % 10 = 0 then 'not_finite' when k % 14 = 0 or k % 22 = 0 then 'out_of_range' end as price_fault, (k % 1000) / 100 as tick, o_orderpriority as segment,
case k % 4 when 0 then 'pre_open' when 1 then 'open' when 2 then 'closed' else 'unknown' end as status, case k % 6 when 0 then 'outer_whitespace' when 1 then 'too_long' end as identifier_fault,
case when o_orderstatus in ('F', 'O') then 'a;b;' || o_orderstatus end as listed from o""",
    "stable_hashes": """select o_orderkey, sha256('{"customer":' || coalesce('"' || case when o_custkey % 5 <> 0 then o_custkey end || '"', 'null') || ',"key":"' || o_orderkey || '","status":"' || o_orderstatus || '"}') as hash,
('0x' || substr(sha256('orders:' || o_orderkey), 1, 2))::int % 64 as stripe from orders""",
    "set_digests": "select l_orderkey, sha256(string_agg(p, chr(10) order by p)) as digest from (select distinct l_orderkey, l_partkey::varchar as p from lineitem) group by 1",
    "rv_last_rows": f"""with {_PRICES}, {_FEATURES} select instrument_id, session_date, round(sqrt(v63 * 252 / 63), 8) as annualized_volatility_63d, regime from z where v63 is not null
qualify row_number() over (partition by instrument_id order by session_date desc) <= 30""",
    "rv_forecast_history": f"""with {_REPORT} select instrument_id, session_date, round(f, 8) as forward_annualized_variance, round(n, 8) as naive_forecast_annualized_variance from t where f is not null and n is not null
qualify row_number() over (partition by instrument_id order by session_date desc) <= 20""",
    "rv_annualized": f"with {_PRICES} select instrument_id, session_date, round(q, 8) as daily_variance, round(q * 252, 8) as annualized_variance, round(sqrt(q * 252), 8) as annualized_volatility from s",
}
