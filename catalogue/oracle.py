"""The catalogue's queries as DuckDB SQL over the same tables.

Written apart from the Spark side: KS from pooled running counts, PSI from bin
counts, positions from row_number, AUC from running negatives.
"""

from __future__ import annotations

from catalogue.inputs import EMBEDDING_FEATURES, LINE_FEATURES, TRANSACTION_FEATURES

# --- base relations -------------------------------------------------------

TX = """
tx as (
  select o_orderkey as "TransactionID",
    date_diff('day', date '1995-01-01', o_orderdate::date)::bigint * 86400
      + floor(o_totalprice * 100)::bigint % 86400 as "TransactionDT",
    o_totalprice as "TransactionAmt", o_custkey as card1,
    case when o_orderstatus <> 'P' then o_custkey // 10 end as card2,
    case when o_orderpriority <> '5-LOW' then substr(o_orderpriority, 1, 1)::bigint * 100 end as addr1,
    case when o_orderpriority <> '4-NOT SPECIFIED' then o_orderpriority end as "P_emaildomain",
    o_orderstatus as "ProductCD",
    (o_custkey // 50)::double as "D1",
    substr(o_orderpriority, 1, 1)::double as "C1",
    floor(o_totalprice / 50000)::double as "C13"
  from orders),
people as (
  select c_custkey as card1, c_acctbal as id_01, c_nationkey::double as id_02
  from customer)"""

PREPARED = (
    TX
    + """,
prepared as (
  select t."TransactionID", t."TransactionDT", t.card1, t."TransactionAmt"::float as "TransactionAmt",
    ln(1 + t."TransactionAmt")::float as amt_log,
    round_even((t."TransactionAmt" - floor(t."TransactionAmt")) * 100, 0)::float as amt_cents,
    ((t."TransactionDT" / 3600e0) % 24e0)::float as hour,
    (count(*) over (partition by t.card1))::float as card1_freq,
    t."C1"::float as "C1", t."C13"::float as "C13",
    (p.card1 is not null)::int::float as has_identity,
    p.id_01::float as id_01, p.id_02::float as id_02
  from tx t left join people p on t.card1 = p.card1)"""
)

LINE_HASH = """md5(concat_ws('|', 42, l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round(l_extendedprice * 100)::bigint,
      date_diff('day', date '1970-01-01', l_shipdate::date)))"""

LINES = f"""
lines as (
  select l_orderkey, l_linenumber, l_shipdate, l_returnflag, l_linestatus,
    l_quantity, l_extendedprice, l_discount, l_tax, {LINE_HASH} as h,
    l_extendedprice / (l_extendedprice + 1000 * l_quantity) as pred
  from lineitem),
placed as (
  select *, row_number() over (order by l_shipdate, h) - 1 as pos, count(*) over () as total from lines),
cutoff as (
  select *, floor(total * 0.4e0)::bigint as cut from placed)"""

LINE_BATCHES = (
    LINES
    + """,
base as (
  select 0 as rk, h, l_quantity, l_extendedprice, l_discount, l_tax, pred from cutoff where pos < cut),
live as (
  select 0 as bk, 0 as rk, l_quantity, l_extendedprice * 1.3e0 as l_extendedprice,
    case when l_linenumber > 4 then l_discount end as l_discount, l_tax, pred
  from cutoff where pos >= cut)"""
)

DRIFTING = f"""
drifting as (
  select l_shipdate, l_quantity, l_discount, {LINE_HASH} as h, l_linestatus, l_returnflag,
    l_extendedprice * (1 + 0.05e0 * (year(l_shipdate) - 1995)) as l_extendedprice,
    case when year(l_shipdate) < 2000 or l_tax < 0.04e0 then l_tax end as l_tax,
    l_extendedprice / (l_extendedprice + 1000 * l_quantity) / (1 + 0.1e0 * (year(l_shipdate) - 1995)) as pred,
    (l_returnflag = 'R')::int as label
  from lineitem)"""

WINDOWS = (
    DRIFTING
    + """,
placed as (
  select *, row_number() over (order by l_shipdate, h) - 1 as pos, count(*) over () as total from drifting),
cutoff as (select *, floor(total * 0.4e0)::bigint as cut from placed),
windowed as (
  select c.*, case when pos < cut then 0 else (
    select count(*) from range(0, 8) i(i) where c.pos >= c.cut + (i.i * (c.total - c.cut)) // 8)::int end as part
  from cutoff c),
base as (select 0 as rk, h, l_quantity, l_extendedprice, l_discount, l_tax, pred from windowed where part = 0),
live as (select part as bk, 0 as rk, l_quantity, l_extendedprice, l_discount, l_tax, pred from windowed where part > 0)"""
)

VECTORS = f"""
raw as (
  select vec_id, {", ".join(f"embedding[{i + 1}]::double as e{i}" for i in range(len(EMBEDDING_FEATURES)))}
  from embeddings),
vectors as (select *, 1 / (1 + e0 * e0 + e1 * e1) as pred from raw)"""

_SHIFTED = ", ".join(
    f"e{i} + 0.005e0 * {i} as e{i}" if i % 4 == 0 else f"e{i}" for i in range(len(EMBEDDING_FEATURES))
)
VECTOR_BATCHES = (
    VECTORS
    + f""",
placed as (select *, row_number() over (order by vec_id) - 1 as pos, count(*) over () as total from vectors),
base as (
  select 0 as rk, md5(concat_ws('|', 42, vec_id)) as h, {", ".join(EMBEDDING_FEATURES)}, pred
  from placed where pos < floor(total * 0.4e0)),
live as (select 0 as bk, 0 as rk, {_SHIFTED}, pred from placed where pos >= floor(total * 0.4e0))"""
)

# --- drift over `base` (rk, h, features, pred) and `live` (bk, rk, features, pred) --


def _series(point: str, first: int, power: int) -> str:
    return (
        f"list_sum(list_transform(range({first}, {first + 16}), lambda k:"
        f" pow({point}, {power}) * exp(-pow(pi() * ({point}), 2) / (2 * z * z))))"
    )


def drift(features: list[str], alpha: str = "0.05e0", cap: int = 20000) -> str:
    names = ", ".join(f'"{f}"' for f in [*features, "pred"])
    order = "[" + ", ".join(f"'{f}'" for f in [*features, "pred"]) + "]"
    deciles = ", ".join(f"{i / 10}e0" for i in range(11))
    half = {p: _series("(k + 0.5e0)", 0, p) for p in (0, 2, 4, 6)}
    whole = {p: _series("k::double", 1, p) for p in (2, 4)}
    return f"""
base_long as (
  select rk, h, feature, v from (
    select rk, h, {", ".join(f'"{f}"::double as "{f}"' for f in [*features, "pred"])} from base) b
  unpivot include nulls (v for feature in ({names}))),
base_stats as (
  select rk, feature, count(*) as n_rows, (count(*) - count(v))::double / count(*) as base_null, avg(v) as base_mean
  from base_long group by all),
ref as (
  select rk, feature, v from (
    select rk, feature, v, row_number() over (partition by rk, feature order by h) as r
    from base_long where v is not null) where r <= {cap}),
ref_n as (select rk, feature, count(*) as n_ref, avg(v) as sample_mean from ref group by all),
edges as (
  select rk, feature, list_sort(list_distinct(quantile_cont(v, [{deciles}]))) as e from ref group by all),
inner_edges as (select rk, feature, case when len(e) > 2 then e[2:len(e) - 1] else [] end as ie from edges),
live_long as (
  select bk, rk, feature, v from (
    select bk, rk, {", ".join(f'"{f}"::double as "{f}"' for f in [*features, "pred"])} from live) b
  unpivot include nulls (v for feature in ({names}))),
live_n as (
  select bk, rk, feature, count(*) as n_rows, count(v) as n_cur, avg(v) as mean from live_long group by all),
pairs as (select distinct bk, rk from live_n),
pooled as (
  select bk, rk, feature, v, sum(r) as r, sum(c) as c from (
    select p.bk, p.rk, r.feature, r.v, 1 as r, 0 as c from ref r join pairs p on p.rk = r.rk
    union all select bk, rk, feature, v, 0, 1 from live_long where v is not null)
  group by all),
running as (
  select bk, rk, feature, sum(r) over w as cr, sum(c) over w as cc,
    sum(r) over (partition by bk, rk, feature) as tr, sum(c) over (partition by bk, rk, feature) as tc
  from pooled window w as (partition by bk, rk, feature order by v)),
ks as (
  select bk, rk, feature, max(abs(cr::double / nullif(tr, 0) - cc::double / nullif(tc, 0))) as gap
  from running group by all),
binned as (
  select p.bk, p.rk, p.feature, len(list_filter(i.ie, lambda e: e <= p.v)) as b,
    sum(p.r)::double as r, sum(p.c)::double as c
  from pooled p join inner_edges i on i.rk = p.rk and i.feature = p.feature group by all),
shares as (
  select bk, rk, feature, greatest(r / nullif(sum(r) over w, 0), 1e-6) as e,
    greatest(c / nullif(sum(c) over w, 0), 1e-6) as a
  from binned window w as (partition by bk, rk, feature)),
psi_raw as (select bk, rk, feature, sum((a - e) * ln(a / e)) as psi_value from shares group by all),
stats as (
  select l.bk, l.rk, l.feature, list_position({order}, l.feature) - 1 as slot, l.n_rows,
    coalesce(rn.n_ref, 0) as n_ref, l.n_cur, l.mean, rn.sample_mean,
    least(coalesce(rn.n_ref, 0), l.n_cur) >= (case when l.feature = 'pred' then 2 else 20 end) as enough,
    ks.gap, psi_raw.psi_value, (l.n_rows - l.n_cur)::double / l.n_rows as null_rate, bs.base_null
  from live_n l
  join base_stats bs on bs.rk = l.rk and bs.feature = l.feature
  left join ref_n rn on rn.rk = l.rk and rn.feature = l.feature
  left join ks on ks.bk = l.bk and ks.rk = l.rk and ks.feature = l.feature
  left join psi_raw on psi_raw.bk = l.bk and psi_raw.rk = l.rk and psi_raw.feature = l.feature),
guarded as (
  select *, case when enough then gap else 0 end as ks_stat, case when enough then psi_value else 0 end as psi,
    abs(null_rate - base_null) as null_delta,
    round_even(n_ref::double * n_cur / nullif(n_ref + n_cur, 0), 0)::double as en
  from stats),
scaled as (select *, ks_stat * sqrt(en) as z from guarded),
sums as (
  select *,
    case when z >= 0.2 then {half[0]} end as h0, case when z >= 0.2 then {half[2]} end as h2,
    case when z >= 0.2 then {half[4]} end as h4, case when z >= 0.2 then {half[6]} end as h6,
    case when z >= 0.2 then {whole[2]} end as w2, case when z >= 0.2 then {whole[4]} end as w4
  from scaled),
pvalues as (
  select *, case
    when not enough or z < 0.2 then 1::double
    when z >= 4 then 2 * exp(-2 * z * z)
    else least(1::double, greatest(0::double, 1 - (
      sqrt(2 * pi()) / z * h0
      + sqrt(pi() / 2) / (3 * pow(z, 4)) * (pow(pi(), 2) * h2 - z * z * h0) / sqrt(en)
      + (sqrt(pi() / 2) / (36 * pow(z, 7)) * ((6 * pow(z, 6) + 2 * pow(z, 4)) * h0
          + pow(pi(), 2) * (2 * pow(z, 4) - 5 * z * z) * h2 + pow(pi(), 4) * (1 - 2 * z * z) * h4)
        - sqrt(pi() / 2) * pow(pi(), 2) / (18 * pow(z, 3)) * w2) / en
      + (sqrt(pi() / 2) / (3240 * pow(z, 10)) * (pow(pi(), 6) * (5 - 30 * z * z) * h6
          + pow(pi(), 4) * (212 * pow(z, 4) - 60 * z * z) * h4
          + pow(pi(), 2) * (135 * pow(z, 4) - 96 * pow(z, 6)) * h2
          - (30 * pow(z, 6) + 90 * pow(z, 8)) * h0)
        + sqrt(pi() / 2) / (108 * pow(z, 6)) * (3 * pow(pi(), 2) * z * z * w2 - pow(pi(), 4) * w4)) / pow(en, 1.5e0)
    ))) end as p_raw
  from sums),
ranked as (
  select *, row_number() over (partition by bk, feature = 'pred' order by p_raw) as rnk,
    count(*) over (partition by bk, feature = 'pred') as tests
  from pvalues),
cut_rank as (
  select *, coalesce(max(case when p_raw <= {alpha} * rnk / tests then rnk end)
    over (partition by bk, feature = 'pred'), 0) as last_rank
  from ranked),
judged as (
  select *, p_raw <= {alpha} as sig_none, p_raw <= {alpha} / tests as sig_bonferroni, rnk <= last_rank as sig_bh,
    null_delta >= 0.35e0 as null_shift
  from cut_rank),
drift_rows as (
  select *, (sig_bh and psi >= 0.1e0) or null_shift as flagged from judged)"""


VERDICT = """
verdict as (
  select *, n_flagged::double / greatest(n_features, 1) as share_flagged from (
    select bk, max(n_rows) as n_rows,
      count(*) filter (where feature <> 'pred') as n_features,
      count(*) filter (where feature <> 'pred' and flagged) as n_flagged,
      count(*) filter (where feature <> 'pred' and null_shift) as n_null_shift,
      max(null_delta) filter (where feature <> 'pred') as max_null_delta,
      first(feature order by round(null_delta, 9) desc, slot) filter (where feature <> 'pred') as worst_null_feature,
      first(feature order by round(psi, 9) desc, slot) filter (where feature <> 'pred') as top_feature,
      max(psi) filter (where feature <> 'pred') as top_psi,
      max(psi) filter (where feature = 'pred') as pred_psi,
      max(sample_mean) filter (where feature = 'pred') as pred_mean_baseline,
      max(mean) filter (where feature = 'pred') as pred_mean_batch
    from drift_rows group by bk)),
reasoned as (
  select *, list_filter([
    case when n_null_shift > 0 then n_null_shift || ' feature(s) changed missing rate, worst ' || worst_null_feature
      || ' by ' || printf('%.1f%%', round_even(max_null_delta * 1000, 0) / 10) end,
    case when share_flagged >= 0.05e0 then n_flagged || '/' || n_features || ' monitored features drifted ('
      || printf('%.1f%%', round_even(share_flagged * 1000, 0) / 10) || ' >= 5%)' end,
    case when pred_psi >= 0.25e0 then 'prediction distribution PSI ' || printf('%.3f', pred_psi) || ' >= 0.25' end
    ], lambda r: r is not null) as reasons
  from verdict)"""

REPORT = """feature, n_ref, n_cur, round(ks_stat, 6) as ks_stat, round(p_raw, 6) as p_raw, round(psi, 6) as psi,
  round(null_rate, 6) as null_rate, round(null_delta, 6) as null_delta,
  sig_none, sig_bonferroni, sig_bh, null_shift, flagged"""

LINE_DRIFT = f"with {LINE_BATCHES}, {drift(LINE_FEATURES)}"
ALL_VALUES = 1 << 62
EXACT_LINE_DRIFT = f"with {LINE_BATCHES}, {drift(LINE_FEATURES, cap=ALL_VALUES)}"
EXACT_WINDOW_DRIFT = f"with {WINDOWS}, {drift(LINE_FEATURES, cap=ALL_VALUES)}"
VECTOR_DRIFT = f"with {VECTOR_BATCHES}, {drift(EMBEDDING_FEATURES)}"
WINDOW_DRIFT = f"with {WINDOWS}, {drift(LINE_FEATURES)}"


def _of_features(prefix: str, columns: str) -> str:
    return f"{prefix} select {columns} from drift_rows where feature <> 'pred'"


def auc(rows: str, keys: str, score: str = "pred", label: str = "label", name: str = "auc_rows") -> str:
    """CTEs giving ``name`` (keys, auc, n, label_rate)."""
    over = f"partition by {keys} order by s"
    return f"""
{name}_counts as (
  select {keys}, {score} as s, sum({label})::double as pos, sum(1 - {label})::double as neg from {rows} group by {keys}, {score}),
{name}_below as (select *, sum(neg) over ({over}) - neg as below from {name}_counts),
{name} as (
  select {keys}, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) as auc,
    sum(pos + neg)::bigint as n, sum(pos) / sum(pos + neg) as label_rate
  from {name}_below group by {keys})"""


# --- requests -------------------------------------------------------------

REQUESTS = """
requests as (
  select o_orderkey as "TransactionID", o_totalprice * 0.25e0 - 1000 as "TransactionAmt",
    case when o_orderstatus <> 'P' then substr(o_orderpriority, 1, 1)::int end as "ProductCD",
    o_custkey - 10 as card1, substr(o_orderpriority, 1, 1)::int - 1 as card4,
    (floor(o_totalprice)::bigint % 100000) / 4000e0 as hour,
    (floor(o_totalprice)::bigint % 70)::double as "C1"
  from orders),
checked as (
  select *, list_filter([
    case when "TransactionAmt" < 0 or "TransactionAmt" > 100000 then 'TransactionAmt out of range' end,
    case when "ProductCD" < 0 or "ProductCD" > 4 then 'ProductCD out of range' end,
    case when card1 < 0 then 'card1 out of range' end,
    case when card4 < 0 or card4 > 3 then 'card4 out of range' end,
    case when hour < 0 or hour >= 24 then 'hour out of range' end], lambda v: v is not null) as violations
  from requests)"""

TX_DECISION = """case when p >= 0.5e0 then 'review' else 'approve' end as decision, 'scorer-v1' as model_version,
  0.03499e0 as baseline_rate, round(p / 0.03499e0, 3) as lift_over_base"""

WHATIF = '"TransactionAmt" amt_log amt_cents "C1" "C13" has_identity id_01 id_02'.split()
COHORT = "substr(md5(concat_ws('|', 42, \"TransactionID\")), 1, 8) < '5999999a'"


def whatif(changes: dict[str, str]) -> str:
    columns = ", ".join(f"round(({changes.get(c, c)})::float::double, 4) as {c}" for c in WHATIF)
    return f'with {PREPARED} select "TransactionID", {columns} from prepared'


SCENARIO_FEATURES = ", ".join(f'"{f}"' for f in TRANSACTION_FEATURES)
_RESCALED = {'"TransactionAmt"': '("TransactionAmt" * 100::float)', "amt_log": 'ln(1 + ("TransactionAmt" * 100::float)::double)::float'}
_COHORT_VALUES = {'"C1"': "1", '"C13"': "1", "has_identity": "0", "card1_freq": "1"}
_COHORT = {c: f"case when {COHORT} then {v}::float else {c} end" for c, v in _COHORT_VALUES.items()}
_OUTAGE = {"has_identity": "0::float", "id_01": "null::float", "id_02": "null::float"}


def _scenario(name: str, changes: dict[str, str]) -> str:
    quoted = [f if f.islower() else f'"{f}"' for f in TRANSACTION_FEATURES]
    return (
        f"select '{name}' as bk, 0 as rk, "
        + ", ".join(f"({changes.get(c, c)})::float as {c}" for c in quoted)
        + " from live_rows"
    )


_PRED = (
    '"TransactionAmt"::double / ("TransactionAmt"::double + 200000e0'
    " + 50000e0 * coalesce(has_identity::double, 0e0)) as pred"
)
SCENARIOS = f"""with {PREPARED},
placed as (
  select *, row_number() over (order by "TransactionDT", "TransactionID") - 1 as pos, count(*) over () as total
  from prepared),
cutoff as (select *, floor(total * 0.4e0)::bigint as cut from placed),
base as (
  select 0 as rk, md5(concat_ws('|', 42, "TransactionID")) as h, {SCENARIO_FEATURES}, {_PRED}
  from cutoff where pos < cut),
live_rows as (select * from cutoff where pos >= cut),
stacked as (
  {_scenario("healthy (control)", {})} union all
  {_scenario("currency units bug", _RESCALED)} union all
  {_scenario("new customer segment", _COHORT)} union all
  {_scenario("identity feed outage", _OUTAGE)} union all
  {_scenario("label shift only", {})}),
live as (select *, {_PRED} from stacked),
{drift(TRANSACTION_FEATURES)}, {VERDICT}
select bk as scenario, len(reasons) > 0 as caught, n_flagged || '/' || n_features as features_flagged,
  round(share_flagged, 3) as share, round(pred_psi, 3) as pred_psi, round(pred_mean_batch, 4) as pred_mean,
  top_feature, round(top_psi, 3) as top_psi, worst_null_feature
from reasoned"""

# The features of either side count their own rows only.
PREPARED_APART = PREPARED.replace(
    "(count(*) over (partition by t.card1))", "(count(*) over (partition by t.card1, t.side))"
).replace("from tx t left join", "from sided t left join").replace(
    "prepared as (",
    """sided as (
  select *, (row_number() over (order by "TransactionDT", "TransactionID") - 1 >= floor(count(*) over () * 0.4e0))::int as side
  from tx),
prepared as (""",
)
SCENARIOS_BY_BATCH = SCENARIOS.replace(PREPARED, PREPARED_APART)

CALIBRATION = f"""{WINDOW_DRIFT}, {VERDICT},
calibrated as (
  select bk as "window", round(share_flagged, 3) as share_flagged, n_null_shift,
    round(max_null_delta, 3) as max_null_delta, round(pred_psi, 3) as pred_psi, len(reasons) > 0 as would_alert
  from reasoned)"""

DEGRADATION = f"""{CALIBRATION},
labelled as (select part, pred, label, 0 as one from windowed),
later as (select * from labelled where part > 0),
first_part as (select * from labelled where part = 0),
{auc("later", "part", name="window_auc")}, {auc("first_part", "one", name="base_auc")},
degraded as (
  select c."window", w.n, c.share_flagged, c.pred_psi, c.would_alert as drifted, round(w.auc, 4) as auc,
    round(b.auc - w.auc, 4) as auc_drop, round(w.label_rate, 4) as label_rate,
    c.n_null_shift, c.max_null_delta, c.would_alert
  from calibrated c join window_auc w on w.part = c."window" join base_auc b on true)"""

NULL_OUTCOMES = """
outcomes as (
  select bk, feature, correction, sig_none,
    case correction when 'none' then sig_none when 'bonferroni' then sig_bonferroni else sig_bh end as sig,
    psi, null_shift
  from drift_rows cross join (select unnest(['none', 'bonferroni', 'bh']) as correction)),
trials as (
  select bk, correction,
    count(*) filter (where feature <> 'pred' and ((sig and psi >= 0.1e0) or null_shift)) as n_flagged,
    count(*) filter (where feature <> 'pred' and sig_none) as ks_only,
    count(*) filter (where feature <> 'pred' and sig) as sig_corrected,
    count(*) filter (where feature <> 'pred') as n_monitored,
    count(*) filter (where feature <> 'pred' and null_shift) as n_null,
    max(psi) filter (where feature = 'pred') as pred_psi
  from outcomes group by all),
alarms as (
  select *, (n_null > 0 or n_flagged::double / n_monitored >= 0.05e0 or pred_psi >= 0.25e0)::int as alarm from trials)
select correction, round(avg(n_flagged), 3) as mean_flagged, max(n_flagged) as max_flagged,
  round(avg(ks_only), 3) as mean_ks_only, round(avg(sig_corrected), 3) as mean_sig_corrected,
  round(avg(alarm), 3) as batch_false_alarm_rate
from alarms group by correction"""

NULL_EXPERIMENT = f"""with {VECTORS},
numbered as (
  select *, trial, md5(concat_ws('|', '42:' || trial, vec_id)) as h
  from vectors cross join (select unnest(range(0, 20)) as trial)),
placed as (
  select *, row_number() over (partition by trial order by h) - 1 as pos, count(*) over (partition by trial) as total
  from numbered),
base as (select trial as rk, h, {", ".join(EMBEDDING_FEATURES)}, pred from placed where pos < total // 2),
live as (select trial as bk, trial as rk, {", ".join(EMBEDDING_FEATURES)}, pred from placed where pos >= total // 2),
{drift(EMBEDDING_FEATURES)},
{NULL_OUTCOMES}"""

EXACT_NULL_EXPERIMENT = f"""with {VECTORS},
halves as (
  select *, trial, (strpos('0123456789abcdef', substr(h, trial // 4 + 1, 1)) - 1) >> (trial % 4)::int & 1 as first
  from (select *, md5(concat_ws('|', 42, vec_id)) as h from vectors) cross join (select unnest(range(0, 20)) as trial)),
base as (select trial as rk, h, {", ".join(EMBEDDING_FEATURES)}, pred from halves where first = 1),
live as (select trial as bk, trial as rk, {", ".join(EMBEDDING_FEATURES)}, pred from halves where first = 0),
{drift(EMBEDDING_FEATURES, cap=ALL_VALUES)},
{NULL_OUTCOMES}"""

LOG = """
log as (
  select event_id, ts, value / 500 as pred, (props::json ->> '$.k')::double as k, event_type, value from events)"""

LOG_BATCHES = (
    LOG
    + """,
placed as (select *, row_number() over (order by ts, event_id) - 1 as pos, count(*) over () as total from log),
base as (
  select 0 as rk, md5(concat_ws('|', 42, event_id)) as h, k, pred from placed where pos < floor(total * 0.4e0))"""
)

MODELS = f"""with {DRIFTING},
outcomes as (select *, (l_quantity > 25)::int as outcome from drifting),
{auc("outcomes", "l_linestatus, l_returnflag", label="outcome")},
models as (
  select l_linestatus || '-' || l_returnflag as model_version,
    case when l_returnflag <> 'N' then 1 - auc end as val_auc, n as n_train, l_linestatus = 'F' as can_score
  from auc_rows),
gated as (
  select model_version, val_auc, n_train, coalesce(val_auc, 0) >= 0.5e0 as val_auc_ok, 4 <= 500 as n_features_ok,
    coalesce(n_train, 0) >= 100 as train_rows_ok, can_score as model_loads
  from models)"""

ALL: dict[str, str] = {
    "join_identity": """select d.doc_id as "TransactionID", d.n_chars, l.quality::double as id_01, l.toxic::double as id_02,
      (l.doc_id is not null)::tinyint as has_identity from documents d left join labels l using (doc_id)""",
    "calendar_amount_features": f"""with {TX}, cents as (
      select *, round_even(("TransactionAmt" - floor("TransactionAmt")) * 100, 0)::float as amt_cents from tx)
      select "TransactionID", ("TransactionDT" / 3600e0) % 24e0 as hour,
        ("TransactionDT" / 86400e0) % 7e0 as dayofweek, "TransactionDT" / 86400e0 as day_index,
        round(ln(1 + "TransactionAmt"), 6) as amt_log, amt_cents, (amt_cents = 0)::tinyint as amt_is_round
      from cents""",
    "category_codes": f"""with {TX},
      codes as (
        select 'p' as col, "ProductCD" as value, dense_rank() over (order by "ProductCD") - 1 as code
        from (select distinct "ProductCD" from tx where "ProductCD" is not null)
        union all
        select 'e', "P_emaildomain", dense_rank() over (order by "P_emaildomain") - 1
        from (select distinct "P_emaildomain" from tx where "P_emaildomain" is not null))
      select "TransactionID", coalesce(p.code, -1)::int as "ProductCD", coalesce(e.code, -1)::int as "P_emaildomain", "C1"
      from tx left join codes p on p.col = 'p' and p.value = tx."ProductCD"
      left join codes e on e.col = 'e' and e.value = tx."P_emaildomain\"""",
    "entity_key_frequency": f"""with {TX}, keyed as (
      select *, card1 || '_' || addr1 || '_' || round_even("TransactionDT" / 86400e0 - "D1", 0)::varchar as uid from tx)
      select "TransactionID", uid as _uid, (count(*) over (partition by card1))::float as card1_freq,
        (case when card2 is null then 0 else count(*) over (partition by card2) end)::float as card2_freq,
        (case when addr1 is null then 0 else count(*) over (partition by addr1) end)::float as addr1_freq,
        (count(*) over (partition by "P_emaildomain"))::float as "P_emaildomain_freq",
        (case when uid is null then 0 else count(*) over (partition by uid) end)::float as _uid_freq
      from keyed""",
    "frequency_normalised": f"""with {TX}, shares as (
      select "TransactionID", (count(*) over (partition by card1))::double / count(*) over () as card1_freq,
        case when addr1 is null then 0 else (count(*) over (partition by addr1))::double / count(*) over () end as addr1_freq,
        case when "P_emaildomain" is null then 0
          else (count(*) over (partition by "P_emaildomain"))::double / count(*) over () end as "P_emaildomain_freq"
      from tx)
      select "TransactionID", round(card1_freq::float::double, 7) as card1_freq,
        round(addr1_freq::float::double, 7) as addr1_freq,
        round("P_emaildomain_freq"::float::double, 7) as "P_emaildomain_freq" from shares""",
    "conform_schema": f"""with {TX} select "TransactionID"::float as "TransactionID", addr1::float as addr1,
      case when "ProductCD" <> 'F' then "C1"::float end as mixed, null::float as not_there, "C13"::float as "C13" from tx""",
    "prepare_features": f"""with {PREPARED} select "TransactionID",
      {", ".join(f'round("{f}"::double, 4) as "{f}"' for f in TRANSACTION_FEATURES)} from prepared""",
    "contract_check": f"""with {REQUESTS} select "TransactionID", "TransactionAmt", coalesce("ProductCD", 4)::int as "ProductCD",
      card1::int as card1, card4::int as card4, 1::int as card6, 299::double as addr1, hour, 2::double as dayofweek,
      "C1", 1::double as "C13", 0::double as "D1", 0::int as has_identity from checked where len(violations) = 0""",
    "contract_rejects": f"""with {REQUESTS} select "TransactionID", array_to_string(violations, '; ') as violations
      from checked where len(violations) > 0""",
    "defaults_overlay": f"""with {REQUESTS}, cents as (
      select *, round_even(("TransactionAmt" - floor("TransactionAmt")) * 100, 0)::float as amt_cents
      from requests)
      select "TransactionID", "TransactionAmt"::float as "TransactionAmt",
        round(case when "TransactionAmt" > -1 then ln(1 + "TransactionAmt") end::float::double, 4) as amt_log, amt_cents, (amt_cents = 0)::int::float as amt_is_round,
        coalesce("ProductCD", 4)::float as "ProductCD", card1::float as card1, 12::float as card1_freq, 0.25::float as "C5"
      from cents""",
    "decision_lift": f"""with {TX}, scored as (
      select "TransactionID", "TransactionAmt" / ("TransactionAmt" + 100000e0) as p from tx)
      select "TransactionID", round(p, 6) as fraud_probability, {TX_DECISION} from scored""",
    "missing_rate": f"""with {LINE_BATCHES} select feature, count(*) as n_rows,
      round((count(*) - count(v))::double / count(*), 6) as null_rate
      from (from live unpivot include nulls (v for feature in ({", ".join(LINE_FEATURES)}))) group by feature""",
    "decile_edges": f"""{LINE_DRIFT.replace("'pred'", "'__none__'")}
      select case when feature = 'pred' then '__pred__' else feature end as feature, (i - 1)::int as i, round(e[i], 6) as edge
      from (select feature, e, unnest(range(1, len(e) + 1)) as i from edges)""",
    "psi_by_feature": f"""{LINE_DRIFT} select case when feature = 'pred' then '__pred__' else feature end as feature,
      n_ref, n_cur, round(psi, 6) as psi from drift_rows""",
    "ks_by_feature": _of_features(LINE_DRIFT, "feature, n_ref, n_cur, round(ks_stat, 6) as ks_stat, round(p_raw, 6) as p_raw"),
    "ks_small_batch": """with recursive ref as (select s_acctbal as v from supplier),
      cur as (select c_nationkey as nation, c_mktsegment as segment, c_acctbal as v from customer),
      sizes as (select nation, segment, count(*) as m, (select count(*) from ref) as n from cur group by all),
      points as (select distinct nation, segment, v from (
        select nation, segment, v from cur union all select nation, segment, ref.v from sizes, ref)),
      gaps as (select nation, segment, n, m,
          abs((select count(*) from ref where ref.v <= p.v) * m
            - (select count(*) from cur c where c.nation = p.nation and c.segment = p.segment and c.v <= p.v) * n) as gap
        from points p join sizes using (nation, segment)),
      tests as (select nation, segment, n, m, max(gap) as reach from gaps group by all),
      walk as (
        select nation, segment, n, m, reach, 0::bigint as s, list_transform(range(0, m + 1), lambda i: 0e0) as met
        from tests where n >= 20 and m >= 20
        union all
        select nation, segment, n, m, reach, s + 1, list_transform(range(0, m + 1), lambda i:
          case when i > s + 1 or s + 1 - i > n then 0e0
            when abs(i * n - (s + 1 - i) * m) >= reach then 1e0
            else (i * case when i > 0 then met[i] else 0e0 end + (s + 1 - i) * met[i + 1]) / (s + 1) end)
        from walk where s < n + m),
      exact as (select nation, segment, met[m + 1] as p from walk where s = n + m)
      select nation, segment, n as n_ref, m as n_cur,
        case when p is null then 0e0 else round(reach / (n * m)::double, 6) end as ks_stat,
        round(coalesce(least(p, 1e0), 1e0), 6) as p_raw
      from tests left join exact using (nation, segment)""",
    "ks_exact_report": f"""{VECTOR_DRIFT.replace("with ", "with recursive ", 1)},
      tests as (select feature, n_ref::bigint as n, n_cur::bigint as m, round(ks_stat * n_ref * n_cur)::bigint as reach
        from guarded where feature <> 'pred'),
      walk as (
        select feature, n, m, reach, 0::bigint as s, list_transform(range(0, n + 1), lambda i: 0e0) as met
        from tests where n >= 20 and m >= 20
        union all
        select feature, n, m, reach, s + 1, list_transform(range(0, n + 1), lambda i:
          case when i > s + 1 or s + 1 - i > m then 0e0
            when abs(i * m - (s + 1 - i) * n) >= reach then 1e0
            else (i * case when i > 0 then met[i] else 0e0 end + (s + 1 - i) * met[i + 1]) / (s + 1) end)
        from walk where s < n + m),
      exact as (select feature, met[n + 1] as p from walk where s = n + m)
      select g.feature, g.n_ref, g.n_cur, round(g.ks_stat, 6) as ks_stat, round(least(coalesce(x.p, 1e0), 1e0), 6) as p_raw,
        least(coalesce(x.p, 1e0), 1e0) <= 0.05e0 as sig_none
      from guarded g left join exact x using (feature) where g.feature <> 'pred'""",
    "approximate_edges": f"""{EXACT_LINE_DRIFT} select feature, i::int as i, n_ref as n, true as within_error
      from ref_n, (select unnest(range(0, 11)) as i) where feature <> 'pred'""",
    "flag_none": _of_features(VECTOR_DRIFT, "feature, round(p_raw, 6) as p_raw, sig_none as significant"),
    "flag_bonferroni": _of_features(VECTOR_DRIFT, "feature, round(p_raw, 6) as p_raw, sig_bonferroni as significant"),
    "flag_bh": _of_features(VECTOR_DRIFT, "feature, round(p_raw, 6) as p_raw, sig_bh as significant"),
    "missing_rate_shift": _of_features(
        LINE_DRIFT, "feature, round(null_rate, 6) as null_rate, round(null_delta, 6) as null_delta, null_shift"
    ),
    "drift_report": _of_features(LINE_DRIFT, REPORT),
    "exact_drift_report": _of_features(EXACT_LINE_DRIFT, REPORT),
    "psi_categorical": f"""with {LINES},
      sides as (
        select 'r' as side, (l_quantity > 25)::int as fits, * from cutoff where pos < cut
        union all select 'c', 0, * from cutoff where pos >= cut),
      tall as (
        select side, unnest([
          {{'f': 'fits', 'v': fits::varchar}}, {{'f': 'l_returnflag', 'v': l_returnflag}},
          {{'f': 'l_linestatus', 'v': l_linestatus}}, {{'f': 'l_linenumber', 'v': l_linenumber::varchar}}]) as x from sides),
      merged as (
        select x.f as feature, x.v as value, count(*) filter (where side = 'r') as r, count(*) filter (where side = 'c') as c
        from tall group by all),
      shares as (
        select feature, sum(r) over w as n_ref, sum(c) over w as n_cur, count(*) over w as n_values,
          greatest(r / sum(r) over w, 1e-6) as e, greatest(c / sum(c) over w, 1e-6) as a
        from merged window w as (partition by feature))
      select feature, n_ref::bigint as n_ref, n_cur::bigint as n_cur, n_values, round(sum((a - e) * ln(a / e)), 6) as psi
      from shares group by all""",
    "batch_verdict": f"""with {LINE_BATCHES}, {drift(["l_quantity", "l_extendedprice", "l_discount"])}, {VERDICT}
      select n_rows, n_features, n_flagged, n_null_shift, round(max_null_delta, 6) as max_null_delta, worst_null_feature,
        top_feature, round(top_psi, 6) as top_psi, round(pred_psi, 6) as pred_psi,
        round(pred_mean_baseline, 6) as pred_mean_baseline, round(pred_mean_batch, 6) as pred_mean_batch,
        round(share_flagged, 6) as share_flagged, array_to_string(reasons, '; ') as reasons, len(reasons) > 0 as drifted,
        'l_tax' as missing_columns from reasoned""",
    "top_drifted": _of_features(
        VECTOR_DRIFT,
        "feature, round(psi, 6) as psi, round(ks_stat, 6) as ks_stat, round(p_raw, 6) as p_raw, flagged",
    )
    + " order by round(drift_rows.psi, 9) desc, slot limit 10",
    "worst_missing": _of_features(LINE_DRIFT, "feature, round(null_delta, 6) as null_delta")
    + " order by round(drift_rows.null_delta, 9) desc, slot limit 1",
    "profile_sample": f"""{LINE_DRIFT} select case when feature = 'pred' then '__pred__' else feature end as feature,
      round(v, 6) as value from ref""",
    "profile_summary": f"""{LINE_DRIFT} select (list_position({[*LINE_FEATURES, "pred"]}, feature) - 1)::int as slot,
      case when feature = 'pred' then '__pred__' else feature end as feature, n_rows, round(base_null, 6) as null_rate,
      round(case when feature = 'pred' then base_mean end, 4) as mean, n_ref, round(sample_mean, 4) as sample_mean
      from base_stats join ref_n using (rk, feature)""",
    "stored_profile_report": _of_features(LINE_DRIFT, REPORT),
    "null_experiment": NULL_EXPERIMENT,
    "exact_null_experiment": EXACT_NULL_EXPERIMENT,
    "window_drift": _of_features(WINDOW_DRIFT, f'bk as "window", {REPORT}'),
    "exact_window_drift": _of_features(EXACT_WINDOW_DRIFT, f'bk as "window", {REPORT}'),
    "calibration_windows": f"{CALIBRATION} select * from calibrated",
    "calibration_summary": f"""{CALIBRATION} select max(share_flagged) as max_share_flagged, 0.05e0 as share_threshold,
      max(max_null_delta) as max_null_delta, 0.35e0 as null_threshold, max(pred_psi) as max_pred_psi,
      0.25e0 as pred_psi_threshold, count(*) filter (where would_alert) as n_alarms, count(*) as n_windows from calibrated""",
    "roc_auc_by_window": f"""with {WINDOWS}, later as (select * from windowed where part > 0), {auc("later", "part")}
      select part as "window", round(auc, 6) as auc, n, round(label_rate, 6) as label_rate from auc_rows""",
    "degradation_windows": f"{DEGRADATION} select * from degraded",
    "drift_vs_degradation_corr": f"""{DEGRADATION} select
      round(case when stddev_samp(share_flagged) > 0 and stddev_samp(auc_drop) > 0
        then corr(share_flagged, auc_drop) end, 4) as corr_share_auc_drop,
      round(case when stddev_samp(pred_psi) > 0 and stddev_samp(auc_drop) > 0
        then corr(pred_psi, auc_drop) end, 4) as corr_pred_psi_auc_drop from degraded""",
    "whatif_rescale": whatif(_RESCALED),
    "whatif_cohort": whatif(_COHORT),
    "whatif_feed_null": whatif(_OUTAGE),
    "live_batch": f"""with {TX}, placed as (
      select *, row_number() over (order by "TransactionDT", "TransactionID") - 1 as pos, count(*) over () as n from tx)
      select "TransactionID", "TransactionDT" from placed
      where pos >= floor(n * 0.4e0) and pos < floor(n * 0.4e0) + 4000""",
    "scenario_backtest": SCENARIOS,
    "scenario_backtest_by_batch": SCENARIOS_BY_BATCH,
    "rolling_prediction_mean": f"""with {LOG} select event_id, pred,
      round(avg(pred) over (order by ts, event_id rows between 49 preceding and current row), 6) as rolling_mean from log""",
    "log_counters": f"""with {LOG} select 'scorer-' || event_type as model_version, count(*) as requests_served,
      2::int as n_features, 1::int as monitored_features from log group by event_type""",
    "prediction_log_roundtrip": f"""with {LOG} select ts::date as day, 'scorer-v1' as model_version, count(*) as n,
      round(avg(pred), 6) as mean_pred, round(avg(k), 6) as mean_k from log group by all""",
    "report_roundtrip": f"{CALIBRATION} select * from calibrated",
    "csv_transactions": f"""with {TX} select t.card1, t."TransactionID", t."TransactionAmt", t."P_emaildomain", p.id_01, p.id_02,
      (p.card1 is not null)::tinyint as has_identity from tx t left join people p on t.card1 = p.card1""",
    "csv_first_transactions": f"""with {TX}, first_rows as (select * from tx order by "TransactionID" limit 500)
      select t.card1, t."TransactionID", t."TransactionAmt", t."P_emaildomain", p.id_01, p.id_02,
      (p.card1 is not null)::tinyint as has_identity from first_rows t left join people p on t.card1 = p.card1""",
    "promotion_gate": f"""{MODELS} select model_version, round(val_auc, 6) as val_auc, n_train, val_auc_ok, n_features_ok,
      train_rows_ok, model_loads, val_auc_ok and n_features_ok and train_rows_ok and model_loads as deployable from gated""",
    "promotion_gate_failures": f"""with {DRIFTING},
      outcomes as (select *, (l_discount > 0.05e0)::int as outcome, floor(l_quantity / 8)::int as kind from drifting),
      {auc("outcomes", "kind, l_returnflag", label="outcome")},
      models as (
        select kind || '-' || l_returnflag as model_version, kind * 100 as n_features,
          case when kind <> 3 then case when l_returnflag = 'A' then auc else 1 - auc end end as val_auc,
          case when l_returnflag = 'R' then 90 else n end as n_train, kind <> 2 as model_loads
        from auc_rows),
      gated as (
        select model_version, val_auc, n_train, coalesce(val_auc, 0) >= 0.5e0 as val_auc_ok, n_features <= 500 as n_features_ok,
          coalesce(n_train, 0) >= 100 as train_rows_ok, model_loads from models)
      select model_version, round(val_auc, 6) as val_auc, n_train, val_auc_ok, n_features_ok, train_rows_ok, model_loads,
        val_auc_ok and n_features_ok and train_rows_ok and model_loads as deployable from gated""",
    "score_stored_bundle": f"""with {TX}, filled as (
        select "TransactionID", "C1", case when "C13" < 8 then "C13" else 0 end as "C13" from tx),
      scored as (select *, "C1" / ("C1" + "C13" + 1) as p from filled)
      select "TransactionID", round(p, 6) as pred, case when p >= 0.5e0 then 'review' else 'approve' end as decision,
        'shares-v1' as model_version from scored""",
    "monitored_selection": f"""with {TX}, dated as (
        select *, "TransactionDT" / 86400e0 as day_index, ("TransactionDT" / 3600e0) % 24e0 as hour,
          round_even(("TransactionAmt" - floor("TransactionAmt")) * 100, 0)::float as amt_cents from tx),
      wide as (select {", ".join(
          f'round(stddev_pop("{c}"::double) / greatest(avg("{c}"), 1e0), 6) as "{c}"'
          for c in ("TransactionAmt", "hour", "amt_cents", "C1", "C13", "card1", "addr1"))} from dated),
      gains as (unpivot wide on * into name feature value gain),
      placed as (select *, list_position(['TransactionAmt', 'hour', 'amt_cents', 'C1', 'C13', 'card1', 'addr1'], feature) as place from gains)
      select feature, gain, rank::int as rank from (
        select feature, gain, row_number() over (order by gain desc, place) as rank from placed) where rank <= 5""",
    "report_cross_reference": f"""with first_model as ({CALIBRATION} select * from calibrated),
      second_model as ({CALIBRATION.replace("windowed as (", """rescored as (
        select * replace (coalesce(l_tax * 5 + l_discount, 0.5e0) as pred) from cutoff),
windowed as (""").replace("from cutoff c),", "from rescored c),")} select * from calibrated)
      select f."window", 'ratio-v1' as model_version, f.share_flagged, f.pred_psi, f.would_alert,
        'rates-v2' as model_version_other, s.share_flagged as share_flagged_other, s.pred_psi as pred_psi_other,
        s.would_alert as would_alert_other, f.would_alert is not distinct from s.would_alert as agreed
      from first_model f full join second_model s on f."window" = s."window" """,
    "registry_records": f"""{MODELS}, decided as (
      select *, val_auc_ok and n_features_ok and train_rows_ok and model_loads as deployable from gated)
      select model_version, deployable, train_rows_ok, n_train::varchar as n_train_rows,
        round(coalesce(val_auc, 0), 6) as val_auc, model_loads::int::double as gate_model_loads,
        deployable::varchar as deployable_tag from decided""",
    "stream_daily_monitor": f"""with {LOG} select ts::date as day, count(*) as n, round(avg(pred), 6) as mean_value,
      round(avg((event_type = 'error')::int), 6) as error_rate from log group by all""",
    "stream_window_drift": f"""with {LOG_BATCHES}, live as (select ts::date as bk, 0 as rk, k, pred from placed),
      {drift(["k"])}, {VERDICT}
      select bk as day, n_rows, n_flagged, round(top_psi, 6) as top_psi, round(pred_psi, 6) as pred_psi,
        len(reasons) > 0 as drifted from reasoned""",
    # A table of one file arrives as one micro-batch.
    "stream_batch_drift": f"""with {LOG_BATCHES}, live as (select 0 as bk, 0 as rk, k, pred from placed),
      {drift(["k"])}, {VERDICT}
      select bk::int as batch_id, n_rows, n_flagged, top_feature, round(top_psi, 6) as top_psi, round(pred_psi, 6) as pred_psi,
        len(reasons) > 0 as drifted from reasoned""",
    "stream_replay_drift": f"""with {LOG_BATCHES}, live as (select date_trunc('week', ts)::date as bk, 0 as rk, k, pred from placed),
      {drift(["k"])}, {VERDICT}
      select bk as week, n_rows, n_flagged, round(top_psi, 6) as top_psi, round(pred_psi, 6) as pred_psi,
        len(reasons) > 0 as drifted from reasoned""",
    "stream_closed_windows": f"""with {LOG_BATCHES}, live as (
        select ts::date as bk, 0 as rk, k, pred from placed
        where ts::date + interval 1 day <= (select max(ts) - interval 1 hour from log)),
      {drift(["k"])}, {VERDICT}
      select bk as day, n_rows, n_flagged, round(top_psi, 6) as top_psi, round(pred_psi, 6) as pred_psi,
        len(reasons) > 0 as drifted from reasoned""",
    "stream_score_log": f"""with {LOG}, requests as (select event_id, k, value * 250 - 1000 as amt from log)
      select event_id, 'scorer-v1' as model_version, k, round(amt / (amt + 100000e0), 6) as pred,
        case when amt / (amt + 100000e0) >= 0.5e0 then 'review' else 'approve' end as decision, '' as violations
      from requests where amt >= 0 and amt <= 100000
      union all
      select event_id, null, null, null, null, 'TransactionAmt out of range' from requests where amt < 0 or amt > 100000""",
}
