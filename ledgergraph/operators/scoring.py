"""Risk scoring, ensembles, data splits and evaluation."""

from __future__ import annotations

from ..functions.expressions import channel_code, level_binned, level_ensemble, night, severity
from ..functions.ranking import cumulated, indexed, moments
from ..plans.catalog import operator
from ..plans.dialect import Spark
from .features import TRAIN_END, VAL_END, first_seen

# Signal tiers (threshold, score), decision thresholds and sharing limits.
FANIN_TIERS = ((100, 0.55), (50, 0.40), (30, 0.25))
FANOUT_TIERS = ((100, 0.45), (50, 0.30), (25, 0.18))
VELOCITY_TIERS = ((50, 0.25), (20, 0.15))
RAPID_INOUT = 0.20
DEVICE_SHARE = 0.15
MAX_DEVICES = 5
ALERT_THRESHOLD = 0.5
FREEZE_THRESHOLD = 0.85
AUTO_FREEZE = ("judol", "JUDOL_RING")


def graduated(value: str, tiers: tuple[tuple[int, float], ...]) -> str:
    return "case " + " ".join(f"when {value} >= {t} then {s!r}e0" for t, s in tiers) + " else 0.0e0 end"


def signal_score(scale: int = 1) -> str:
    """Summed tiers of ``fan_in, fan_out, velocity, rapid, devices``; ``scale`` divides
    the thresholds for small tables."""

    def cut(tiers: tuple[tuple[int, float], ...]) -> tuple[tuple[int, float], ...]:
        return tuple((max(1, t // scale), s) for t, s in tiers)

    return (
        f"{graduated('fan_in', cut(FANIN_TIERS))} + {graduated('fan_out', cut(FANOUT_TIERS))} + "
        f"{graduated('velocity', cut(VELOCITY_TIERS))} + case when rapid then {RAPID_INOUT!r}e0 else 0.0e0 end + "
        f"case when devices > {MAX_DEVICES} then {DEVICE_SHARE!r}e0 else 0.0e0 end"
    )


def fused(base: str, total: str, signals: str) -> str:
    return f"least(1.0e0, {signals} + {base} * least(1.0e0, {total} / 20.0e0) * 0.5e0)"


def decision(risk: str, typology: str) -> str:
    freeze = ", ".join(f"'{t}'" for t in AUTO_FREEZE)
    return (
        f"case when {risk} >= {FREEZE_THRESHOLD!r}e0 and {typology} in ({freeze}) then 'FREEZE' "
        f"when {risk} >= {FREEZE_THRESHOLD!r}e0 then 'ESCALATE' when {risk} >= {ALERT_THRESHOLD!r}e0 then 'ALERT' else 'NONE' end"
    )


def _signals_in_one_pass(d: Spark) -> str:
    """CTEs up to ``s``: both ends of every transfer go to their account once, and all
    signals are counted there, distinct ones by their ranks (a null has one, and is none)."""

    def distinct(rank: str, item: str, side: str) -> str:
        return f"coalesce(max({rank}) filter (where {side} and {item} is not null) - max(if({item} is null, 1, 0)) filter (where {side}), 0)"

    return f"""
with e as (select id, sent, peer, ep, if(sent, device_id, null) as device_id, if(sent, tx_id, null) as tx_id, if(sent, judol, false) as judol
    from (select stack(2, from_account, true, to_account, to_account, false, from_account) as (id, sent, peer),
      {d.epoch("tx_timestamp")} as ep, device_id, tx_id, coalesce(typology = 'judol', false) as judol from {{tx}}) b where id is not null),
  l as (select *, max(if(sent, ep, null)) over (partition by id) as last_out from e),
  p as (select *, dense_rank() over (partition by id, sent order by peer) as peer_no from l),
  w as (select *, dense_rank() over (partition by id, sent order by device_id) as device_no from p),
  a as (select id, count(*) as total, max(last_out) as last_out, {distinct("peer_no", "peer", "sent")} as fan_out, {distinct("peer_no", "peer", "not sent")} as fan_in,
      {distinct("device_no", "device_id", "sent")} as devices, max(judol) as judol, count(*) filter (where sent and ep > last_out - 3600) as velocity,
      max(if(ep = last_out, tx_id, null)) as tx_id, max(ep) filter (where not sent and ep <= last_out) as last_in from w group by id),
  s as (select id as account_id, tx_id, cast(fan_in as bigint) as fan_in, cast(fan_out as bigint) as fan_out, velocity, cast(devices as bigint) as devices, total,
      coalesce(last_out - last_in between 0 and 600, false) as rapid, if(judol, 'judol', '') as typology from a where velocity > 0),"""


def _decisions(d: Spark, scale: int) -> str:
    scored = f"""
  r as (select s.*, coalesce(p.risk_score, 0.0e0) as base from s left join {{predictions}} p on s.account_id = p.account_id),
  f as (select *, {fused("base", "total", signal_score(scale))} as risk from r)
select account_id, tx_id, typology, fan_in, fan_out, velocity, rapid, devices, {d.round("base", 4)} as base_score, {d.round("risk", 4)} as risk_score,
  {decision("risk", "typology")} as decision
from f"""
    if d.name == "spark":
        return _signals_in_one_pass(d) + scored
    return f"""
with o as (select from_account as id, {d.epoch("tx_timestamp")} as ep, to_account, device_id, tx_id, typology from {{tx}}),
  last as (select id, max(ep) as last_out, count(*) as n_out, count(distinct to_account) as fan_out,
      count(distinct device_id) as devices, max(case when typology = 'judol' then typology end) as typology from o group by id),
  vel as (select o.id, count(*) as velocity, max(case when ep = last_out then tx_id end) as tx_id from o join last on o.id = last.id
    where ep > last_out - 3600 group by o.id),
  i as (select to_account as id, {d.epoch("tx_timestamp")} as ep, from_account from {{tx}}),
  inc as (select i.id, count(*) as n_in, count(distinct from_account) as fan_in,
      max(case when ep <= last_out then ep end) as last_in from i left join last on i.id = last.id group by i.id),
  s as (select last.id as account_id, tx_id, coalesce(fan_in, 0) as fan_in, fan_out, velocity, devices, n_out + coalesce(n_in, 0) as total,
      coalesce(last_out - last_in between 0 and 600, false) as rapid, coalesce(typology, '') as typology
    from last join vel on last.id = vel.id left join inc on last.id = inc.id),""" + scored


@operator("T8 T7", scale=4)
def score_signals(d: Spark, scale: int = 1) -> str:
    """The streaming scorer's decision as a batch over each account's last transfer; an
    account without a prediction has a base score of 0."""
    return _decisions(d, scale)


@operator("R3", scale=4)
def alerts_stream(d: Spark, scale: int = 1) -> str:
    """An alert row for every decision but NONE: its id from the transfer's, FROZEN if
    the decision freezes, of no known typology unless the transfer tells one."""
    return f"""
select 'ALT-' || upper(substr(sha1(tx_id), 1, 12)) as alert_id, account_id, tx_id, risk_score, 'ML_ENSEMBLE' as detection_layer,
  coalesce(nullif(nullif(lower(typology), 'nan'), ''), 'AI_DETECTED') as typology, {severity("risk_score")} as severity,
  case decision when 'FREEZE' then 'FROZEN' else 'NEW' end as status
from ({_decisions(d, scale)}) x where decision <> 'NONE'"""


@operator("E1 F24")
def ml_node_split(d: Spark) -> str:
    """Accounts by first appearance: 70 per cent train, 15 validation, the rest test."""
    return f"""
with {first_seen(d)},
  {moments("first_seen_", "first_seen", {"train": TRAIN_END, "val": VAL_END})},
  tied as (select account_id, row_number() over (partition by first_seen order by account_id) - 1 as pos from first_seen_
    where first_seen in (select v from at_train union all select v from at_val))
select f.account_id, case when first_seen < t.v or (first_seen = t.v and pos < t.ties) then 'train'
  when first_seen < v.v or (first_seen = v.v and pos < v.ties) then 'val' else 'test' end as split
from first_seen_ f left join tied on f.account_id = tied.account_id cross join at_train t cross join at_val v"""


@operator("E3")
def ml_stratified_split(d: Spark) -> str:
    """Accounts by hash within their label: 70 per cent train, 15 validation, the rest test,
    so that the illicit share is alike in all three."""
    key = d.hash_order("account_id")
    digits = " + ".join(f"(instr('0123456789abcdef', substr({key}, {i + 1}, 1)) - 1) * {16**i}" for i in range(4))
    return f"""
with e as (select from_account as account_id, is_laundering from {{tx}} union all select to_account, is_laundering from {{tx}}),
  a as (select account_id, max(is_laundering) as label from e group by account_id),
  h as (select account_id, label, ({digits} + label * 32749) % 65536 as place from a)
select account_id, label, case when place < 45875 then 'train' when place < 55706 then 'val' else 'test' end as split from h"""


@operator("E2")
def ml_edge_split(d: Spark) -> str:
    """Transfers by time cut-offs at 60 and 80 per cent."""
    ranks = {n: f"cast(floor(total * {share}e0) as bigint) - 1" for n, share in (("train", 0.6), ("val", 0.8))}
    return f"""
with {moments("{tx}", "tx_timestamp", ranks)}
select tx_id, case when tx_timestamp <= t.v then 'train' when tx_timestamp <= v.v then 'val' else 'test' end as split, is_laundering
from {{tx}} cross join at_train t cross join at_val v"""


@operator("E4")
def ml_rebalance(d: Spark, keep: int = 4) -> str:
    """All illicit transfers, and in the training window one of ``keep`` licit ones by hash."""
    key = d.hash_order("tx_id")
    return f"""
with m as (select max(tx_timestamp) - interval 365 days as cut from {{tx}})
select tx_id, is_laundering, tx_timestamp <= cut as training from {{tx}} cross join m
where is_laundering = 1 or tx_timestamp > cut or (instr('0123456789abcdef', substr({key}, 1, 1)) - 1) % {keep} = 0"""


@operator("E5 M7 P15")
def ml_edge_encoding(d: Spark, text_ids: bool = False) -> str:
    """Edges with account indices, log amount, channel code and hour."""
    if d.name == "spark":  # what an edge says is computed before it is moved
        return f"""
with {indexed(d, f"select distinct account_id as id from ({d.ends()}) e", text_ids)},
  said as (select tx_id, from_account, to_account, {d.round("ln(1 + cast(amount as double))", 9)} as amount_log,
    cast({channel_code("channel")} as tinyint) as channel_enc, cast(hour(tx_timestamp) as tinyint) as hour from {{tx}})
select tx_id, cast(x.idx as bigint) as src, cast(y.idx as bigint) as dst, amount_log, cast(channel_enc as int) as channel_enc, cast(hour as bigint) as hour
from said join ids x on from_account = x.id join ids y on to_account = y.id"""
    return f"""
with {indexed(d, "select from_account as id from {tx} union select to_account from {tx}", text_ids)}
select tx_id, cast(x.idx as bigint) as src, cast(y.idx as bigint) as dst, {d.round("ln(1 + cast(amount as double))", 9)} as amount_log,
  {channel_code("channel")} as channel_enc, cast(hour(tx_timestamp) as bigint) as hour
from {{tx}} join ids x on from_account = x.id join ids y on to_account = y.id"""


@operator("E6 A12")
def ml_standardise(d: Spark) -> str:
    """Out-amounts standardised by statistics of the training accounts (by first
    appearance) only; no deviation is 1."""
    return f"""
with split_ as ({ml_node_split.build(d)}),
  f as (select from_account as account_id, cast(sum(amount) as double) as v from {{tx}} group by from_account),
  s as (select avg(v) as mu, coalesce(nullif(stddev_pop(v), 0), 1) as sd from f join split_ t on f.account_id = t.account_id
    where t.split = 'train')
select account_id, {d.round("(v - mu) / sd", 6)} as z from f cross join s"""


@operator("E17 L4", tenths=3)
def ml_sampled_scaler(d: Spark, tenths: int = 1) -> str:
    """Mean and deviation of the log amount over a sample of transfers by hash; no deviation is 1."""
    key = d.hash_order("tx_id")
    return f"""
select count(*) as n, {d.round("avg(x)", 6)} as mean, {d.round("coalesce(nullif(stddev_pop(x), 0), 1)", 6)} as std from (
  select ln(1 + cast(amount as double)) as x from {{tx}} where (instr('0123456789abcdef', substr({key}, 1, 1)) - 1) * 16
    + instr('0123456789abcdef', substr({key}, 2, 1)) - 1 < {tenths} * 25.6e0) s"""


@operator("E10 E22")
def ml_ensemble(d: Spark, w_a: float = 0.3, w_b: float = 0.3, w_c: float = 0.4) -> str:
    """Weighted mean of three scores, an absent one being 0, with its level."""
    return f"""
select doc_id, ensemble, {level_ensemble("ensemble")} as level from (
  select doc_id, (score * {w_a!r}e0 + score_b * {w_b!r}e0 + coalesce(score_c, 0.0e0) * {w_c!r}e0) / ({w_a!r}e0 + {w_b!r}e0 + {w_c!r}e0) as ensemble
  from {{scored}}) e"""


def _average_precision(source: str) -> str:
    """Average precision by group ``k`` of rows ``k, y, s``; ties share a threshold."""
    return f"""{cumulated(source)},
  ap as (select k, sum(cast(tp as double) / cast(np as double) * (cast(ctp as double) / cast(cn as double))) as value from cum group by k)"""


@operator("E13")
def ml_metrics(d: Spark, cut: float = 0.5) -> str:
    """Average precision, and precision, recall and F1 at a cut; empty ratios are 0."""
    ap = _average_precision("select 0 as k, label as y, score as s from {scored}")
    return f"""
with {ap},
  c as (select cast(sum(case when score >= {cut!r}e0 then label else 0 end) as double) as tp,
    cast(count(*) filter (where score >= {cut!r}e0) as double) as pp, cast(sum(label) as double) as p from {{scored}})
select {d.round("value", 9)} as average_precision, coalesce(tp / nullif(pp, 0), 0.0e0) as precision_, coalesce(tp / nullif(p, 0), 0.0e0) as recall,
  coalesce(2.0e0 * tp / nullif(pp + p, 0), 0.0e0) as f1 from ap cross join c"""


@operator("E11")
def ml_weight_sweep(d: Spark) -> str:
    """Average precision over mixing weights of two scores."""
    weights = " union all ".join(f"select {i} as w" for i in range(11))
    ap = _average_precision(
        f"select w as k, label as y, round(cast((score * w + score_b * (10 - w)) / 10.0e0 as decimal(18, 12)), 9) as s from {{scored}} cross join ({weights}) x"
    )
    return f"with {ap} select cast(k as int) as weight, {d.round('value', 6)} as average_precision from ap"


@operator("E12")
def ml_stacking_inputs(d: Spark, holdout: int = 7) -> str:
    """Inputs of the stacked scorer: the base score, the extra one where there is any
    (null stays null, with a mark), and whether a row is held out of both trainings."""
    return f"""
select doc_id, label, score, score_c as extra_score, case when score_c is null then 0 else 1 end as has_extra,
  fold >= {holdout} and score_c is not null as double_holdout from {{scored}}"""


@operator("E20")
def ml_stacking_coverage(d: Spark, holdout: int = 7) -> str:
    """Rows with and without the extra score in both parts of a double hold-out."""
    return f"""
select case when score_c is null then 'missing' else 'covered' end as score, case when fold >= {holdout} then 'holdout' else 'train' end as part,
  count(*) as n, {d.round("avg(cast(label as double))", 9)} as label_rate from {{scored}} group by 1, 2"""


@operator("E14")
def ml_cost_threshold(d: Spark, cost_fn: int = 100, cost_fp: int = 10) -> str:
    """The cheapest threshold for several cost ratios, the lowest of equals."""
    multipliers = " union all ".join(f"select {m} as m5" for m in (1, 3, 5, 10, 25))
    return f"""
with {cumulated("select 0 as k, label as y, score as s from {scored}")},
  c as (select m5, s, cast((np - ctp) * {cost_fn} * m5 + (cn - ctp) * {cost_fp} * 5 as bigint) as cost from cum cross join ({multipliers}) x),
  r as (select m5, min(struct_(cost, s)) as best from c group by m5)
select cast(m5 as int) as multiplier5, best.s as threshold, best.cost as cost from r""".replace(
        "struct_(cost, s)", "struct(cost, s)" if d.name == "spark" else "{'cost': cost, 's': s}"
    )


@operator("E19")
def ml_split_balance(d: Spark) -> str:
    """Illicit rate by split, and training edges whose both ends are training accounts."""
    return f"""
with s as ({ml_node_split.build(d)})
select x.split as from_split, y.split as to_split, count(*) as n, cast(sum(is_laundering) as bigint) as illicit,
  cast(sum(is_laundering) as double) / count(*) as rate
from {{tx}} join s x on from_account = x.account_id join s y on to_account = y.account_id group by x.split, y.split"""


@operator("E9", min_confidence=0.015)
def ml_typology_decision(d: Spark, min_confidence: float = 0.40) -> str:
    """The class of largest probability, UNKNOWN below a confidence."""
    return f"""
with r as (select vec_id, class, p, row_number() over (partition by vec_id order by p desc, class) as rn from {{class_scores}})
select vec_id, class, case when p < {min_confidence!r}e0 then 'UNKNOWN' else 'T' || cast(class as varchar(5)) end as typology from r where rn = 1"""


@operator("E15")
def ml_focal_loss(d: Spark, gamma: int = 2, alpha: float = 0.75) -> str:
    """Mean focal loss of a score."""
    return f"""
select {d.round(f"avg(-a * power(1 - p, {gamma}) * ln(p))", 9)} as focal_loss from (
  select case when label = 1 then {alpha!r}e0 else 1 - {alpha!r}e0 end as a,
    greatest(1e-7, case when label = 1 then score else 1 - score end) as p from {{scored}}) q"""


@operator("E15 J13")
def ml_neighbour_mean(d: Spark) -> str:
    """One mean-aggregation step: a node's neighbours' mean out-degree."""
    return f"""
with deg as (select from_account as id, count(*) as x from {{tx}} group by from_account)
select p.to_account as account_id, {d.round("avg(cast(coalesce(x, 0) as double))", 9)} as neighbour_mean
from {{pairs}} p left join deg on p.from_account = deg.id group by p.to_account"""


@operator("E18")
def ml_negative_samples(d: Spark, text_ids: bool = False) -> str:
    """A hashed other destination for every transfer."""
    key = d.hash_order("tx_id")
    digits = " + ".join(f"(instr('0123456789abcdef', substr({key}, {i + 1}, 1)) - 1) * {16**i}" for i in range(5))
    return f"""
with {indexed(d, "select distinct to_account as id from {tx}", text_ids)},
  pos as (select tx_id, from_account, to_account, ({digits}) % (select count(*) from ids) as pick from {{tx}})
select tx_id, from_account, to_account, id as negative_account from pos join ids on idx = pick"""


@operator("E8 D4 E22")
def ml_level_counts(d: Spark) -> str:
    """Risk-level counts under two scales."""
    return f"""
select {level_binned("score")} as binned, {severity("score")} as severity, count(*) as n from {{scored}} group by 1, 2"""


@operator("T14 T2")
def stream_hourly_batch(d: Spark) -> str:
    """Hourly event counts, the batch twin of the tumbling-window stream."""
    return f"""
select {d.idiv(d.epoch("ts"), "3600")} as hour, event_type, count(*) as n, {night("ts")} as night
from {{events}} group by 1, 2, {night("ts")}"""
