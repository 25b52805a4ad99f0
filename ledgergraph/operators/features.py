"""The 24-column account feature contract and its parts."""

from __future__ import annotations

from ..functions.expressions import night, round_amount, struct_feature
from ..functions.ranking import moments
from ..plans.catalog import operator
from ..plans.dialect import Spark

FEATURE_COLUMNS = (
    "in_degree", "out_degree", "in_amount_sum", "out_amount_sum", "unique_senders", "unique_recipients", "total_tx",
    "max_single_tx", "degree_ratio", "amount_ratio", "night_tx_ratio", "avg_amount_in", "avg_amount_out",
    "counterparty_hhi", "channel_entropy", "round_amount_ratio", "structuring_score", "burst_ratio", "inter_tx_std",
    "dormancy_days", "device_sharing_count", "n_institutions", "pagerank", "kcore_number",
)


def _side(d: Spark, own: str, other: str, p: str, shapes: bool = False) -> str:
    counts = {f"{p}_night": night("tx_timestamp")}
    if shapes:
        counts |= {"n_round": round_amount("amount"), "n_struct": struct_feature("amount")}
    counted = "".join(f", count(*) filter (where {x}) as {n}" for n, x in counts.items())
    if d.name == "spark":  # a pair of accounts is grouped once, so that its receiver or sender is counted without a second copy of the rows
        summed = "".join(f", sum({n}) as {n}" for n in counts)
        return f"""select {own} as account_id, sum(n_) as {p}_degree, sum(sum_) as {p}_amount_sum,
    count({other}) as {p}_peers, max(max_) as {p}_max, sum(bad_) as {p}_illicit{summed} from (
      select {own}, {other}, count(*) as n_, sum(amount) as sum_, max(amount) as max_, cast(sum(is_laundering) as bigint) as bad_{counted}
      from {{tx}} group by {own}, {other}) g group by {own}"""
    extra = f""",
    count(*) filter (where {round_amount("amount")}) as n_round,
    count(*) filter (where {struct_feature("amount")}) as n_struct""" if shapes else ""
    return f"""select {own} as account_id, count(*) as {p}_degree, sum(amount) as {p}_amount_sum,
    count(distinct {other}) as {p}_peers, max(amount) as {p}_max,
    count(*) filter (where {night("tx_timestamp")}) as {p}_night,
    cast(sum(is_laundering) as bigint) as {p}_illicit{extra} from {{tx}} group by {own}"""


@operator("F1 A1")
def feat_incoming(d: Spark) -> str:
    """Per receiver: count, sum, distinct senders, largest, at night, illicit."""
    return f"select account_id, in_degree, cast(in_amount_sum as double) as in_amount_sum, in_peers as unique_senders, cast(in_max as double) as in_max, in_night, in_illicit from ({_side(d, 'to_account', 'from_account', 'in')}) i"


@operator("F2 F13 P1")
def feat_outgoing(d: Spark) -> str:
    """Per sender, with the shares of round and limit-hugging amounts."""
    return f"""
select account_id, out_degree, cast(out_amount_sum as double) as out_amount_sum, out_peers as unique_recipients,
  cast(out_max as double) as out_max, out_night, out_illicit,
  cast(n_round as double) / out_degree as round_amount_ratio, cast(n_struct as double) / out_degree as structuring_score
from ({_side(d, "from_account", "to_account", "out", True)}) o"""


@operator("F3 P3 J10 O1")
def feat_incoming_of(d: Spark) -> str:
    """Incoming measures of the accounts in the customer table only (semi-join)."""
    return f"""
select to_account as account_id, count(*) as in_degree, cast(sum(amount) as double) as in_amount_sum
from {{tx}} where to_account in (select c_custkey from {{customer}})
group by to_account"""


def _endpoints(d: Spark) -> str:
    if d.name == "spark":
        return d.ends("tx_timestamp", "channel", "institution_id")
    return """select from_account as account_id, tx_timestamp, channel, institution_id from {tx}
    union all select to_account, tx_timestamp, channel, institution_id from {tx}"""


@operator("F12 A5")
def feat_channel_entropy(d: Spark) -> str:
    """Entropy in bits of the channels of both directions; null is a channel."""
    return f"""
with k as (select account_id, channel, cast(count(*) as double) as n from ({_endpoints(d)}) e group by account_id, channel),
  t as (select account_id, n, sum(n) over (partition by account_id) as total from k)
select account_id, {d.round("-sum((n / total) * log2(n / total + 1e-12))", 6)} as channel_entropy from t group by account_id"""


def _temporal(d: Spark, newest: int) -> str:
    # of equal times any may be among the newest, as only times are used; Spark need not sort their ids
    ties = "" if d.name == "spark" else ", tx_id desc"
    one = """select {own} as account_id, tx_timestamp from (select {own}, tx_timestamp,
      row_number() over (partition by {own} order by tx_timestamp desc{ties}) as rn
      from {{tx}} where tx_timestamp is not null) q where rn <= {k}"""
    both = " union all ".join(one.format(own=c, k=newest, ties=ties).replace("{{tx}}", "{tx}") for c in ("from_account", "to_account"))
    return f"""
with u as (select account_id, {d.epoch("tx_timestamp")} as ep from ({both}) b),
  g as (select account_id, ep - lag(ep) over (partition by account_id order by ep) as gap,
      count(*) over (partition by account_id order by ep range between 3600 preceding and current row) as w
    from u),
  s as (select account_id, count(*) as n, max(w) as w, stddev_pop(gap) as sd, max(gap) as gap from g group by account_id)
select account_id, case when n <= 1 then 0.0e0 else cast(w as double) / n end as burst_ratio,
  case when n <= 1 then 0.0e0 else {d.round("sd", 4)} end as inter_tx_std,
  case when n <= 1 then 0.0e0 else cast(gap as double) / 86400.0e0 end as dormancy_days
from s"""


@operator("F14 F15 F16 F17 J7 W1 W2 W3 A11 O4 O12")
def feat_temporal(d: Spark, newest: int = 500) -> str:
    """Bursts, gap deviation and longest gap over the newest transfers per direction."""
    return _temporal(d, newest)


@operator("F27 D6 A9")
def feat_temporal_short(d: Spark, newest: int = 20) -> str:
    """The same over the newest 20 transfers of both directions together."""
    return f"""
with e as ({_endpoints(d)}),
  u as (select account_id, ep from (select account_id, {d.epoch("tx_timestamp")} as ep,
      row_number() over (partition by account_id order by {d.epoch("tx_timestamp")} desc) as rn from e) q where rn <= {newest}),
  g as (select account_id, ep - lag(ep) over (partition by account_id order by ep) as gap,
      count(*) over (partition by account_id order by ep range between 3600 preceding and current row) as w from u)
select account_id, cast(max(w) as double) / count(*) as burst_ratio, coalesce({d.round("stddev_pop(gap)", 4)}, 0.0e0) as inter_tx_std,
  coalesce(cast(max(gap) as double) / 86400.0e0, 0.0e0) as dormancy_days
from g group by account_id"""


def first_seen(d: Spark) -> str:
    """CTE ``first_seen_`` (``account_id, first_seen``)."""
    return f"""first_seen_ as (select account_id, min(tx_timestamp) as first_seen from (
      {d.ends("tx_timestamp")}) e
    group by account_id)"""


#: Ranks at which training and validation accounts end.
TRAIN_END = "cast(floor(0.70e0 * total) as bigint)"
VAL_END = f"({TRAIN_END} + cast(floor(0.15e0 * total) as bigint))"
def cutoff(d: Spark) -> str:
    """CTE ``cut_`` (``cutoff``): when 85 per cent of the accounts have appeared."""
    return f"""{first_seen(d)},
  {moments("first_seen_", "first_seen", {"cut": f"{VAL_END} - 1"})},
  cut_ as (select v as cutoff from at_cut)"""


@operator("F18 F22 W4 J12")
def feat_device_sharing(d: Spark, max_cluster: int = 20) -> str:
    """Other accounts on an account's devices, pools of over 20 accounts left out;
    only transfers up to the validation cut-off count."""
    return f"""
with {cutoff(d)},
  own as (select distinct from_account as account_id, device_id from {{tx}} cross join cut_
    where device_id is not null and tx_timestamp <= cutoff),
  cluster as (select device_id, count(*) as n from own group by device_id)
select account_id, cast(greatest(max(n) - 1, 0) as bigint) as device_sharing_count
from own join cluster on own.device_id = cluster.device_id where n <= {max_cluster} group by account_id"""


@operator("F19 F22")
def feat_institutions(d: Spark) -> str:
    """Distinct institutions of both directions up to the validation cut-off."""
    return f"""
with {cutoff(d)}
select account_id, count(distinct institution_id) as n_institutions
from ({_endpoints(d)}) e cross join cut_ where tx_timestamp <= cutoff group by account_id"""


@operator("F29")
def feat_institutions_active(d: Spark, days: int = 30) -> str:
    """The same without cut-off, for accounts active in the last days."""
    return f"""
with e as ({_endpoints(d)}),
  active as (select distinct account_id from e where tx_timestamp >= (select max(tx_timestamp) from e) - interval {days} days)
select account_id, count(distinct institution_id) as n_institutions from e
where account_id in (select account_id from active) group by account_id"""


@operator("F23 A1")
def feat_first_seen(d: Spark) -> str:
    """When an account first appears in either direction."""
    return f"select account_id, min(tx_timestamp) as first_seen, count(*) as n from ({_endpoints(d)}) e group by account_id"


@operator("F24")
def feat_val_cutoff(d: Spark) -> str:
    """The moment by which 85 per cent of the accounts have appeared."""
    return f"with {cutoff(d)} select cutoff as val_cutoff from cut_"


@operator("F4 F5 F6 F7 F8 F9 F10 F11 J1 J3 P5 P8 A7 A8 O3")
def feat_account_table(d: Spark) -> str:
    """All SQL features of every account in one plan; an absent side counts as 0."""
    return f"""
with i as ({_side(d, "to_account", "from_account", "in")}),
  o as ({_side(d, "from_account", "to_account", "out", True)}),
  t as (select coalesce(i.account_id, o.account_id) as account_id,
      coalesce(in_degree, 0) as in_degree, coalesce(out_degree, 0) as out_degree,
      cast(coalesce(in_amount_sum, 0) as double) as in_amount_sum, cast(coalesce(out_amount_sum, 0) as double) as out_amount_sum,
      coalesce(in_peers, 0) as unique_senders, coalesce(out_peers, 0) as unique_recipients,
      cast(greatest(coalesce(in_max, 0), coalesce(out_max, 0)) as double) as max_single_tx,
      coalesce(in_night, 0) + coalesce(out_night, 0) as night,
      coalesce(in_illicit, 0) + coalesce(out_illicit, 0) as illicit,
      coalesce(n_round, 0) as n_round, coalesce(n_struct, 0) as n_struct
    from i full outer join o on i.account_id = o.account_id),
  c as ({feat_channel_entropy.build(d)}), w as ({_temporal(d, 500)}),
  dv as ({feat_device_sharing.build(d)}), n as ({feat_institutions.build(d)})
select t.account_id, in_degree, out_degree, in_amount_sum, out_amount_sum, unique_senders, unique_recipients,
  in_degree + out_degree as total_tx, max_single_tx,
  cast(out_degree as double) / (in_degree + 1) as degree_ratio, out_amount_sum / (in_amount_sum + 1) as amount_ratio,
  cast(night as double) / greatest(in_degree + out_degree, 1) as night_tx_ratio,
  in_amount_sum / (in_degree + 1) as avg_amount_in, out_amount_sum / (out_degree + 1) as avg_amount_out,
  1.0e0 / greatest(unique_recipients, 1) as counterparty_hhi,
  coalesce(channel_entropy, 0.0e0) as channel_entropy,
  cast(n_round as double) / greatest(out_degree, 1) as round_amount_ratio,
  cast(n_struct as double) / greatest(out_degree, 1) as structuring_score,
  coalesce(burst_ratio, 0.0e0) as burst_ratio, coalesce(inter_tx_std, 0.0e0) as inter_tx_std,
  coalesce(dormancy_days, 0.0e0) as dormancy_days,
  coalesce(device_sharing_count, 0) as device_sharing_count, coalesce(n_institutions, 0) as n_institutions,
  case when illicit > 0 then 1 else 0 end as is_laundering_label
from t left join c on t.account_id = c.account_id left join w on t.account_id = w.account_id
  left join dv on t.account_id = dv.account_id left join n on t.account_id = n.account_id"""


@operator("F25 L4 S25")
def feat_account_sample(d: Spark, illicit: int = 80, licit: int = 20) -> str:
    """Accounts of illicit transfers by id, and others in a fixed hash order."""
    return f"""
with e as (select from_account as account_id, is_laundering from {{tx}} union all select to_account, is_laundering from {{tx}}),
  bad as (select distinct account_id from e where is_laundering = 1)
select account_id, 1 as label from (select account_id from bad order by account_id limit {illicit}) b
union all
select account_id, 0 as label from (select account_id from (select distinct account_id from e) a
  where not exists (select 1 from bad b where b.account_id = a.account_id) order by {d.hash_order("account_id")} limit {licit}) g"""
