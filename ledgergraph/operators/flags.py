"""Behavioural flags of single accounts over their newest transfers."""

from __future__ import annotations

from ..functions.expressions import STRUCT_FLAG_LIMITS, night_flag
from ..plans.catalog import operator
from ..plans.dialect import Spark

#: Newest incident transfers per account, sent and received apart (a self-transfer is both).
_INCIDENT = """incident as (select account_id, direction, tx_id, peer, amount, tx_timestamp, channel from (
    select *, row_number() over (partition by account_id order by tx_timestamp desc, tx_id, direction) as rn from (
      select from_account as account_id, 'OUT' as direction, tx_id, to_account as peer, amount, tx_timestamp, channel from {tx}
      union all
      select to_account, 'IN', tx_id, from_account, amount, tx_timestamp, channel from {tx}) e) r where rn <= @newest)"""


#: The same for Spark: both ends of a transfer from one pass over the ledger.
_INCIDENT_SPARK = """incident as (select account_id, direction, tx_id, peer, amount, tx_timestamp, channel from (
    select *, row_number() over (partition by account_id order by tx_timestamp desc, tx_id, direction) as rn from (
      select tx_id, amount, tx_timestamp, channel,
        stack(2, from_account, 'OUT', to_account, to_account, 'IN', from_account) as (account_id, direction, peer)
      from {tx}) e) r where rn <= @newest)"""


def _incident(d: Spark, newest: int) -> str:
    return (_INCIDENT_SPARK if d.name == "spark" else _INCIDENT).replace("@newest", str(newest))


@operator("B1")
def flag_structuring(d: Spark, newest: int = 500, min_hits: int = 3) -> str:
    """A flag per limit with three sent transfers within 85 and 99.9 per cent of it."""
    limits = " union all ".join(f"select {t} as lim" for t in STRUCT_FLAG_LIMITS)
    ids = d.join(d.first_n(d.sorted_list("tx_id"), 5), ",")
    return f"""
with {_incident(d, newest)}, limits as ({limits})
select account_id, 'STRUCTURING' as flag_type, 'HIGH' as severity, cast(lim as bigint) as lim, count(*) as hits, {ids} as evidence
from incident join limits on amount >= lim * 0.85 and amount <= lim * 0.999
where direction = 'OUT' group by account_id, lim having count(*) >= {min_hits}"""


@operator("B2")
def flag_timing(d: Spark, newest: int = 500, min_hits: int = 2) -> str:
    """Two or more transfers between midnight and five."""
    return f"""
with {_incident(d, newest)}
select account_id, 'TIMING_ANOMALY' as flag_type, 'MEDIUM' as severity, count(*) as hits
from incident where {night_flag("tx_timestamp")} group by account_id having count(*) >= {min_hits}"""


@operator("B3 J8", {"tx": "flagged"})
def flag_rapid_cashout(d: Spark, newest: int = 500, seconds: int = 600) -> str:
    """Money that leaves within ten minutes of its arrival (range join)."""
    return f"""
with {_incident(d, newest)},
  gaps as (select i.account_id, {d.epoch("o.tx_timestamp")} - {d.epoch("i.tx_timestamp")} as gap
    from incident i join incident o on i.account_id = o.account_id
      and o.tx_timestamp >= i.tx_timestamp and o.tx_timestamp <= i.tx_timestamp + interval {seconds} seconds
    where i.direction = 'IN' and o.direction = 'OUT')
select account_id, 'RAPID_CASHOUT' as flag_type, 'HIGH' as severity, count(*) as events, min(gap) as fastest
from gaps group by account_id"""


@operator("B4")
def flag_channel_switch(d: Spark, newest: int = 500) -> str:
    """Three or more channels."""
    return f"""
with {_incident(d, newest)}
select account_id, 'CHANNEL_SWITCH' as flag_type, 'MEDIUM' as severity, count(distinct channel) as channels,
  {d.join_distinct("channel")} as names
from incident group by account_id having count(*) >= 3 and count(distinct channel) >= 3"""


@operator("B5", {"tx": "flagged"})
def flag_channel_hop(d: Spark, newest: int = 500, seconds: int = 1800) -> str:
    """Exactly two channels, changed within half an hour."""
    if d.name == "spark":  # the channels are counted beside the steps, so the newest transfers are found once
        line = "over (partition by account_id order by tx_timestamp, tx_id, direction)"
        return f"""
with {_incident(d, newest)},
  steps as (select account_id, channel, {d.epoch("tx_timestamp")} as ep, lag(channel) {line} as last_channel, lag({d.epoch("tx_timestamp")}) {line} as last_ep,
      min(channel) over (partition by account_id) as one, max(channel) over (partition by account_id) as two
    from incident where account_id is not null),
  hops as (select account_id, min(ep - last_ep) filter (where channel <> last_channel and ep - last_ep < {seconds}) as fastest,
      count(*) filter (where channel <> last_channel and ep - last_ep < {seconds}) as hops,
      count(*) filter (where channel <> one and channel <> two) as others, max(one) < max(two) as several
    from steps group by account_id)
select account_id, 'CHANNEL_SWITCH' as flag_type, 'LOW' as severity, fastest, hops from hops where several and others = 0 and hops > 0"""
    return f"""
with {_incident(d, newest)},
  two as (select account_id from incident group by account_id having count(distinct channel) = 2),
  steps as (select account_id, channel, {d.epoch("tx_timestamp")} as ep,
      lag(channel) over (partition by account_id order by tx_timestamp, tx_id, direction) as last_channel,
      lag({d.epoch("tx_timestamp")}) over (partition by account_id order by tx_timestamp, tx_id, direction) as last_ep
    from incident where account_id in (select account_id from two))
select account_id, 'CHANNEL_SWITCH' as flag_type, 'LOW' as severity, min(ep - last_ep) as fastest, count(*) as hops
from steps where channel <> last_channel and ep - last_ep < {seconds} group by account_id"""


@operator("B6 W3", min_hits=2)
def flag_frequency(d: Spark, newest: int = 500, min_hits: int = 8) -> str:
    """Eight or more transfers in an hour that starts with one of them."""
    return f"""
with {_incident(d, newest)},
  w as (select account_id, count(*) over (partition by account_id order by {d.epoch("tx_timestamp")}
      range between current row and 3599 following) as n from incident)
select account_id, 'FREQUENCY_ANOMALY' as flag_type, 'HIGH' as severity, max(n) as peak
from w group by account_id having max(n) >= {min_hits}"""


@operator("B7 B8 R13")
def flag_incident_amounts(d: Spark, newest: int = 500) -> str:
    """The sum of an account's newest transfers."""
    return f"""
with {_incident(d, newest)}
select account_id, count(*) as n, cast(sum(amount) as double) as amount_involved from incident group by account_id"""
