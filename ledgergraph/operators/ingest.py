"""Scans, cleaning, validation, defaults and idempotent loads."""

from __future__ import annotations

from ..functions.expressions import CHANNELS
from ..plans.catalog import operator
from ..plans.dialect import Spark

TX_COLUMNS = (
    "tx_id, from_account, to_account, cast(amount as double) as amount, currency, channel, payment_format, tx_timestamp, "
    "device_id, institution_id, is_laundering, typology"
)
#: Accepted text timestamps, as Spark and strptime write them.
TS_FORMATS = (
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"),
)


@operator("S1 O1 O2")
def src_scan(d: Spark) -> str:
    """The whole ledger, all twelve columns."""
    return f"select {TX_COLUMNS} from {{tx}}"


@operator("S2 J6")
def src_sliding_window(d: Spark, days: int = 90) -> str:
    """Transfers of the last days before the newest one."""
    return f"""
select {TX_COLUMNS} from {{tx}}
where tx_timestamp >= (select max(tx_timestamp) from {{tx}}) - interval {days} days"""


@operator("S3")
def src_illicit(d: Spark) -> str:
    """Illicit transfers only."""
    return f"select {TX_COLUMNS} from {{tx}} where is_laundering = 1"


@operator("S4")
def src_ordered_days(d: Spark) -> str:
    """Ordered chunks, a chunk being a day: size, amount and ends of each."""
    return """
select cast(cast(tx_timestamp as date) as varchar(10)) as day, count(*) as n, cast(sum(amount) as double) as amount,
  min(tx_timestamp) as first_ts, max(tx_timestamp) as last_ts
from {tx} group by cast(tx_timestamp as date)"""


@operator("S23 L3", offset=50)
def src_replay_page(d: Spark, limit: int = 500, offset: int = 0) -> str:
    """A page of the ledger in the order of time, for replay."""
    return f"select {TX_COLUMNS} from {{tx}} order by tx_timestamp, tx_id limit {limit} offset {offset}"


# Raw landing names and the canonical ones.
RAW_NAMES = {
    "Account": "from_account", "Account.1": "to_account", "Amount Paid": "amount", "Payment Currency": "currency",
    "Payment Format": "payment_format", "Is Laundering": "is_laundering", "Timestamp": "tx_timestamp",
}


@operator("S6")
def src_raw_rename(d: Spark) -> str:
    """Raw landing rows under the twelve canonical names; what landing lacks is null."""
    named = ", ".join(f"{d.quote(raw)} as {name}" for raw, name in RAW_NAMES.items())
    absent = ", ".join(f"cast(null as varchar(10)) as {c}" for c in ("tx_id", "channel", "device_id", "institution_id", "typology"))
    return f"select {named}, {absent} from {{raw_landing}}"


@operator("S7 P10")
def src_time_compress(d: Spark, target_start: int = 1_735_689_600, target_seconds: int = 7_776_000) -> str:
    """Map the ledger's time span affinely on a target span (whole seconds)."""
    ep = d.epoch("tx_timestamp")
    return f"""
with edge as (select min({ep}) as lo, max({ep}) as hi from {{tx}})
select tx_id, cast({target_start} + floor(cast({ep} - lo as double) / cast(hi - lo as double) * {target_seconds}e0) as bigint) as new_epoch
from {{tx}} cross join edge"""


@operator("S9")
def src_device_assignment(d: Spark, pool: int = 4096) -> str:
    """A device per account from the first four hex digits of its MD5."""
    key = d.hash_order("account_id")

    def digit(i: int) -> str:
        return f"(instr('0123456789abcdef', substr({key}, {i}, 1)) - 1)"

    number = f"{digit(1)} * 4096 + {digit(2)} * 256 + {digit(3)} * 16 + {digit(4)}"
    return f"""
select account_id, 'DEV-' || cast(({number}) % {pool} as varchar(10)) as device_id
from (select distinct from_account as account_id from {{tx}}) a"""


@operator("S10 D13")
def src_clean_rows(d: Spark) -> str:
    """Coerce text amounts, turn 'NaN' typologies to null, drop rows without keys."""
    return """
select event_id, user_id, try_cast(raw_amount as double) as amount,
  nullif(nullif(lower(trim(raw_type)), 'nan'), '') as event_type, coalesce(label, 0) as label
from {dirty} where user_id is not null and event_id is not null"""


@operator("S11 U2 U3")
def src_accounts_upsert(d: Spark) -> str:
    """Accounts of both ends not yet in the dimension, the first institution winning."""
    return """
select account_id, institution_id from (
  select account_id, institution_id, row_number() over (partition by account_id order by tx_timestamp, tx_id, side) as rn from (
    select from_account as account_id, institution_id, tx_timestamp, tx_id, 0 as side from {tx}
    union all select to_account, institution_id, tx_timestamp, tx_id, 1 from {tx}) e) r
where rn = 1 and not exists (select 1 from {known_accounts} k where k.account_id = r.account_id)"""


@operator("S12 M5")
def src_account_devices(d: Spark) -> str:
    """Distinct account and device pairs."""
    return "select distinct from_account as account_id, device_id from {tx} where device_id is not null"


@operator("S13 J10 T1")
def src_insert_ignore(d: Spark) -> str:
    """Transfers whose id is not stored yet, one row per id."""
    return """
select tx_id, min(cast(amount as double)) as amount, count(*) as offered from {tx} t
where not exists (select 1 from {alerts} a where a.tx_id = t.tx_id) group by tx_id"""


@operator("S14")
def src_load_summary(d: Spark) -> str:
    """Rows, illicit rows and their share."""
    return """
select count(*) as n, cast(sum(is_laundering) as bigint) as illicit,
  cast(sum(is_laundering) as double) / count(*) * 100.0e0 as illicit_pct, count(distinct tx_id) as ids from {tx}"""


@operator("S16 M2")
def src_graph_edges(d: Spark) -> str:
    """One edge per transfer id, the earliest row's properties winning."""
    return """
select tx_id, from_account, to_account, amount, tx_timestamp from (
  select tx_id, from_account, to_account, cast(amount as double) as amount, tx_timestamp,
    row_number() over (partition by tx_id order by tx_timestamp, amount) as rn from {tx} where trim(tx_id) <> '') r
where rn = 1"""


def _reason(d: Spark) -> str:
    parsed = " and ".join(f"{d.try_timestamp('trim(tx_timestamp)', *f)} is null" for f in TS_FORMATS)
    return f"""case when trim(tx_id) = '' then 'empty tx_id' when trim(from_account) = '' then 'empty from_account'
    when trim(to_account) = '' then 'empty to_account' when not isnan(amount) and amount < 0 then 'negative amount'
    when isnan(amount) or abs(amount) > 1.7e308 then 'amount is not finite' when trim(tx_timestamp) = '' then 'empty tx_timestamp'
    when {parsed} then 'unknown tx_timestamp' end"""


@operator("S19 P9 M10")
def ingest_validate(d: Spark) -> str:
    """The first failed check of each event, or null; unknown channels only warn."""
    known = ", ".join(f"'{c}'" for c in CHANNELS)
    return f"""
select event_id, {_reason(d)} as rejected, coalesce(lower(channel) not in ({known}), false) as channel_warning
from {{offered}}"""


@operator("S20")
def ingest_defaults(d: Spark) -> str:
    """Defaults of absent fields; the two entry paths differ in the channel's."""
    return """
select event_id, coalesce(nullif(currency, ''), 'IDR') as currency, coalesce(nullif(channel, ''), 'internet') as channel_gateway,
  coalesce(nullif(channel, ''), 'mobile') as channel_producer, coalesce(nullif(payment_format, ''), 'Transfer') as payment_format,
  coalesce(is_laundering, 0) as is_laundering
from {offered}"""


@operator("S21")
def ingest_summary(d: Spark) -> str:
    """Received, accepted and rejected events, and up to 20 rejected ids by reason."""
    ids = d.first_n(d.sorted_list("event_id"), 20)
    joined = d.join(ids, ",") if d.name == "duck" else f"array_join(transform({ids}, x -> cast(x as string)), ',')"
    return f"""
select coalesce(rejected, 'accepted') as outcome, count(*) as n, {joined} as samples
from (select event_id, {_reason(d)} as rejected from {{offered}}) v group by coalesce(rejected, 'accepted')"""


@operator("S25 L1 U1")
def src_demo_replay(d: Spark, illicit: int = 50, licit: int = 200, min_amount: int = 1000) -> str:
    """A replay set over sampled hold-out accounts: some illicit transfers and licit ones
    for the rest, by time."""
    body = f"from_account <> to_account and amount >= {min_amount} and from_account in (select account_id from {{holdout}})"

    def part(label: int, n: int) -> str:
        return f"""select * from (select tx_id, from_account, to_account, cast(amount as double) as amount, tx_timestamp, is_laundering
    from {{tx}} where {body} and is_laundering = {label} order by tx_timestamp, tx_id limit {n}) p{label}"""

    return f"{part(1, illicit)} union all {part(0, licit)}"


@operator("S26 W1 L1")
def src_demo_collectors(d: Spark, top: int = 25, incoming: int = 300, outgoing: int = 15) -> str:
    """Transfers of the accounts with most illicit senders: incoming, then outgoing."""
    return f"""
with best as (select to_account as account_id from {{tx}} where is_laundering = 1 group by to_account
    order by count(distinct from_account) desc, to_account limit {top}),
  i as (select to_account as account_id, tx_id, 'IN' as side, row_number() over (partition by to_account order by tx_timestamp, tx_id) as rn
    from {{tx}} where to_account in (select account_id from best)),
  o as (select from_account as account_id, tx_id, 'OUT' as side, row_number() over (partition by from_account order by tx_timestamp, tx_id) as rn
    from {{tx}} where from_account in (select account_id from best) and from_account <> to_account)
select account_id, tx_id, side, cast(rn as bigint) as rn from i where rn <= {incoming}
union all select account_id, tx_id, side, cast(rn as bigint) as rn from o where rn <= {outgoing}"""
