"""Scalar expressions and predicates as queries."""

from __future__ import annotations

from ..functions import expressions as e
from ..plans.catalog import operator
from ..plans.dialect import Spark


@operator("P4")
def expr_date_parts(d: Spark) -> str:
    """Hour, day of week (Sunday 0) and date."""
    return f"""
select tx_id, cast(hour(tx_timestamp) as bigint) as hour, {d.dow("tx_timestamp")} as dow, cast(cast(tx_timestamp as date) as varchar(10)) as day,
  {e.night("tx_timestamp")} as night, {e.night_flag("tx_timestamp")} as night_flag from {{tx}}"""


@operator("P5 P6 P8")
def expr_safe_math(d: Spark) -> str:
    """Safe division, logarithms, sigmoid, and non-finite values to 0."""
    return f"""
select event_id, value / nullif(event_id % 3, 0) as ratio, {d.round("ln(1 + value)", 9)} as log1p_value,
  {d.round(e.sigmoid("(value - 100.0e0) / 50.0e0"), 9)} as sigmoid_value,
  case when isnan(x) or abs(x) > 1.7e308 then 0.0e0 else x end as finite, greatest(value, 50.0e0) as at_least, abs(value - 100.0e0) as dist
from (select event_id, value, case when event_id % 5 = 0 then cast('NaN' as double) when event_id % 7 = 0
  then cast('Infinity' as double) else value end as x from {{events}}) v"""


@operator("P7")
def expr_fx(d: Spark) -> str:
    """Amounts in the local currency, unknown currencies as they are."""
    return f"select tx_id, currency, {e.fx('amount', 'currency')} as amount_local from {{tx}}"


@operator("P9 P10")
def expr_timestamp_parse(d: Spark) -> str:
    """The first format that fits, as epoch seconds."""
    from .ingest import TS_FORMATS

    parsed = ", ".join(d.try_timestamp("x", *f) for f in TS_FORMATS)
    return f"""
select event_id, coalesce({d.epoch(f"coalesce({parsed})")}, -1) as ep from (select event_id, stamp as x from {{stamped}}) t"""


@operator("P11 P12")
def expr_ids(d: Spark) -> str:
    """Deterministic alert ids of both paths and a key digest."""
    return f"""
select tx_id, {e.alert_id(d, "from_account", "coalesce(typology, 'unknown')", "'run-1'")} as alert_id,
  'ALT-' || upper(substr(sha1(tx_id), 1, 12)) as stream_id, {d.sha256("tx_id")} as key_hash from {{tx}}"""


@operator("P13")
def expr_rule_text(d: Spark) -> str:
    """Text with fixed decimals, cut at 2000 characters."""
    return f"""
select tx_id, substr('amount ' || {d.fixed("amount", 2)} || ' via ' || channel, 1, 2000) as rule_triggered from {{tx}}"""


@operator("P14")
def expr_account_guard(d: Spark) -> str:
    """Whether a name is a well-formed account id."""
    return f"select page_id, {d.matches('url', '^[A-Za-z0-9_-]{1,64}$')} as url_ok, {d.matches('cast(page_id as varchar(20))', '^[A-Za-z0-9_-]{1,64}$')} as id_ok from {{pages}}"


@operator("P15 E5")
def expr_channel_code(d: Spark) -> str:
    """Channel codes, unknown ones 2."""
    return f"select event_id, event_type, {e.channel_code('event_type')} as code, {e.channel_code(chr(39) + 'qris' + chr(39))} as qris from {{events}}"


@operator("P16 N11")
def osint_blocklist_normalise(d: Spark) -> str:
    """Blocklist lines to distinct urls: first token, scheme added, trailing slash off,
    comments and blanks skipped; the first line of a url gives its priority."""
    token = "split_part(trim(line), ' ', 1)"
    return f"""
with urls as (select n, {d.replace_all(f"case when {token} like 'http%' then {token} else 'https://' || {token} end", '/+$', '')} as url
    from {{blocklist}} where trim(line) <> '' and trim(line) not like '#%'),
  firsts as (select url, min(n) as n from urls group by url)
select url, cast(row_number() over (order by n, url) as bigint) as priority from firsts"""


@operator("P17 D4")
def expr_risk_levels(d: Spark) -> str:
    """All five level scales side by side, with scores on their edges."""
    return f"""
select alert_id, tx_id, s as score, {e.severity("s")} as severity, {e.level_binned("s")} as binned, {e.level_ensemble("s")} as ensemble,
  {e.level_stream("s")} as stream, {e.severity_osint("s")} as osint
from (select alert_id, tx_id, risk_score as s from {{edge_scores}}) x"""


@operator("P18 G10")
def graph_viz_style(d: Spark) -> str:
    """Colour by illicit share and size by degree of accounts, for drawings."""
    return """
select account_id, degree, illicit, case when illicit >= 0.6e0 * degree then 'red' when illicit >= 0.2e0 * degree then 'amber'
    else 'green' end as colour, cast(greatest(15, least(45, 10 + 3 * degree)) as bigint) as size
from (select from_account as account_id, count(*) as degree, cast(sum(is_laundering) as bigint) as illicit
  from {tx} group by from_account) g"""
