"""Views that stand for the engine's tables over the test tables.

``tx`` is a transaction ledger over ``lineitem`` and ``orders``; customers and
parts share one id space, so the graph has cycles.  Every view exists for both
dialects and has the same rows in both.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.workspace import CODEC, Workspace
from .dialect import DUCK, SPARK, Spark

RAW = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _tx_narrow(d: Spark) -> str:
    """The same ledger for Spark: what depends on one side alone is computed before the join,
    so that the join moves and sorts narrow rows.  Spark keeps only what a plan uses."""
    seconds = "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 86400"
    return f"""
select 'TX-' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string)
    || '-' || cast(l_suppkey as string) as tx_id,
  from_account, cast(l_partkey as bigint) as to_account, amount, currency, channel, payment_format, tx_timestamp,
  case when from_account % 3 = 0 then 'DEV-S-' || cast({d.idiv('from_account', '36')} as string)
    else 'DEV-P-' || cast(from_account % 5 as string) end as device_id,
  'BANK_' || cast(l_suppkey % 8 as string) as institution_id, is_laundering,
  case when is_laundering = 1 and l_linenumber <= 3 then case l_linenumber when 1 then 'judol' when 2 then 'qris' else 'dormant' end end as typology
from (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
    cast(cast(l_extendedprice as decimal(18,2)) * case l_returnflag when 'A' then 105 when 'N' then 190 else 2250 end
      as decimal(18,2)) as amount,
    case l_returnflag when 'A' then 'Yen' when 'N' then 'Rupee' else 'Yuan' end as currency,
    timestampadd(SECOND, cast({seconds} as int), l_shipdate) as tx_timestamp,
    cast(case when l_returnflag = 'R' and l_linestatus = 'F' and l_discount >= 0.09 then 1 else 0 end as int) as is_laundering
  from {{lineitem}}) l
join (select o_orderkey, cast(o_custkey as bigint) as from_account, o_orderstatus as payment_format,
    case o_orderpriority when '1-URGENT' then 'qris' when '2-HIGH' then 'mobile' when '3-MEDIUM' then 'atm'
      when '4-NOT SPECIFIED' then 'internet' else 'teller' end as channel
  from {{orders}}) o on l_orderkey = o_orderkey"""


def _tx(d: Spark) -> str:
    if d.name == "spark":
        return _tx_narrow(d)
    seconds = "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 86400"
    return f"""
select 'TX-' || cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) || '-' || cast(l_partkey as varchar)
    || '-' || cast(l_suppkey as varchar) as tx_id,
  cast(o_custkey as bigint) as from_account, cast(l_partkey as bigint) as to_account,
  cast(cast(l_extendedprice as decimal(18,2)) * case l_returnflag when 'A' then 105 when 'N' then 190 else 2250 end
    as decimal(18,2)) as amount,
  case l_returnflag when 'A' then 'Yen' when 'N' then 'Rupee' else 'Yuan' end as currency,
  case o_orderpriority when '1-URGENT' then 'qris' when '2-HIGH' then 'mobile' when '3-MEDIUM' then 'atm'
    when '4-NOT SPECIFIED' then 'internet' else 'teller' end as channel,
  o_orderstatus as payment_format,
  l_shipdate + to_seconds({seconds}) as tx_timestamp,
  case when o_custkey % 3 = 0 then 'DEV-S-' || cast({d.idiv('o_custkey', '36')} as varchar)
    else 'DEV-P-' || cast(o_custkey % 5 as varchar) end as device_id,
  'BANK_' || cast(l_suppkey % 8 as varchar) as institution_id,
  cast(case when l_returnflag = 'R' and l_linestatus = 'F' and l_discount >= 0.09 then 1 else 0 end as int) as is_laundering,
  case when l_returnflag = 'R' and l_linestatus = 'F' and l_discount >= 0.09 and l_linenumber <= 3
    then case l_linenumber when 1 then 'judol' when 2 then 'qris' else 'dormant' end end as typology
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey"""


def _pairs(d: Spark) -> str:
    return "select distinct from_account, to_account from {tx}"


def _alerts(d: Spark) -> str:
    """A stored alert table: one alert per illicit transfer of a known typology."""
    return f"""
select 'ALT-' || upper(substr(sha1(tx_id), 1, 12)) as alert_id, from_account as account_id, tx_id,
  'C' || lpad(cast(from_account % 50 as varchar(20)), 4, '0') as cluster_id, typology,
  case typology when 'judol' then 'TYPOLOGY_ID' when 'qris' then 'TYPOLOGY_ID' else 'STATISTICAL' end as detection_layer,
  cast(from_account % 100 as double) / 100.0e0 as risk_score,
  'rule:' || typology as rule_triggered,
  case when from_account % 100 >= 80 then 'HIGH' when from_account % 100 >= 50 then 'MEDIUM' else 'LOW' end as severity,
  cast(1 + from_account % 7 as int) as node_count,
  case from_account % 4 when 0 then 'NEW' when 1 then 'IN_REVIEW' when 2 then 'ESCALATED' else 'CLOSED' end as status,
  tx_timestamp as created_at,
  case from_account % 3 when 0 then 'FAN_IN' when 1 then 'FAN_OUT' end as aml_pattern,
  cast(case when from_account % 2 = 0 then amount end as double) as amount_at_risk,
  cast(from_account % 9 as bigint) as in_degree, cast(to_account % 9 as bigint) as out_degree
from {{tx}} where typology is not null"""


def _cases(d: Spark) -> str:
    return """
select cast(row_number() over (order by alert_id) as bigint) as case_id, alert_id,
  case when account_id % 3 = 0 then null else 'officer' || cast(account_id % 5 as varchar(20)) end as assigned_to,
  case account_id % 4 when 0 then 'OPEN' when 1 then 'IN_PROGRESS' when 2 then 'ESCALATED' else 'CLOSED' end as status,
  created_at as opened_at
from {alerts} where account_id % 2 = 0"""


def _scored(d: Spark) -> str:
    """Labelled scores: the label is ``quality``, the score derives from the id."""
    return """
select doc_id, cast(quality as int) as label, cast((doc_id * 37) % 101 as double) / 101.0e0 as score,
  cast((doc_id * 53) % 97 as double) / 97.0e0 as score_b,
  case when doc_id % 5 = 0 then null else cast((doc_id * 29) % 89 as double) / 89.0e0 end as score_c, doc_id % 10 as fold
from {labels}"""


def _known_accounts(d: Spark) -> str:
    """A stored account dimension that has every second customer."""
    return "select c_custkey as account_id from {customer} where c_custkey % 2 = 0"


def _stamped(d: Spark) -> str:
    """Times as texts in three formats, and some that are none."""
    return """
select event_id, cast(cast(ts as date) as varchar(10)) || case event_id % 4 when 0 then ' 01:02:03' when 1 then 'T04:05:06'
  when 2 then ' 07:08:09.123456' else ' noon' end as stamp from {events}"""


def _blocklist(d: Spark) -> str:
    """Numbered lines: comments, blanks, notes after the address, addresses without a scheme."""
    return """
select page_id as n, case page_id % 5 when 0 then '# ' || url when 1 then '' when 2 then url || '/ extra'
  when 3 then replace(url, 'http://', '') else url end as line from {pages}"""


def _edge_scores(d: Spark) -> str:
    """Alerts with scores on the edges of the level scales."""
    return "select alert_id, tx_id, cast(account_id % 21 as double) / 20.0e0 as risk_score from {alerts}"


def _class_scores(d: Spark) -> str:
    """A classifier's output in long form: the squared parts of unit vectors sum to 1."""
    items = "posexplode(embedding) as (label_, p)" if d.name == "spark" else "unnest(range(len(embedding))) as label_, unnest(embedding) as p"
    return f"select vec_id, cast(label_ as bigint) as class, cast(p as double) * cast(p as double) as p from (select vec_id, {items} from {{embeddings}}) u"


def _features(d: Spark) -> str:
    """Some feature columns of the accounts, amounts as logarithms; late comers have none."""
    return """
select account_id, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree, ln(1 + cast(sum(i * amount) as double)) as in_log,
  ln(1 + cast(sum(o * amount) as double)) as out_log, cast(sum(night) as double) / count(*) as night_ratio
from (select from_account as account_id, 0 as i, 1 as o, amount, case when hour(tx_timestamp) < 4 then 1 else 0 end as night, tx_timestamp from {tx}
  union all select to_account, 1, 0, amount, case when hour(tx_timestamp) < 4 then 1 else 0 end, tx_timestamp from {tx}) e
group by account_id having min(tx_timestamp) < (select max(tx_timestamp) from {tx}) - interval 2200 days"""


def _holdout(d: Spark) -> str:
    return "select c_custkey as account_id from {customer} where c_custkey % 3 = 0"


def _predictions(d: Spark) -> str:
    """A model's output: a score per account."""
    return "select c_custkey as account_id, cast((c_custkey * 31) % 101 as double) / 101.0e0 as risk_score from {customer}"


def _raw_landing(d: Spark) -> str:
    """Landing rows under their seven raw names."""
    names = ("Account", "Account.1", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering", "Timestamp")
    values = ("o_custkey", "l_partkey", "l_extendedprice", "o_orderpriority", "o_orderstatus", "case when l_returnflag = 'R' then 1 else 0 end", "l_shipdate")
    columns = ", ".join(f"{v} as {d.quote(n)}" for n, v in zip(names, values, strict=True))
    return f"select {columns} from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey"


def _dirty(d: Spark) -> str:
    """Rows with missing keys, text amounts and 'NaN' types."""
    return """
select event_id, case when event_id % 11 = 0 then null else user_id end as user_id,
  case when event_id % 7 = 0 then 'n/a' else cast(value as varchar(30)) end as raw_amount,
  case when event_id % 5 = 0 then ' NaN ' else event_type end as raw_type, case when event_id % 3 = 0 then 1 end as label from {events}"""


def _offered(d: Spark) -> str:
    """Events as senders offer them, some of them broken in every way that is checked."""
    return """
select event_id, case when event_id % 13 = 0 then ' ' else 'TX' || cast(event_id as varchar(20)) end as tx_id,
  case when event_id % 17 = 0 then '' else cast(user_id as varchar(20)) end as from_account,
  case when event_id % 19 = 0 then '' else cast(user_id + 1 as varchar(20)) end as to_account,
  case when event_id % 23 = 0 then -value when event_id % 29 = 0 then cast('NaN' as double) else value end as amount,
  case when event_id % 31 = 0 then '' when event_id % 37 = 0 then 'yesterday' when event_id % 2 = 0
    then cast(cast(ts as date) as varchar(10)) || 'T10:00:00' else cast(cast(ts as date) as varchar(10)) || ' 11:30:00' end as tx_timestamp,
  case when event_id % 4 = 0 then null else event_type end as channel, case when event_id % 3 = 0 then '' else 'USD' end as currency,
  case when event_id % 5 = 0 then '' else 'Wire' end as payment_format, case when event_id % 2 = 0 then 1 end as is_laundering from {events}"""


def _commands(d: Spark) -> str:
    """What officers did to alerts, in order: a case opened twice now and then, hand-overs, states."""
    return """
select account_id as subject, seq, kind, value from (
  select account_id, cast(row_number() over (partition by account_id order by created_at, alert_id, tx_id) as bigint) as seq,
    case n % 5 when 0 then 'ASSIGN' when 1 then 'STATUS' when 2 then 'ESCALATE' when 3 then 'CREATE' else 'ASSIGN' end as kind,
    case n % 5 when 1 then case n % 3 when 0 then 'CLOSED' when 1 then 'FP' else 'IN_REVIEW' end when 2 then 'to the head office'
      when 3 then '' else 'officer' || cast(n % 3 as varchar(5)) end as value
  from (select *, cast(in_degree + 2 * out_degree as bigint) as n from {alerts}) a) c"""


def _planted(d: Spark) -> str:
    """Pages with payment lines and how their text was got, since the test pages have none."""
    return """
select page_id, url, case page_id % 3 when 0 then 'ocr' when 1 then 'html' else 'visual' end as origin,
  html || case page_id % 6 when 0 then ' BCA : 12345' || lpad(cast(page_id % 7 as varchar(5)), 5, '0')
    when 1 then ' DANA 0812-3456-78' || lpad(cast(page_id % 9 as varchar(5)), 2, '0')
    when 2 then ' mandiri 123 456 789 0' || lpad(cast(page_id % 5 as varchar(5)), 3, '0')
    when 3 then ' bri 1 gopay 62812 3456 789' || cast(page_id % 4 as varchar(5)) || ' bni 99.8877.66' || lpad(cast(page_id % 3 as varchar(5)), 2, '0')
    when 4 then ' ovo 777 888 999 ' || cast(page_id % 2 as varchar(5)) || ' call 0812 3456 7890 now'
    else ' Just a moment...' end as html from {pages}"""


def _visits(d: Spark) -> str:
    """What a crawler got: the page, and the message of a failed visit."""
    return """
select page_id, html, case page_id % 3 when 0 then 'net::ERR_PROXY_CONNECTION_FAILED' when 1 then 'Timeout 30000ms exceeded' else 'gone' end as message
from {planted}"""


def _queue(d: Spark) -> str:
    return """
select page_id, url, case when page_id % 3 = 0 then 'DONE' when page_id % 5 = 0 then 'FAILED' else 'PENDING' end as status,
  page_id % 4 as attempts, page_id % 10 as priority, page_id % 7 as queued_at from {pages}"""


def _seeds(d: Spark) -> str:
    """Accounts found on gambling pages, with the score of the finding."""
    return "select c_custkey as account_id, 0.90e0 as score from {customer} where c_custkey % 40 = 0"


def _found(d: Spark) -> str:
    """Accounts that extraction finds on the planted pages, with the page's address."""
    from ..operators.extraction import osint_extract_accounts

    hits = osint_extract_accounts.build(d).replace("{page_texts}", "{planted}")
    return f"select f.page_id, p.url, f.rekening, f.bank, f.account_type, f.confidence from ({hits}) f join {{planted}} p on f.page_id = p.page_id"


def _flagged(d: Spark) -> str:
    """The ledger with the transfers of three invented accounts, one per behavioural flag that it lacks."""
    text = "string" if d.name == "spark" else "varchar"
    rows = [
        ("2", 9_000_002, 9_000_009, 4_990_000, "02:30:00", "qris"), ("3", 9_000_002, 9_000_009, 4_980_000, "02:35:00", "teller"),
        ("4", 9_000_002, 9_000_009, 4_970_000, "02:40:00", "atm"), ("5", 9_000_002, 9_000_009, 4_960_000, "02:45:00", "mobile"),
        ("6", 9_000_001, 9_000_002, 5_000_000, "02:50:00", "teller"), ("7", 9_000_002, 9_000_003, 4_900_000, "02:53:00", "qris"),
        ("8", 9_000_002, 9_000_008, 100_000, "02:55:00", "qris"), ("9", 9_000_002, 9_000_008, 100_000, "03:00:00", "qris"),
        ("10", 9_000_002, 9_000_008, 100_000, "03:05:00", "teller"), ("11", 9_000_002, 9_000_008, 100_000, "03:10:00", "atm"),
        ("12", 9_000_004, 9_000_005, 100_000, "10:00:00", "atm"), ("13", 9_000_004, 9_000_005, 100_000, "10:10:00", "qris"),
        ("14", 9_000_006, 9_000_007, 100_000, "10:00:00", "atm"), ("15", 9_000_006, 9_000_007, 100_000, "10:30:00", "qris"),
    ]
    planted = " union all ".join(
        f"select 'FLAG-{i}' as tx_id, cast({a} as bigint) as from_account, cast({b} as bigint) as to_account, cast({m} as decimal(18,2)) as amount, "
        f"'{c}' as channel, cast('2025-03-15 {t}' as {'timestamp_ntz' if d.name == 'spark' else 'timestamp'}) as tx_timestamp"
        for i, a, b, m, t, c in rows
    )
    return f"""
select tx_id, from_account, to_account, amount, channel, tx_timestamp from {{tx}}
union all select cast(tx_id as {text}), from_account, to_account, amount, channel, tx_timestamp from ({planted}) p"""


FIXTURES: dict[str, Callable[[Spark], str] | None] = dict.fromkeys(RAW)
FIXTURES |= {
    "tx": _tx, "pairs": _pairs, "alerts": _alerts, "cases": _cases, "scored": _scored, "holdout": _holdout, "predictions": _predictions,
    "raw_landing": _raw_landing, "dirty": _dirty, "offered": _offered, "commands": _commands, "planted": _planted, "visits": _visits,
    "queue": _queue, "seeds": _seeds, "found": _found, "flagged": _flagged, "known_accounts": _known_accounts, "stamped": _stamped,
    "blocklist": _blocklist, "edge_scores": _edge_scores, "class_scores": _class_scores, "features": _features,
}


def _needed(text: str, d: Spark) -> list[str]:
    """Derived views that a text uses, each after those it needs itself."""
    out: list[str] = []
    for name in re.findall(r"\{(\w+)\}", text):
        build = FIXTURES.get(name)
        if build is not None:
            out += [x for x in _needed(build(d), d) if x not in out]
            if name not in out:
                out.append(name)
    return out


def fixture_sql(text: str) -> str:
    """CTEs, for the oracle, of the derived views that a text uses."""
    parts = []
    for name in _needed(text, DUCK):
        body = FIXTURES[name](DUCK)
        for other in FIXTURES:
            body = body.replace("{" + other + "}", other)
        parts.append(f"{name} AS ({body})")
    return ", ".join(parts)


#: Uses of the ledger view in one plan from which it is written as a table first, as a
#: ledger is; the view is a join, and Spark would run it for each use.
MANY_USES = 5


def named_columns(ledger: DataFrame, text: str) -> DataFrame:
    """The columns of a ledger that a text, or a view that it uses, names; all if it takes
    all as they are."""
    every = " ".join([text, *(FIXTURES[x](SPARK) for x in _needed(text, SPARK) if x != "tx")])
    if re.search(r"\*\s+from\s+\{tx\}", every):
        return ledger
    return ledger.select(*[c for c in ledger.columns if re.search(rf"\b{c}\b", every)] or ledger.columns[:1])


def fixture_tables(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    """DataFrames of all tables and derived views that a text uses."""
    tables: dict[str, DataFrame] = {}
    many = text.count("{tx}") >= MANY_USES

    def load(name: str) -> DataFrame:
        if name not in tables:
            build = FIXTURES[name]
            if build is None:
                tables[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            else:
                body = build(SPARK)
                tables[name] = spark.sql(body, **{x: load(x) for x in set(re.findall(r"\{(\w+)\}", body))})
                if many and name == "tx":
                    tables[name] = Workspace(spark, "ledger").cut(named_columns(tables[name], text), "tx", CODEC)
        return tables[name]

    for name in set(re.findall(r"\{(\w+)\}", text)) & set(FIXTURES):
        load(name)
    return tables


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixture_tables(spark, sf_dir, "{" + name + "}")[name]
