"""Typology detectors.

Every rule gives ``account_id, typology, layer, rule_triggered, confidence`` and
the measures it judged by; thresholds are parameters with the usual defaults.
Thresholds, formulas of confidence and texts are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import STRUCT_RULE_BANDS, night
from ..plans.catalog import OPERATORS, operator
from ..plans.dialect import SPARK, Spark

LAYERS = {
    "STRUCTURING": "AML_CORE",
    "FAN_OUT": "AML_CORE",
    "LAYERING": "AML_CORE",
    "CYCLE": "AML_CORE",
    "JUDOL_RING": "TYPOLOGY_ID",
    "QRIS_RING": "TYPOLOGY_ID",
    "DORMANT_ACTIVATION": "TYPOLOGY_ID",
    "FANOUT_ANOMALY": "STATISTICAL",
    "FANIN_ANOMALY": "STATISTICAL",
    "CYCLE_MOTIF": "GRAPH_MOTIF",
}


def _hit(account: str, typology: str, text: str, confidence: str) -> str:
    return (
        f"{account} as account_id, '{typology}' as typology, '{LAYERS[typology]}' as layer, "
        f"{text} as rule_triggered, {confidence} as confidence"
    )


def _text(x: str) -> str:
    return f"cast({x} as varchar(40))"


def _first(order: str, limit: int | None) -> str:
    """Hits are cut only where a limit is asked for."""
    return "" if limit is None else f"order by {order} limit {limit}"


@operator("D-01 P2 A3 P13 L1")
def rule_structuring(d: Spark, min_hits: int = 3, limit: int | None = None) -> str:
    """Repeated transfers just below a limit, in any one of four bands."""
    names = ["n_500k", "n_1m", "n_5m", "n_25m"]
    counts = ", ".join(
        f"count(*) filter (where amount between {lo} and {hi}) as {n}"
        for n, (lo, hi) in zip(names, STRUCT_RULE_BANDS, strict=True)
    )
    peak = f"greatest({', '.join(names)})"
    confidence = d.round(f"least(0.9e0, 0.5e0 + {peak} / 20.0e0 * 0.4e0)", 4)
    text = " || ', ' || ".join(f"'{n}=' || {_text(n)}" for n in names[:3])
    return f"""
select {_hit("account", "STRUCTURING", text, confidence)}, {", ".join(names)}
from (select from_account as account, {counts} from {{tx}} group by from_account)
where {" or ".join(f"{n} >= {min_hits}" for n in names)}
{_first("n_500k + n_1m desc, account", limit)}"""


@operator("D-02 A2")
def rule_fan_out(d: Spark, min_recipients: int = 20, min_tx: int = 20, limit: int | None = None) -> str:
    """Many distinct recipients of one sender."""
    confidence = d.round("least(0.85e0, 0.4e0 + recipients / 100.0e0 * 0.45e0)", 4)
    text = f"'recipient_count=' || {_text('recipients')} || ', tx_count=' || {_text('n')}"
    return f"""
select {_hit("account", "FAN_OUT", text, confidence)}, recipients as recipient_count, n as tx_count, total_out
from (select from_account as account, count(distinct to_account) as recipients, count(*) as n, cast(sum(amount) as double) as total_out
  from {{tx}} group by from_account)
where recipients >= {min_recipients} and n >= {min_tx} {_first("recipients desc, account", limit)}"""


@operator("D-03 J2")
def rule_layering(d: Spark, min_in: int = 1_000_000, low: float = 0.80, high: float = 1.05, limit: int | None = None) -> str:
    """What comes in goes out again nearly whole."""
    confidence = d.round("least(0.8e0, 0.45e0 + (1.0e0 - abs(passed - 0.95e0)) * 0.35e0)", 4)
    text = f"'passthrough_ratio=' || {d.fixed('passed', 3)} || ', in=' || {_text('n_in')} || ', out=' || {_text('n_out')}"
    return f"""
with i as (select to_account as account, cast(sum(amount) as double) as total_in, count(*) as n_in
    from {{tx}} group by to_account),
  o as (select from_account as account, cast(sum(amount) as double) as total_out, count(*) as n_out
    from {{tx}} group by from_account),
  sides as (select i.account, total_in, total_out, n_in, n_out, total_out / total_in as passed
    from i join o on i.account = o.account where total_in > {min_in} and n_in >= 3 and n_out >= 3)
select {_hit("account", "LAYERING", text, confidence)}, {d.round("passed", 4)} as passthrough_ratio, n_in as in_cnt, n_out as out_cnt
from sides where passed between {low!r}e0 and {high!r}e0 {_first("total_in desc, account", limit)}"""


@operator("D-04 J4 O6")
def rule_cycle(d: Spark) -> str:
    """Accounts that send to each other."""
    return f"""
select distinct {_hit("a.from_account", "CYCLE", "'CYCLE: mutual transfer (A→B→A)'", "0.75e0")}
from (select distinct from_account, to_account from {{tx}} where from_account <> to_account) a
join (select distinct from_account, to_account from {{tx}} where from_account <> to_account) b
  on a.to_account = b.from_account and a.from_account = b.to_account"""


@operator("D-05", max_amount=5_000_000, min_senders=8, min_tx=8)
def rule_judol_ring(
    d: Spark, max_amount: int = 500_000, min_senders: int = 30, min_tx: int = 50, min_night: float = 0.3, limit: int | None = None
) -> str:
    """Gambling deposits: many senders of small amounts, much of it at night."""
    confidence = d.round("least(0.95e0, 0.5e0 + senders / 200.0e0 * 0.3e0 + night_share * 0.2e0)", 4)
    text = "'JUDOL_RING: many small senders + night dominance'"
    return f"""
select {_hit("account", "JUDOL_RING", text, confidence)}, senders as sender_count, n as tx_count, avg_amount, night_share
from (select to_account as account, count(distinct from_account) as senders, count(*) as n, cast(sum(amount) as double) / count(*) as avg_amount,
    cast(count(*) filter (where {night("tx_timestamp")}) as double) / count(*) as night_share
  from {{tx}} where amount < {max_amount} group by to_account)
where senders >= {min_senders} and n >= {min_tx} and night_share >= {min_night!r}e0
{_first("senders desc, account", limit)}"""


@operator("D-06", min_senders=4, min_tx=4)
def rule_qris_ring(d: Spark, min_senders: int = 10, min_tx: int = 30, limit: int | None = None) -> str:
    """A merchant code paid by many senders."""
    confidence = d.round("least(0.9e0, 0.5e0 + senders / 100.0e0 * 0.4e0)", 4)
    text = "'QRIS_RING: many QRIS senders to one receiver'"
    return f"""
select {_hit("account", "QRIS_RING", text, confidence)}, senders as merchant_count, n as tx_count, total_received
from (select to_account as account, count(distinct from_account) as senders, count(*) as n, cast(sum(amount) as double) as total_received
  from {{tx}} where channel = 'qris' group by to_account)
where senders >= {min_senders} and n >= {min_tx} {_first("senders desc, account", limit)}"""


@operator("D-07 J1", min_recent=1)
def rule_dormant_activation(
    d: Spark, min_span_days: int = 180, recent_days: int = 60, min_recent: int = 5, max_total: int = 100, limit: int | None = None
) -> str:
    """A long-known account of few transfers that has lately become busy."""
    confidence = d.round("least(0.8e0, 0.45e0 + recent / 30.0e0 * 0.35e0)", 4)
    span = f"cast({d.epoch('last_ts')} - {d.epoch('first_ts')} as double) / 86400.0e0"
    text = f"'gap=' || {d.fixed(span, 0)} || 'd, recent=' || {_text('recent')} || ', total=' || {_text('total')}"

    def side(column: str) -> str:
        return f"""select {column} as account, count(*) as n, min(tx_timestamp) as first_ts, max(tx_timestamp) as last_ts,
    count(*) filter (where tx_timestamp > cut) as recent from {{tx}} cross join edge group by {column}"""

    return f"""
with edge as (select max(tx_timestamp) - interval {recent_days} days as cut from {{tx}}),
  s as ({side("from_account")}), r as ({side("to_account")}),
  sides as (select coalesce(s.account, r.account) as account, coalesce(s.n, 0) + coalesce(r.n, 0) as total,
    coalesce(s.recent, 0) + coalesce(r.recent, 0) as recent,
    least(coalesce(s.first_ts, r.first_ts), coalesce(r.first_ts, s.first_ts)) as first_ts,
    greatest(coalesce(s.last_ts, r.last_ts), coalesce(r.last_ts, s.last_ts)) as last_ts
    from s full outer join r on s.account = r.account)
select {_hit("account", "DORMANT_ACTIVATION", text, confidence)}, {d.round(span, 1)} as span_days, total as total_tx, recent as recent_cnt
from sides
where {d.epoch("last_ts")} - {d.epoch("first_ts")} >= {min_span_days} * 86400 and recent >= {min_recent}
  and total <= {max_total}
{_first("recent desc, account", limit)}"""


def _outliers(d: Spark, typology: str, own: str, other: str, min_metric: int, limit: int | None) -> str:
    confidence = d.round("least(0.95e0, 0.5e0 + least(coalesce(z, 0.0e0) / 10.0e0, 1.0e0) * 0.45e0)", 4)
    text = f"'metric=' || {_text('metric')} || ' (P99=' || {d.fixed('p99', 0)} || ', z=' || {d.fixed('coalesce(z, 0.0e0)', 1)} || ')'"
    return f"""
with f as (select {own} as account, count(distinct {other}) as metric from {{tx}} group by {own}),
  stat as (select avg(metric) as mu, stddev_pop(metric) as sd, percentile_cont(0.99) within group (order by metric) as p99
    from f),
  scored as (select account, metric, p99, (metric - mu) / nullif(sd, 0) as z from f cross join stat
    where metric > p99 and metric >= {min_metric})
select {_hit("account", typology, text, confidence)}, metric, {d.round("p99", 2)} as p99, {d.round("z", 6)} as zscore
from scored {_first(d.round("z", 6) + " desc, account", limit)}"""


@operator("D-08 A4 J6 W5")
def rule_fanout_anomaly(d: Spark, min_metric: int = 5, limit: int | None = None) -> str:
    """Recipients beyond the 99th percentile."""
    return _outliers(d, "FANOUT_ANOMALY", "from_account", "to_account", min_metric, limit)


@operator("D-09 A4 J6 W5")
def rule_fanin_anomaly(d: Spark, min_metric: int = 5, limit: int | None = None) -> str:
    """Senders beyond the 99th percentile."""
    return _outliers(d, "FANIN_ANOMALY", "to_account", "from_account", min_metric, limit)


_SUSPECT_RULES = (
    "rule_structuring", "rule_fan_out", "rule_layering", "rule_cycle", "rule_judol_ring", "rule_qris_ring",
    "rule_dormant_activation", "rule_fanout_anomaly", "rule_fanin_anomaly",
)


#: The thresholds that the small test tables need, by rule.
FIXTURE_RULES = {name: dict(OPERATORS[name].fixture) for name in _SUSPECT_RULES if OPERATORS[name].fixture}

Params = Mapping[str, Mapping[str, object]]


def hits_sql(d: Spark, rules: tuple[str, ...], params: Params | None = None) -> str:
    """``account_id, typology, layer, rule_order, rule_triggered, confidence`` of the given
    rules, in their order; ``params`` by rule override its defaults."""
    parts = []
    for i, name in enumerate(rules):
        built = OPERATORS[name].build(d, **(params or {}).get(name, {}))
        parts.append(f"select account_id, typology, layer, {i} as rule_order, rule_triggered, confidence from ({built}) h{i}")
    return "\nunion all\n".join(parts)


def motif_sql(d: Spark, suspects: str, max_suspects: int | None = None, limit: int | None = None) -> str:
    """Accounts of the query ``suspects`` (``account_id``) that lie on a cycle of three.

    A cycle is found at its account of fewest neighbours, from an edge in and an edge out
    to accounts of no fewer, so a hub's edges are not paired with each other.
    """
    return f"""
with pairs_ as (select distinct from_account as a, to_account as b from {{tx}} where from_account <> to_account),
  degree as (select id, count(*) as n from (select a as id from pairs_ union all select b from pairs_) v group by id),
  edges as (select a, b, x.n as na, y.n as nb from pairs_ join degree x on a = x.id join degree y on b = y.id),
  into_low as (select a as u, b as v from edges where nb < na or (nb = na and b < a)),
  out_of_low as (select a as v, b as w from edges where na < nb or (na = nb and a < b)),
  cycles as (select u, i.v, w from into_low i join out_of_low o on i.v = o.v join pairs_ p on p.a = w and p.b = u where u <> w),
  suspects_ as (select distinct account_id from ({suspects}) y {_first("account_id", max_suspects)})
select {_hit("a", "CYCLE_MOTIF", "'CYCLE_MOTIF: 3-hop circular flow (A->B->C->A)'", "0.85e0")}
from (select distinct {d.explode(d.array("u", "v", "w"))} as a from cycles) z
where exists (select 1 from suspects_ s where s.account_id = z.a)
{_first("a", limit)}"""


@operator("D-10 J5 O7", rules=FIXTURE_RULES)
def rule_cycle_motif(d: Spark, rules: Params | None = None, max_suspects: int | None = None, limit: int | None = None) -> str:
    """Suspects of the first three layers, by any of their rules, on a cycle of three
    accounts; ``rules`` are parameters of those rules."""
    return motif_sql(d, f"select account_id from ({hits_sql(d, _SUSPECT_RULES, rules)}) x", max_suspects, limit)


def all_hits_sql(d: Spark, rules: Params | None = None) -> str:
    """Hits of all four layers: the suspects' rules, and the motif among these."""
    first = hits_sql(d, _SUSPECT_RULES, rules)
    motif = motif_sql(d, "select account_id from first_layers")
    order = len(_SUSPECT_RULES)
    return f"""
with first_layers as ({first})
select * from first_layers
union all select account_id, typology, layer, {order} as rule_order, rule_triggered, confidence from ({motif}) m"""


#: Detectors that users add, by name: their layer and function.
_REGISTERED: dict[str, tuple[str, Callable[[DataFrame, Mapping[str, object]], DataFrame]]] = {}


def register_rule(name: str, layer: str, detect: Callable[[DataFrame, Mapping[str, object]], DataFrame]) -> None:
    """Add a detector: ``detect(tx, params)`` gives ``account_id, rule_triggered,
    confidence`` of its hits, which :func:`detect` reports under ``name`` and ``layer``."""
    if name in _REGISTERED or name in LAYERS:
        raise ValueError(f"{name} is registered already")
    _REGISTERED[name] = (layer, detect)


def unregister_rule(name: str) -> None:
    del _REGISTERED[name]


def detect(spark: SparkSession, tx: DataFrame, params: Params | None = None) -> DataFrame:
    """``account_id, typology, layer, rule_order, rule_triggered, confidence`` of all
    built-in rules and of those that :func:`register_rule` added, in the order of adding;
    ``params`` by rule."""
    found = spark.sql(all_hits_sql(SPARK, params), tx=tx)
    for i, (name, (layer, own)) in enumerate(_REGISTERED.items(), len(_SUSPECT_RULES) + 1):
        hits = own(tx, (params or {}).get(name, {}))
        found = found.unionByName(
            hits.select(
                "account_id", F.lit(name).alias("typology"), F.lit(layer).alias("layer"), F.lit(i).alias("rule_order"),
                F.col("rule_triggered").cast("string"), F.col("confidence").cast("double"),
            )
        )
    return found


@operator("D-11 A14")
def rule_layer_lookup(d: Spark) -> str:
    """Hits per layer, unknown typologies under ML_ENSEMBLE."""
    whens = " ".join(f"when '{t}' then '{layer}'" for t, layer in LAYERS.items())
    return f"""
select case upper(typology) {whens} else 'ML_ENSEMBLE' end as layer, upper(typology) as typology, count(*) as n
from {{tx}} where is_laundering = 1 group by upper(typology)"""


@operator("D-12 U1 U2 U4", rules=FIXTURE_RULES)
def rule_union_suspects(d: Spark, rules: Params | None = None) -> str:
    """All hits of the first three layers by rule, and how many accounts they name;
    ``rules`` are parameters of the rules."""
    return f"""
select rule_order, typology, layer, count(*) as hits, count(distinct account_id) as accounts
from ({hits_sql(d, _SUSPECT_RULES, rules)}) h group by rule_order, typology, layer"""


@operator("D-13")
def rule_late_layers(d: Spark) -> str:
    """Suspects of a run of the late layers alone: statistical hits and alerted accounts."""
    return f"""
select account_id, min(origin) as origin, count(*) as n from (
  select account_id, 'STATISTICAL' as origin from ({hits_sql(d, ('rule_fanout_anomaly', 'rule_fanin_anomaly'))}) s
  union all select account_id, 'ALERT' as origin from {{alerts}}) u
group by account_id"""
