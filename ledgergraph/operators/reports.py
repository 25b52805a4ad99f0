"""Alert generation, dashboards, lists, case folds and narratives."""

from __future__ import annotations

from ..functions.expressions import alert_id, severity
from ..plans.catalog import operator
from ..plans.dialect import Spark
from .features import feat_account_table
from .rules import FIXTURE_RULES, Params, all_hits_sql

# Triage weights.
TYPOLOGY_WEIGHT = {
    "JUDOL_RING": 4, "LAYERING": 4, "DORMANT_ACTIVATION": 3, "STRUCTURING": 3, "RAPID_IN_OUT": 3, "FAN_OUT": 2,
    "QRIS_FRAUD": 2, "PEP_NETWORK": 2, "VENDOR_SHELL": 1, "SMURF_LAYERING": 2, "UNKNOWN": 0,
}
SEVERITY_WEIGHT = {"HIGH": 10, "MEDIUM": 5, "LOW": 1}
# Words that mark a refused or broken narrative.
REFUSAL_MARKERS = (
    "as an ai", "sebagai ai", "i cannot", "i can't", "saya tidak bisa", "i'm unable", "language model", "model bahasa",
    "as a language", "i apologize", "mohon maaf, saya",
)


@operator("R1 R2 A14 U4", rules=FIXTURE_RULES)
def alerts_generate(d: Spark, threshold: float = 0.5, run_key: str = "run-1", rules: Params | None = None) -> str:
    """Alerts from predictions at the threshold and from rule hits of all layers.

    Predictions are a table of ``account_id, risk_score``; the threshold is theirs alone.
    A rule-only account needs a confidence of 0.5 and takes 0.8 of it as its risk;
    the first rule in layer order gives the typology; ``rules`` are parameters of the rules.  Stored alerts are not made again.
    """
    first = "min_by(typology, rule_order)" if d.name == "spark" else "arg_min(typology, rule_order)"
    text = (
        "array_join(transform(array_sort(collect_list(struct(rule_order, rule_triggered))), x -> x.rule_triggered), '; ')"
        if d.name == "spark"
        else "string_agg(rule_triggered, '; ' order by rule_order, rule_triggered)"
    )
    return f"""
with hits as ({all_hits_sql(d, rules)}),
  ruled as (select account_id, max(confidence) as confidence, {first} as typology, substr({text}, 1, 2000) as rule_triggered
    from hits group by account_id),
  predicted as (select account_id, risk_score from {{predictions}} p where risk_score >= {threshold!r}e0),
  joined as (select coalesce(p.account_id, r.account_id) as account_id,
      coalesce(p.risk_score, 0.8e0 * r.confidence) as risk_score, coalesce(r.typology, 'ML_ENSEMBLE') as typology,
      coalesce(r.rule_triggered, '') as rule_triggered
    from predicted p full outer join ruled r on p.account_id = r.account_id
    where p.account_id is not null or r.confidence >= 0.5e0)
select {alert_id(d, "account_id", "typology", "'" + run_key + "'")} as alert_id, account_id, typology,
  {d.round("risk_score", 4)} as risk_score, {severity("risk_score")} as severity, rule_triggered, 'NEW' as status
from joined j where not exists (select 1 from {{alerts}} a where a.alert_id = {alert_id(d, "j.account_id", "j.typology", "'" + run_key + "'")})"""


@operator("R4 J11")
def report_overview(d: Spark) -> str:
    """Dashboard figures; funds at risk fall back on the alerted transfer's amount."""
    return """
select count(*) filter (where a.status in ('NEW', 'IN_REVIEW')) as active_alerts, count(distinct a.cluster_id) as clusters,
  cast(sum(cast(coalesce(a.amount_at_risk, cast(t.amount as double), 0.0e0) as decimal(38, 2))) as double) as funds_at_risk,
  (select count(*) from {cases} where status in ('OPEN', 'IN_PROGRESS')) as pending_cases, count(*) as total_alerts
from {alerts} a left join (select tx_id, max(amount) as amount from {tx} group by tx_id) t on a.tx_id = t.tx_id"""


@operator("R5 A1")
def report_breakdowns(d: Spark) -> str:
    """Counts by typology, structural pattern and status."""
    parts = [
        f"select '{k}' as dimension, coalesce({k}, 'NONE') as item, count(*) as n from {{alerts}} group by coalesce({k}, 'NONE')"
        for k in ("typology", "aml_pattern", "status")
    ]
    return " union all ".join(parts)


@operator("R6")
def report_risk_trend(d: Spark, days: int = 400) -> str:
    """Alerts and mean risk per day of the last days."""
    return f"""
select cast(cast(created_at as date) as varchar(10)) as day, count(*) as n, {d.round("avg(risk_score)", 4)} as avg_risk from {{alerts}}
where created_at >= (select max(created_at) from {{alerts}}) - interval {days} days group by cast(created_at as date)"""


@operator("R7")
def report_heatmap(d: Spark) -> str:
    """Alerts by day of week and hour, on a dense grid."""
    hours = "select explode(sequence(0, 23)) as hour" if d.name == "spark" else "select unnest(range(24)) as hour"
    days = "select explode(sequence(0, 6)) as dow" if d.name == "spark" else "select unnest(range(7)) as dow"
    return f"""
with seen as (select {d.dow("created_at")} as dow, cast(hour(created_at) as bigint) as hour, count(*) as n from {{alerts}}
    group by 1, 2),
  grid as (select cast(dow as bigint) as dow, cast(hour as bigint) as hour from ({days}) x cross join ({hours}) y)
select g.dow, g.hour, coalesce(n, 0) as n from grid g left join seen s on g.dow = s.dow and g.hour = s.hour"""


@operator("R8 A6 L1")
def report_top_accounts(d: Spark, limit: int = 10) -> str:
    """Accounts of highest risk with their typologies."""
    return f"""
select account_id, max(risk_score) as max_risk, count(*) as n, {d.join_distinct("typology")} as typologies
from {{alerts}} group by account_id order by max_risk desc, n desc, account_id limit {limit}"""


# What filters may ask for.
STATUSES = ("NEW", "IN_REVIEW", "CONFIRM", "FP", "CLOSED")
SEVERITIES = ("HIGH", "MEDIUM", "LOW")
DETECTION_LAYERS = ("AML_CORE", "TYPOLOGY_ID", "STATISTICAL", "GRAPH_MOTIF", "ML_ENSEMBLE")
AML_PATTERNS = ("FAN_IN", "FAN_OUT", "RELAY", "CYCLE", "PERIPHERAL")
TERMINAL = ("CONFIRM", "FP", "CLOSED")


def category_filters(source: str | None, category: str | None) -> dict[str, object]:
    """The filters of a choice of source ('AML' or 'Tipologi') and, within it, of a
    category; a category alone tells its source.  Alerts without a typology are those
    of a structural pattern."""
    pattern = category in AML_PATTERNS
    if source == "AML" or (source is None and pattern):
        return {"typology": "UNKNOWN"} | ({"aml_pattern": category} if category else {})
    if category:
        return {"typology": category}
    return {"only_known_typology": True} if source == "Tipologi" else {}


def _checked(name: str, value: str, known: tuple[str, ...]) -> str:
    if value not in known:
        raise ValueError(f"{name} must be one of {', '.join(known)}")
    return f"{name} = '{value}'"


def _alert_filters(
    status: str | None = None, typology: str | None = None, detection_layer: str | None = None, aml_pattern: str | None = None,
    only_known_typology: bool = False, severity: str | None = None, account_id: object = None, min_risk: float | None = None,
    date_from: str | None = None, date_to: str | None = None,
) -> str:
    """The conjunction of the filters that are given."""
    quoted = {n: str(v).replace("'", "''") for n, v in (("typology", typology), ("account_id", account_id), ("from", date_from), ("to", date_to))}
    parts = [
        status and _checked("status", status, STATUSES),
        detection_layer and _checked("detection_layer", detection_layer, DETECTION_LAYERS),
        aml_pattern and _checked("aml_pattern", aml_pattern, AML_PATTERNS),
        severity and _checked("severity", severity, SEVERITIES),
        typology and f"coalesce(typology, 'UNKNOWN') = '{quoted['typology']}'",
        only_known_typology and "coalesce(typology, 'UNKNOWN') <> 'UNKNOWN'",
        account_id is not None and f"cast(account_id as varchar(64)) = '{quoted['account_id']}'",
        min_risk is not None and f"risk_score >= {float(min_risk)!r}e0",
        date_from and f"created_at >= cast('{quoted['from']}' as timestamp)",
        date_to and f"created_at <= cast('{quoted['to']}' as timestamp)",
    ]
    return " and ".join(p for p in parts if p) or "1 = 1"


@operator("R9 L3", status="NEW", severity="HIGH", min_risk=0.1, only_known_typology=True, date_from="1996-01-01", offset=1)
def report_list_alerts(d: Spark, limit: int = 50, offset: int = 0, **filters: object) -> str:
    """A page of the alerts that all given filters leave, newest first, with the number
    of all matches: status, typology, detection_layer, aml_pattern, only_known_typology,
    severity, account_id, min_risk, date_from, date_to.  An unknown value is an error."""
    return f"""
select alert_id, tx_id, account_id, typology, risk_score, created_at, count(*) over () as total from {{alerts}}
where {_alert_filters(**filters)}
order by created_at desc, alert_id, tx_id limit {limit} offset {offset}"""


@operator("R10 L3", source="Tipologi", category="qris")
def report_list_category(d: Spark, source: str | None = None, category: str | None = None, limit: int = 50, offset: int = 0) -> str:
    """A page of the alerts of a source and a category within it."""
    return report_list_alerts.build(d, limit, offset, **category_filters(source, category))


@operator("R11 W1")
def report_alert_detail(d: Spark) -> str:
    """Alerts with their latest case."""
    return """
select a.alert_id, a.tx_id, a.typology, coalesce(c.case_id, -1) as case_id, c.status as case_status from {alerts} a left join (
  select *, row_number() over (partition by alert_id order by opened_at desc, case_id desc) as rn from {cases}) c
on a.alert_id = c.alert_id and rn = 1"""


@operator("R12 R13")
def cases_fold(d: Spark) -> str:
    """Case state folded from a command log (``subject, seq, kind, value``).

    The first CREATE or ASSIGN opens a case; another CREATE is refused.  The last ASSIGN
    and STATUS hold.  A terminal status is the alert's too; an assigned alert is in review.
    """
    terminal = ", ".join(f"'{t}'" for t in TERMINAL)
    return f"""
with c as (select *, min(case when kind in ('CREATE', 'ASSIGN') then seq end) over (partition by subject) as opened from {{commands}})
select subject, count(*) as commands, count(*) filter (where kind = 'CREATE' and seq > opened) as refused,
  {d.last("value", "seq")} filter (where kind = 'ASSIGN') as assigned_to,
  coalesce({d.last("value", "seq")} filter (where kind = 'STATUS'), 'NEW') as case_status,
  coalesce({d.last("value", "seq")} filter (where kind = 'STATUS' and value in ({terminal})),
    case when count(*) filter (where kind = 'ASSIGN') > 0 then 'IN_REVIEW' else 'NEW' end) as alert_status
from c group by subject"""


@operator("R12 R13")
def cases_audit(d: Spark) -> str:
    """Audit events of the command log: the opening, escalations, and else only what changed."""
    return """
with c as (select *, min(case when kind in ('CREATE', 'ASSIGN') then seq end) over (partition by subject) as opened from {commands}),
  changes as (select subject, seq, kind, value, lag(value) over (partition by subject, kind order by seq) as before
    from c where kind in ('ASSIGN', 'STATUS'))
select distinct subject, cast(0 as bigint) as seq, 'CASE_CREATED' as event_type, '' as detail from c where opened is not null
union all select subject, seq, 'ESCALATED', value from c where kind = 'ESCALATE'
union all select subject, seq, case when kind = 'ASSIGN' then 'ASSIGNED' else 'STATUS_CHANGED' end, coalesce(before, '') || '>' || value
from changes where before is null or before <> value"""


@operator("R14 R15")
def report_summaries(d: Spark) -> str:
    """Counts and mean risk by typology, severity, status and layer."""
    parts = [
        f"select '{k}' as dimension, {k} as item, count(*) as n, {d.round('avg(risk_score)', 6)} as avg_risk from {{alerts}} group by {k}"
        for k in ("typology", "severity", "status", "detection_layer")
    ]
    return " union all ".join(parts)


@operator("R16 W1")
def report_copilot_context(d: Spark) -> str:
    """The latest alert of each account with its features."""
    return f"""
with latest as (select * from (select account_id, typology, risk_score, severity,
    row_number() over (partition by account_id order by created_at desc, alert_id, tx_id) as rn from {{alerts}}) r where rn = 1),
  f as ({feat_account_table.build(d)})
select l.account_id, l.typology, l.risk_score, l.severity, f.total_tx, f.in_amount_sum, f.night_tx_ratio, f.burst_ratio
from latest l left join f on l.account_id = f.account_id"""


@operator("R17 R19")
def report_narrative(d: Spark, limit: int = 3) -> str:
    """A template narrative with up to three indicators beyond their cut-offs."""
    pct = lambda x: f"{d.fixed(f'{x} * 100', 1)} || '%'"
    indicators = d.array(
        f"case when dormancy_days > 30 then 'dormant for ' || {d.fixed('dormancy_days', 0)} || ' days' end",
        f"case when burst_ratio > 0.5 then 'burst ratio ' || {pct('burst_ratio')} end",
        f"case when structuring_score > 0.3 then 'structuring score ' || {pct('structuring_score')} end",
        f"case when night_tx_ratio > 0.4 then 'night transfers ' || {pct('night_tx_ratio')} end",
        f"case when in_amount_sum > 0 then 'incoming ' || {d.fixed('in_amount_sum', 0)} end",
    )
    chosen = d.join(d.first_n(d.keep_if(indicators, "x", "x is not null"), limit), ", ")
    return f"""
with f as ({feat_account_table.build(d)})
select account_id, 'Account ' || cast(account_id as varchar(20)) || ' shows '
  || coalesce(nullif({chosen}, ''), 'an unusual pattern') || '.' as narrative from f"""


@operator("R18 W7")
def report_triage(d: Spark) -> str:
    """Alerts in order of urgency: severity, typology weight, risk."""
    typology = " ".join(f"when '{k}' then {v}" for k, v in TYPOLOGY_WEIGHT.items())
    sev = " ".join(f"when '{k}' then {v}" for k, v in SEVERITY_WEIGHT.items())
    return f"""
with s as (select alert_id, tx_id, (case severity {sev} else 1 end) * 10
    + (case case typology when 'judol' then 'JUDOL_RING' when 'dormant' then 'DORMANT_ACTIVATION' else typology end {typology} else 0 end)
    + risk_score as score from {{alerts}}),
  steps as (select cast(floor(score * 100) as bigint) as b, count(*) as n from s group by cast(floor(score * 100) as bigint)),
  ahead as (select b, coalesce(cast(sum(n) over (order by b desc rows between unbounded preceding and 1 preceding) as bigint), 0) as base from steps)
select alert_id, tx_id, score, base + cast(row_number() over (partition by b order by score desc, alert_id, tx_id) as bigint) as triage_rank
from s join ahead on cast(floor(score * 100) as bigint) = b"""


@operator("R20")
def report_output_guard(d: Spark) -> str:
    """Whether a generated text may stand: length, refusal marks, names its subject."""
    marks = " or ".join(f"strpos(lower(text), '{m.replace(chr(39), chr(39) * 2)}') > 0" for m in REFUSAL_MARKERS)
    if d.name == "spark":
        marks = " or ".join(f'instr(lower(text), "{m}") > 0' for m in REFUSAL_MARKERS)
    return f"""
select conv_id, turn, case when text is null or length(trim(text)) < 40 then 'too short' when length(text) > 4000 then 'too long'
  when {marks} then 'refusal' when strpos_(lower(text), lower(role)) = 0 then 'subject not named' else 'ok' end as verdict
from {{conversations}}""".replace("strpos_", "instr" if d.name == "spark" else "strpos")


@operator("A15 D1")
def report_aml_pattern(d: Spark) -> str:
    """Structural role of accounts; the thresholds are this engine's own."""
    return """
with p as (select distinct from_account as a, to_account as b from {tx} where from_account <> to_account),
  cyc as (select distinct x.a from p x join p y on x.b = y.a and x.a = y.b),
  deg as (select coalesce(i.id, o.id) as account_id, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out
    from (select b as id, count(*) as n_in from p group by b) i
    full outer join (select a as id, count(*) as n_out from p group by a) o on i.id = o.id)
select account_id, n_in, n_out, case when account_id in (select a from cyc) then 'CYCLE'
  when n_in >= 10 and n_in >= 3 * n_out then 'FAN_IN' when n_out >= 10 and n_out >= 3 * n_in then 'FAN_OUT'
  when n_in >= 3 and n_out >= 3 then 'RELAY' else 'PERIPHERAL' end as aml_pattern
from deg"""
