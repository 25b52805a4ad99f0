"""Account extraction from stored pages and what follows from it."""

from __future__ import annotations

from ..plans.catalog import operator
from ..plans.dialect import Spark

# Digits of account numbers by bank, and names on pages.
BANK_DIGITS = {
    "BCA": (10, 10), "BNI": (10, 10), "MANDIRI": (13, 13), "BRI": (15, 15), "BSI": (10, 10), "DANAMON": (10, 11),
    "CIMB": (13, 14), "PERMATA": (10, 16),
}
BANK_NAMES = {
    "bca": "BCA", "klikbca": "BCA", "bni": "BNI", "mandiri": "MANDIRI", "mndr": "MANDIRI", "bri": "BRI", "britama": "BRI",
    "bsi": "BSI", "syariah indonesia": "BSI", "danamon": "DANAMON", "cimb": "CIMB", "niaga": "CIMB", "permata": "PERMATA",
}
WALLET_NAMES = {
    "gopay": "GOPAY", "gojek": "GOPAY", "ovo": "OVO", "dana": "DANA", "shopeepay": "SHOPEEPAY", "shopee": "SHOPEEPAY",
    "linkaja": "LINKAJA",
}
# Marks of challenge pages, and of proxy failures in error messages.
BLOCK_MARKS = (
    "checking your browser", "just a moment", "one moment, please", "one moment please", "cf-browser-verification",
    "cf-challenge", "enable javascript and cookies to continue", "attention required! | cloudflare", "ddos protection by",
    "verifying you are human", "please wait while we verify",
)
PROXY_MARKS = (
    "err_proxy_connection_failed", "err_tunnel_connection_failed", "err_socks_connection_failed",
    "err_socks_connection_host_unreachable", "err_proxy_auth", "proxy connection",
)
# Phone numbers, separators and blocks of digits, what is no text on a
# page, and words of a timeout's message.
PHONE = r"(?:\+62|62|0)8(?:[\s.\-]?\d){7,12}"
SEPARATORS = r"[\s.\-,_]+"
DIGIT_BLOCK = "[0-9]{10,18}"
NO_TEXT = (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<[^>]+>")
TIMEOUT_MARKS = ("timeout", "err_timed_out", "err_connection_timed_out")


def page_text(d: Spark, html: str) -> str:
    for pattern in NO_TEXT:
        html = d.replace_all(html, pattern, " ")
    return html


@operator("N1")
def osint_page_text(d: Spark) -> str:
    """Page text without scripts, styles and tags."""
    return f"select page_id, {page_text(d, 'html')} as text from {{pages}}"


@operator("N2 W1", {"page_texts": "planted"})
def osint_phones(d: Spark) -> str:
    """Phone numbers in national form, of 10 to 13 digits."""
    digits = d.replace_all("raw", "[^0-9]", "")
    return f"""
select distinct page_id, number from (
  select page_id, case when digits like '62%' then '0' || substr(digits, 3) else digits end as number from (
    select page_id, {digits} as digits from (
      select page_id, {d.explode(d.extract_all(page_text(d, "html"), PHONE))} as raw from {{page_texts}}) r) q) n
where length(number) between 10 and 13"""


@operator("N3", {"page_texts": "planted"})
def osint_digit_blocks(d: Spark) -> str:
    """Runs of 10 to 18 digits once separators are gone."""
    squeezed = d.replace_all(page_text(d, "html"), SEPARATORS, "")
    blocks = d.explode(d.extract_all(squeezed, DIGIT_BLOCK))
    return f"select page_id, block, count(*) as n from (select page_id, {blocks} as block from {{page_texts}}) b group by page_id, block"


@operator("N5")
def osint_length_check(d: Spark) -> str:
    """Whether a number's length fits its bank; others take 10 to 18 digits."""
    whens = " ".join(f"when '{b}' then length(rekening) between {lo} and {hi}" for b, (lo, hi) in BANK_DIGITS.items())
    return f"""
select page_id, bank, rekening, case bank {whens} else length(rekening) between 10 and 18 end as valid, confidence from {{found}}"""


@operator("N7 N8 A8")
def osint_accounts(d: Spark) -> str:
    """Accounts over all pages: best confidence, sites, and how many share them."""
    return f"""
with best as (select rekening, bank, confidence, row_number() over (partition by rekening order by confidence desc, page_id, bank) as rn from {{found}})
select f.rekening, b.bank, b.confidence, count(distinct f.url) as shared_count, {d.join_distinct("f.url", ",")} as sumber_url,
  cast(max(f.page_id) as bigint) as last_seen
from {{found}} f join best b on f.rekening = b.rekening and rn = 1 group by f.rekening, b.bank, b.confidence"""


@operator("N13")
def osint_account_list(d: Spark, min_shared: int = 2, limit: int = 100) -> str:
    """Accounts on at least some sites, the most shared first."""
    return f"""
select rekening, count(distinct url) as shared_count, max(confidence) as confidence from {{found}}
group by rekening having count(distinct url) >= {min_shared} order by shared_count desc, confidence desc, rekening limit {limit}"""


@operator("N10 J10")
def osint_alerts(d: Spark) -> str:
    """Alerts for found accounts and, at nine tenths, their connections; accounts with
    an open alert are left out."""
    return """
with linked as (select to_account as account_id, max(greatest(0.5e0, 0.9e0 * score)) as score from {pairs} p join {seeds} on from_account = account_id
    where not exists (select 1 from {seeds} s where s.account_id = p.to_account) group by to_account),
  every_ as (select account_id, score, 'SEED' as origin from {seeds} union all select account_id, score, 'LINKED' from linked)
select account_id, score, origin, case when score >= 0.8e0 then 'HIGH' else 'MEDIUM' end as severity from every_ e
where not exists (select 1 from {alerts} a where a.account_id = e.account_id and a.status in ('NEW', 'IN_REVIEW'))"""


@operator("N12")
def osint_page_state(d: Spark) -> str:
    """Challenge pages, and the kind of an error message."""
    blocked = " or ".join(f"{d.find('lower(html)', repr(m))} > 0" for m in BLOCK_MARKS)
    proxy, late = (" or ".join(f"{d.find('lower(message)', repr(m))} > 0" for m in marks) for marks in (PROXY_MARKS, TIMEOUT_MARKS))
    return f"""
select page_id, {blocked} as blocked, case when {proxy} then 'PROXY_ERROR' when {late} then 'TIMEOUT' else 'SITE_ERROR' end as error_type
from {{visits}}"""


@operator("N13 N14")
def osint_status_counts(d: Spark) -> str:
    """Queue states, and accounts by how many sites share them."""
    return """
with a as (select rekening, count(distinct url) as n from {found} group by rekening)
select 'queue' as kind, status as item, count(*) as n from {queue} group by 1, 2
union all select 'shared', case when n >= 3 then 'HIGH' when n = 2 then 'MED' else 'LOW' end, count(*) from a group by 2"""


@operator("T15", since=10)
def osint_watchlist_sync(d: Spark, since: int = 100, limit: int = 40) -> str:
    """The next page of a cursor sync, with the cursor it advances to."""
    return f"""
select page_id, url, max(page_id) over () as next_cursor from (select page_id, url from {{pages}} where page_id >= {since}
  order by page_id limit {limit}) p"""


@operator("T16")
def osint_queue_claim(d: Spark, limit: int = 25) -> str:
    """Claim the first pending urls by priority and time; failed ones return until two attempts."""
    return f"""
select page_id, url, 'IN_PROGRESS' as status, cast(attempts + 1 as bigint) as attempts from (
  select page_id, url, attempts, priority, queued_at from {{queue}} where status = 'PENDING' or (status = 'FAILED' and attempts < 2)
  order by priority, queued_at, page_id limit {limit}) c"""


@operator("T16 N13", {"results": "visits"})
def osint_queue_finalise(d: Spark) -> str:
    """The queue after visits (``page_id, message``, null if it worked): done, back in
    line, or failed at the second attempt."""
    return """
select q.page_id, cast(q.attempts + 1 as bigint) as attempts, case when r.message is null then 'DONE' when q.attempts + 1 < 2 then 'PENDING' else 'FAILED' end as status
from {queue} q join {results} r on q.page_id = r.page_id"""
