"""Account numbers in page text, attributed to the nearest bank or wallet name.

Numbers and the text between them come from one pattern, by matching and by
splitting, so what stands before a number is put together from the last few pairs of
gap and match without any position in the page.  A block of digits is a run of digits
with separators between them.  The plan keeps a row per number, never per character.
"""

from __future__ import annotations

from ..plans.catalog import operator
from ..plans.dialect import Spark
from .osint import BANK_DIGITS, BANK_NAMES, PHONE, WALLET_NAMES, page_text

# Characters before a number in which its name is sought, and digits of
# phone numbers and of blocks.
REACH = 40
PHONE_DIGITS = (10, 13)
BLOCK = r"[0-9](?:[\s.\-,_]*[0-9]){9,17}"
# Confidence by how a text was got, and shares of it by kind of number.
ORIGINS = {"html": 1.0, "ocr": 0.7, "visual": 0.6}
SHARES = {"phone": 0.9, "bank": 1.0, "wallet": 0.8}

NAMES = WALLET_NAMES | BANK_NAMES
WALLETS = tuple(dict.fromkeys(WALLET_NAMES.values()))
#: Earlier matches that can lie within reach: a match has nine characters at least.
_BACK = -(-REACH // 9)


def _numbers(d: Spark, kind: str, pattern: str) -> str:
    """``page_id, origin, kind, raw, ahead``: matches and the text within reach before them."""
    pairs = d.indexed("found", "gaps[$k] || x".replace("$k", "$i - 1" if d.name == "spark" else "$i"))
    lead = "array_join(slice(pairs, greatest(1, i - @back), least(@back, i - 1)), '')" if d.name == "spark" else "array_to_string(pairs[greatest(1, i - @back) : i - 1], '')"
    gap = "gaps[i - 1]" if d.name == "spark" else "gaps[i]"
    body = f"named_struct('raw', found[i - 1], 'ahead', lower(right({lead} || {gap}, {REACH})))"
    if d.name != "spark":
        body = f"{{'raw': found[i], 'ahead': lower(right({lead} || {gap}, {REACH}))}}"
    body = body.replace("@back", str(_BACK))
    each = f"explode(transform(sequence(1, size(found)), i -> {body}))" if d.name == "spark" else f"unnest(list_transform(range(1, len(found) + 1), lambda i: {body}))"
    return f"""
select page_id, origin, '{kind}' as kind, h.raw as raw, h.ahead as ahead from (
  select page_id, origin, {each} as h from (
    select page_id, origin, found, gaps, {pairs} as pairs from (
      select page_id, origin, {d.extract_all("text", pattern)} as found, {d.split("text", pattern)} as gaps from texts) m
    where {d.size("found")} > 0) p) e"""


def _nearest(d: Spark) -> str:
    """The bank or wallet whose name starts last in ``ahead`` (the first listed of equals),
    or null: what is greedily skipped leaves the last start to the names."""
    whens = " ".join(f"when '{name}' then '{bank}'" for name, bank in NAMES.items())
    return f"case regexp_extract(ahead, {d.pattern('(?s)^.*(' + '|'.join(NAMES) + ')')}, 1) {whens} end"


@operator("N2 N3 N4 N5 N6 M12", {"page_texts": "planted"})
def osint_extract_accounts(d: Spark) -> str:
    """``page_id, rekening, bank, account_type, confidence`` of every account on pages
    (``page_id, html, origin``): wallets by phone number, then banks and wallets by
    block, of a length that fits.  A number without a name nearby is no account, and a
    block that a wallet's phone number took is not read again."""
    digits = d.replace_all("raw", "[^0-9]", "")
    wallets = ", ".join(f"'{w}'" for w in WALLETS)
    fits = " ".join(f"when '{b}' then length(digits) between {lo} and {hi}" for b, (lo, hi) in BANK_DIGITS.items())
    base = " ".join(f"when '{o}' then {c!r}e0" for o, c in ORIGINS.items())
    low, high = PHONE_DIGITS
    return f"""
with texts as (select page_id, origin, {page_text(d, "html")} as text from {{page_texts}}),
  numbers as ({_numbers(d, "phone", PHONE)} union all {_numbers(d, "block", BLOCK)}),
  named as (select page_id, kind, {digits} as digits, {_nearest(d)} as bank, case origin {base} else 1.0e0 end as base from numbers),
  national as (select page_id, kind, bank, base,
      case when kind = 'phone' and digits like '62%' then '0' || substr(digits, 3) else digits end as digits from named where bank is not null),
  phones as (select distinct page_id, digits, bank, base from national
    where kind = 'phone' and bank in ({wallets}) and length(digits) between {low} and {high}),
  blocks as (select distinct page_id, digits, bank, base from national n
    where kind = 'block' and case bank {fits} else length(digits) between {low} and {high} end
      and not exists (select 1 from phones p where p.page_id = n.page_id and p.digits = n.digits))
select page_id, digits as rekening, bank, 'ewallet' as account_type, {d.round(f"base * {SHARES['phone']!r}e0", 3)} as confidence from phones
union all
select page_id, digits, bank, case when bank in ({wallets}) then 'ewallet' else 'bank' end,
  {d.round(f"base * case when bank in ({wallets}) then {SHARES['wallet']!r}e0 else {SHARES['bank']!r}e0 end", 3)} from blocks"""
