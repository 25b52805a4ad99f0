"""Generated ledgers of the seven local typologies.

A typology is a list of legs.  A leg is ``n`` transfers whose ends, amounts and times
are expressions over their number ``id`` and hashes of it, so any size is made in
parallel and is the same at every run.  Times are days from the start, an hour of a
range, and a hashed minute.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .generate import _ledger, _pick, inject, licit

#: Accounts of each typology start here; its groups are numbered from there.
BASES = {"judol": 3_000_000, "scam": 4_000_000, "dormant": 5_000_000, "pep": 6_000_000, "vendor": 7_000_000, "bendahara": 8_000_000, "qris": 9_000_000}
START = 1_735_689_600
# The upper bound of public officials' transfers, just below the reporting limit.
SUB_THRESHOLD = 499_000_000


@dataclass(frozen=True)
class Leg:
    name: str
    n: int
    sender: Column
    receiver: Column
    amount: tuple[int, int, int]  # from, to, rounded to
    day: Column
    hours: tuple[int, int]
    illicit: bool = True


def _group(width: int) -> Column:
    return F.floor(F.col("id") / width)


def legs_of(spark: SparkSession, kind: str, legs: list[Leg]) -> DataFrame:
    """The transfers of all legs under the ledger's columns."""
    found = None
    for leg in legs:
        low, high, unit = leg.amount
        hour = F.lit(leg.hours[0]) + _pick(leg.hours[1] - leg.hours[0] + 1, leg.name, "h")
        rows = spark.range(leg.n).select(
            "id", leg.sender.alias("from_account"), leg.receiver.alias("to_account"),
            (F.floor((F.lit(low) + _pick(high - low + 1, leg.name, "a")) / unit) * unit).alias("amount"),
            (F.lit(START) + leg.day * 86_400 + F.pmod(hour, F.lit(24)) * 3600 + _pick(3600, leg.name, "s")).cast("bigint").alias("at"),
        )
        made = _ledger(rows, f"{leg.name}-", kind if leg.illicit else None)
        found = made if found is None else found.unionByName(made)
    return found


def customers(of: int, *salt: object) -> Column:
    """Accounts of ordinary customers, by hash."""
    return _pick(of, *salt)


def judol(n: int = 8000, organic: int = 2000) -> list[Leg]:
    """Gamblers pay 15 shell merchants in small sums, mostly in the evening and at night;
    these settle daily with two collectors, who cash out every third day."""
    base, merchants, collectors = BASES["judol"], 15, 2
    shell, pot = F.lit(base), F.lit(base + merchants)
    return [
        Leg("JDL", n, customers(organic, "JDL"), shell + _pick(merchants, "JDL", "t"), (10_000, 500_000, 1000), _pick(365, "JDL", "d"), (18, 26)),
        Leg("JDL-PT", merchants * 365, shell + F.col("id") % merchants, pot + _pick(collectors, "JDL-PT"), (3_000_000, 30_000_000, 1), _group(merchants), (22, 23)),
        Leg("JDL-OUT", collectors * 122, pot + F.col("id") % collectors, F.lit(base + 100), (50_000_000, 300_000_000, 1), _group(collectors) * 3, (1, 4)),
    ]


def scam(chains: int = 100, victims: int = 10, organic: int = 2000) -> list[Leg]:
    """Victims pay a hired customer; the money then passes four more accounts within a day."""
    base, spots = BASES["scam"], 4

    def mule(k: int) -> Column:
        return F.lit(base) + F.col("id") * spots + k

    first = [Leg("SCM-V", chains * victims, customers(organic, "SCM-V"), F.lit(base) + _group(victims) * spots, (20_000, 5_000_000, 1000), F.pmod(F.xxhash64(_group(victims)), F.lit(360)), (20, 21))]
    day = F.pmod(F.xxhash64(F.col("id")), F.lit(360))
    hops = [Leg(f"SCM-C{k}", chains, mule(k), mule(k + 1), (1_000_000 - 100_000 * k, 4_000_000 - 400_000 * k, 1), day, (21 + k // 2, 21 + k // 2)) for k in range(3)]
    return first + hops + [Leg("SCM-X", chains, mule(3), F.lit(base + 900_000) + F.col("id") % 20, (500_000, 2_500_000, 1), day, (23, 23))]


def dormant(accounts: int = 200, burst: int = 20) -> list[Leg]:
    """A small transfer, silence of at least 180 days, a large sum, a burst of payments within
    three days, and the rest in cash."""
    base = BASES["dormant"]
    own, account = F.lit(base) + F.col("id"), F.lit(base) + _group(burst)

    def woken(row: Column) -> Column:
        return F.lit(180) + F.pmod(F.xxhash64(row), F.lit(150))

    return [
        Leg("DRM-OLD", accounts, F.lit(base + 500_000) + F.col("id") % 100, own, (100_000, 2_000_000, 1), F.lit(0), (9, 15), illicit=False),
        Leg("DRM-ACT", accounts, F.lit(base + 600_000) + F.col("id") % 50, own, (5_000_000, 50_000_000, 1), woken(F.col("id")), (0, 6)),
        Leg("DRM-BST", accounts * burst, account, F.lit(base + 700_000) + _pick(50, "DRM"), (500_000, 20_000_000, 1000), woken(_group(burst)) + F.floor(F.col("id") % burst / 10), (7, 23)),
        Leg("DRM-EXIT", accounts, own, F.lit(base + 800_000) + F.col("id") % 20, (10_000_000, 100_000_000, 1), woken(F.col("id")) + 3, (1, 4)),
    ]


def pep(officials: int = 100, between: int = 4) -> list[Leg]:
    """Sums just below the limit pass from a source over intermediaries to an official's
    relative, and on to a purchase."""
    base, width = BASES["pep"], between + 3
    day = F.pmod(F.xxhash64(F.col("id")), F.lit(330))

    def spot(k: int) -> Column:
        return F.lit(base) + F.col("id") * width + k

    return [
        Leg(f"PEP-{k}", officials, spot(k), spot(k + 1), (100_000_000, SUB_THRESHOLD, 1_000_000), day + k, (9, 15)) for k in range(between + 2)
    ]


def vendor(tenders: int = 60, layers: int = 3, width: int = 4) -> list[Leg]:
    """A budget is shared among shell vendors in layers, each paying all of the next, and
    comes together again."""
    base, spots = BASES["vendor"], 2 + layers * width
    own = F.floor(F.col("id") / width)
    day = F.pmod(F.xxhash64(own), F.lit(300))
    hub = F.lit(base) + own * spots

    def shell(layer: int, k: Column) -> Column:
        return hub + 1 + layer * width + k

    first = [Leg("VND-0", tenders * width, hub, shell(0, F.col("id") % width), (12_000_000, 150_000_000, 1_000_000), day, (9, 16))]
    deeper = []
    for layer in range(1, layers):
        pair = F.floor(F.col("id") / (width * width))
        start = F.lit(base) + pair * spots + 1
        sender = start + (layer - 1) * width + F.floor(F.col("id") / width) % width
        deeper.append(
            Leg(f"VND-{layer}", tenders * width * width, sender, start + layer * width + F.col("id") % width, (3_000_000, 40_000_000, 1_000_000),
                F.pmod(F.xxhash64(pair), F.lit(300)) + layer * 2, (9, 16))
        )
    last = Leg("VND-X", tenders * width, shell(layers - 1, F.col("id") % width), hub + spots - 1, (10_000_000, 200_000_000, 1_000_000), day + layers * 2 + 2, (9, 14))
    return [*first, *deeper, last]


def bendahara(treasurers: int = 100, recipients: int = 6) -> list[Leg]:
    """A treasurer receives a budget, pays recipients within three days, and takes a
    kickback out in the evening."""
    base, spots = BASES["bendahara"], recipients + 3
    hub, one = F.lit(base) + F.col("id") * spots, F.lit(base) + _group(recipients) * spots
    day = F.pmod(F.xxhash64(F.col("id")), F.lit(330))
    return [
        Leg("BND-IN", treasurers, hub + 1, hub, (50_000_000, SUB_THRESHOLD, 1_000_000), day, (8, 10)),
        Leg("BND-PAY", treasurers * recipients, one, one + 3 + F.col("id") % recipients, (5_000_000, 80_000_000, 1_000_000),
            F.pmod(F.xxhash64(_group(recipients)), F.lit(330)) + 1 + _pick(3, "BND"), (9, 15)),
        Leg("BND-CUT", treasurers, hub, hub + 2, (5_000_000, 100_000_000, 1_000_000), day + 5, (20, 23)),
    ]


def qris(n: int = 6000, merchants: int = 50, providers: int = 11, organic: int = 2000) -> list[Leg]:
    """Buyers pay cloned merchant codes; the merchants settle over payment providers, and
    these pay two collectors every other day before dawn."""
    base = BASES["qris"]
    shop, pay, pot = F.lit(base), F.lit(base + 1000), F.lit(base + 2000)
    return [
        Leg("QRS", n, customers(organic, "QRS"), shop + _pick(merchants, "QRS", "t"), (10_000, 2_000_000, 1000), _pick(365, "QRS", "d"), (9, 23)),
        Leg("QRS-S", merchants * 52, shop + F.col("id") % merchants, pay + _pick(providers, "QRS-S"), (5_000_000, 50_000_000, 1), _group(merchants) * 7, (23, 23)),
        Leg("QRS-X", providers * 182, pay + F.col("id") % providers, pot + F.col("id") % 2, (100_000_000, SUB_THRESHOLD, 1), _group(providers) * 2, (2, 5)),
    ]


TYPOLOGIES = {"judol": judol, "scam": scam, "dormant": dormant, "pep": pep, "vendor": vendor, "bendahara": bendahara, "qris": qris}


def typology(spark: SparkSession, kind: str, **sizes: int) -> DataFrame:
    """The transfers of one typology; ``sizes`` are its parameters."""
    return legs_of(spark, kind, TYPOLOGIES[kind](**sizes))


def gen_typologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of licit traffic with all seven typologies in it."""
    return inject(licit(spark, 20_000, days=365), *[typology(spark, kind) for kind in TYPOLOGIES])


QUERIES = {"gen_typologies": gen_typologies}
COVERS = {"gen_typologies": "S27"}
SQL: dict[str, str] = {}
