"""The online account store: 24 features of every account, kept as state of a stream.

A transfer is split into its two ends; each end updates the state of its account.
:class:`StoreRun` keeps it as tables that every batch derives from the last one's;
for streams that want it in the RocksDB state store, :class:`AccountStore` has it by
``transformWithState``, at the price of a Python call an account and batch:

* one value of counters: transfers, amounts (in whole hundredths), night, largest, round
  and limit-hugging ones, transfers per channel, numbers of distinct peers and devices,
  last times, the longest gap, the newest 20 times sent, and the first few peers and devices;
* a map with an entry per further sender, recipient and device, so that a hub's set is
  entries of the store and no row;
* one value of transfers per second, out for an hour and in for ten minutes: at most 3601
  and 601 counts for the busiest account, gone by time-to-live where it falls silent.

There a call of the store costs a round trip, so an ordinary account has all it needs in the
two values; rows come as plain rows, as frames of an account's few rows cost far more than
its arithmetic.  Rows of a micro-batch come in any order; of a batch only its times are held
together, a number each.  The feature columns are computed
from the state by SQL functions, in the JVM, for the stream, for replays and for readers.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.expressions import night, round_amount, struct_feature
from ..functions.workspace import Workspace
from ..operators.features import FEATURE_COLUMNS
from ..operators.iterative import SQL as ITERATIVE_SQL
from ..operators.iterative import LEDGER_COLUMNS, causal_network
from ..plans.catalog import OPERATORS
from ..plans.fixtures import fixture, fixture_sql
from .account_state import RAPID_S, RETENTION_S, VELOCITY_S
from .network_cache import COLUMNS as NETWORK_COLUMNS
from .network_cache import NetworkCache

#: Newest times sent that the deviation of gaps is of.
NEWEST = 20
_MICRO = 1_000_000
_COUNTS = (
    "in_n", "out_n", "in_cents", "out_cents", "night_n", "largest_cents", "round_n", "struct_n", "senders", "recipients", "devices",
    "last_ts", "max_gap", "last_in", "last_out",
)
COUNTERS = ", ".join(f"{c} bigint" for c in _COUNTS) + ", newest array<bigint>, names array<string>, channels array<bigint>, items array<string>"
WINDOWS = "out_at array<bigint>, out_n array<int>, in_at array<bigint>, in_n array<int>"
STATE_ROW = f"{', '.join(f'{c} bigint' for c in _COUNTS)}, newest array<bigint>, channels array<bigint>, hour_out bigint, recent_in bigint"
#: Time that the store keeps the windows of an account that is silent, in milliseconds.
WINDOWS_TTL_MS = RETENTION_S * 1000
#: Peers and devices of an account that its value holds; further ones go to the map.
INLINE_ITEMS = 96
#: Distinct peers and devices of a batch that are gathered before they are looked up.
OFFERED_ITEMS = 4096
_KINDS = {"S": "senders", "R": "recipients", "D": "devices"}
_END = ("out", "peer", "at", "cents", "channel", "device_id", "is_night", "is_round", "is_struct")


def ends(transfers: DataFrame) -> DataFrame:
    """A row per transfer and end of ``tx_id, from_account, to_account, amount, channel,
    device_id, ts``; rows without an id of an account or without a time have no end there."""
    flags = {"is_night": night("ts"), "is_round": round_amount("amount"), "is_struct": struct_feature("amount")}
    marked = transfers.select("*", *[F.coalesce(F.expr(x), F.lit(False)).alias(n) for n, x in flags.items()])
    marked = marked.withColumn("channel", F.coalesce("channel", F.lit("unknown")))
    base = ["channel", "device_id", "is_night", "is_round", "is_struct"]
    cents = F.coalesce(F.round(F.col("amount") * 100), F.lit(0)).cast("bigint").alias("cents")
    sides = [
        F.struct(F.col(own).alias("account_id"), F.lit(out).alias("out"), F.col(peer).cast("string").alias("peer"))
        for own, peer, out in (("from_account", "to_account", True), ("to_account", "from_account", False))
    ]
    found = marked.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), cents, *base, F.explode(F.array(*sides)).alias("e"))
    return found.select("e.*", "at", "cents", *base).where("account_id is not null and at is not null")


class AccountStore(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", COUNTERS)
        self.windows = handle.getValueState("windows", WINDOWS, ttlDurationMs=WINDOWS_TTL_MS)
        self.more_items = handle.getMapState("more_items", "item string", "n int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.counters.get()
        c = dict.fromkeys(_COUNTS, 0) | {"last_ts": -1, "last_in": -1, "last_out": -1}
        newest: list[int] = []
        channels: Counter[str] = Counter()
        items: set[str] = set()
        if held:
            c = dict(zip(_COUNTS, held, strict=False))
            newest, items = list(held[-4]), set(held[-1])
            channels.update(dict(zip(held[-3], held[-2], strict=True)))
        outs: list[int] = []
        ins: list[int] = []
        offered: set[str] = set()
        place = None
        for row in rows:
            place = place or [row.__fields__.index(x) for x in _END]
            out, peer, at, cents, channel, device, is_night, is_round, is_struct = (row[i] for i in place)
            c["night_n"] += is_night
            c["largest_cents"] = max(c["largest_cents"], cents)
            channels[channel] += 1
            if out:
                outs.append(at)
                c["out_cents"] += cents
                c["round_n"] += is_round
                c["struct_n"] += is_struct
            else:
                ins.append(at)
                c["in_cents"] += cents
            if peer:
                offered.add(f"{'R' if out else 'S'}:{peer}")
            if device:
                offered.add(f"D:{device}")
            if len(offered) >= OFFERED_ITEMS:
                self._add_items(offered, items, c)
                offered = set()
        self._add_items(offered, items, c)
        for p, times in (("out", outs), ("in", ins)):
            c[f"{p}_n"] += len(times)
            c[f"last_{p}"] = max(c[f"last_{p}"], max(times, default=-1))
        newest = sorted([*newest, *outs])[-NEWEST:]
        ordered = sorted([*outs, *ins])
        if c["last_ts"] >= 0:
            ordered.insert(0, c["last_ts"])
        c["max_gap"] = max(c["max_gap"], max((y - x for x, y in itertools.pairwise(ordered)), default=0))
        c["last_ts"] = max(c["last_ts"], ordered[-1])
        names = sorted(channels)
        self.counters.update((*(c[n] for n in _COUNTS), newest, names, [channels[x] for x in names], sorted(items)))
        hour_out, recent_in = self._seconds(outs, ins, c["last_ts"] // _MICRO)
        found = {"newest": newest, "channels": sorted(channels.values()), "hour_out": hour_out, "recent_in": recent_in}
        yield Row(account_id=key[0], **{n: c[n] for n in _COUNTS}, **found)

    def _add_items(self, offered: set[str], items: set[str], c: dict[str, int]) -> None:
        """Count the peers and devices that the account has not had; they are remembered."""
        full = c["senders"] + c["recipients"] + c["devices"] > len(items)
        for item in offered - items:
            if full and self.more_items.containsKey((item,)):
                continue
            c[_KINDS[item[0]]] += 1
            if len(items) < INLINE_ITEMS:
                items.add(item)
            else:
                self.more_items.updateValue((item,), (1,))
                full = True

    def _seconds(self, outs: list[int], ins: list[int], last: int) -> tuple[int, int]:
        """Add a batch's times to the windows, and count what these hold up to ``last``,
        both ends included; older seconds go."""
        held = self.windows.get() or ([], [], [], [])
        found = []
        for times, old, width in ((outs, held[:2], VELOCITY_S), (ins, held[2:], RAPID_S)):
            counts = Counter(dict(zip(*old, strict=True)))
            counts.update(t // _MICRO for t in times)
            kept = sorted(t for t in counts if t >= last - width)
            found.append((kept, [counts[t] for t in kept]))
        self.windows.update((*found[0], *found[1]))
        return sum(found[0][1]), sum(found[1][1])

    def close(self) -> None:
        pass


def states(transfers: DataFrame) -> DataFrame:
    """By the state store, the state of every account that a micro-batch touches, after it: ``account_id``
    and :data:`STATE_ROW` (update mode).  The session's state store must be RocksDB."""
    split = ends(transfers)
    kind = split.schema["account_id"].dataType.simpleString()
    return split.groupBy("account_id").transformWithState(
        AccountStore(), f"account_id {kind}, {STATE_ROW}", "Update", "ProcessingTime"
    )


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / b.cast("double")


def features(state: DataFrame) -> DataFrame:
    """``account_id``, the 20 columns of the contract that state alone gives, in its
    order, and the signals ``velocity_1h, rapid_inout, device_count``; ``state`` also
    may hold other columns, which stay in front."""
    c = F.col
    money = lambda x: c(x).cast("double") / 100
    gaps = F.transform(F.sequence(F.lit(1), F.size("newest") - 1), lambda i: _ratio(c("newest")[i] - c("newest")[i - 1], F.lit(_MICRO)))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    spread = F.transform(F.array(F.struct(gaps.alias("g"), mean(gaps).alias("m"))), lambda s: F.sqrt(mean(F.transform(s["g"], lambda x: (x - s["m"]) * (x - s["m"])))))[0]
    every = (c("in_n") + c("out_n")).cast("long")
    share = lambda n: _ratio(n, F.greatest(every, F.lit(1)))
    entropy = F.aggregate("channels", F.lit(0.0), lambda a, n: a - share(n) * F.log2(share(n) + 1e-12))
    made = {
        "in_degree": c("in_n"),
        "out_degree": c("out_n"),
        "in_amount_sum": money("in_cents"),
        "out_amount_sum": money("out_cents"),
        "unique_senders": c("senders"),
        "unique_recipients": c("recipients"),
        "total_tx": every,
        "max_single_tx": money("largest_cents"),
        "degree_ratio": _ratio(c("out_n"), c("in_n") + 1),
        "amount_ratio": money("out_cents") / (money("in_cents") + 1),
        "night_tx_ratio": share(c("night_n")),
        "avg_amount_in": money("in_cents") / (c("in_n") + 1),
        "avg_amount_out": money("out_cents") / (c("out_n") + 1),
        "counterparty_hhi": 1.0 / F.greatest(c("recipients"), F.lit(1)),
        "channel_entropy": entropy,
        "round_amount_ratio": _ratio(c("round_n"), F.greatest(c("out_n"), F.lit(1))),
        "structuring_score": _ratio(c("struct_n"), F.greatest(c("out_n"), F.lit(1))),
        "burst_ratio": share(c("hour_out")),
        "inter_tx_std": F.when(F.size("newest") < 2, 0.0).otherwise(spread),
        "dormancy_days": _ratio(c("max_gap"), F.lit(86_400 * _MICRO)),
    }
    gap = c("last_out") - c("last_in")
    rapid = (c("recent_in") > 0) & (c("last_in") >= 0) & (c("last_out") >= 0) & gap.between(0, RAPID_S * _MICRO)
    inner = set(STATE_ROW.replace(",", "").split()[::2])
    front = [x for x in state.columns if x not in inner]
    return state.select(*front, *[made[x].alias(x) for x in FEATURE_COLUMNS if x in made], c("hour_out").alias("velocity_1h"), rapid.alias("rapid_inout"), c("devices").alias("device_count"))


#: What a batch adds to an account's counters, by column of them; ``at`` and ``cents`` are whole numbers.
_ADDED = {
    "in_n": "count_if(not out)", "out_n": "count_if(out)", "in_cents": "sum(if(out, 0, cents))", "out_cents": "sum(if(out, cents, 0))",
    "night_n": "count_if(is_night)", "largest_cents": "greatest(0, max(cents))", "round_n": "count_if(out and is_round)",
    "struct_n": "count_if(out and is_struct)", "last_ts": "max(at)", "last_in": "max(if(out, -1, at))", "last_out": "max(if(out, at, -1))",
}
#: Columns of which the greater is kept, where others are added.
_GREATEST = ("largest_cents", "last_ts", "max_gap", "last_in", "last_out")


def _side_by_side(one: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        one = one.join(other, "account_id", "left")
    return one


def batch_sums(split: DataFrame, last: DataFrame) -> DataFrame:
    """What a batch of ends adds, a row an account: counters, the longest gap from the
    account's time in ``last`` on, the newest times sent, transfers by channel."""
    before = Window.partitionBy("account_id").orderBy("at")
    timed = split.join(last, "account_id", "left").withColumn("gap", F.col("at") - F.coalesce(F.lag("at").over(before), F.col("last_ts"))).drop("last_ts")
    sums = timed.groupBy("account_id").agg(F.greatest(F.max("gap"), F.lit(0)).alias("max_gap"), *[F.expr(x).cast("long").alias(c) for c, x in _ADDED.items()])
    sent = split.where("out").select("account_id", "at").withColumn("i", F.row_number().over(before.orderBy(F.col("at").desc()))).where(F.col("i") <= NEWEST)
    newest = sent.groupBy("account_id").agg(F.collect_list("at").alias("newest"))
    channels = split.groupBy("account_id", "channel").agg(F.count(F.lit(1)).alias("n"))
    channels = channels.groupBy("account_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "n"))).alias("by_channel"))
    return _side_by_side(sums, newest, channels)


def batch_items(split: DataFrame) -> DataFrame:
    """``account_id, item`` of the peers and devices of a batch's ends, each once."""
    peer = F.when(F.col("peer") != "", F.concat(F.when(F.col("out"), "R:").otherwise("S:"), "peer"))
    device = F.when(F.col("device_id") != "", F.concat(F.lit("D:"), "device_id"))
    return split.select("account_id", F.explode(F.array(peer, device)).alias("item")).where("item is not null").distinct()


def _updated(held: DataFrame | None, sums: DataFrame, items: DataFrame) -> DataFrame:
    """The counters of all accounts after a batch, and whether it touched them."""
    counted = items.groupBy("account_id").agg(*[F.count_if(F.col("item").startswith(f"{k}:")).alias(c) for k, c in _KINDS.items()])
    new = _side_by_side(sums, counted).fillna(0, list(_KINDS.values())).withColumn("touched", F.lit(True))
    if held is None:
        both = new.select("account_id", *_COUNTS, F.sort_array("newest").alias("newest"), "by_channel", "touched")
        return both.withColumn("newest", F.coalesce("newest", F.array().cast("array<bigint>")))
    none = "array()", "map()"
    columns = [(F.greatest(f"h.{c}", f"b.{c}") if c in _GREATEST else F.coalesce(f"h.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0))).alias(c) for c in _COUNTS]
    newest = f"slice(sort_array(concat(coalesce(h.newest, {none[0]}), coalesce(b.newest, {none[0]})), false), 1, {NEWEST})"
    channels = f"map_zip_with(coalesce(h.by_channel, {none[1]}), coalesce(b.by_channel, {none[1]}), (k, x, y) -> coalesce(x, 0L) + coalesce(y, 0L))"
    return held.drop("touched").alias("h").join(new.alias("b"), "account_id", "full_outer").select(
        "account_id", *columns, F.expr(f"sort_array({newest})").alias("newest"),
        F.expr(f"if(b.by_channel is null, h.by_channel, if(h.by_channel is null, b.by_channel, {channels}))").alias("by_channel"),
        F.coalesce("b.touched", F.lit(False)).alias("touched"),
    )


def _windows(held: DataFrame | None, split: DataFrame, counters: DataFrame) -> DataFrame:
    """``account_id, out, second, n`` within the windows up to an account's last second."""
    every = split.select("account_id", "out", F.floor(F.col("at") / _MICRO).alias("second"), F.lit(1).cast("long").alias("n"))
    every = every if held is None else held.unionByName(every)
    summed = every.groupBy("account_id", "out", "second").agg(F.sum("n").alias("n"))
    width = F.when(F.col("out"), VELOCITY_S).otherwise(RAPID_S)
    last = counters.select("account_id", F.floor(F.col("last_ts") / _MICRO).alias("last"))
    return summed.join(last, "account_id").where(F.col("second") >= F.col("last") - width).drop("last")


class StoreRun:
    """A store over staged transfers: each :meth:`offer` is written and processed as one
    micro-batch, by a query that starts from the checkpoint of the last.

    The state is tables that a batch writes under its number: counters and windows anew
    from those of the batch before, and the peers and devices that are new, a row each.
    They come by joins and groupings, with no Python and no call an account, and a batch
    that runs again finds what it found at first.  Versions stay, so any batch can be read.
    :func:`states` is the same store as state of ``transformWithState``.
    """

    def __init__(self, work: Workspace, schema: T.StructType, cache: NetworkCache):
        self.work, self.schema, self.cache = work, schema, cache
        self.input, self.output, self.checkpoint = (f"{work.path}/{x}" for x in ("in", "features", "checkpoint"))
        #: Id of each offer's micro-batch.
        self.batches: list[int] = []

    def _version(self, name: str, batch: int) -> DataFrame:
        return self.work.spark.read.parquet(f"{self.work.path}/{name}/batch={batch}")

    def _derive(self, batch: DataFrame, number: int) -> DataFrame:
        """Write the state after a batch, and give the state rows of the accounts that it touched."""
        cut = lambda df, name: self.work.cut(df, f"{name}/batch={number}")
        split = cut(ends(batch), "ends")
        held = self._version("counters", number - 1) if number else None
        items = batch_items(split)
        if held is None:
            last = split.select("account_id", F.lit(None).cast("long").alias("last_ts")).limit(0)
        else:
            last = held.select("account_id", "last_ts")
            known = self._version("items", 0)
            for i in range(1, number):
                known = known.unionByName(self._version("items", i))
            items = items.join(known, ["account_id", "item"], "left_anti")
        items = cut(items, "items")
        counters = cut(_updated(held, batch_sums(split, last), items), "counters")
        windows = cut(_windows(self._version("windows", number - 1) if number else None, split, counters), "windows")
        self.work.drop(f"ends/batch={number}")
        recent = windows.groupBy("account_id").agg(F.sum(F.expr("if(out, n, 0)")).alias("hour_out"), F.sum(F.expr("if(out, 0, n)")).alias("recent_in"))
        found = counters.where("touched").join(recent, "account_id", "left").fillna(0, ["hour_out", "recent_in"])
        return found.withColumn("channels", F.sort_array(F.map_values("by_channel"))).drop("by_channel", "touched")

    def offer(self, transfers: DataFrame) -> None:
        spark = self.work.spark
        transfers.write.mode("append").parquet(self.input)
        seen: list[int] = []

        def sink(batch: DataFrame, number: int) -> None:
            seen.append(number)
            joined = features(self._derive(batch, number)).join(self.cache.read(), "account_id", "left").fillna(0.0, list(NETWORK_COLUMNS))
            joined.write.mode("overwrite").parquet(f"{self.output}/batch={number}")

        stream = spark.readStream.schema(self.schema).parquet(self.input)
        stream.writeStream.option("checkpointLocation", self.checkpoint).trigger(once=True).foreachBatch(sink).start().awaitTermination()
        self.batches += seen[-1:]

    def latest(self) -> DataFrame:
        """Each account's features after the last batch that touched it."""
        found = self.work.spark.read.parquet(self.output)
        return found.groupBy("account_id").agg(F.max_by(F.struct("*"), "batch").alias("s")).select("s.*").drop("batch")

    def stored(self, batch: int) -> DataFrame:
        """The counters of all accounts as of a batch.  Reading changes nothing."""
        return self._version("counters", batch).drop("touched")

    def stored_seconds(self, batch: int) -> DataFrame:
        """``account_id, second, n`` of the transfers sent, in the windows as of a batch."""
        return self._version("windows", batch).where("out").select("account_id", "second", "n")

    def replay(self, transfers: DataFrame, batch: int) -> DataFrame:
        """Transfers (``tx_id, from_account, ts``) against the senders' state as of a
        batch; nothing is updated.  A sender without state has zeros and ``known`` false.

        ``velocity_1h`` counts the sender's stored transfers of the hour up to the
        transfer, ``rapid_inout`` whether money came in within ten minutes before it.
        """
        state = self.stored(batch).select("account_id", "in_n", "out_n", "senders", "recipients", "devices", "last_in")
        asked = transfers.select("tx_id", F.col("from_account").alias("account_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
        close = asked.join(self.stored_seconds(batch), "account_id")
        close = close.where((F.col("second") >= F.col("at") - VELOCITY_S) & (F.col("second") <= F.col("at")))
        velocity = close.groupBy("tx_id").agg(F.sum("n").alias("velocity_1h"))
        count = lambda x: F.coalesce(x, F.lit(0)).cast("long")
        gap = F.col("at") - F.floor(F.col("last_in") / _MICRO)
        return asked.join(state, "account_id", "left").join(velocity, "tx_id", "left").select(
            "tx_id", "account_id", F.col("out_n").isNotNull().alias("known"), count(F.col("in_n") + F.col("out_n")).alias("total_tx"),
            count(F.col("senders")).alias("fan_in"), count(F.col("recipients")).alias("fan_out"), count(F.col("devices")).alias("device_count"),
            count(F.col("velocity_1h")).alias("velocity_1h"), F.coalesce((F.col("last_in") >= 0) & gap.between(0, RAPID_S), F.lit(False)).alias("rapid_inout"),
        )


_SLICES = 4


def _sliced(spark: SparkSession, work: Workspace, sf_dir: str) -> tuple[DataFrame, Callable[[int], DataFrame]]:
    """The fixture's transfers, written once, and the function that gives those of a quarter
    of its time."""
    tx = work.cut(fixture(spark, sf_dir, "tx").select("tx_id", *LEDGER_COLUMNS), "rows")
    # the fixture repeats some ids; the store counts every transfer that it is offered
    rows = tx.select("tx_id", "from_account", "to_account", "amount", "channel", "device_id", F.col("tx_timestamp").alias("ts"))
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    width = (high - low) / _SLICES
    part = sum(((at >= low + i * width).cast("int") for i in range(1, _SLICES)), F.lit(0))
    return tx, lambda i: rows.where(part == i)


def _run(spark: SparkSession, sf_dir: str, name: str, offers: int, before: Callable[[int, DataFrame, NetworkCache], None] | None = None):
    work = Workspace(spark, name)
    tx, quarter = _sliced(spark, work, sf_dir)
    key = tx.schema["from_account"].dataType
    cache = NetworkCache(spark, f"{work.path}/network", key)
    first = quarter(0)
    run = StoreRun(work, first.schema, cache)
    for i in range(offers):
        if before:
            before(i, tx, cache)
        run.offer(quarter(i))
    return run, quarter


def network_sources(spark: SparkSession, tx: DataFrame, devices: bool) -> dict[str, DataFrame]:
    """The sources of two network columns, and no other features: those of devices and
    institutions, or PageRank and core numbers."""
    if devices:
        found = (OPERATORS[x].apply(spark, {"tx": tx}) for x in ("feat_device_sharing", "feat_institutions"))
    else:
        found = causal_network(spark, tx)
    return dict(zip(NETWORK_COLUMNS[:2] if devices else NETWORK_COLUMNS[2:], found, strict=True))


def stream_account_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 columns after all four quarters.  The network cache is refreshed before the
    first (two columns are ready) and before the third quarter (the other two are)."""

    def refresh(i: int, tx: DataFrame, cache: NetworkCache) -> None:
        if i in (0, 2):
            cache.refresh(OPERATORS["feat_first_seen"].apply(spark, {"tx": tx}), network_sources(spark, tx, i == 0))

    run, _ = _run(spark, sf_dir, "account-store", _SLICES, refresh)
    found = run.latest().select("account_id", *FEATURE_COLUMNS, "velocity_1h", "rapid_inout", "device_count")
    rounded = {"channel_entropy": 6, "inter_tx_std": 4, "pagerank": 12}
    return found.withColumns({c: F.round(c, n) for c, n in rounded.items()})


def stream_state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers of the third quarter scored against the state after the second, read by
    its number when the third has been processed; the state is the same after as before."""
    run, quarter = _run(spark, sf_dir, "state-replay", 3)
    batch = run.batches[1]
    digest = lambda: run.stored(batch).agg(F.sum(F.xxhash64("account_id", *_COUNTS, "newest").cast("decimal(38,0)"))).first()[0]
    before = digest()
    found = run.work.cut(run.replay(quarter(2).dropDuplicates(["tx_id"]), batch), "scores")
    if digest() != before:
        raise RuntimeError("a replay changed the stored state")
    return found


QUERIES = {"stream_account_store": stream_account_store, "stream_state_replay": stream_state_replay}
COVERS = {"stream_account_store": "T2 T3 T4 T5 T6 T7 T11", "stream_state_replay": "T10"}

_ENDS_SQL = f"""{fixture_sql("{tx}")},
  edge AS (SELECT min(epoch(tx_timestamp)) AS low, (max(epoch(tx_timestamp)) - min(epoch(tx_timestamp))) / {_SLICES} AS width FROM tx),
  timed AS (SELECT tx.*, epoch(tx_timestamp) AS ep, CAST(epoch(tx_timestamp) >= low + width AS INT) + CAST(epoch(tx_timestamp) >= low + 2 * width AS INT)
    + CAST(epoch(tx_timestamp) >= low + 3 * width AS INT) AS part FROM tx CROSS JOIN edge),
  ends AS (SELECT from_account AS account_id, true AS out, to_account AS peer, device_id, channel, amount, tx_timestamp, ep, part, tx_id FROM timed
    UNION ALL SELECT to_account, false, from_account, device_id, channel, amount, tx_timestamp, ep, part, tx_id FROM timed)"""
_SQL_STORE = f"""WITH {_ENDS_SQL},
  late AS (SELECT *, max(ep) OVER (PARTITION BY account_id) AS last, ep - lag(ep) OVER (PARTITION BY account_id ORDER BY ep) AS gap,
    row_number() OVER (PARTITION BY account_id, out ORDER BY ep DESC, tx_id) AS newest FROM ends),
  sent AS (SELECT account_id, ep - lag(ep) OVER (PARTITION BY account_id ORDER BY ep) AS gap FROM late WHERE out AND newest <= {NEWEST}),
  spread AS (SELECT account_id, round(stddev_pop(gap), 4) AS inter_tx_std FROM sent GROUP BY account_id),
  c AS (SELECT account_id, count(*) FILTER (WHERE NOT out) AS in_n, count(*) FILTER (WHERE out) AS out_n,
    CAST(coalesce(sum(amount) FILTER (WHERE NOT out), 0) AS DOUBLE) AS in_amount, CAST(coalesce(sum(amount) FILTER (WHERE out), 0) AS DOUBLE) AS out_amount,
    count(DISTINCT peer) FILTER (WHERE NOT out) AS senders, count(DISTINCT peer) FILTER (WHERE out) AS recipients, CAST(max(amount) AS DOUBLE) AS largest,
    count(*) FILTER (WHERE {night("tx_timestamp")}) AS night_n, count(*) FILTER (WHERE out AND {round_amount("amount")}) AS round_n,
    count(*) FILTER (WHERE out AND {struct_feature("amount")}) AS struct_n, count(*) FILTER (WHERE out AND ep >= last - {VELOCITY_S}) AS velocity_1h,
    count(*) FILTER (WHERE NOT out AND ep >= last - {RAPID_S}) AS recent_in, max(ep) FILTER (WHERE out) AS last_out, max(ep) FILTER (WHERE NOT out) AS last_in,
    max(gap) AS max_gap, count(DISTINCT device_id) AS device_count, max(part) AS part FROM late GROUP BY account_id)
SELECT c.account_id, in_n AS in_degree, out_n AS out_degree, in_amount AS in_amount_sum, out_amount AS out_amount_sum, senders AS unique_senders,
  recipients AS unique_recipients, in_n + out_n AS total_tx, largest AS max_single_tx, out_n::DOUBLE / (in_n + 1) AS degree_ratio,
  out_amount / (in_amount + 1) AS amount_ratio, night_n::DOUBLE / (in_n + out_n) AS night_tx_ratio, in_amount / (in_n + 1) AS avg_amount_in,
  out_amount / (out_n + 1) AS avg_amount_out, 1.0 / greatest(recipients, 1)::DOUBLE AS counterparty_hhi, f.channel_entropy,
  round_n::DOUBLE / greatest(out_n, 1) AS round_amount_ratio, struct_n::DOUBLE / greatest(out_n, 1) AS structuring_score,
  velocity_1h::DOUBLE / (in_n + out_n) AS burst_ratio, coalesce(s.inter_tx_std, 0) AS inter_tx_std, coalesce(max_gap, 0)::DOUBLE / 86400 AS dormancy_days,
  f.device_sharing_count::DOUBLE AS device_sharing_count, f.n_institutions::DOUBLE AS n_institutions,
  CASE WHEN part >= 2 THEN f.pagerank ELSE 0 END AS pagerank, CASE WHEN part >= 2 THEN f.kcore_number ELSE 0 END::DOUBLE AS kcore_number,
  velocity_1h, coalesce(recent_in > 0 AND last_out - last_in BETWEEN 0 AND {RAPID_S}, false) AS rapid_inout, device_count
FROM c LEFT JOIN spread s ON c.account_id = s.account_id JOIN ({ITERATIVE_SQL["feat_full_table"]}) f ON c.account_id = f.account_id"""
_SQL_REPLAY = f"""WITH {_ENDS_SQL},
  c AS (SELECT account_id, count(*) AS n, count(DISTINCT peer) FILTER (WHERE NOT out) AS fan_in, count(DISTINCT peer) FILTER (WHERE out) AS fan_out,
    count(DISTINCT device_id) AS devices, max(ep) FILTER (WHERE NOT out) AS last_in FROM ends WHERE part < 2 GROUP BY account_id),
  asked AS (SELECT tx_id, any_value(from_account) AS account_id, any_value(ep) AS ep FROM timed WHERE part = 2 GROUP BY tx_id),
  v AS (SELECT a.tx_id, count(*) AS n FROM asked a JOIN ends e ON a.account_id = e.account_id AND e.out AND e.part < 2
    AND e.ep BETWEEN a.ep - {VELOCITY_S} AND a.ep GROUP BY a.tx_id)
SELECT a.tx_id, a.account_id, c.n IS NOT NULL AS known, coalesce(c.n, 0) AS total_tx, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out,
  coalesce(devices, 0) AS device_count, coalesce(v.n, 0) AS velocity_1h, coalesce(a.ep - last_in BETWEEN 0 AND {RAPID_S}, false) AS rapid_inout
FROM asked a LEFT JOIN c ON a.account_id = c.account_id LEFT JOIN v ON a.tx_id = v.tx_id"""
SQL = {"stream_account_store": _SQL_STORE, "stream_state_replay": _SQL_REPLAY}
