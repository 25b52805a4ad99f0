"""The store's handler over plain rows: what an account costs, and what it then knows."""

import time

from pyspark.sql import Row

from ledgergraph.streaming.account_store import INLINE_ITEMS, AccountStore


class Kept:
    """A state variable, and how often it was called."""

    def __init__(self):
        self.value, self.entries, self.calls = None, {}, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.entries

    def updateValue(self, key, value):
        self.calls += 1
        self.entries[key] = value


class Handle:
    def __init__(self):
        self.kept = {}

    def getValueState(self, name, schema, ttlDurationMs=None):
        return self.kept.setdefault(name, Kept())

    getMapState = lambda self, name, *_: self.kept.setdefault(name, Kept())


def end(at, out=True, peer="p", cents=100):
    return Row(account_id=1, out=out, peer=peer, at=at * 1_000_000, cents=cents, channel="atm", device_id="d", is_night=False, is_round=True, is_struct=False)


def test_an_account_of_few_rows_costs_four_calls_and_little_time():
    began, n = time.process_time(), 2000
    for _ in range(n):
        store, handle = AccountStore(), Handle()
        store.init(handle)
        (found,) = store.handleInputRows((1,), iter([end(10), end(70), end(40, out=False, peer="q")]), None)
        assert sum(k.calls for k in handle.kept.values()) == 4
    assert (found.out_n, found.in_n, found.recipients, found.senders, found.devices, found.max_gap) == (2, 1, 1, 1, 1, 30_000_000)
    assert (found.round_n, found.out_cents, found.hour_out, found.recent_in, found.newest) == (2, 200, 2, 1, [10_000_000, 70_000_000])
    assert time.process_time() - began < n * 1e-3  # frames took several times that


def test_items_past_the_value_are_counted_once_over_batches():
    store, handle = AccountStore(), Handle()
    store.init(handle)
    for batch in (range(2 * INLINE_ITEMS), range(INLINE_ITEMS, 3 * INLINE_ITEMS)):
        (found,) = store.handleInputRows((1,), iter([end(i, peer=f"p{i}") for i in batch for _ in range(2)]), None)
    assert found.recipients == 3 * INLINE_ITEMS and found.devices == 1 and found.out_n == 8 * INLINE_ITEMS
