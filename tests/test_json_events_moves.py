"""What the keyed log writes and moves: no text twice, no column that is not asked for."""

import glob

from ledgergraph.functions.workspace import CODEC, Workspace
from ledgergraph.streaming import keyed_log


def test_only_asked_columns_are_claimed_and_texts_are_written_once(spark, monkeypatch):
    seen, names = [], []
    claimed, cut = keyed_log.claimed, Workspace.cut
    monkeypatch.setattr(keyed_log, "claimed", lambda events: seen.append(events.columns) or claimed(events))
    monkeypatch.setattr(Workspace, "cut", lambda self, df, name, *a: names.append((name, df.columns)) or cut(self, df, name, *a))
    found = keyed_log.stream_json_events(spark, "/root/testdata/sf0.001")
    assert not {"payment_format", "institution_id"} & set(seen[0]) and "ts" in seen[0]
    assert [name for name, columns in names if "value" in columns] == []
    assert found.count() == found.select("tx_id").distinct().count()


def test_written_tables_are_packed(spark):
    work = Workspace(spark, "packed")
    work.cut(spark.range(10), "x", CODEC)
    assert glob.glob(f"{work.path.removeprefix('file://')}/x/*.zstd.parquet")
