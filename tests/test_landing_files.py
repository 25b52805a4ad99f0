"""The staged landing files are of bounded size, whatever the ledger's."""

from ledgergraph.sources import landing

SF = "/root/testdata/sf0.001"


def test_files_grow_in_number_not_in_size(spark, monkeypatch):
    asked = []
    run = landing.Landing.run

    def noted(self, files=1, before=None):
        lines = [spark.read.option("header", True).csv(f).count() for f in spark.read.text(self.source).inputFiles()]
        asked.append((files, len(lines), max(lines)))
        return run(self, files, before)

    monkeypatch.setattr(landing.Landing, "run", noted)
    monkeypatch.setattr(landing, "FILE_LINES", 500)
    whole = landing.src_landing_resume(spark, SF)
    files, number, most = asked[0]
    assert asked[0] == asked[1] and number == 3 * files > 3 and most < 600
    monkeypatch.setattr(landing, "FILE_LINES", 10_000)
    assert whole.exceptAll(landing.src_landing_resume(spark, SF)).isEmpty() and asked[2][:2] == (1, 3)
