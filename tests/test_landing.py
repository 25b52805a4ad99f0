"""A landing load that is killed and goes on."""

import pytest

from ledgergraph.sources.landing import Landing

HEADER = "Account,Account.1,Amount Paid,Payment Currency,Payment Format,Is Laundering,Timestamp\n"


def test_a_stopped_load_goes_on_and_signs_last(spark, tmp_path):
    source = tmp_path / "csv"
    source.mkdir()
    for i in range(3):
        (source / f"part-{i}.csv").write_text(HEADER + f"{i},1,2.5,Yen,Wire,0,2025-01-0{i + 1}\n{i},2,oops,Yen,Wire,0,2025-01-01\n{i},3,,,Wire,,\n")
    load = Landing(spark, str(source), f"file://{tmp_path}/table")
    tried = []

    def stop(number):
        tried.append(number)
        if number == 1 and tried.count(1) == 1:
            raise InterruptedError("power cut")

    with pytest.raises(Exception, match="power cut"):
        load.run(before=stop)
    assert load.signature() is None
    with pytest.raises(RuntimeError, match="no complete load"):
        load.rows()
    found = load.run(before=stop)
    assert tried == [0, 1, 1, 2]  # the first file is not read again
    assert (found["rows"], found["rejects"]) == (6, 3) and load.signature() == found
    assert sorted(r.line for r in load.rejects().collect()) == [f"{i},2,oops,Yen,Wire,0,2025-01-01" for i in range(3)]
    rows = {(r.from_account, r.to_account, r.amount, r.currency) for r in load.rows().collect()}
    assert rows == {(i, *x) for i in range(3) for x in ((1, 2.5, "Yen"), (3, None, None))}
    # a file that arrives later is loaded alone, and signed anew
    (source / "part-9.csv").write_text(HEADER + "9,1,7.0,Yen,Wire,1,2025-02-01\n")
    assert load.run(before=stop)["rows"] == 7 and tried == [0, 1, 1, 2, 3]
    with pytest.raises(RuntimeError, match="no complete load"):
        Landing(spark, str(source), f"file://{tmp_path}/table", "from_account bigint, other string").rows()
