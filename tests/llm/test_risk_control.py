"""Fixed-sequence thresholds: the chain, what holds on the test tables, and the guarantee."""

import random

from pyspark.sql import functions as F

from ledgergraph.functions.workspace import Workspace
from ledgergraph.llm import quality_rules as Q

SF = "/root/testdata/sf0.01"


def test_the_chain_tightens_one_rule_at_a_time():
    steps = Q.chain()
    assert len(steps) == sum(map(len, Q.CUTOFFS.values())) and [r for r, _ in steps[:5]] == list(Q.CUTOFFS)
    for rule, values in Q.CUTOFFS.items():
        assert [c for r, c in steps if r == rule] == sorted(values, reverse=True)
    assert Q.chain({"symbols": (0.1, 0.2), "repeats": (0.3,)}) == [("symbols", 0.2), ("repeats", 0.3), ("symbols", 0.1)]


def test_some_cutoffs_hold_and_some_do_not_at_a_hundredth(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    work = Workspace(spark, "risk-test")
    tested = Q.thresholds(work.cut(Q.counts(docs), "counts"), labels, work).collect()
    assert {r.holds for r in tested} == {True, False}
    for stratum in {r.stratum for r in tested}:
        own = sorted((r.step, r.k, r.tail, r.holds) for r in tested if r.stratum == stratum)
        assert all(a[1] <= b[1] and a[2] <= b[2] and a[3] >= b[3] for a, b in zip(own, own[1:]))


def test_the_risk_is_controlled(spark):
    """Three hundred strata, each a draw of labelled documents from one population, each
    tested at a tenth: hardly more than a tenth of them may exceed the risk."""
    rng, strata, n = random.Random(6), 300, 150
    # the share of good documents that symbols reject at its cutoffs, from loose to strict
    shares = {1.0: 0.01, 0.5: 0.02, 0.3: 0.045, 0.2: 0.055, 0.1: 0.08, 0.05: 0.3, 0.02: 0.6}
    rows = []
    for s in range(strata):
        for i in range(n):
            u = rng.random()
            over = [c for c, p in shares.items() if u < p]
            n_symbols = int(1000 * max(over)) + 5 if over else 0
            rows.append((s * n + i, f"s{s}", 1000, 5000, n_symbols, 0, 0, 10, 0, False))
    counted = spark.createDataFrame(rows, "doc_id bigint, stratum string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_capitals bigint, base_failed boolean")
    labels = counted.select("doc_id", F.lit(1).alias("quality"))
    cutoffs = {"symbols": Q.CUTOFFS["symbols"]}
    found = Q.thresholds(counted, labels, Workspace(spark, "risk-test"), cutoffs, risk=0.05, delta=0.1 * strata)
    last = {r.stratum: r.last for r in found.where("holds").groupBy("stratum").agg(F.max("step").alias("last")).collect()}
    by_step = [shares[c] for _, c in Q.chain(cutoffs)]
    exceeded = sum(by_step[t] > 0.05 for t in last.values())
    assert len(last) > strata / 2  # it decides often
    assert exceeded <= 0.1 * strata + 3 * (strata * 0.09) ** 0.5
