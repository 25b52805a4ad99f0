"""Near duplicates where ids repeat, with the same text and with others."""

import itertools
import random
import re

import pytest

from ledgergraph.llm import near_dedup

NAMES = ["_gone", "_mark", "_first", "row", "mark", "id", "goes", "every", "some", "node", "rep", "fp", "component", "kept"]


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain(rows, percent=85):
    """``component, kept`` of each row, each by its own text."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        component = (min(ids) if ids else None) if sets[i] else doc_id
        out.append((component, not sets[i] or doc_id == component))
    return out


def repeated(seed):
    rng = random.Random(seed)
    rows = [(1, "a b c d"), (5, "a b c d"), (5, "x y z w"), (5, "X y z w"), (6, ""), (6, "a b c d"), (6, None), (3, "x y z w v u t s r q")]
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(60)]
        for _ in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(60)] = f"v{rng.randrange(400)}"
            rows.append((rng.choice([rng.randrange(30), rng.randrange(1000), rng.randrange(1000)]), " ".join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 4)])
def test_rows_are_judged_by_their_own_text(spark, monkeypatch, seed, block):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    rows = repeated(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", *[f"'x' as {c}" for c in NAMES])
    wanted = sorted((i, len(shingles(t)), *v) for (i, t), v in zip(rows, plain(rows), strict=True))
    assert sorted(map(tuple, near_dedup.near_duplicates(spark, docs, shingle=3, percent=85).collect())) == wanted
    stay = near_dedup.keep_one(spark, docs, shingle=3, percent=85)
    assert stay.columns == docs.columns
    kept = [r for r, v in zip(rows, plain(rows), strict=True) if v[1]]
    assert sorted(((r.doc_id, r.text) for r in stay.collect()), key=str) == sorted(kept, key=str)
    # no text is lost whose set nothing else is linked with
    assert {t for i, t in rows if t == "x y z w"} <= {t for _, t in kept}


def test_plain_ids_need_no_second_key(spark, monkeypatch):
    rows = [(i, f"{i % 3} b c d e f g h") for i in range(9)] + [(None, "n o p"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", *[f"'x' as {c}" for c in NAMES])
    kept = near_dedup.keep_one(spark, docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["0", "1", "2", "None", "None"]
