"""Hot groups, ties, rows without ids, and independent versions of operators."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgergraph.llm import chat, decontaminate, language, line_dedup, mixing, near_dedup, pii, quality_model, quality_rules, token_output
from ledgergraph.llm.queries import tokenizer_path
from tests.oracle import connect

SF = "/root/testdata/sf0.001"


def test_a_chain_of_half_similar_pages_is_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 32)
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**9)}" for _ in range(40 * 303)]
    texts = [" ".join(words[i * 40 : i * 40 + 120]) for i in range(300)]
    texts += [t + " end" for t in texts[100:140]]  # links inside the chain
    compared = []
    monkeypatch.setattr(near_dedup, "_confirm", lambda *a, old=near_dedup._confirm: compared.append(a) or old(*a))
    found = near_dedup.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), shingle=3, percent=85)
    assert compared and {r.doc_id: r.component_id for r in found.collect()} == {i: i - 200 if i >= 300 else i for i in range(340)}


def test_large_clumps_split_like_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 4)
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(60)]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(7)):
                own[rng.randrange(60)] = f"v{rng.randrange(300)}"
            texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    found = near_dedup.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), shingle=3, percent=85)
    assert [r.component_id for r in found.orderBy("doc_id").collect()] == root


def test_rows_without_ids_go_with_their_copies(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (1, "A b c d e f g"), (None, "x y z w v"), (None, "X y z w v"), (None, None), (None, " "), (2, None), (3, "other words stand here now")]
    kept = near_dedup.keep_one(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in kept) == [("1", "a b c d e f g"), ("2", ""), ("3", "other words stand here now"), ("None", ""), ("None", " "), ("None", "x y z w v")]


def exact_grams(text):
    data = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in (text or "").lower())
    data = re.sub(rb"[^a-z\x80-\xff]", b" ", f"  {data}  ".encode())
    return [data[i : i + 4] for i in range(len(data) - 3) if data[i : i + 4] != b"    "]


def test_filters_answer_like_sets_of_grams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    taught = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    counts, size = {}, {}
    for r in {(r.doc_id, r.text, r.lang) for r in taught}:
        size[r[2]] = size.get(r[2], 0) + 1
        for g in set(exact_grams(r[1])):
            own = counts.setdefault(r[2], {})
            own[g] = own.get(g, 0) + 1
    most = {x: {g for g, _ in sorted(c.items(), key=lambda p: (-p[1], int.from_bytes(p[0], "little")))[: language.FILTER_GRAMS]} for x, c in counts.items()}
    order = sorted(size, key=lambda x: (-size[x], x))
    found = {r.doc_id: r for r in language.identify(spark, docs).collect()}
    for r in rows:
        grams = exact_grams(r.text)
        shares = {x: sum(g in most[x] for g in grams) / max(1, len(grams)) for x in order}
        best = max(order, key=lambda x: shares[x])
        assert abs(found[r.doc_id].score - shares.get(found[r.doc_id].lang_pred, 0.0)) < 0.02
        ahead = sorted(shares.values())
        if grams and ahead[-1] - ahead[-2] > 0.03:
            assert found[r.doc_id].lang_pred == best


def test_language_sample_is_bounded_for_repeated_keys(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "LanguageFilters", lambda order, members, *a: seen.append((order, members)))
    rows = [(None, f"text number {i} ab", "en") for i in range(300)] + [(7, "the same text", "de")] * 400
    labelled = spark.createDataFrame(rows, "key bigint, text string, lang string")
    language.fit(spark, labelled, sample_docs=20)
    assert seen[0][0] == ["en", "de"]  # twenty texts against one
    assert len(seen[0][1][1]) == len({g for g in exact_grams("the same text")})


def test_equal_language_scores_go_to_the_larger_then_the_smaller_name():
    codes = np.arange(50, dtype=np.uint32)
    filters = language.LanguageFilters(["b", "a"], [codes, codes], slots=1 << 12)
    assert filters.score(codes, np.array([0, 50])).argmax(axis=1).tolist() == [0]


def dense_co_training(content, meta, y, apart, free_content, free_meta, rounds):
    """The same co-training with plain arrays and one weight per row."""

    def fit(x, labels, weight):
        x, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
        ridge = np.array([1e-3] * (len(w) - 1) + [1e-9])
        for _ in range(60):
            p = quality_model.sigmoid(x @ w)
            step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(w)), x.T @ (weight * (p - labels)) + ridge * w)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        return w

    def weights(known, free, trust=(1.0, 1.0)):
        own, more = np.zeros(len(known)), np.zeros(len(free))
        for c in (0, 1):
            n, m = (known == c).sum(), (free == c).sum()
            each = min(1.0, trust[c] * n / max(m, 1))
            own[known == c], more[free == c] = 0.5 / (n + each * m), each * 0.5 / (n + each * m)
        return np.concatenate([own, more])

    train = ~apart
    views, free = [content, meta], [free_content, free_meta]
    none = np.zeros(0)
    models = [fit(x[train], y[train], weights(y[train], none)) for x in views]
    for _ in range(rounds):
        sure, trust = [], []
        for x, f, w in zip(views, free, models, strict=True):
            slope, offset = quality_model.fit_logistic(quality_model.logits(x[apart], w)[:, None], y[apart], 1e-2)
            z = quality_model.logits(f, w) * slope + offset
            wide = np.floor((z + 32) * 64)  # 4096 classes of logits from -32 to 32
            k = max(1, int(np.ceil(quality_model.SHARE * len(z))))
            low, high = np.sort(wide)[k - 1], np.sort(wide)[-k]
            sure.append(np.where((wide <= low) & (z < 0), 0, np.where((wide >= high) & (z >= 0), 1, -1)))
            trust.append([np.abs(np.tanh(z[sure[-1] == c] / 2)).mean() if (sure[-1] == c).any() else 0.0 for c in (0, 1)])
        new = []
        for v, other in ((0, 1), (1, 0)):
            at = sure[other] >= 0
            labels = sure[other][at]
            new.append(fit(np.vstack([views[v][train], free[v][at]]), np.concatenate([y[train], labels]), weights(y[train], labels, trust[other])))
        models = new
    return models


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_co_training_like_plain_arrays(spark, sf):
    db = connect(f"/root/testdata/sf{sf}")
    docs = db.execute("select doc_id, text, source, lang, n_chars from documents order by doc_id").fetchall()
    truth = dict(db.execute("select doc_id, max(quality) from labels group by 1").fetchall())
    content = quality_model.content_features(pa.array([r[1] for r in docs], pa.string())).astype("<f4").astype(float)
    slots = quality_model.meta_slots(*(pa.array([r[i] for r in docs], t) for i, t in ((2, pa.string()), (3, pa.string()), (4, pa.int64()))))
    meta = quality_model.one_hot(slots)
    known = np.array([r[0] in truth for r in docs])
    y = np.array([float(truth.get(r[0], 0)) for r in docs])[known]
    apart = np.arange(known.sum()) % 4 == 3
    code = (slots[:, 0] * quality_model.META_DIM + slots[:, 1]) * quality_model.META_DIM + slots[:, 2]
    rows = [(bytearray(c.astype("<f4").tobytes()), int(k)) for c, k, own in zip(content, code, known, strict=True) if not own]
    free = quality_model.Unlabelled(spark.createDataFrame(rows, "content binary, code bigint"))
    model = quality_model.co_train(content[known], meta[known], y, apart, free, rounds=2)
    wanted = dense_co_training(content[known], meta[known], y, apart, content[~known], meta[~known], rounds=2)
    for got, want, x in ((model.content, wanted[0], content), (model.meta, wanted[1], meta)):
        a, b = (quality_model.sigmoid(quality_model.logits(x, w)) for w in (got, want))
        assert np.abs(a - b).max() < 0.02
    if sf == "0.01":  # both views teach both classes in every round
        assert len(model.exchanged) == 2 and min(min(n) for n in model.exchanged) > 0


def test_repeated_ids_teach_once(spark, monkeypatch):
    rows = [(i % 40, f"{'good words here' if i % 2 else 'bad ### !!!'} {i}", "s", "en", 9) for i in range(2000)] + [(100 + i, "some text", "s", "en", 9) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    sizes = []
    monkeypatch.setattr(quality_model, "co_train", lambda content, *a, old=quality_model.co_train: sizes.append(len(content)) or old(content, *a))
    assert quality_model.classify_quality(spark, docs, labels).count() == 2050 and sizes == [40]


def test_a_score_at_the_cut_is_kept(spark):
    docs = spark.createDataFrame([(1, "a", "s", "en", 1)], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    found = quality_model.classify_quality(spark, docs, spark.createDataFrame([], "doc_id bigint, quality int")).first()
    assert found.score == 0.5 and found.kept


def test_a_line_at_the_ratio_stays(spark):
    pages = [(i, f"http://h.example/{i}", "<p>edge</p>" * (i < 3) + "<p>over</p>" * (i < 4) + f"<p>own {i}</p>") for i in range(10)]
    found = line_dedup.drop_boilerplate(spark, spark.createDataFrame(pages, "page_id bigint, url string, html string"), ratio=0.3)
    texts = {r.page_id: r.text for r in found.collect()}
    assert texts[0] == "edge\nown 0" and texts[3] == "own 3"


def test_turns_without_conversation_are_alone(spark):
    rows = [(None, 0, "user", "hi")] * 3 + [(None, 1, "bot", "yo"), (4, 0, "user", "hi"), (4, 1, "bot", "x"), (5, 0, "bot", "yo")]
    found = chat.format_chats(spark, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert sorted((str(r.conv_id), r.n_turns, r.copies) for r in found.collect()) == [("4", 2, 1), ("5", 1, 2)]


def test_many_hits_in_one_document(spark):
    item = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, (item + " gap ") * 3000)], "doc_id bigint, text string")
    found = decontaminate.digest(decontaminate.contamination(spark, docs, spark.createDataFrame([(1, item)], "item_id bigint, text string"))).first()
    assert (found.n_words, found.n_hit, found.n_items) == (93_000, 90_000, 1)


PLANTED = [
    ("write to jane.roe@mail.example.org today", "jane.roe@mail.example.org", "email"),
    ("contact bob [at] corp [dot] net please", "bob [at] corp [dot] net", "email"),
    ("send it to amy (at) shop (dot) com now", "amy (at) shop (dot) com", "email"),
    ("the host 10.20.30.40 was down", "10.20.30.40", "ip"),
    ("seen from 172[.]16[.]0[.]9 twice", "172[.]16[.]0[.]9", "ip"),
    ("paid with 4111 1111 1111 1111 yesterday", "4111 1111 1111 1111", "card"),
    ("paid with 5500.0000.0000.0004 yesterday", "5500.0000.0000.0004", "card"),
    ("call (415) 555-0134 after lunch", "(415) 555-0134", "phone"),
    ("call 415-555-0134 after lunch", "415-555-0134", "phone"),
    ("ring +44 20 7946 0958 tonight", "+44 20 7946 0958", "phone"),
    ("ring 212.555.0187 tonight", "212.555.0187", "phone"),
]
CLEAN = [
    "version 1.2.3 was out on 2021-03-14", "the sum is 12,345.67 for 89 units", "read pages 100-120 and 300-410", "order 12345 of 1999",
    "open at 10:30 and close at 18:45", "pi is 3.14159 and e is 2.71828", "a ratio of 16:9 on 1920x1080", "see section 4.2 of part 7",
]


def test_field_on_independently_planted_spans():
    field = pii.trained()
    found = right = 0
    for text, span, kind in PLANTED:
        start = text.index(span)
        spans = pii.find_spans(text, field)[1]
        found += len(spans)
        right += (start, start + len(span), kind) in spans
    assert right >= len(PLANTED) - 2 and right / found >= 0.8
    assert sum(len(pii.find_spans(t, field)[1]) for t in CLEAN) <= 1


def test_long_numeric_text_takes_linear_time_and_little_memory():
    import time
    import tracemalloc

    field, took = pii.trained(), []
    for n in (4000, 16_000):
        text = "123 456 78 " * n
        began = time.perf_counter()
        spans = pii.find_spans(text, field)[1]
        took.append(time.perf_counter() - began)
        assert all(a < b <= c for (a, b, _), (c, _, _) in itertools.pairwise(spans))
    assert took[1] < 8 * took[0]
    tracemalloc.start()
    pii.find_spans("123 456 78 " * 4000, field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def judged(rows, labels, spark, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return quality_rules.quality_verdicts(spark, docs, spark.createDataFrame(labels, "doc_id bigint, quality int"), **options).collect()


def test_strata_accept_and_refuse_cutoffs_apart(spark):
    def text(i, junk):
        return " ".join(f"word{i}x{j}" for j in range(40)) + "".join(f" ##{j}" for j in range(80 if junk else 0))

    rows, labels = [], []
    for s, (n, dirty) in enumerate((("many", False), ("more", False), ("noisy", True), ("few", False))):
        size = 100 if n == "few" else 2500
        for i in range(size):
            junk = i % 10 == 0 or (dirty and i % 3 == 0)  # in the noisy stratum many good ones have symbols
            rows.append((s * 10_000 + i, text(i, junk), n))
            labels.append((s * 10_000 + i, int(not junk or (dirty and i % 10 != 0))))
    held_out = {d for d, _ in labels if d % 4 == 0}
    found = {r.doc_id: r for r in judged(rows, [x for x in labels if x[0] not in held_out], spark)}
    good = {d for d, q in labels if q}
    for s, n in enumerate(("many", "more", "noisy", "few")):
        own = [d for d in held_out if d // 10_000 == s]
        lost = [d for d in own if d in good and not found[d].kept]
        caught = [d for d in own if d not in good and not found[d].kept]
        assert len(lost) <= 0.05 * len([d for d in own if d in good])
        assert bool(caught) == (n in ("many", "more"))  # too many good ones at risk, or too few labels


def test_a_signal_at_its_cutoff_is_not_rejected(spark):
    base = "abcd " * 19
    rows = [(i, base + f"efgh{i:04d}"[:4], "en") for i in range(3000)]
    rows += [(9000, " ".join(["#a1b"] * 2 + [f"w{i:03d}" for i in range(98)]), "en"), (9001, " ".join(["#a1b"] * 3 + [f"w{i:03d}" for i in range(97)]), "en")]
    rows = [(i, " ".join(f"w{i}{j:02d}" for j in range(30)), "en") if i < 3000 else (i, t, s) for i, t, s in rows]
    found = {r.doc_id: r for r in judged(rows, [(i, 1) for i in range(3000)], spark)}
    assert (found[9000].n_symbols, found[9000].n_words) == (2, 100)  # exactly 0.02
    assert found[9000].kept and not found[9001].kept


def test_repeated_and_missing_ids_in_tokens(spark):
    rows = [(5, f"text {i} here") for i in range(300)] + [(None, f"other {i}") for i in range(300)] + [(1, "one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = token_output.token_output(spark, docs, tokenizer_path()).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None] * 300 + [1] + [5] * 300
    assert all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(found)) and found[0].start == 0


def test_tokens_in_a_given_order(spark):
    docs = spark.createDataFrame([(i, f"text {i}", -i) for i in range(100)], "doc_id bigint, text string, place int")
    found = token_output.token_output(spark, docs, tokenizer_path(), order=[F.col("place")]).orderBy("start").collect()
    assert [r.doc_id for r in found] == list(range(99, -1, -1))


def test_cache_starts_anew_by_characters(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE_CHARS", 50)
    enc = token_output.Encoder(tokenizer_path())
    texts = [" ".join(f"chunk{i}x{j}" for j in range(9)) for i in range(30)]
    for t in texts:
        got = [ids.tolist() for _, ids, _ in enc.encode(pa.array([t]))][0]
        assert got == enc.tokenizer.encode(t, add_special_tokens=False).ids
    assert enc.chars < 500


def test_equal_and_missing_ids_in_the_mix(spark):
    rows = [(7, f"w {'x ' * (i % 5)}y{i}", "a") for i in range(200)] + [(None, f"z{i} z", "b") for i in range(200)] + [(3, "same row", "c")] * 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix(spark, docs).collect()
    assert len(found) == 450
    for source in ({r.source_size for r in found}):
        own = [r for r in found if r.source_size == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    taken = mixing.take(spark, docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in found)
    again = mixing.take(spark, docs.repartition(5)).groupBy("doc_id", "text", "source").count()
    assert taken.groupBy("doc_id", "text", "source").count().exceptAll(again).count() == 0


def test_pipeline_tokens_lie_in_training_order(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.source_mixing(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    found = corpus_pipeline.token_ids(spark, mixed, SF).orderBy("start").collect()
    first = {r.doc_id: r.first_position for r in mixing.mix(spark, docs).collect()}
    seen = list(dict.fromkeys(r.doc_id for r in found))
    assert len(found) == mixed.count() and seen == sorted(seen, key=lambda d: first[d])
    assert seen != sorted(seen)


@pytest.mark.parametrize("stage", ["language_id", "near_dedup", "decontamination"])
def test_stages_keep_clean_documents(spark, stage):
    import corpus_pipeline

    rng = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = docs.where("lang = 'en'").orderBy("doc_id").first().text.split()
    rows = [(10**6 + i, " ".join(rng.choices(words, k=80)), "en", "web", 9) for i in range(20)]
    more = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = dict(corpus_pipeline.STAGES)[stage](spark, docs.unionByName(more), SF)
    assert {r[0] for r in rows} <= {r.doc_id for r in kept.select("doc_id").collect()}
