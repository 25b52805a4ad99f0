"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import pytest

from ledgergraph.llm import chat, decontaminate, language, line_dedup, mixing, near_dedup, pii, quality_model, quality_rules, token_output
from ledgergraph.llm.queries import tokenizer_path

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog near the river bank while it rains all day long in town"
ROWS = [
    (1, BASE, "en", "a", 99),
    (1, BASE, "en", "a", 99),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (4, " \t\n", "en", "b", 3),
    (5, LONG, "de", "b", len(LONG)),
    (None, BASE, "en", "a", 99),
    (6, "123 !!! 456", "de", "c", 11),
    (7, "é", "fr", "c", 1),
]
EXTRA = ["key", "row", "h", "size", "target", "score", "kept", "n_words", "hit", "items", "position", "copies", "stratum", "label", "fp", "rep", "bucket", "text_"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return plain.selectExpr("*", *[f"'x' as {c}" for c in EXTRA])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, BASE), (2, None), (3, ""), (4, "quick brown"), (None, "lazy dog"), (1, BASE)], "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")


def operators(items, labels):
    return {
        "quality": lambda s, d: quality_model.classify_quality(s, d, labels),
        "language": lambda s, d: language.identify(s, d),
        "near": lambda s, d: near_dedup.near_duplicates(s, d, shingle=3, percent=85),
        "leaks": lambda s, d: decontaminate.digest(decontaminate.contamination(s, d, items)),
        "private": lambda s, d: pii.personal_data(s, d),
        "rules": lambda s, d: quality_rules.quality_verdicts(s, d, labels),
        "tokens": lambda s, d: token_output.token_output(s, d, tokenizer_path()),
        "mix": lambda s, d: mixing.mix(s, d),
    }


NAMES = sorted(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_every_row(spark, docs, items, labels, name):
    found = operators(items, labels)[name](spark, docs).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)
    one = [r for r in found if r["doc_id"] == 1]
    drop = {"start", "copies", "taken", "first_position"}  # repeated rows are written and taken one after another
    assert len({tuple(v for k, v in r.asDict().items() if k not in drop) for r in one}) == 1


@pytest.mark.parametrize("name", NAMES)
def test_an_empty_table_gives_no_rows(spark, docs, items, labels, name):
    assert operators(items, labels)[name](spark, docs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["quality", "leaks", "rules"])
def test_empty_side_tables(spark, docs, items, labels, name):
    found = operators(items.where("false"), labels.where("false"))[name](spark, docs).collect()
    assert len(found) == len(ROWS)
    if name == "quality":
        assert {r.score for r in found} == {0.5}
    if name == "leaks":
        assert not any(r.contaminated for r in found)
    if name == "rules":
        assert all(r.kept != r.base_failed for r in found)


@pytest.mark.parametrize(
    "stage",
    [
        lambda s, d, i: language.keep_identified(s, d),
        lambda s, d, i: near_dedup.keep_one(s, d),
        lambda s, d, i: decontaminate.remove_contaminated(s, d, i),
        lambda s, d, i: mixing.take(s, d),
    ],
    ids=["language", "near", "leaks", "mix"],
)
def test_stages_return_the_columns_they_got(spark, docs, items, stage):
    found = stage(spark, docs, items)
    assert found.columns == docs.columns
    assert {tuple(r) for r in found.collect()} <= {tuple(r) for r in docs.collect()}
    assert stage(spark, docs.where("false"), items).count() == 0


def test_defined_results(spark, docs, items):
    lang = {r.doc_id: r for r in language.identify(spark, docs).collect()}
    assert (lang[2].lang_pred, lang[2].score) == ("und", 0.0) and lang[6].lang_pred == "und" and lang[4].lang_pred == "und"
    assert lang[7].lang_pred in {"en", "de", "fr"}
    near = {r.doc_id: r for r in near_dedup.near_duplicates(spark, docs, shingle=3, percent=85).collect()}
    assert [near[i].n_shingles for i in (2, 3, 4)] == [0, 0, 0] and near[4].kept and near[7].n_shingles == 1
    assert near[None].component_id == 1 and not near[None].kept
    leaks = {r.doc_id: r for r in decontaminate.digest(decontaminate.contamination(spark, docs, items)).collect()}
    assert (leaks[1].n_hit, leaks[1].n_items, leaks[1].n_words) == (21, 2, 21) and leaks[2].n_words == 0
    tokens = {r.doc_id: r.n_tokens for r in token_output.token_output(spark, docs, tokenizer_path()).collect()}
    assert tokens[2] == tokens[3] == tokens[4] == 1


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "bot", "yo"),
    (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (2, 2, "user", "bye"),
    (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "bye"),
    (4, 0, None, None), (5, 0, "", ""), (6, 0, "user", "h"), (6, 0, "user", "h"),
    (None, 0, "user", "alone"), (7, 0, "user", LONG),
]


def test_chats(spark):
    turns = spark.createDataFrame(CHATS, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' as rendered", "'y' as whole")
    found = {r.conv_id: r for r in chat.format_chats(spark, turns).collect()}
    assert set(found) == {2, 4, 5, 6, None, 7}
    assert found[2].copies == 2 and found[2].n_turns == 3 and found[6].n_turns == 2
    assert found[2].rendered.startswith("<|im_start|>user\nhi<|im_end|>\n")
    assert chat.format_chats(spark, turns.where("false")).count() == 0


PAGES = [
    (i, f"http://A.example.com/{i}", f"<p>menu</p><p>own {i}</p><script>x</script><div>menu</div>") for i in range(4)
] + [(9, None, None), (10, "no url", ""), (11, "http://b.example.com", "<p>menu</p>" + "<p>z</p>" * 20_000)]


def test_lines(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'x' as host", "'y' as lines")
    found = {r.page_id: r for r in line_dedup.drop_boilerplate(spark, pages).collect()}
    assert (found[0].host, found[0].n_lines, found[0].n_dropped, found[0].text) == ("a.example.com", 3, 2, "own 0")
    assert (found[9].host, found[9].n_lines, found[9].text) == ("", 0, "")
    assert found[11].n_lines == 20_001 and found[11].n_dropped == 0
    assert line_dedup.drop_boilerplate(spark, pages.where("false")).count() == 0
