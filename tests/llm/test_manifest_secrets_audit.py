"""The Merkle manifest, the secret scan and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgergraph.llm import filter_audit, merkle, secrets

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ["grp", "leaf", "id", "other", "key", "part", "fp", "A", "E", "good", "state", "least", "labelled", "path", "run"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha(*map(plain_field, (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves):
    """Root, and each leaf's runs on the way."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, i in enumerate(at):
            paths[k].append((runs[i // 8], i % 8))
        at, nodes = [i // 8 for i in at], [sha(*r) for r in runs]
    return nodes[0], paths


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, plain_leaf(row, row[1]), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: x[:3]), *plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])])) for g in order}
    root, tops = plain_tree([trees[g][1] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        own, subroot, paths = trees[g]
        for (_, _, leaf, row), path in zip(own, paths, strict=True):
            shown, path = leaf, path + top
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                shown = plain_leaf(row, re.sub("[A-Z]", lambda m: m[0].lower(), row[1]))
            proof = sha(*[h for run, pos in path for h in run[:pos] + run[pos + 1 :]])
            for run, pos in path:
                shown = sha(*run[:pos], shown, *run[pos + 1 :])
            out.append((row[0], leaf, subroot, root, proof, shown, shown == root))
    return sorted(out, key=str)


def made_rows(sizes, seed=1):
    rng, rows = random.Random(seed), []
    for lang, n in sizes.items():
        for _ in range(n):
            i = rng.randrange(10**6)
            rows.append((i, rng.choice([None, "", f"Text É {i}", "plain", "UP"]), lang, rng.choice([None, "a", "é"]), rng.choice([None, i])))
    rows += [(None, "no id", None, "a", 1), (None, "No id", "en", None, 2), rows[0], rows[0]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"en": 700, "de": 1, None: 3, "": 9, "zh": 64, "é": 65}, {"en": 1}, {f"g{i}": 2 for i in range(70)}, {"a": 2, "b": 600, "c": 2}])
@pytest.mark.parametrize("few", [0, 1 << 13])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, sizes, few):
    monkeypatch.setattr(merkle, "FEW_LEAVES", few)  # ragged ends, or one partition
    rows = made_rows(sizes)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *[f"'x' as {c}" for c in EXTRA])
    found = merkle.tampering_audit(spark, docs).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_manifest(rows)


def test_a_hot_group_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FEW_LEAVES", 0)
    monkeypatch.setattr(merkle, "PARTITION_LEAVES", 37)  # no partition holds an aligned run of 64
    rows = made_rows({"en": 1500, "fr": 40}, seed=4)
    found = merkle.tampering_audit(spark, spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_manifest(rows)


def test_paths_fold_to_the_root_and_the_manifest_has_it(spark):
    rows = made_rows({"en": 100, "de": 20})
    docs = spark.createDataFrame(rows, DOCS)
    found = merkle.prove(spark, docs, merkle.DOCUMENT_FIELDS).collect()
    groups = {r.lang: r for r in merkle.manifest(spark, docs, merkle.DOCUMENT_FIELDS).collect()}
    assert {g: r.n for g, r in groups.items()} == {g: sum(r[2] == g for r in rows) for g in ("en", "de", None)}
    roots = {r.root for r in groups.values()}
    assert len(roots) == 1 and all(r.verified for r in found)
    for r in found:
        assert merkle.fold(r.leaf, [(list(s.run), s.pos) for s in r.path]) == r.root in roots
        assert merkle.fold("0" * 64, [(list(s.run), s.pos) for s in r.path]) != r.root


def test_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert merkle.tampering_audit(spark, none).count() == 0
    assert secrets.secret_scan(spark, none).count() == 0
    assert filter_audit.filter_audit(spark, none, labels).count() == 0


# -- secrets ---------------------------------------------------------------------------

SECRET_TEXTS = st.lists(
    st.sampled_from(["password", "PassWD", "token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "AKIA", "AKIAABCDEFGH", "0123456789abcdef", "a" * 32, "deadbeef", "é", "ſecret", "toKen", "\n", "A", "9", "+/_.=-", "X" * 8]),
    max_size=14,
).map("".join)


def plain_secrets(text):
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(a, b, secrets.KINDS[k]) for a, k, b in sorted(out)]


@given(SECRET_TEXTS)
@settings(max_examples=400, deadline=None)
def test_base_secrets_are_the_patterns(text):
    base, every = secrets.find_secrets(text.encode())
    assert base == plain_secrets(text)
    assert set(base) <= set(every) and every == sorted(every, key=lambda s: (s[0], secrets.KINDS.index(s[2]), s[1]))


V = "q8W!e7R$t6"
FOUND = [
    ('password = "hunter2!x"', ["hunter2!x"]), ("pwd = 'swordfish'", ["swordfish"]), ("db_pw: s3cr3tP@ss!", ["s3cr3tP@ss!"]),
    ("export DB_PASSWORD=Tr0ub4dor&3", ["Tr0ub4dor&3"]), ('{"a": 1, "clientSecret": "a8F$kq92lmZ!"}', ["a8F$kq92lmZ!"]),
    (f"<conf><password>{V}</password></conf>", [V]), (f'<add key="dbPassword" value="{V}"/>', [V]), (f'define("DB_PASSWORD", "{V}")', [V]),
    (f'conn.setPassword("{V}")', [V]), ("mysql --password q8Wxe7R9t6 -u root", ["q8Wxe7R9t6"]), ("postgres://bob:q8Wxe7R9t6@host/db", ["q8Wxe7R9t6"]),
    ("Authorization: Bearer eyJhbGciOi.J9.abcd", ["eyJhbGciOi.J9.abcd"]), (f'const apiKey: string = "{V}";', [V]), (f'cfg["private_key"] = "{V}"', [V]),
    (f'pw = os.getenv("DB_PASS", "{V}")', [V]), (f"'passphrase' => '{V}',", [V]), (f'é password: "é{V}"', [f"é{V}"]), ('pass_ = """abc123def456\nxx"""', ["abc123def456\nxx"]),
]
PROPAGATED = [
    (f'x = "{V}"\ny = x\nself.password = y', [V]), ('A = "ghp_aB3dE5"\nB = "fG7hJ9kL1mN3"\nauth.pass = A + B', ["ghp_aB3dE5", "fG7hJ9kL1mN3"]),
    (f'P="{V}"\nurl = "x"\npwd: ${{P}}', [V]), (f'pwd = LATER\nLATER = "{V}"', [V]), (f'k = "{V}"\npwd = f"pre-{{k}}"', [V, "pre-"]),
    (f'k = "changeme"\npwd = k\nk = "{V}"', []), ("a = b\nb = a\npwd = a", []), (f'm = "{V}"\ncount = m', []),
]
CLEAN = [
    'password = "changeme"', "token_count = 12345678", "max_tokens: 1234567890", "Password: required for login", "the secret: nobody knows it", f'public_key = "{V}"',
    'password_hint = "my first dog 1"', 'apikey: "<your key>"', "pw = ${DB_PASSWORD}", "pwd = getToken()", "password = None", "The key: Paris1999", "time 12:30:45 and 3 = 4",
    'sort_key = "created_at_1234"', "passed: 12345678 tests", 'secret_name: "prod/db/pass1"', "x = y = z", f'name = "{V}"', "http://a.b/c:d@e", 'path_to_key = "/etc/ssl/x1.pem"',
]


@pytest.mark.parametrize(("text", "wanted"), FOUND + PROPAGATED + [(x, []) for x in CLEAN])
def test_literals_of_sensitive_names(text, wanted):
    base, every = secrets.find_secrets(text.encode())
    added = [text[a:b] for a, b, _ in every if (a, b) not in {s[:2] for s in base}]
    assert sorted(added) == sorted(wanted)


def test_planted_assignments_in_prose(spark):
    """Recall and precision of what is added, over prose with planted assignments."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(200).collect()
    rng = random.Random(2)
    kinds = FOUND + PROPAGATED[:5]
    hit = wanted_n = extra = 0
    for r in docs:
        text, wanted = rng.choice(kinds)
        cut = r.text.find(" ", rng.randrange(len(r.text)))
        cut = len(r.text) if cut < 0 else cut
        whole = f"{r.text[:cut]}\n{text}\n{r.text[cut:]}"
        base, every = secrets.find_secrets(whole.encode())
        added = [whole[a:b] for a, b, _ in every if (a, b) not in {s[:2] for s in base}]
        hit += len(set(added) & set(wanted))
        extra += len(set(added) - set(wanted))
        wanted_n += len(wanted)
    assert hit >= 0.97 * wanted_n and extra <= 0.02 * wanted_n


def test_redacting_and_hostile_texts():
    assert secrets.redact(f'a password = "{V}" z') == 'a password = "<assign>" z'
    for text in ('x="' * 20_000, "a" * 200_000, "key=" * 30_000, "'''" * 9_999, "<a>" * 30_000, "://:" * 30_000, "token:" * 20_000, "\\" * 100_000 + '="', "pwd=" + "9f" * 100_000):
        secrets.find_secrets(text.encode())


def test_secret_rows(spark):
    rows = [(1, 'token = "abcdefgh12"', "x"), (1, 'token = "abcdefgh12"', "x"), (None, None, "x"), (2, "", "x"), (3, "é " + "0" * 40, "x"), (4, "word " * 200_000 + "AKIA0123456789AB", "x")]
    found = secrets.secret_scan(spark, spark.createDataFrame(rows, "doc_id bigint, text string, spans string")).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 6 and by[None].spans == "" and by[None].base_sha256 == sha() and by[2].n_hex == 0
    assert (by[1].n_assign, by[1].spans, by[1].base_sha256) == (1, "assign:0:19", sha("assign:0:19"))
    assert by[3].spans == "hex:2:42" and by[4].n_access == 1


# -- filter audit ----------------------------------------------------------------------


def plain_audit(rows, labels):
    ids = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            ids[text or ""] = min(doc_id, ids.get(text or "", doc_id))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    judged = []
    for doc_id, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and ids[t] < doc_id,
        }
        judged.append((source or "", {f for f in fails if fails[f]}, doc_id is not None and doc_id in good, doc_id is not None and doc_id in toxic))
    out = []
    for part in {j[0] for j in judged}:
        own, shapley, rows_ = [j for j in judged if j[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone, stay = [j for j in left if f in j[1]], [j for j in left if f not in j[1]]
                shapley[f] += len(gone)
                rows_.append((part, "".join(order), k, len(stay), len(gone), sum(f in j[1] for j in own) - len(gone), sum(j[1] == {f} for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone), f))
                left = stay
        out += [(*r[:-1], shapley[r[-1]]) for r in rows_]
    return sorted(out)


def audit_rows(n=150):
    rng = random.Random(3)
    rows = [(None, None, None), (None, None, "s0"), (7, "same text", "s1"), (7, "same text", "s1"), (9, "same text", None), (3, None, ""), (4, "", "s0"), (5, "é" * 5000, "s2")]
    for i in range(10, 10 + n):
        w = [rng.choice(["Word", "word", f"w{rng.randrange(500)}", "ÉCOLE", "UPPER"]) for _ in range(rng.choice([3, 49, 50, 80]))]
        rows.append((i, rng.choice([" ", "\t", "\n"]).join(w) + rng.choice(["", "", " #", " &|"]), rng.choice(["s0", "s0", "s1"])))
    rows += [(500 + i, rng.choice(rows)[1], "s1") for i in range(40)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 400, 2)] + [(10, 1, 0), (10, 0, 1), (None, 1, 1)]
    return rows, labels


def test_audit_equals_applying_every_order(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", *[f"'x' as {c}" for c in EXTRA])
    found = filter_audit.filter_audit(spark, docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert sorted(tuple(r) for r in found) == plain_audit(rows, labels)


def test_every_state_is_counted_once_and_no_survivors_stay(spark, monkeypatch):
    counted, held = [], []
    walk = filter_audit._Walk
    monkeypatch.setattr(walk, "_count", lambda self, state, s, rest, old=walk._count: (counted.append(state), held.append(s), old(self, state, s, rest))[-1])
    rows, labels = audit_rows(20)
    judged = filter_audit.judge(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    filter_audit.audit(spark, judged).count()
    assert len(counted) == len(set(counted)) == 31
    assert not any(s.storageLevel.useMemory for s in held)


def test_audit_of_two_filters(spark):
    judged = spark.createDataFrame([("p", True, True, True, False), ("p", False, True, False, True), ("q", False, False, False, False)], "part string, x boolean, y boolean, good boolean, toxic boolean")
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(spark, judged, "xy").collect()}
    assert len(found) == 8
    assert found["p", "xy", 1] == (1, 1, 0, 0, 1, 0, 1) and found["p", "xy", 2] == (0, 1, 1, 1, 0, 1, 3)
    assert found["p", "yx", 1] == (0, 2, 0, 1, 1, 1, 3) and found["q", "yx", 2] == (1, 0, 0, 0, 0, 0, 0)
