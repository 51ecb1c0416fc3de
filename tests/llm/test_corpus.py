"""The corpus operators against brute force, on small fixtures that hold nulls, empty and very long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tallyloom.llm")
from tallyloom.llm import ann, decontam, neardup, ordinal, packing, pii, queries, secrets, sharding, tokencount, urlrules  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind int, row int, shard int"


def table(spark, texts):
    """Documents with extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1, 2, 3) for i, t in texts], SCHEMA)


def words(n, seed, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    return [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, "Two words"), (8, "two WORDS"), (9, words(20_000, 2)), (10, words(60, 3)), (10, words(60, 3)), (None, "no id"), (11, "x" * 50_000), (12, 'key token = "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432" mail a.b@c.de +1 (212) 555-0199')]


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack(table(spark, texts), path).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 4096 for r in rows)
    want = []
    for i, t in texts:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for n in packing.pieces(len(ids), 4096):
            want.append((str(i), at, n, zlib.crc32(np.asarray(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
        assert at == len(ids)
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == sorted(want)
    assert packing.pack(table(spark, []), path).count() == 0


def test_near_duplicates_brute_force(spark, texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    root = {i: i for i in sets if i is not None}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in combinations(root, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = sorted((str(i), len(sets[i]), str(None if i is None else find(i)), i is None or find(i) == i) for i, _ in texts)
    got = neardup.near_duplicates(table(spark, texts)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == want
    kept = neardup.keep_one(table(spark, texts))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2] and kept.count() == sum(w[3] for w in want)
    assert neardup.near_duplicates(table(spark, [])).count() == 0


def test_large_bucket_of_near_copies(spark):
    """A chain of edits: many members are linked to neighbours only, not to the first."""
    base, rows = words(100, 5).split(), []
    for i in range(150):
        if i % 2:
            base[(i * 7) % 100] = f"edit{i}"
        rows.append((i, " ".join(base)))
    sets = [frozenset(tuple(t.split()[j : j + 5]) for j in range(96)) for _, t in rows]
    root = list(range(150))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in combinations(range(150), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: find(i) for i in range(150)}


def hits(text, items, window=10):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    hit, found = [False] * len(w), set()
    for item, t in items:
        q = re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())
        for j in range(max(1, len(q) - window + 1)) if q else ():
            p = q[j : j + window]
            for s in range(len(w) - len(p) + 1):
                if w[s : s + len(p)] == p:
                    found.add(item)
                    hit[s : s + len(p)] = [True] * len(p)
    return len(w), sum(hit), found


@pytest.mark.parametrize("block", [None, 40])
def test_decontamination_brute_force(spark, texts, block, monkeypatch):
    if block:
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    base = texts[0][1].split()
    items = [(1, " ".join(base[5:30])), (2, "Two, words!"), (30, " ".join(base[50:60])), (4, ""), (5, words(12, 9))]
    bench = spark.createDataFrame([*items, (6, None)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.decontaminate(table(spark, texts), bench).collect())
    want = []
    for i, t in texts:
        n, h, found = hits(t, items)
        want.append((str(i), n, h, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), h > 0))
    assert got == sorted(want)
    if not block:
        left = decontam.remove_passages(table(spark, texts), bench).collect()
        assert all(hits(r.text, items)[1] == 0 and r.n_chars == len(r.text or "") for r in left)
        assert {r.doc_id for r in left} == {i for i, _ in texts} - {7, 8}
        assert decontam.decontaminate(table(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_passages_of_two_blocks_are_cut_once(spark, monkeypatch):
    """Windows of items in different blocks overlap; what is cut does not depend on the blocks, nor do words that meet at a cut."""
    w = words(40, 21, 9_000).split()
    items = [(1, " ".join(w[5:15])), (2, " ".join(w[10:20])), (3, " ".join([*w[0:5], *w[20:25]]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, [(1, " ".join(w)), (2, None), (3, items[0][1]), (4, "clean words")])
    one = {r.doc_id: r for r in decontam.remove_passages(docs, bench).collect()}
    assert one[1].text.split() == [*w[:5], *w[20:]] and set(one) == {1, 2, 4}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1)
    assert {r.doc_id: r for r in decontam.remove_passages(docs, bench).collect()} == one


def test_personal_data_brute_force(spark, texts):
    more = [*texts, (20, "a@b.com_x@y.zz a@b.c.d@e.f 1.2.3.4.5.6.7.8 256.1.1.1"), (21, "4111 1111 1111 1111 é +44 20 7946 0958 1.2.3.4"), (22, "call 555-123-4567")]

    def luhn(d):
        return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0

    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    want = {}
    for i, t in more:
        out = []
        for kind, p in kinds.items():
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                    out.append(f"{kind}:{m.start()}:{m.end()}")
        want[i] = ",".join(out)
    for r in pii.find_personal(table(spark, more)).collect():
        assert r.base_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest() and r.spans.startswith(want[r.doc_id])
        if r.doc_id == 22:
            assert "number:5:17" in r.spans


def test_em_learns_reliable_labelers():
    post = pii.estimate([((1, 1, 0), 50.0), ((-1, -1, 1), 60.0), ((1, 1, -1), 40.0), ((-1, -1, 0), 80.0)])
    assert post[1, 1, 0] > 0.9 > 0.1 > post[-1, -1, 1]


def test_sharding(spark, texts):
    rows = sharding.shard_documents(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    keys = np.arange(20_000, dtype=np.uint64)
    n = np.bincount(sharding.jump_hash(keys, 16))
    assert n.min() > 1_050 and n.max() < 1_450


def test_shard_of_large_id_beside_a_null(spark):
    big = [2**53 + 1, 2**60 + 7, 2**62 + 3]
    docs = table(spark, [(i, "x") for i in [*big, None]]).coalesce(1)
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(docs).collect()}
    keys = np.array([*big, 0], np.uint64)
    assert got == dict(zip([*big, None], zip(sharding.jump_hash(keys, 16).tolist(), sharding.jump_hash(keys, 17).tolist(), strict=True), strict=True))


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/1?q", "https://www.example.com/en/2#t", "http://x.net/fr/", "http://net/es/a", "http://notnet/es/a", "nothing", None, "http://a.org", "ftp://b.com/x/y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge_urls(pages, empty).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert got[2][2:] == ("net/fr/", "block") and got[3][2:] == ("net/es/", "block") and got[4][2:] == (None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7] == ("a.org", "", None, "allow") and got[8][2] == "com/"


def test_url_rules_are_mined(spark):
    rows = [(i, f"http://h{i % 7}.org/{'bad' if i % 4 == 0 else 'good'}/{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)], "doc_id long, toxic int")
    got = urlrules.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {i for i in range(200) if i % 4 == 0}


def test_url_rules_of_a_hot_host_leave_others(spark):
    """A host whose urls share 10 items, with 1,023 rules of equal confidence; another's rules are weaker, and both stay. Most pages are bad."""
    hot = [(i, "ftp://spam.hot.org/a/b/c/d/e/f/g") for i in range(100)]
    weak = [(i, f"weak/{'w' if i < 240 else 'good' if i % 12 else 'w'}") for i in range(200, 300)]
    bad = {i for i, _ in hot} | {i for i in range(200, 240)}
    labels = spark.createDataFrame([(i, int(i in bad)) for i in [*range(100), *range(200, 300)]], "doc_id long, toxic int")
    pages = spark.createDataFrame([*hot, *((i, f"http://{u}") for i, u in weak), (400, "http://weak/w"), (401, "http://weak/good"), (402, "ftp://spam.hot.org/a/new")], "page_id long, url string")
    got = {r.page_id: r for r in urlrules.judge_urls(pages, labels, rules=()).collect()}
    assert {i for i in (0, 200, 400, 401, 402) if got[i].verdict == "block"} == {0, 200, 400, 402}
    assert {r.mined_rule for r in got.values() if r.verdict == "block"} <= set(range(11)) | {11}


def test_quality_held_out(spark):
    bad, rows, labels = ["vileword", "vilething", "vilest"], [], []
    for i in range(600):
        text = words(60, 1000 + i, 3000)
        if i % 5 == 0:
            text = f"{text} {bad[i % 3]} {text[:40]}"
        elif i % 5 == 1:
            text = f"junk{i} " * 80
        rows.append((i, text))
        if i < 400:
            labels.append((i, int(i % 5 > 1), int(i % 5 == 0)))
    got = ordinal.classify(table(spark, [*rows, (900, None), (901, "")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    late = {r.doc_id: r for r in got.collect()}
    right = [late[i].keep == (i % 5 > 1) for i in range(400, 600)]
    assert np.mean(right) > 0.95 and 900 in late and 901 in late
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ordinal.keep_good(table(spark, rows), none, 0.0).count() == 600


def test_secrets(spark, texts):
    r = random.Random(4)
    rows = [(i, f"w {'token' if i % 2 else 'ref'} {'= ' if i % 2 else ''}\"{''.join(r.choice('0123456789abcdef') for _ in range(40))}\" end" if i % 2 else f"plain Aword{i}Longer1{i}Compound tail") for i in range(100, 160)]
    got = secrets.scan_secrets(table(spark, [*texts, *rows]))
    assert {x.doc_id for x in got.where("is_secret").collect()} == {12, *range(101, 160, 2)}
    out = {x.doc_id: x for x in secrets.redact_secrets(table(spark, [*texts, *rows])).collect()}
    assert "[SECRET]" in out[12].text and "9f8e" not in out[12].text and out[12].n_chars == len(out[12].text) and out[4].text is None and out[9].text == dict(texts)[9]
    assert secrets.scan_secrets(table(spark, [])).count() == 0


def test_secrets_assigned_without_break_and_known_formats(spark):
    r = random.Random(8)
    draw = lambda n, of="0123456789abcdef": "".join(r.choice(of) for _ in range(n))
    wide = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = [draw(40) for _ in range(30)]
    rows = [(i, (f"set API_KEY={k} now", f"curl http://a.org/x?token={k}&y=1", f"token={k}")[i % 3]) for i, k in enumerate(keys)]
    bare = ["AKIA" + draw(16, wide[:26]), "ghp_" + draw(36, wide), f"eyJ{draw(20, wide)}.eyJ{draw(30, wide)}.{draw(43, wide)}"]
    rows += [(100 + i, f"some words {k} and more") for i, k in enumerate(bare)]
    rows += [(200 + i, f"plain Aword{i}Longer1{i}Compound tail") for i in range(40)]
    rows += [(300, f"some words {draw(40)} and more")]
    text = dict(rows)
    found = secrets.scan_secrets(table(spark, rows)).collect()
    assert {(x.doc_id, text[x.doc_id][x.start : x.end]) for x in found if x.is_secret and x.doc_id < 300} == {*enumerate(keys), *enumerate(bare, 100)}
    labels = {x.doc_id: x.label for x in secrets.label_findings(secrets._scored(table(spark, rows), 0.5)).collect()}
    assert labels[300] is None and labels[0] == labels[1] == labels[100] == 1.0 and labels[200] == 0.0
    padded = secrets._CANDIDATE.search(f"key={'Ab1' * 8}== end")
    assert padded[0] == "Ab1" * 8 + "=="


def test_secret_dictionary_counts_all_documents(spark):
    """Words of 6 documents among 4,006 count, too few for any sample of half of them; a word of 4 documents does not."""
    docs = spark.createDataFrame([(i, "common prose of all" if i < 4_000 else "kivuli nyota" if i < 4_004 else "kivuli") for i in range(4_006)], "doc_id long, text string")
    assert {r.w for r in secrets.dictionary(docs).collect()} == {"common", "prose", "all", "kivuli"}
    assert {r.w for r in secrets.dictionary(docs, share=0.5).collect()} == {"common", "prose", "all"}
    found = secrets.candidates(table(spark, [(1, "see Kivuli1_Kivuli2_9 here"), (2, "see A1b2C3d4E5f6G7h8 here")]))
    covered = {r.doc_id: r.covered for r in secrets.cover(found, secrets.dictionary(docs)).collect()}
    assert covered == {1: pytest.approx(12 / 17), 2: 0.0}


def test_section_tokens(spark, texts):
    import public_tokenizers

    more = [*texts, (30, "a\n\n\nb  \n c\n"), (31, "é\nü")]
    got = tokencount.section_tokens(table(spark, more), queries.tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    total = defaultdict(int)
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert all(total[r.doc_id] in (r.doc_tokens, 2 * r.doc_tokens) for r in got)
    assert [(r.start, r.end) for r in got if r.doc_id == 31] == [(0, 2), (2, 3)]
    assert tokencount.attribute(np.array([1, 4, 6]), np.array([0, 2, 5, 6])).tolist() == [1, 2, 0]


def test_nearest_neighbours(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 16))
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1020, [float("nan")] * 16), (1040, [1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == set(range(0, 600, 20))
    hit = 0
    for q, found in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(600), -np.round(s, 12)))[:20]
        hit += len({i for i, _ in found} & set(order.tolist()))
        assert len(found) == 20 and all(v == pytest.approx(float(x[i] @ x[q]), abs=1e-12) for i, v in found)
    assert hit / (20 * len(by)) >= 0.95
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).count() == 0
