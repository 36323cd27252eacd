"""Operators of the llm subpackage against plain versions, exact round trips and held-out labels."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import (components, feistel_shard, fm_toxicity, ftrl_quality, host_rules, labelled, language_id, order_minhash, queries,
                           sentence_pieces, suffix, template_decontam, url_filter)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- suffix array -----------------------------------------------------------------------------

def cut_plainly(rows, n):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p: p + n] for _, b in raw for p in range(len(b) - n + 1))
    out = []
    for i, b in raw:
        cover = []
        for p in range(len(b) - n + 1):
            if seen[b[p: p + n]] > 1:
                if cover and p <= cover[-1][1]:
                    cover[-1][1] = p + n
                else:
                    cover.append([p, p + n])
        kept = bytes(c for p, c in enumerate(b) if not any(x <= p < y for x, y in cover))
        out.append((i, len(b), len(b) - len(kept), len(cover), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_two_stage_sorting_orders_all_suffixes():
    rng = random.Random(1)
    for _ in range(60):
        raw = bytes(rng.randrange(3) for _ in range(rng.randrange(1, 70)))
        order = suffix.two_stage(np.frombuffer(raw, np.uint8), np.ones(len(raw), bool), 100)
        padded = raw + b"\x00\xff"
        assert [padded[i:] for i in order] == sorted(padded[i:] for i in range(len(raw)))


def test_repeated_starts_by_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        spans = [bytes(rng.randrange(2) for _ in range(rng.randrange(50))) for _ in range(5)]
        for n in (1, 4, 9):
            seen = Counter(s[i: i + n] for s in spans for i in range(len(s) - n + 1))
            assert [x.tolist() for x in suffix.repeated_starts(spans, n)] == [[i for i in range(len(s) - n + 1) if seen[s[i: i + n]] > 1] for s in spans]


def test_spans_hold_each_window_once_in_blocks():
    rng = np.random.default_rng(3)
    data, ends = rng.integers(0, 4, 5000).astype(np.uint8), np.array([1300, 1320, 5000])
    owner = np.repeat(np.arange(3), np.diff(np.concatenate([[0], ends])))
    starts = [(int(p), int(o)) for o, lo, n, _, _ in suffix.spans_of(data, ends, owner, 16, 40, suffix._tables(600), 512) for o, b, c in zip(o, lo, n) for p in range(b, b + c)]
    assert sorted(starts) == [(p, int(owner[p])) for p in range(5000) if p + 40 <= ends[owner[p]]]


def test_suffix_dedup_hot_passage_and_odd_rows(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    hot, long = word(35), word(90)
    rows = [(i, word(60) + hot + word(60)) for i in range(60)] + [(i + 100, word(20) + long[: 50 + i] + word(20)) for i in range(20)]
    rows += [(200, long + long), (201, None), (202, ""), (203, "x"), (None, long), (204, "a" * 300), (205, rows[0][1]), (205, rows[0][1])]
    got = suffix.suffix_array_dedup(docs(spark, rows), min_len=40, hot_spans=8, bucket_bytes=4000)
    assert sorted((tuple(r)[:5] for r in got.drop("spans").collect()), key=str) == cut_plainly(rows, 40)
    assert suffix.suffix_array_dedup(docs(spark, []), min_len=40).count() == 0


# --- near-duplicates --------------------------------------------------------------------------

def test_word_distance_by_dynamic_programming():
    rng = random.Random(5)
    for _ in range(1500):
        a = [rng.randrange(3) for _ in range(rng.randrange(13))]
        b = [rng.randrange(3) for _ in range(rng.randrange(13))] if rng.random() < 0.3 else [x for x in a if rng.random() < 0.8] + [1]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        for most in (0, 2, 6, 20):
            assert order_minhash.word_distance(a, b, most) == min(row[-1], most + 1)


def test_columns_as_bits_by_dynamic_programming():
    rng = random.Random(15)
    for _ in range(300):
        a = [rng.randrange(rng.choice([3, 40])) for _ in range(rng.randint(1, 90))]
        b = [rng.randrange(40) if rng.random() < 0.3 else w for w in a if rng.random() > 0.1] or [1]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        most = rng.randint(0, 60)
        assert order_minhash._bit_distance(a, b, most) == order_minhash.word_distance(a, b, most) == min(row[-1], most + 1)


def test_texts_of_a_family_are_aligned_with_few_others(spark, monkeypatch):
    rng = random.Random(16)
    base, rows = [rng.randrange(5000) for _ in range(150)], []
    for i in range(60):
        words = [rng.randrange(5000) if rng.random() < 0.04 else w for w in base]
        rows.append((i, " ".join(f"w{w}" for w in words)))
    aligned, verified = [], order_minhash._verified

    def counted(held, pairs, similarity):
        aligned.append(pairs.count())
        return verified(held, pairs, similarity)

    monkeypatch.setattr(order_minhash, "_verified", counted)
    got = order_minhash.near_duplicates(docs(spark, rows)).collect()
    assert len({r.class_id for r in got}) == 1 and sum(aligned) <= 3 * len(rows), aligned


def test_near_duplicates_are_one_class(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(120)]
        for c in range(rng.choice([1, 2, 15])):
            w = list(base)
            for _ in range(3 if c else 0):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    shared = " ".join(rng.choice(vocab) for _ in range(60))  # half of each text: no near-duplicates
    for g in range(40):
        group[len(rows)] = 100 + g
        rows.append((len(rows), shared + " " + " ".join(rng.choice(vocab) for _ in range(60))))
    extra = [(900, None), (901, ""), (902, "one"), (903, "one"), (None, "two words")]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs(spark, rows + extra)).collect()}
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert {i: got[i] for i in group} == {i: first[g] for i, g in group.items()}
    assert (got[900], got[901], got[902], got[903], got[None]) == (900, 900, 902, 902, None)
    assert order_minhash.near_duplicates(docs(spark, [])).count() == 0


def test_large_buckets_by_brute_force(spark):
    """Families of edited copies that drift, all with one passage: every link counts, wherever in its bucket."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(4000)]
    pick = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, texts = pick(60), []
    for _ in range(12):
        family = [pick(60)]
        while len(family) < 14:  # a copy of any earlier one with up to a third of its own words changed
            own = list(rng.choice(family))
            for _ in range(rng.randrange(12, 21)):
                own[rng.randrange(60)] = rng.choice(vocab)
            family.append(own)
        texts += [passage + own for own in family]
    rng.shuffle(texts)
    tables, seed = suffix._tables(1 << 20), order_minhash.seeds(order_minhash.SKETCHES)
    keys = []
    for t in texts:
        data = np.frombuffer(" ".join(t).encode(), np.uint8)
        words = order_minhash.word_hashes(data, np.array([len(data)]), tables)[0]
        keys.append(set(order_minhash.sketch(order_minhash.labelled_kmers(words, 5), seed, order_minhash.WIDTH).tolist()))
    root = list(range(len(texts)))
    for y in range(len(texts)):
        for x in range(y):
            if root[x] != root[y] and keys[x] & keys[y] and order_minhash.word_distance(texts[x], texts[y], 24) <= 24:
                low, high = sorted((root[x], root[y]))
                root = [low if r == high else r for r in root]
    for small in (order_minhash.SMALL, 6):  # without hot buckets, and with many
        got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), small=small).collect()}
        assert [got[i] for i in range(len(texts))] == root


def test_last_comparison_of_texts_of_one_common_word(spark, monkeypatch):
    """Texts that are mostly one word meet by their rare words; no pair within the distance is left out, few are taken twice."""
    rng, written, kept = random.Random(21), order_minhash.written, {}
    texts = [["the"] * rng.randrange(60, 90) + [f"w{rng.randrange(60)}" for _ in range(15)] for _ in range(30)]
    for t in texts:
        rng.shuffle(t)
    for t in texts[:]:  # and copies with some words changed
        own = list(t)
        for _ in range(rng.randrange(4, 24)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(60)}"
        texts.append(own)
    monkeypatch.setattr(order_minhash, "written", lambda df, what: kept.setdefault(what, written(df, what)))
    held = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "rid long, text string")
    keys = held.selectExpr("rid", "array(1L) AS keys")
    found = [tuple(sorted(r)) for r in order_minhash._possible(held, keys, held.selectExpr("rid", "rid AS root"), 0.8).collect()]
    assert len(found) == len(set(found))
    near = set()
    for x in range(len(texts)):
        for y in range(x):
            most = int(max(len(texts[x]), len(texts[y])) * (1 - 0.8) + 1e-9)
            if order_minhash.word_distance(texts[x], texts[y], most) <= most:
                near.add((y, x))
    assert len(near) >= 15 and near <= set(found)
    # rows that meet on a key, before: each of a text's common words with each of all texts
    met = kept["rare"].groupBy("word").count().selectExpr("sum(count * count) AS n").first().n
    assert met < 20 * len(texts) ** 2, met


def test_sketches_meet_at_the_threshold_of_acceptance():
    """Every fifth word on average is another one: edit similarity 0.8."""
    rng, seed, met = np.random.default_rng(3), order_minhash.seeds(order_minhash.SKETCHES), 0
    for _ in range(200):
        a = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
        b = a.copy()
        b[rng.permutation(300)[:60]] = rng.integers(1, 1 << 62, 60, dtype=np.uint64)
        x, y = (order_minhash.sketch(order_minhash.labelled_kmers(w, 5), seed, order_minhash.WIDTH) for w in (a, b))
        met += (x == y).any()
    assert met >= 0.97 * 200


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}


# --- SentencePiece ----------------------------------------------------------------------------

def test_pieces_have_the_best_score_and_decode_exactly(spark, table):
    sp = pytest.importorskip("sentencepiece")
    if not os.path.exists(sentence_pieces.MODEL):
        pytest.skip("no model file")
    raw = open(sentence_pieces.MODEL, "rb").read()
    pieces = sentence_pieces.read_model(raw)
    trie = sentence_pieces.double_array([(t.encode(), i) for i, (t, k) in enumerate(zip(pieces.text, pieces.kind)) if k in (1, 4, 5)])
    codec = sentence_pieces.Codec(pieces, trie)

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    as_unigram = b"".join(varint(n << 3 | 2) + varint(len(v)) + v for n, v in ((n, v + b"\x18\x01" if n == 2 else v) for n, v in sentence_pieces._fields(raw)))
    library = sp.SentencePieceProcessor(model_proto=as_unigram)
    texts = [r.text for r in table.select("text").limit(60).collect()]
    odd = ["", " ", "  a  b ", "日本語 x", "a\tb\n\n c", "é ü ß 😀", "the" * 60, "x" * 5000]
    score = lambda ids: sum(pieces.score[i] for i in ids)
    vocab = {t: s for t, s, k in zip(pieces.text, pieces.score, pieces.kind) if k in (1, 4, 5)}

    def best_score(marked):  # over all cuts of the whole marked text, without a trie or words
        best = [0.0]
        for j in range(1, len(marked) + 1):
            best.append(max(best[i] + vocab.get(marked[i:j], codec.penalty if j == i + 1 else -np.inf) for i in range(max(0, j - 20), j)))
        return best[-1]
    assert max(map(len, vocab)) <= 20
    for t in [x[:400] for x in texts if x] + odd[2:3]:
        ids = codec.encode(t)
        if not any(pieces.kind[i] == 6 for i in ids):
            assert score(ids) == best_score("\u2581" + t.replace(" ", "\u2581"))
        assert score(ids) >= score(library.nbest_encode(t, nbest_size=1)[0]) - 1
    assert all(codec.decode(codec.encode(t)) == t for t in texts + odd)
    out = sentence_pieces.encode(docs(spark, list(enumerate(odd)) + [(99, None)]))
    back = {r.doc_id: r.text for r in sentence_pieces.decode(out).collect()}
    assert back == {**dict(enumerate(odd)), 99: ""}
    assert out.filter("not round_trip").count() == 0


# --- url filter -------------------------------------------------------------------------------

def test_rules_and_redirect_classes(spark):
    link = '<head><link href="{}" rel="canonical"></head>'
    rows = [(1, "http://a.example.org/es/x", ""), (2, "https://A.example.net/q#f", link.format("http://a.example.org/es/x")),
            (3, "http://b.example.net/", '<meta http-equiv="refresh" content="0; url=http://A.example.net/q">'), (4, "http://b.example.org/", link.format("/es/1")),
            (5, None, None), (6, "no scheme", link.format("http://c.example.org/es/")), (7, "http://x.net/1", link.format("http://y.com/fr/")), (8, "http://x.net/2", link.format("http://x.net/1")),
            (9, "http://x.net/3", link.format("http://y.com/de/")), (10, "http://x.net/2", link.format("http://y.com/de/k")), (11, "s://notexample.org/en/1?x", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("a.example.net", "/q", None, "block") and got[3][3] == "block"
    assert got[4] == ("b.example.org", "/", "org/", "allow")
    assert got[5] == ("", "", None, "allow") == got[6]
    assert got[7][3] == got[8][3] == got[10][3] == "allow" and got[9][3] == "block"
    assert got[11] == ("notexample.org", "/en/1", "org/", "allow")


def test_relative_targets(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "http://n.net/d/a.html?x#f", link.format("b.html")), (2, "http://n.net/d/b.html", link.format("../c")), (3, "http://n.net/c", link.format("?p=2")),
            (4, "http://n.net/c?p=2", link.format("http://a.example.org/es/x")), (5, "http://m.net/x", link.format("/login?next=http://a.example.org/es/x")), (6, "http://m.net", link.format("mailto:a@n.net/c"))]
    got = {r.page_id: r.verdict for r in url_filter.judged_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow"}


# --- classifiers ------------------------------------------------------------------------------

@pytest.mark.parametrize("name, mod, part, label, least", [("op5_fm_toxicity", 3, 1, "toxic", 0.85), ("op10_ftrl_quality", 4, 2, "quality", 0.9)])
def test_held_out_rank(spark, name, mod, part, label, least):
    """About 260 training rows here, few of them toxic; with 13,700 (check_s) the rank is 0.9999 and 1.0."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % mod == part) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    pos, neg = ([got[i].score for i, v in y.items() if v == k and got[i].held_out] for k in (1, 0))
    rank = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    print(name, rank)
    assert rank > least


def test_factorization_machine_learns_a_pair_that_weights_miss():
    rng = np.random.default_rng(1)
    x = (rng.random((4000, 4)) < 0.5).astype(np.float32)
    y = ((x[:, 0] == 1) ^ (x[:, 1] == 1)).astype(float)
    b, w, v = fm_toxicity.train_fm(x, y, 4, 60, 0.1, 1e-4)
    assert np.mean((fm_toxicity.fm_scores(x, b, w, v) > 0) == y) > 0.95


def test_factorization_machine_sums_all_pairs():
    rng = np.random.default_rng(4)
    x, w, v = rng.normal(size=(20, 6)) * (rng.random((20, 6)) < 0.6), rng.normal(size=6), rng.normal(size=(6, 3))
    want = [0.5 + r @ w + sum((v[i] @ v[j]) * r[i] * r[j] for i in range(6) for j in range(i)) for r in x]
    assert np.allclose(fm_toxicity.fm_scores(x, 0.5, w, v), want)


@pytest.mark.parametrize("fill", [6, 40])
def test_toxicity_of_pairs_of_words_that_tell_nothing_alone(spark, fill):
    """Every marked word is as frequent under both labels; all have one shape."""
    rng = np.random.default_rng(9)
    rows, y = [], {}
    for i in range(3000):
        a, b = i % 2, i // 2 % 2
        rows.append((i, " ".join(rng.permutation([*(f"word{k}" for k in rng.integers(100, 1000, fill)), ("insulta", "insultb")[a], ("namings", "groupin")[b]]))))
        y[i] = int(a == b)
    labels = spark.createDataFrame([(i, t) for i, t in y.items()], "doc_id long, toxic int")
    got = fm_toxicity.toxicity_scores(docs(spark, rows), labels, usable=lambda i: i % 5 != 0).filter("doc_id % 5 = 0").collect()
    pos, neg = (np.array([r.score for r in got if y[r.doc_id] == k]) for k in (1, 0))
    assert len(got) == 600 and np.mean(pos[:, None] > neg) > 0.95


def test_toxicity_without_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    assert fm_toxicity.toxicity_scores(docs(spark, []), labels).count() == 0
    got = fm_toxicity.toxicity_scores(docs(spark, [(0, None), (1, ""), (1, "")]), labels).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)


def test_ftrl_separates():
    rng = np.random.default_rng(2)
    rows = [(np.array([rng.integers(0, 5) + 5 * (k % 2), 20]), np.ones(2)) for k in range(400)]
    w = ftrl_quality.ftrl(rows, np.arange(400) % 2, 20, 3)
    assert all((w[i] @ x > 0) == k % 2 for k, (i, x) in enumerate(rows))


def test_scores_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)], "doc_id long, quality int, toxic int")
    some = docs(spark, [(i, "good text here" if i % 2 else "bad ### text") for i in range(40)] + [(90, None), (91, ""), (None, "a " * 9000), (90, None)])
    got = ftrl_quality.quality_scores(some, labels).collect()
    assert len(got) == 44 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in fm_toxicity.toxicity_scores(some, labels).collect()} == {0.5}
    assert ftrl_quality.quality_scores(docs(spark, []), labels).count() == 0


# --- host rules -------------------------------------------------------------------------------

def test_host_counts_by_hand(spark, table):
    odd = [(900_001, None), (900_002, ""), (900_003, " \x0b\n\t"), (900_004, "a b c d e a b c d e f\n\nx\nx\n x\n"), (900_005, "##$ é\u00a0é |"), (900_006, "q " * 7000)]
    all_docs = table.unionByName(docs(spark, odd))
    text = {r.doc_id: r.text for r in all_docs.collect()}
    for r in host_rules.host_quality(all_docs).collect():
        t = text[r.doc_id] or ""
        w = re.findall("[^\x20\x09-\x0D]+", t)
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i: i + 5])].append(i)
        rep = len({j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)})
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), rep, len(w) < 10 or 100 * rep > 20 * len(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 == 0 else "x", "en", "bad.example", 0) for i in range(200)] + [(1000 + i, good, "en", f"h{i % 5}", 0) for i in range(500)]
    got = host_rules.host_quality(spark.createDataFrame(rows, SCHEMA))
    assert got.filter("kept and host = 'bad.example'").count() == 0 and got.filter("kept").count() == 500


# --- decontamination --------------------------------------------------------------------------

def test_templates_and_slots(spark):
    item = "If Alice buys 3 apples for 2 euros each and sells 5 of them to Bob, how much money does Alice have after 10 days of trading?"
    other = item.replace("Alice", "Carol").replace("3", "17").replace("10", "44")
    broken = item.replace("Alice", "Carol", 1)  # one name with two values
    rows = [(1, "some words before it. " + item + " and after"), (2, other), (3, broken), (4, "nothing of the kind is in this text at all, really nothing"), (5, None), (6, ""), (None, item)]
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in template_decontam.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(1, 7): True, (2, 7): False, (None, 7): True}
    assert template_decontam.contaminated(docs(spark, []), bench).count() == 0


def test_values_of_other_lengths_and_contradictions(spark):
    item = "Our friend saw that Bob and his sister paid for the old car with money that 1,000 people had given to them in the spring"
    two = "a shop sells pens for 3 coins and books for 5 coins each so that we ask how much both of them cost together"
    filler = " ".join(f"plain{i}" for i in range(70))
    long = "The crate has 12 bolts in it and nobody knows why. " + filler + " The other crate has 12 nuts."
    rows = [(1, "so " + item.replace("Bob", "Mary Ann")), (2, item.replace("1,000", "1 000")), (3, two.replace("3", "4").replace("5", "4")), (4, long.replace("12", "13", 1)),
            (5, long.replace("The other", "This other")), (6, "Then Paul said Paul " + item)]
    bench = spark.createDataFrame([(1, item), (2, two), (3, long)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in template_decontam.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(1, 1): False, (2, 1): False, (3, 2): False, (4, 3): False, (5, 3): False, (6, 1): True}


def test_short_and_placeholder_heavy_items(spark):
    items = ["What is 2 + 2?", "12 + 30 = 42 and 7 + 8 = 15 and 9 + 9 = 18", "THE CAPITAL OF FRANCE IS PARIS AND THAT OF SPAIN IS MADRID", "The Old Man And The Sea", "东京是日本的首都，也是最大的城市。", "Madrid"]
    rows = [(i, f"before, {t} after") for i, t in enumerate(items)] + [(10, "前面" + items[4] + "后面"), (11, "What is 2 + 3? 12 + 30 = 42 and 7 + 8 = 15 and 9 + 9 = 19; The Old Man and the Sea"), (12, None)]
    bench = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, ""), (92, " .. ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in template_decontam.contaminated(docs(spark, rows), bench).collect()}
    assert got == {**{(i, i): True for i in range(len(items))}, (10, 4): True}


def test_all_exact_benchmark_passages_are_found(spark, table):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {(r.doc_id, r.item_id) for r in table.join(bench.withColumnRenamed("text", "b"), F.expr("contains(text, b)")).collect()}
    assert held == {(r.doc_id, r.item_id) for r in template_decontam.contaminated(table, bench).collect()}


# --- shards -----------------------------------------------------------------------------------

def test_permutation_and_its_inverse():
    keys = feistel_shard.round_keys(3)
    for n in (1, 2, 5, 64, 1000, 4097):
        rows = np.arange(n)
        p = feistel_shard.permute(rows, n, keys)
        assert sorted(p.tolist()) == list(range(n)) and (feistel_shard.permute(p, n, keys, back=True) == rows).all()


def test_shards_are_even_and_repeatable(spark):
    rows = [(i % 50, f"text {i % 60}") for i in range(301)] + [(None, None), (None, "é")]
    got = feistel_shard.feistel_shards(docs(spark, rows)).collect()
    again = feistel_shard.feistel_shards(docs(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and {len(v) for v in slots.values()} <= {37, 38}
    assert {(r["size"], r.text_crc32) for r in got if r.doc_id is None} == {(1, 0), (3, zlib.crc32("é".encode()))}
    assert feistel_shard.feistel_shards(docs(spark, [])).count() == 0


# --- language ---------------------------------------------------------------------------------

def test_language_by_fused_evidence(spark, table):
    odd = spark.createDataFrame([(900_001, None, "de", "src1", 0), (900_002, "", None, None, 0), (900_003, "zq", "xx", "a.b.de", 0)], SCHEMA)
    got = {r.doc_id: r for r in language_id.identify(table.unionByName(odd)).collect()}
    want = {r.doc_id: r.lang for r in table.collect()}
    assert np.mean([got[i].language == v for i, v in want.items()]) > 0.97
    assert got[900_001].language == "de" and len(got) == len(want) + 3
    noise = docs(spark, [(i, "the cat and the dog went home again " * 5) for i in range(50)] + [(60, "\x01\x7fq\x02zX" * 40)])
    kept = {r.doc_id: r.kept for r in language_id.identify(noise, declared=None, host=None, languages=["en"]).collect()}
    assert set(kept.values()) == {False}  # no declared rows: nothing is known
    assert language_id.identify(docs(spark, [])).count() == 0
    page = spark.createDataFrame([('<!doctype html><HTML class="x" lang=\'DE-at\'>',), (None,), ("<p>",)], "h string")
    assert [r[0] for r in page.select(language_id.declared_in(F.col("h"))).collect()] == ["de", None, None]


def test_a_rare_language_is_known(spark):
    rng = random.Random(10)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, text("abcdefgh"), "en", None, 0) for i in range(2500)] + [(9000 + i, text("ijklmnop"), "fi", None, 0) for i in range(12)] + [(9500, text("ijklmnop"), None, None, 0)]
    got = {r.doc_id: (r.language, r.kept) for r in language_id.identify(spark.createDataFrame(rows, SCHEMA), max_rows=300).collect()}
    assert {i: x for i, x in got.items() if i >= 9000} == {i: ("fi", True) for i in [*range(9000, 9012), 9500]} and got[0] == ("en", True)


# --- passages between documents ---------------------------------------------------------------

def later_windows_plainly(texts, n):
    """Per text the window starts that an earlier text (by the operator's order) holds too, and
    those that it is the first of several to hold."""
    holders = defaultdict(set)
    for t, (_, raw) in texts.items():
        for p in range(len(raw) - n + 1):
            holders[raw[p: p + n]].add(texts[t][0])
    gone, stay = {}, {}
    for t, (d, raw) in texts.items():
        at = range(len(raw) - n + 1)
        gone[t] = {p for p in at if min(holders[raw[p: p + n]]) < d}
        stay[t] = {p for p in at if len(holders[raw[p: p + n]]) > 1} - gone[t]
    return gone, stay


def test_later_windows_of_texts_by_brute_force(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("ab cdeé") for _ in range(n))
    hot, shared = word(40), [word(90) for _ in range(4)]
    texts = [word(30) + hot + word(30) for _ in range(50)] + [word(20) + rng.choice(shared)[rng.randrange(20): 40 + rng.randrange(50)] + word(rng.randrange(20)) for _ in range(60)]
    texts += [shared[0] + word(9) + shared[0], word(5) + shared[0] + shared[0] + word(5), word(50) * 3, "a" * 200, "b" + "a" * 150]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("tid"), F.lit(0).cast("long").alias("row"), "text").distinct()
    keyed = {r["tid"]: (r["d"], r["text"].encode()) for r in frame.withColumn("d", F.xxhash64("tid")).collect()}
    keyed = {bytes(k): v for k, v in keyed.items()}
    for hot_spans in (1500, 8):
        gone, stay = later_windows_plainly(keyed, 30)
        told, kept = defaultdict(set), defaultdict(set)
        for r in suffix.repeats(frame, 30, hot_spans, 2000, across=True).collect():
            (told if r["gone"] else kept)[bytes(r["tid"])] |= set(range(r["lo"], r["lo"] + r["n"]))
        for t in keyed:
            assert told[t] == gone[t]
            # what only this text repeats may be listed to stay too
            assert stay[t] <= kept[t] | told[t]


def test_passages_stay_in_one_document(spark):
    rng = random.Random(13)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage, short = words(60), words(30)
    rows = [(i, f"{words(40)} {passage} {words(30)}") for i in range(12)] + [(20 + i, f"{words(40)} {short} {words(30)}") for i in range(4)]
    own = words(55)
    rows += [(30, f"{own} {words(9)} {own}"), (31, None), (31, ""), (None, words(80)), (32, passage), (33, "x"), (34, words(70) + "é")]
    frame = spark.createDataFrame([(i, t, 1, "c", "t", 2) for i, t in rows], "doc_id long, text string, rest int, cut string, tid string, row int")
    import corpus_pipeline as cp
    out = cp.suffix_dedup(spark, frame, SF)
    assert out.columns == frame.columns
    got = {(r["doc_id"], len(r["text"]) if r["text"] else r["text"]): r["text"] for r in out.collect()}
    kept = [t for t in got.values() if t and passage in t]
    assert len(kept) == 1 and not any(w in t for w in [" ".join(passage.split()[5:25])] for t in got.values() if t and t != kept[0])
    texts = dict((i, t) for i, t in rows)
    for (i, _), t in got.items():
        if i is None or i >= 20 and i != 32:
            assert t == texts[i] or i == 31
        elif i != 32 and t != kept[0]:
            assert t.split() == texts[i].replace(passage, "").split()
    assert len(got) in (len(rows), len(rows) - 1)  # the document that is the passage goes unless it is the one that keeps it


def test_stages_with_clashing_columns(spark):
    import corpus_pipeline as cp
    names = ["_id", "_row", "_tid", "_key", "n_removed", "kept_text", "id", "row", "tid", "doc", "key", "text_", "part", "n_words", "class_id"]
    base = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40")
    wide = base.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for _, stage in cp.STAGES[:-1]:
        plain = sorted(r["doc_id"] for r in stage(spark, base, SF).collect())
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns
        assert sorted(r["doc_id"] for r in got.collect()) == plain
        assert stage(spark, wide.limit(0), SF).count() == 0


# --- pipeline ---------------------------------------------------------------------------------

def test_near_duplicates_of_missing_and_repeated_ids(spark):
    import corpus_pipeline as cp
    rng = random.Random(11)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(50)) for _ in range(4))
    rows = [(1, a), (2, a), (1, b), (None, c), (None, c + " more"), (None, d), (None, d)]
    got = cp.near_duplicates(spark, docs(spark, rows), SF).collect()
    assert len(got) == 4 and {(r.doc_id, r.text) for r in got} >= {(1, a), (1, b), (None, d)}


def test_pipeline_stages_follow_each_other(spark, table):
    import corpus_pipeline as cp
    at, rows = table, table.count()
    for name, stage in cp.STAGES[:-1]:
        out = cp.written(stage(spark, at, SF), name)
        assert out.columns == table.columns
        rows, before = out.count(), rows
        assert 0.5 * before < rows <= before
        at = out
    last = cp.STAGES[-1][1](spark, at, SF)
    assert last.count() == rows and last.filter("not round_trip").count() == 0
    holders = defaultdict(set)
    for r in at.collect():
        words = (r.text or "").split()
        for i in range(len(words) - 50):
            window = " ".join(words[i: i + 51])
            if len(window.encode()) >= suffix.PASSAGE_LEN:
                holders[window].add((r.doc_id, r.text))
    assert holders and all(len(x) == 1 for x in holders.values())
    assert cp.run(spark, SF).count() == rows


def test_sample_is_bounded_and_repeatable(spark, table):
    labels = spark.createDataFrame([(r.doc_id, 1) for r in table.select("doc_id").collect()], "doc_id long, y int")
    pick = lambda: sorted(r.text or "" for r in labelled.training_rows(table, labels, "y", "doc_id", "text", lambda i: F.lit(True), 50).collect())
    assert pick() == pick() and 20 < len(pick()) < 90
