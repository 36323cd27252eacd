"""Secret scans, periodic runs and whitening against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from riskframe.llm import exact_whitening, periodic_runs, queries, secret_scan

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def docs(spark, rows):
    return frame(spark, [(i, t, "en", "src", 0) for i, t in rows])


def odd_docs(spark, rows):
    """The same with columns of the operators' own names."""
    return frame(spark, [(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, spans string, row long, n int, id int")


# --- secret scans -----------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_plainly(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def entropy(x):
    return -sum(x.count(c) / len(x) * math.log2(x.count(c) / len(x)) for c in set(x))


def test_windows_by_brute_force():
    rng = random.Random(1)
    for _ in range(100):
        data = bytes(rng.randrange(rng.choice([2, 5, 40])) + 48 for _ in range(rng.randrange(60)))
        for width, bits in ((4, 1.6), (10, 2.5)):
            covered = sorted({j for i in range(len(data) - width + 1) if entropy(data[i: i + width]) >= bits - 1e-9 for j in range(i, i + width)})
            assert [j for b, e in secret_scan.windows(data, width, bits) for j in range(b, e)] == covered


def test_base_kinds_equal_a_plain_scan_of_the_table(spark):
    got = queries.op11_secret_scan(spark, SF)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        plain = base_plainly(texts[r["doc_id"]])
        told = [f"{secret_scan.KINDS[k]}:{b}:{e}" for b, k, e in plain]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in plain) for j in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")] == told


def test_base_kinds_on_random_texts(spark):
    rng = random.Random(2)
    bits = ["password", "API_KEY", "apikey", "ToKen", "=", ": ", " ", "\"", "'", "AKIA", "AKIAABCDEFGHIJKL", "abcdef0123456789" * 2, "é", "ſ", "K", "日本", "x.y/z+", "0a" * 17, "\n", "Secret"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(400)]
    for r in secret_scan.scan_secrets(odd_docs(spark, rows)).collect():
        told = [f"{secret_scan.KINDS[k]}:{b}:{e}" for b, k, e in base_plainly(rows[r["doc_id"]][1])]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()


def test_entropy_finds_keys_and_leaves_the_allow_list(spark):
    rng = random.Random(3)
    key = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    secrets = [key(low + up + dig + "+/", 40) for _ in range(40)] + [key(up + dig, 28) for _ in range(20)] + [key(low + dig, 32) for _ in range(20)] + [key(dig + "ABCDEF", 40) for _ in range(20)]
    rows = [(i, f"schlüssel für é: {s} und weiter") for i, s in enumerate(secrets)]
    found = {r["doc_id"]: r["spans"] for r in secret_scan.scan_secrets(docs(spark, rows)).collect()}
    hit = 0
    for i, s in enumerate(secrets):
        at = rows[i][1].index(s)
        hit += any(x["kind"].startswith("entropy") and at <= x["start"] and x["end"] <= at + len(s) and x["end"] - x["start"] >= 0.7 * len(s) for x in found[i])
    assert hit >= 95
    clean = ["123e4567-e89b-12d3-a456-426614174000", "sha256:" + key(dig + "ABCDEF", 40), "https://example.net/a/" + key(low + dig, 30), "getUserAccountSettingsForProfileView2", "31415926535897932384626433832795028841",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "your_" + key(low + dig, 30), "/usr/local/share/applications/python3/library", "the quick brown fox jumps over the lazy dog " * 5, "aaaaaaaaaa1111111111aaaaaaaaaa1111111111",
             "data:image/png;base64," + key(low + up + dig, 200), None, ""]
    for r in secret_scan.scan_secrets(docs(spark, list(enumerate(clean)))).collect():
        assert not [s for s in r["spans"] if s["kind"].startswith("entropy")], clean[r["doc_id"]]


def test_secret_scan_odd_rows(spark):
    long = "wort " * 300_000 + "token=abcdefgh12 " + "ab" * 400_000
    rows = [(1, None), (1, ""), (None, "password: 12345678"), (2, long), (2, long), (3, "token=short")]
    got = secret_scan.scan_secrets(odd_docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), len([s for s in r["spans"] if s["kind"] in ("assign", "hex")])) for r in got) == [("1", 0), ("1", 0), ("2", 2), ("2", 2), ("3", 0), ("None", 1)]
    assert secret_scan.scan_secrets(docs(spark, [])).count() == 0


# --- periodic runs ----------------------------------------------------------------------------

def runs_plainly(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            block = words[i: i + q]
            if j + q - i >= max(6, 4 * q) and not any(q % d == 0 and block[d:] == block[:-d] for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def periodic_ids(rng, most):
    out = []
    while len(out) < rng.randrange(most):
        p = rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 12, 16, 17, 31, 40, 60])
        block = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(p)]
        out += (block * 9)[: int(p * rng.choice([1, 2, 3.9, 4, 4.5, 6, 8.3])) + rng.randrange(3)]
    return out


@pytest.mark.parametrize("tile", [8, 64, 4096])
def test_tiles_find_all_runs(monkeypatch, tile):
    monkeypatch.setattr(periodic_runs, "TILE_WORDS", tile)
    rng = random.Random(tile)
    for _ in range(300):
        ids = periodic_ids(rng, 400)
        got = set()
        for d, lo, part, own in periodic_runs.tiles(np.array(ids, np.int32)):
            for q, b, e in periodic_runs.solve(part, d, own.tolist()):
                assert e - b >= 4 * q and ids[lo + b: lo + e - q] == ids[lo + b + q: lo + e]
                got.add((lo + b, lo + e, q))
        for s, n, q in runs_plainly(ids):  # the fragments of a run overlap by its period and reach its ends
            end = s
            for b, e, _ in sorted(x for x in got if x[2] == q and s <= x[0] and x[1] <= s + n):
                assert end == s and b == s or b <= end - q
                end = max(end, e)
            assert end == s + n


def test_periodic_runs_of_documents(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(f"wé{x}" for x in periodic_ids(rng, 300))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "a " * 9), (None, "a b " * 9), (203, "x x x x x"), (203, "x x x x x x"), (203, "x x x x x x"), (204, "nb sp " * 6)]
    rows += [(300, "eins zwei drei " * 40_000), (301, "a " * 50_000 + "b c " * 5_000)]
    got = periodic_runs.periodic_runs(odd_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    plain = []
    for i, t in rows[:-2]:
        runs = runs_plainly(words_of(t))
        plain.append((str(i), len(words_of(t)), runs, hashlib.sha256(collapsed(words_of(t), runs).encode()).hexdigest()))
    plain += [("300", 120_000, [(0, 120_000, 3)], hashlib.sha256(b"eins zwei drei").hexdigest())]
    plain += [("301", 60_000, [(0, 50_000, 1), (50_000, 10_000, 2)], hashlib.sha256(b"a b c").hexdigest())]
    assert sorted((str(r["doc_id"]), r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed_sha256"]) for r in got) == sorted(plain)
    for r in periodic_runs.periodic_runs(docs(spark, rows[:20]), keep_text=True).collect():
        assert r["collapsed_text"] == collapsed(words_of(rows[r["doc_id"]][1]), runs_plainly(words_of(rows[r["doc_id"]][1])))
    assert periodic_runs.periodic_runs(docs(spark, [])).count() == 0


def test_periodic_query_equals_a_plain_version(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_periodic_runs(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    with_runs = 0
    for r in rows:
        words, h = words_of(texts[r["doc_id"]]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_plainly(words)
        with_runs += bool(runs)
        top = min(runs, key=lambda x: (-x[1] * math.lcm(*[y[2] for y in runs]) // x[2], x[0], x[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (top or (None,) * 3) and r["n_runs"] == len(runs)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if top else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert with_runs >= 5


# --- whitening --------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x string, n int, component string, id long"


def exact_polynomial(a):
    """Faddeev-LeVerrier in whole numbers."""
    d = len(a)
    m, c = np.zeros((d, d), object), [0] * d + [1]
    for k in range(1, d + 1):
        m = a @ m + c[d - k + 1] * np.eye(d, dtype=int).astype(object)
        t = a @ m
        c[d - k] = -sum(t[i, i] for i in range(d)) // k
    return c


def integer_scatter(x):
    t = x.sum(axis=0)
    return (len(x) * (x.T @ x) - np.outer(t, t)).astype(object)


@pytest.mark.parametrize("d,n", [(1, 4), (2, 2), (3, 9), (7, 4), (12, 60)])
def test_polynomial_and_roots(d, n):
    rng = np.random.default_rng(d)
    x = rng.integers(-40, 40, (n, d))
    if d == 7:
        x[:, 3] = x[:, 2]
    a = integer_scatter(x)
    primes = exact_whitening.primes_below(1 << 31, exact_whitening.primes_needed(a))
    assert all(pow(2, p - 1, p) == 1 for p in primes) and len(set(primes)) == len(primes)
    poly = exact_whitening.joined_residues([exact_whitening.polynomial_mod(np.array(a % p, np.int64), p) for p in primes], primes)
    assert poly == exact_polynomial(a)
    values, trace = np.linalg.eigvalsh(a.astype(float))[::-1], int(np.trace(a))
    for k in range(1, d + 1 - next(i for i, c in enumerate(poly) if c)):
        root = exact_whitening.kth_root(poly, k, trace)
        e = root.value / 2 ** exact_whitening._ROOT_BITS
        v = exact_whitening.null_vectors(a, root)[k - root.first]
        assert abs(e - values[k - 1]) <= 1e-12 * values[0] and np.abs(a.astype(float) @ v - e * v).max() <= 1e-12 * trace and abs(v @ v - 1) < 1e-14


def test_equal_roots_get_orthogonal_components():
    a = np.diag([5, 5, 5, 2, 0]).astype(object)
    poly = exact_polynomial(a)
    roots = [exact_whitening.kth_root(poly, k, 17) for k in (1, 2, 3, 4)]
    assert [(r.first, r.size) for r in roots] == [(1, 3)] * 3 + [(4, 1)]
    v = np.array([exact_whitening.null_vectors(a, r)[k - r.first] for k, r in enumerate(roots, 1)])
    assert np.allclose(v @ v.T, np.eye(4), atol=1e-14) and np.allclose(v[:3, 3:], 0, atol=1e-14)


def whiten_plainly(rows, most=16):
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, s = len(fit), fit.sum(axis=0)
    e, vec = np.linalg.eigh(integer_scatter(fit).astype(float) / n / n)
    e, vec = e[::-1], vec[:, ::-1]
    k = min(most, int((e > 1e-9 * e[0]).sum()))
    out = []
    for i, x in good:
        off = n * np.array(x) - s
        for c in range(k):
            out.append((str(i), c + 1, n, int((off.astype(object) ** 2).sum()), off / n @ vec[:, c] / math.sqrt(e[c]), e[c] / e.sum()))
    return out


def check_whitening(got, plain):
    key = lambda r: (r[1], r[0], r[3], round(abs(r[4]), 6))
    got = sorted(((str(r["vec_id"]), r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got), key=key)
    plain = sorted(plain, key=key)
    assert [x[:4] for x in got] == [x[:4] for x in plain]
    for c in {x[1] for x in plain}:
        a, b = (np.array([x[4] for x in y if x[1] == c]) for y in (got, plain))
        far = np.abs(b).argmax()
        assert np.allclose(a * np.sign(a[far]), b * np.sign(b[far]), atol=1e-6)
    assert np.allclose([x[5] for x in got], [x[5] for x in plain], rtol=1e-6)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(0, 1, (80, 5)).astype(np.float32))]
    rows = [(i, [*v, v[0], 2.0]) for i, v in rows]  # one entry twice, one constant: five components
    rows += [(7, rows[3][1]), (None, rows[3][1]), (90, rows[4][1])] * 2
    bad = [(91, None), (92, [None] + [1.0] * 6), (93, [math.nan] + [1.0] * 6), (94, [math.inf] + [1.0] * 6), (95, []), (96, [1.0] * 3)]
    frame_of = lambda r: frame(spark, [(i, v, 0, "x", 1, "c", 5) for i, v in r], VECTORS)
    got = exact_whitening.whiten(frame_of(rows + bad)).collect()
    check_whitening(got, whiten_plainly(rows))
    assert {r["component"] for r in got} == set(range(1, 6)) and max(r["identity_error"] for r in got) < 1e-9
    assert exact_whitening.whiten(frame_of([])).count() == 0
    assert exact_whitening.whiten(frame_of([(1, [1.0, 2.0])] * 3)).count() == 0
    big = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(0, 1e11, (40, 3)).astype(np.float32))]
    vectors = exact_whitening.whiten(frame_of(big)).collect()
    assert max(r["identity_error"] for r in vectors) < 1e-9 and all(r["deviation"] is None or r["deviation"] >= 0 for r in vectors)


def test_whitening_query_equals_a_plain_version(spark):
    got = queries.op13_exact_whitening(spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    check_whitening(got, whiten_plainly([(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]))
    assert got[0]["identity_error"] < 1e-10
