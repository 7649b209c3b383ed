"""Hard negatives, URL rules and spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import language, negatives, neighbours, registry, sanitize, spelling, urlrules


@pytest.fixture(autouse=True)
def _settings(spark):
    registry.settings(spark)


# -- hard negatives ----------------------------------------------------------

def mined(rows, every=3, n_pos=5, n_neg=3):
    """Plain scores over all pairs; rows: (id, label, vector)."""
    own = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v):
            own[i] = min(own.get(i, (label, [np.inf])), (label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for a, (label, v) in own.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own_label) for i, (own_label, w) in own.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:n_pos]:
            fit = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fit[:n_neg])]
    return sorted(out)


def vectors(n, dims=11, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(4)), [float(x) for x in np.round(rng.normal(size=dims), 2)]) for i in range(n)]


ODD = [(900, None, [1.0] * 11), (901, 1, None), (902, 1, [1.0] * 10 + [None]), (903, 1, [1.0] * 10 + [float("nan")]), (904, 1, [float("inf")] + [0.0] * 10),
       (None, 1, [1.0] * 11), (906, 2, [3.0] * 11), (907, 2, [3.0] * 11), (908, 1, [3.0] * 11), (909, 2, [3.0] * 11), (909, 2, [3.0] * 11),
       (909, 1, [5.0] * 11), (912, 1, [1.0, 2.0]), (915, 1, [2.0, 2.0]), (916, 2, [1.0, 1.0]), (917, 1, []), (918, 1, [])]


@pytest.mark.parametrize("blocks", [(512, 4096), (7, 16)])
def test_negatives_equal_all_pairs(spark, blocks):
    rows = vectors(150) + ODD
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, score string")
    got = negatives.mine(table, table.vec_id % 3 == 0, anchor_block=blocks[0], row_block=blocks[1])
    found = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())
    assert found == mined(rows) and found
    assert negatives.mine(table.limit(0), table.vec_id % 3 == 0).count() == 0


def test_scores_are_full_inner_products():
    rng = np.random.default_rng(3)
    for dims, most in ((1, 1), (8, 127), (13, 5000), (64, 300), (5, 10**8)):
        a, b = rng.integers(-most, most + 1, (6, dims)), rng.integers(-most, most + 1, (9, dims))
        packed = [negatives.pack(x)[1] for x in (a, b)]
        assert (negatives.unpack(packed[0])[:, :dims] == a).all()
        assert (negatives.scores(*packed).astype(np.int64) == a @ b.T).all()
    # Rows packed with fewer planes repeat their sign.
    few, many = negatives.pack(np.array([[-1, 0]])), negatives.pack(np.array([[100, -100]]))
    both = negatives._stack([few[0], many[0]], [few[1].tobytes(), many[1].tobytes()], 2)
    assert negatives.unpack(both)[:, :2].tolist() == [[-1, 0], [100, -100]]


def test_components_too_large_for_64_bits_take_no_part(spark):
    table = spark.createDataFrame([(0, 1, [1e160]), (3, 1, [1e4]), (4, 1, [2e4]), (5, 2, [1.5e4])], "vec_id long, label int, embedding array<double>")
    got = [tuple(r) for r in negatives.mine(table, table.vec_id % 3 == 0).collect()]
    assert got == [(3, 4, 1, 5, 256 * 256 * 2 * 10**8, 256 * 256 * 15 * 10**7)]


# -- URL rules ---------------------------------------------------------------

def parts(url):
    if not url or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path, rest[len(host) + len(path):]


def url_words(url):
    out = set()
    for mark, part in zip("hpq", parts(url)):
        for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), part)):
            out.add(f"{mark}:" + ("#" if re.fullmatch("[0-9]+", w) else w))
    return sorted(out)


def mined_rules(labelled, support, least, confidence, window):
    baskets = [(w[k:k + window], b) for u, b in set(labelled) if u is not None and b is not None for w in [url_words(u)] for k in range(0, len(w), window)]
    wanted = max(least, -(-support * len(baskets) // 1))
    n, hit = Counter(), Counter()
    for items, b in baskets:
        for size in range(1, len(items) + 1):
            for s in itertools.combinations(items, size):
                n[s] += 1
                hit[s] += b
    rules = {s: hit[s] / n[s] for s in n if hit[s] >= wanted and hit[s] / n[s] >= confidence}
    return {s: c for s, c in rules.items() if not any(set(x) < set(s) for x in rules)}


def verdict(url, rules, given):
    host, path, _ = parts(url)
    fit = [(-len(h + p), h + p, v) for h, p, v in given if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, min(fit)[1], min(fit)[2], None
    met = [c for s, c in rules.items() if set(s) <= set(url_words(url))]
    return host, path, None, "block" if met else "allow", max(met, default=None)


def made_urls(seed=5, n=400):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        bad = rng.random() < 0.4
        host = rng.choice(["casino.win", "bets.casino.com", "News.example.com"] if bad else ["a.example.com", "news.example.com", "x.net", "example.net", "casino.example.com"])
        path = rng.choice(["/en/%d" % rng.randrange(99), "/de/Win", "/fr/a.html", "", "/en"])
        out.append((f"http://{host}{path}{rng.choice(['', '?ref=win', '#Top', '?q=/en/'])}", bad if rng.random() < 0.95 else not bad))
    return out


@pytest.mark.parametrize("window", [12, 3])
def test_url_rules_equal_brute_force(spark, window):
    labelled = made_urls() + [(None, True), ("http://x.com/", None), ("no scheme", True)] + [("http://hot.com/same", True)] * 50
    table = spark.createDataFrame(labelled, "url string, blocked boolean")
    rules = mined_rules(labelled, 0.02, 3, 0.7, window)
    mined = urlrules.mine(table, support=0.02, least=3, confidence=0.7, window=window)
    assert {tuple(r.words): r.confidence for r in mined.collect()} == rules and len(rules) > 1
    urls = [u for u, _ in made_urls(6, 150)] + [None, "", "x", "://", "http://", "HTTP://EXAMPLE.net/en/", "a://b://c/d", "http://a.net", "http://a.net/", "http://notexample.net/en/",
                                           "http://q.Org/fr/ü?x#y", "http://a.org/frx", "http://example.com?/de/", "http://long.example/" + "casino/win/" * 20_000] + ["http://hot.com/same"] * 40
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(None, None, None)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in urlrules.judge(pages, mined, urlrules.RULES).collect()}
    assert len(got) == len(urls) + 1
    for k, u in enumerate(urls):
        assert got[k] == verdict(u, rules, urlrules.RULES), u


def test_url_rules_of_empty_tables(spark):
    none = spark.createDataFrame([], "url string, blocked boolean")
    mined = urlrules.mine(none)
    assert mined.count() == 0
    pages = spark.createDataFrame([(1, "http://a.org/fr/x")], "page_id long, url string")
    assert [tuple(r) for r in urlrules.judge(pages, mined, []).collect()] == [(1, "a.org", "/fr/x", None, "allow", None)]
    assert urlrules.judge(pages.limit(0), mined, urlrules.RULES).count() == 0


# -- spelling variants -------------------------------------------------------

def plain_counts(rows, least_length=6, least_count=5):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least_length:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= least_count}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(n, ratio=5):
    out = {}
    for w, c in n.items():
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= ratio * c else None
        out[w] = [form, None, c, len(near), n[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def texts(seed, n=60):
    rng = random.Random(seed)
    stems = ["example", "spelling", "Überall", "aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "naïveté", "×÷×÷×÷"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(200):
            w = rng.choice(stems[:rng.randrange(1, len(stems) + 1)])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i * 37, rng.choice([" ", ", ", "1", "ł"]).join(words)))
    return rows + [(5, None), (6, ""), (None, "nullid " * 3000), (7, "same text repeated " * 40), (7, "same text repeated " * 40), (8, "w" * 30_000 + " " + "w" * 29_999)] * 5


@pytest.mark.parametrize("block", [1024, 4])
def test_variants_equal_brute_force(spark, block):
    rows = texts(2)
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(5)
    counts = spelling.word_counts(table)
    want = plain_counts(rows)
    assert {r.word: r.n for r in counts.collect()} == want
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(counts, block=block).collect()}
    assert got == plain_variants(want) and any(v[0] for v in got.values())


def test_hashed_runs_lose_a_code_point(spark):
    rows = [(i, "wordnumber" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) + " ") for i in range(4000)]
    rows = [(i, t * 5) for i, t in rows]
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_counts(rows) and {12, 13} == {len(w) for w in got}


def test_chains_of_forms_end_at_their_root(spark):
    words = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("aabbbb", 3125), ("abbbbb", 3000), ("zzzzzz", 5)]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == plain_variants(dict(words)) and got["aaaaaa"][:2] == ("aaaaab", "aabbbb")


def test_variants_of_empty_tables(spark):
    counts = spelling.word_counts(spark.createDataFrame([], "doc_id long, text string"))
    assert counts.count() == 0 and spelling.variants(counts).count() == 0


# -- edges of earlier operators ----------------------------------------------

def test_very_small_and_large_vectors_keep_their_neighbours(spark):
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(60, 4))
    scales = [10.0 ** float(e) for e in rng.choice([-170, -300, 0, 160, 250], size=60)]
    table = spark.createDataFrame([(i, [float(x) for x in v * s]) for i, (v, s) in enumerate(zip(plain, scales))], "vec_id long, embedding array<double>")
    got = neighbours.search(table, table.vec_id % 10 == 0, share=1.0).collect()
    unit = plain / np.sqrt((plain * plain).sum(1))[:, None]
    for q in range(0, 60, 10):
        cosine = unit @ unit[q]
        want = sorted((-c, i) for i, c in enumerate(cosine) if i != q)[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == [i for _, i in want]
        assert np.allclose([r.score for r in mine], [-c for c, _ in want], rtol=0, atol=1e-12)


def test_scaling_by_powers_of_two_changes_no_bit():
    v = np.random.default_rng(9).normal(size=(200, 64)).astype(np.float32).astype(np.float64)
    w = neighbours._scaled(v)
    plain = np.einsum("ij,j->i", v, v[0]) / (np.sqrt((v * v).sum(1)) * np.sqrt((v[0] * v[0]).sum()))
    assert (plain == np.einsum("ij,j->i", w, w[0]) / (np.sqrt((w * w).sum(1)) * np.sqrt((w[0] * w[0]).sum()))).all()


def test_addresses_with_thousands_of_digits():
    text = "1.2.3." + "0" * 5000 + "1 and 1.2.3." + "9" * 5000 + " and 0000.01.002.255"
    assert [(text[s:e][:8], k) for s, k, e in sanitize.base_spans(text) if k == 1] == [("1.2.3.00", 1), ("0000.01.", 1)]


def test_letters_of_the_last_planes_are_letters():
    points = language.Points()
    for text in ("\U00030000\U0003134A", "\U00031350\U000323AF", "\U00020000", "日本"):
        assert (points.of(text)[1] > 0).all()
    assert not (points.of("\U000E0041\U0010FFFD1 !")[1] > 0).any()
