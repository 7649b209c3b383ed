"""The operators of the training-data package on small fixtures, against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventloom.llm import (
    chat, components, decontaminate, hmm, language, mixing, neighbours, registry, sanitize, simhash, text as T, tokenbin, toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def _settings(spark):
    registry.settings(spark)


def docs(spark, rows, extra=""):
    return spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) if not extra else r for r in rows], DOCS + extra)


# -- decontamination ---------------------------------------------------------

def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def leaks(rows, items, n=10):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            grams.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in grams:
                    hit |= set(range(k, k + size))
                    found |= grams[tuple(w[k:k + size])]
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=repr)


ITEMS = [(1, " ".join(f"w{i}" for i in range(14))), (2, "short item Here"), (10, " ".join(f"W{i}" for i in range(3, 16))), (3, None), (4, "..."), (None, "no id item of four")]
LEAKY = [
    (1, "x " + " ".join(f"w{i}" for i in range(14)) + " y"), (2, "SHORT, item here short item here"), (3, None), (4, ""), (5, "clean text"),
    (6, " ".join(f"w{i}" for i in range(9))), (7, "no id; item OF four"), (7, "no id; item OF four"), (None, "short item here"), (8, "É" * 50_000 + " short item here"),
]


@pytest.mark.parametrize("max_set", [1000, 0])
def test_decontamination_equals_brute_force(spark, max_set):
    table = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.scan(docs(spark, LEAKY), table, max_set=max_set).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got], key=repr) == leaks(LEAKY, ITEMS)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


@pytest.mark.parametrize("max_set", [1000, 0])
def test_decontamination_removes(spark, max_set):
    table = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(i, t, None, None, None, "kept", 5) for i, t in LEAKY]
    given = docs(spark, rows, ", hits string, words int")
    kept = decontaminate.remove_documents(given, table, max_set=max_set)
    assert kept.columns == given.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6"]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(given, table, max_set=max_set).collect()}
    assert cut[1] == "x y" and cut[2] == "" and cut[5] == "clean text" and cut[3] is None and cut[8] == "É" * 50_000 + " "


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs(spark, []), spark.createDataFrame(ITEMS, none.schema)).count() == 0
    assert decontaminate.scan(docs(spark, LEAKY), none).where("contaminated").count() == 0


# -- SimHash -----------------------------------------------------------------

def simhash_of(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(grams))


def classes_of(pairs):
    """Smallest member reachable, by links of up to four bits."""
    label = {d: d for d, _ in pairs}
    changed = True
    while changed:
        changed = False
        for a, fa in pairs:
            for b, fb in pairs:
                if (fa ^ fb).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def near_texts():
    rng = np.random.default_rng(3)
    base = [" ".join(f"tok{x}" for x in rng.integers(0, 500, 300)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        for k in range(8):
            w = t.split()
            for at in rng.integers(0, 300, rng.integers(0, 3)):
                w[at] = "changed"
            rows.append((100 + i * 10 + k, " ".join(w).upper() if k % 2 else "\t".join(w)))
    return rows + [(900, None), (901, ""), (902, "  \n"), (903, "one two"), (904, "ONE two"), (905, "é " * 30_000)]


@pytest.mark.parametrize("dense", [simhash.DENSE, 1])
def test_simhash_equals_brute_force(spark, dense):
    rows = near_texts()
    want = {d: simhash_of(t) for d, t in rows}
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows), dense).collect()}
    assert {d: r.fp % (1 << 64) for d, r in got.items()} == want
    assert {d: r.component_id for d, r in got.items()} == classes_of(list(want.items()))


def test_simhash_odd_rows(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "lonely words"), (7, "p q"), (7, "totally other text here")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs(spark, rows)).collect())
    assert got == [("3", "3"), ("5", "3"), ("5", "3"), ("7", "7"), ("7", "7"), ("None", "3"), ("None", "None")]
    given = docs(spark, [(*r, None, None, None, {"k": 1}, 1) for r in rows], ", m map<string,int>, fp int")
    kept = simhash.keep_one(given)
    assert kept.columns == given.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "None", "None"]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_dense_members_are_linked_without_pairs():
    rng = np.random.default_rng(1)
    fps = set()
    for b in rng.integers(0, 2**63, 20):
        for _ in range(15):
            x = int(b)
            for k in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = simhash._spanning(len(fps), *np.nonzero(np.triu(near, 1)))
    a, b, left = [], [], set()
    for start in range(5):
        seg = simhash._segments(fps)[start]
        for v in np.unique(seg):
            at = np.flatnonzero(seg == v)
            if len(at) > 1:
                x, y, dense = simhash._group_links(fps[at], start, 2)
                a += at[x].tolist()
                b += at[y].tolist()
                left |= set(at[dense].tolist())
    pairs = [(x, y) for x in left for y in left if x < y and near[x, y]]
    got = simhash._spanning(len(fps), np.array(a + [p[0] for p in pairs]), np.array(b + [p[1] for p in pairs]))
    assert left and np.array_equal(got, want)


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200)]
    got = dict(tuple(r) for r in components.components(spark, spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[300] == got[200] == 200


# -- toxicity ----------------------------------------------------------------

def toxic_corpus():
    rng = np.random.default_rng(0)
    vocabulary = ["table", "window", "garden", "river", "morning", "paper", "letter", "stone", "winter", "market", "silver", "yellow"]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(vocabulary, 20))
        bad = i % 6 == 0
        if bad:
            w[int(rng.integers(0, 20))] = ["idiot", "moron", "stupid"][int(rng.integers(0, 3))]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


NOISY = {"1d10t": "idiot", "m0r0n": "moron", "$tup1d": "stupid", "stuuupid": "stupid", "i.d.i.o.t": "idiot", "id*ot": "idiot", "MORON!": "MORON!", "window": "window"}


def test_toxicity_sees_through_noise(spark):
    rows, labels = toxic_corpus()
    noisy = [(2000 + i, f"river stone {w} garden") for i, w in enumerate(NOISY)] + [(3000, "you m o r o n there"), (3001, None), (3002, ""), (None, "idiot"), (3003, "a " * 40_000)]
    given = docs(spark, rows + noisy)
    table = spark.createDataFrame([*labels, (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(given.select("doc_id", "text"), given, table).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) + len(noisy) and all(0 <= s <= 1 for s in score.values())
    held = [(i, bad) for i, _, bad in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((score[i] >= 0.7) == bool(bad) for i, bad in held)
    for i, w in enumerate(NOISY):
        assert (score[2000 + i] >= 0.7) == (w != "window"), w
    assert score[3000] >= 0.7 and score[None] >= 0.7 and max(score[3001], score[3002], score[3003]) < 0.7


def test_toxicity_learns_rare_words_and_counts_copies_once(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in ("lam", "ten", "sor", "vid") for b in ("ari", "ope", "uni") for c in ("sta", "lor", "den", "mik", "fes")]
    names = [f"{a}{b}" for a in ("zuk", "qir", "xob", "wyj", "pfa", "kru", "gno", "hja", "bwe", "yzo") for b in ("ax", "ept", "ulm", "ord", "iff", "yng", "osk", "ebb")]
    rows, labels = [], []
    for i in range(9000):
        w = list(rng.choice(words, 25))
        bad = i % 3 == 0
        if bad:
            w[int(rng.integers(0, 25))] = names[i // 3 % len(names)]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    for i in range(9000, 9400):  # edited copies of one toxic text share a word
        w = ["calm", "stagnant", "waterfall", "behind", "narrow", "bridges", "under", words[i % 60]]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, 1))
    rows += [(20_000, "lamarista waterfall tenopelor"), *((30_000 + k, f"lamarista {w} tenopelor") for k, w in enumerate(names))]
    given = docs(spark, rows)
    score = {r.doc_id: r.score for r in toxicity.toxicity(given.select("doc_id", "text"), given, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    # Each of the 80 words stands in little over one in a hundred toxic rows.
    assert [w for k, w in enumerate(names) if score[30_000 + k] < 0.7] == []
    assert score[20_000] < 0.7


def test_toxicity_sees_spaced_and_broken_words(spark):
    rows, labels = toxic_corpus()
    forms = ["i  d  i  o  t", "i . d . i . o . t", "i, d, i, o, t", "i - d - i - o - t", "i\u00a0d\u00a0i\u00a0o\u00a0t", "id iot", "idi-ot", "id - iot", "1d 10t", "i di ot", "stu pid", "mo - r0n"]
    clean = ["id est", "stu dio", "r  i  v  e  r", "win dow", "1 2 3"]
    noisy = [(5000 + k, f"river stone {w} garden") for k, w in enumerate(forms)] + [(6000 + k, f"river stone {w} garden") for k, w in enumerate(clean)]
    given = docs(spark, rows + noisy)
    got = toxicity.toxicity(given.select("doc_id", "text"), given, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    score = {r.doc_id: r.score for r in got.where("doc_id >= 5000").collect()}
    assert [w for k, w in enumerate(forms) if score[5000 + k] < 0.7] == []
    assert [w for k, w in enumerate(clean) if score[6000 + k] >= 0.7] == []


def test_toxicity_filter_and_empty_tables(spark):
    rows, labels = toxic_corpus()
    given = docs(spark, [(*r, None, None, None, 1.0, "x") for r in rows], ", score double, _row string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = toxicity.reject_toxic(given, table)
    assert kept.columns == given.columns and {r.doc_id for r in kept.collect()} == {i for i, _, bad in labels if not bad}
    none = table.limit(0)
    assert toxicity.reject_toxic(given, none).count() == len(rows)
    assert toxicity.reject_toxic(given.limit(0), table).count() == 0


def test_decoder_restores_words(spark):
    rows, _ = toxic_corpus()
    logp = toxicity.character_model(docs(spark, rows))
    assert {w: toxicity.restore_token(w, logp) for w in NOISY} == NOISY
    assert toxicity.restore("the i d i o t there", logp) == "the idiot there" and toxicity.restore(None, logp) == ""


# -- mixing ------------------------------------------------------------------

def mixture(spark, sizes, **kwargs):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, "w " * 10, None, source))
            i += 1
    given = docs(spark, rows)
    return given, mixing.mix(given, block_tokens=50, **kwargs)


def test_mixing_meets_the_repetition_limit(spark):
    given, mixed = mixture(spark, {"a": 600, "b": 100, "c": 50, None: 30}, max_repeats=2.0)
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got["a"] == 600 and got[None] == 60  # least repeated once, most repeated twice
    a = math.log(2) / math.log(20)
    for source, n in (("b", 100), ("c", 50)):
        assert abs(got[source] - n * (600 / n) ** a) <= 1
    epochs = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("_epoch").alias("e")).collect()
    assert len(epochs) == given.count() and all(r.n == r.e <= 2 for r in epochs)


def test_mixing_meets_an_entropy_and_a_budget(spark):
    sizes = spark.createDataFrame([("a", 8000, 1), ("b", 1000, 1), ("c", 1000, 1)], "source string, tokens long, docs long")
    plan = mixing.plan(sizes, entropy=1.0, budget=5000.0).collect()
    w = [r.weight for r in plan]
    assert abs(sum(w) - 1) < 1e-9 and abs(-sum(x * math.log(x) for x in w) - 1.0) < 1e-4
    assert abs(sum(r.repeats * r.tokens for r in plan) - 5000) < 1e-6


def test_mixing_is_repeatable_and_takes_odd_rows(spark):
    rows = [(1, "a b", None, "s", None, {"k": 1}, 9), (1, "a b", None, "s", None, {"k": 1}, 9), (2, None, None, "s", None, None, 9), (3, "", None, None, None, None, 9), (None, "x y z", None, "t", None, None, 9)]
    given = docs(spark, rows, ", m map<string,int>, tokens int")
    one, two = (sorted(str(r) for r in mixing.mix(given).collect()) for _ in range(2))
    assert one == two and len(one) >= 5 and mixing.mix(given).columns == [*given.columns, "_epoch"]
    assert mixing.mix(given.limit(0)).count() == 0


# -- token shards ------------------------------------------------------------

@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 5, 5, 1 << 40], list(range(1000)), sorted(np.random.default_rng(2).integers(0, 1 << 45, 3000).tolist())])
def test_elias_fano_round_trip(values):
    code = tokenbin.EliasFano(tokenbin.EliasFano.encode(np.array(values, dtype=np.uint64)))
    assert code.values().tolist() == values and [code[i] for i in range(len(values))] == values
    assert len(tokenbin.EliasFano(tokenbin.EliasFano.encode(np.array([], dtype=np.uint64)))) == 0


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(4).integers(1, 2000, 50_000))
    assert len(tokenbin.EliasFano.encode(values)) * 8 / len(values) < 2.5 + math.log2(1000)


ODD_TEXTS = ["", None, "a  b", " lead", "trail ", "tab\tx \n y", "nb sp ace", "a ᠎ b", "<|endoftext|> mid<|endoftext|>dle", "don't we'll", "line\nbreak", "é" * 3000 + " x", "日本 語", "1 22 333", "  \x1c z"]


def test_pieces_encode_like_whole_texts():
    from tokenizers import Tokenizer

    path = tokenbin.default_tokenizer()
    whole, own = Tokenizer.from_file(path), tokenbin.Encoder(path)
    assert own.in_pieces and own.width == 2
    for t in ODD_TEXTS:
        assert np.frombuffer(own.encode(t or ""), "<u2").tolist() == whole.encode(t or "", add_special_tokens=False).ids, t
    rng = np.random.default_rng(13)
    for _ in range(3000):
        t = "".join(rng.choice(list("aBé .,\n'!1\u00a0日s\t|<>"), rng.integers(0, 25)))
        assert np.frombuffer(own.encode(t), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_of_very_many_lines():
    from tokenizers import Tokenizer

    path = tokenbin.default_tokenizer()
    whole, own = Tokenizer.from_file(path), tokenbin.Encoder(path)
    for t in ("\n".join(f"w{i % 1000}/x." for i in range(100_000)), "lead " + "\n".join("日本語" for _ in range(100_000)), "a\nb\n\nc\nd!\n", "x\ny\n1\n.\nz"):
        assert np.frombuffer(own.encode(t), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert sum(map(len, [*own.bare.known, *own.spaced.known])) < 5_000_000


def test_token_shards_read_back(spark, folder):
    from tokenizers import Tokenizer

    rows = [(i * 7 - 20, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (1, "again"), (1, "again"), (1 << 60, "far")]
    path = tokenbin.default_tokenizer()
    tokenbin.write_shards(docs(spark, rows).repartition(3), path, folder, shard_bytes=64)
    with open(f"{folder}/shards/stray.ids", "wb") as f:
        f.write(b"left by a lost task")
    got = tokenbin.read_documents(spark, folder).orderBy("start").collect()
    whole, start = Tokenizer.from_file(path), 0
    for (i, t), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), got, strict=True):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenbin.encode_corpus(docs(spark, [])).count() == 0


# -- personal data -----------------------------------------------------------

def base_by_pattern(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if least <= len(d) <= most and (kind == 3 or sanitize.luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        t = "".join(rng.choice(list("aB1.@+- ()25é\n%_0"), rng.integers(0, 40)))
        assert sanitize.base_spans(t) == base_by_pattern(t), t
    t = "mail a.b@c.de, x@y, card 4111 1111 1111 1111 ip 10.0.0.256 1.2.3.4.5 tel +1 (415) 555-2671"
    assert sanitize.base_spans(t) == base_by_pattern(t) and sanitize.base_spans("1" * 100_000 + "@" + "a" * 100_000) is not None


def test_terms_that_reveal_are_marked_everywhere(spark):
    rng = np.random.default_rng(6)
    filler = [f"word{i}" for i in range(60)]

    def some(n):
        return " ".join(rng.choice(filler, n))

    rows = [(i, f"{some(12)} Zorblat {some(3)} contact joe@ex.org {some(12)}") for i in range(6)]
    rows += [(10 + i, some(30) + " contact") for i in range(40)] + [(60, f"{some(5)} zorblat {some(30)}")]
    rows += [(70 + i, "copied unique context around sue@ex.org every time") for i in range(5)] + [(80, None), (81, ""), (None, "joe@ex.org"), (82, "x " * 50_000)]
    found = {r.doc_id: r.spans for r in sanitize.find(docs(spark, rows)).collect()}
    terms = {d: [t for t in s if t.kind == sanitize.TERM] for d, s in found.items()}
    assert all(len(terms[i]) == 1 for i in range(6)) and len(terms[60]) == 1  # also away from the address
    text = dict(rows)
    assert {text[d][t.start:t.end].lower() for d, ts in terms.items() for t in ts} == {"zorblat"}
    assert not any(terms[70 + i] for i in range(5))  # copies of one context are one piece of evidence
    clean = {r.doc_id: r.text for r in sanitize.sanitized(docs(spark, rows)).collect()}
    assert "joe@ex.org" not in clean[0] and "[EMAIL]" in clean[0] and "orblat" not in clean[60] and clean[80] == "" and clean[10] == text[10]
    assert sanitize.find(docs(spark, [])).count() == 0


# -- language model ----------------------------------------------------------

def hmm_corpus():
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        side = i % 2
        rows.append((i, " ".join(f"{'ab'[side]}{x}" for x in np.minimum(rng.geometric(0.05, 40), 60))))
    return rows + [(1000, None), (1001, ""), (None, "a1 b1 never"), (1002, "a1 " * 9000), (1002, "a1 " * 9000)]


@pytest.mark.parametrize("head", [hmm.HEAD, 20])
def test_language_model_beats_single_words(spark, head):
    rows = hmm_corpus()
    given = docs(spark, rows)
    part = T.remainder("doc_id", 5)
    got = hmm.score_corpus(given, part != 1, part == 1, states=4, iterations=6, head=head, tail=16).collect()
    tokens = {i: T.white_words(t) + [hmm.END] for i, t in rows}
    counts = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(T.white_words(t) + [hmm.END])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[r.doc_id])
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(tokens[r.doc_id]), sum(counts[w] > 0 for w in tokens[r.doc_id]))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + 5 * len(held)


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(8)
    model = hmm.first_model(rng.dirichlet(np.ones(5)), states=3)
    for length in (1, 2, 5):
        x = rng.integers(0, 5, length).astype(np.int32)
        total = 0.0
        for path in np.ndindex(*[3] * length):
            p = model.start[path[0]] * model.emit[x[0], path[0]]
            for t in range(1, length):
                p *= model.move[path[t - 1], path[t]] * model.emit[x[t], path[t]]
            total += p
        assert abs(hmm.forward([x, np.array([0], np.int32)], model)[0] - math.log(total)) < 1e-9


def test_training_raises_the_likelihood(spark):
    given = docs(spark, hmm_corpus()).withColumn("row", F.monotonically_increasing_id()).withColumn("held_out", F.lit(False)).withColumn("trained", F.lit(True))
    vocab, _ = hmm.vocabulary(hmm.word_counts(given), 1000, 8)
    encoded = hmm.encode(given, spark.sparkContext.broadcast(vocab), 8)
    _, seen = hmm.train(encoded, vocab, states=3, iterations=5)
    assert all(b > a for a, b in zip(seen, seen[1:]))
    plain = vocab.plain
    assert abs(plain.sum() - 1) < 1e-9


def test_language_model_without_training_rows(spark):
    got = hmm.score_corpus(docs(spark, [(1, "a b"), (2, None)]), F.lit(False), F.lit(True), states=2, iterations=2).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)
    assert hmm.score_corpus(docs(spark, []), F.lit(True), F.lit(False), states=2, iterations=1).count() == 0


# -- language ----------------------------------------------------------------

EN = "the house and the garden are with this that from which there have been other people"
DE = "das haus und der garten sind mit diesem dass von welche dort haben andere leute nicht"
RU = "дом и сад были здесь когда люди пришли сюда вчера вечером"


def tongues():
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        lang, base = [("en", EN), ("de", DE), ("ru", RU)][i % 3]
        rows.append((i, " ".join(rng.choice(base.split(), 15)), lang))
    return rows


def best_path(scores, switch):
    value, back = scores[:, 0].copy(), []
    for t in range(1, scores.shape[1]):
        step = value[:, None] - switch * (1 - np.eye(len(value)))
        back.append(step.argmax(0))
        value = step.max(0) + scores[:, t]
    return value.max()


def cost(scores, path, switch):
    return scores[path, np.arange(len(path))].sum() - switch * np.count_nonzero(np.diff(path))


def test_word_labels_are_the_best_path():
    rng = np.random.default_rng(10)
    for _ in range(200):
        scores = rng.normal(0, 10, (int(rng.integers(1, 4)), int(rng.integers(1, 12))))
        path = language.label_words(scores, 8.0)
        assert abs(cost(scores, path, 8.0) - best_path(scores, 8.0)) < 1e-9


def test_languages_and_spans(spark):
    rows = tongues() + [(1000, None, None), (1001, "123 !!", "en"), (1002, "", "en"), (None, EN, None), (1003, f"{EN} {EN} {DE} {DE} {DE}", None), (1004, "ß" + "x" * 50_000, None)]
    given = docs(spark, rows)
    model = language.fit(given, T.remainder("doc_id", 4) != 2)
    assert model.langs == ["de", "en", "ru"]
    got = {r.doc_id: r for r in language.label_documents(given, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in tongues()) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[None].lang_pred == "en"
    mixed = got[1003]
    assert mixed.lang_pred == "de" and [s.lang for s in mixed.spans] == ["en", "de"]
    assert abs(mixed.spans[1].start - len(f"{EN} {EN} ")) <= 12 and mixed.score < 0.8
    empty = language.fit(given.limit(0), F.lit(True))
    assert language.label_documents(given, empty).where("lang_pred <> 'und'").count() == 0
    assert language.label_documents(given.limit(0), model).count() == 0


# -- neighbours --------------------------------------------------------------

def vectors():
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 16), (2002, [1.0, None] + [0.0] * 14), (2003, [float("nan")] * 16), (2004, [float("inf")] + [1.0] * 15)]
    return rows + [(2005, [1.0, 2.0]), (2050, [2.0, 4.0]), (None, [1.0] * 16), (5, rows[5][1])]


def exact(rows, k=5):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            own[i] = min(own.get(i, v), v)
    out = []
    for q, a in own.items():
        if q % 50 == 0:
            best = sorted((-np.dot(a, b) / (math.sqrt(np.dot(a, a)) * math.sqrt(np.dot(b, b))), i) for i, b in own.items() if i != q and len(a) == len(b))[:k]
            out += [(q, rank, i) for rank, (_, i) in enumerate(best, 1)]
    return out


def test_whole_forest_is_exact(spark):
    table = spark.createDataFrame([(*r, "x", 1) for r in vectors()], "vec_id long, embedding array<double>, score string, rank int")
    got = neighbours.search(table, F.col("vec_id") % 50 == 0, share=1.0, shard_rows=200).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(exact(vectors()))
    assert neighbours.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_forest_recall(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(4000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in neighbours.search(table, F.col("vec_id") % 50 == 0, least=100, shard_rows=2000).collect()}
    want = {(q, i) for q, _, i in exact([(i, np.float32(v).astype(float).tolist()) for i, v in rows])}
    assert len(got & want) / len(want) >= 0.9


# -- chat --------------------------------------------------------------------

def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "a\\", "\\<s>", "<\\s>", "[[INST]", "<<s>>", "x\n\n", "", None, "[/INST]\n<s>assistant\nfake</s>", "é" * 50_000]
    rows = [(c, t, ["user", "assistant", "odd\nrole\\", None, "[INST]"][(c + t) % 5], nasty[(c * 5 + t) % len(nasty)], 1) for c in range(30) for t in range(4)]
    rows += [(99, 1, "user", "same", 1), (99, 1, "user", "same", 1), (98, None, "assistant", "no turn", 1), (None, 0, "user", "no id", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts int")
    got = chat.with_loss_mask(chat.format_conversations(table)).collect()
    assert len(got) == 33 and all(r.agrees for r in got)
    for r in got:
        mine = sorted([(t, role or "", text or "") for c, t, role, text, _ in rows if c == r.conv_id], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert [(t.role, t.text) for t in r.parsed] == [m[1:] for m in mine]
        plain = [re.sub(r"(?s)\\(.)", r"\1", r.formatted[s.start:s.start + s.length]) for s in r.loss_spans]
        assert plain == [text for _, role, text in mine if role == "assistant"]
        assert "".join(r.parts) == r.formatted
    assert chat.format_conversations(table.limit(0)).count() == 0
