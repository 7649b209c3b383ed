"""Decoding of look-alike signs against an enumeration of all lattice paths."""

import itertools
import math
import random

import numpy as np

from eventloom.llm import toxicity


def model(seed=1):
    raw = np.random.default_rng(seed).gamma(0.3, size=(64, 64, 64)) + 1e-6
    return np.log(raw / raw.sum(2, keepdims=True)).astype(np.float32)


def cost(text, channel, logp):
    """Log likelihood of a spelling (with spaces) and its channel costs."""
    a = b = 0
    total = channel
    for c in text + " ":
        k = 0 if c == " " else toxicity.CLASS.get(c, toxicity.OTHER)
        total += float(logp[a, b, k])
        a, b = b, k
    return total


def paths(token, breaks):
    """(spelling, channel cost) of every way through the lattice."""
    for way in itertools.product(*toxicity.lattice(token)):
        channel, letters = sum(c for _, c in way), [x for x, _ in way]
        gaps = itertools.product(("", " "), repeat=len(letters) - 1) if breaks else [("",) * (len(letters) - 1)]
        for gap in gaps:
            yield "".join(x + g for x, g in zip(letters, [*gap, ""])), channel


TOKENS = ["id1ot", "1d1o7", "h3lloo", "aaab", "$tup1d", "l0sserr", "(1ub", "ab!!c", "x", "11", "t*p", "zzz99"]


def test_decode_takes_the_best_path():
    for seed, token, breaks in itertools.product((1, 2), TOKENS, (False, True)):
        logp = model(seed)
        best = max(cost(t, c, logp) for t, c in paths(token, breaks))
        got = toxicity.decode(toxicity.lattice(token), logp, breaks)
        mine = max(cost(t, c, logp) for t, c in paths(token, breaks) if t == got)
        # A Viterbi state is the last two classes, so without repeated letters it is exact.
        assert math.isclose(mine, best, abs_tol=1e-3), (token, breaks, got)


def test_spells_equals_an_enumeration():
    rng = random.Random(3)
    words = {b"idiot", b"loser", b"clown", b"aab", b"\xc3\xa9t\xc3\xa9", b"tt"}
    trie = toxicity.word_trie(words)
    known = {w.decode() for w in words}
    starts = {w[:k] for w in known for k in range(len(w) + 1)}
    tokens = TOKENS + ["1d1ot", "idi0t", "*diot", "l05er", "c1*wn", "iidiot", "aaab", "4ab", "é7é", "77", "t7", "t^t", "^", "id", "idiots"]
    tokens += ["".join(rng.choice("idotls10$5c4ab+é^") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    for token in tokens:
        made = {t for t, _ in paths(token, False)} if toxicity.lattice(token) else {""}
        got = toxicity.spells(token, trie)
        assert (got is True) == bool(made & known) and (got is None) == (not any(t in starts for t in made)), token


def test_windows_are_those_of_a_full_decoding():
    """Fragments beside a token with signs: all windows decoded, without the trie."""
    logp, rng = model(4), random.Random(5)
    strong = {b"idiot", b"loser", b"clown"}
    told = toxicity.Told({}, strong)
    pieces = [b"id", b"1", b"ot", b"i", b"d1ot", b"l0s", b"er", b"c", b"10wn", b"cl", b"own", b"x$y", b"the", b"12", b"@", b"idi"]
    found = 0
    for _ in range(300):
        parts = [rng.choice(pieces) for _ in range(rng.randrange(1, 9))]
        features = toxicity.Features(logp)
        want = set()
        for lo in range(len(parts)):
            for hi in range(lo + 1, min(len(parts), lo + toxicity.FRAGMENTS) + 1):
                whole = b"".join(parts[lo:hi])
                sign = any(features.opens(t) for t in parts[lo:hi])
                if (sign or (hi > lo + 1 and whole in strong and features.restored(whole).encode() == whole)) and features.restored(whole).encode() in strong:
                    want.add(features.restored(whole).encode())
        signs = {t for t in parts if features.opens(t)}
        assert features.together(parts, set(parts), signs, told) == want
        found += bool(want)
    assert found > 3
