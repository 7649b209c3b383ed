"""Toxicity of texts behind leetspeak, spacing and repetition.

1. A character trigram model is counted over all documents (letters in 64
   classes, so at most 64^3 counts leave any task).
2. A token that mixes letters with look-alike signs, repeats letters three
   times or more, or is spelt letter by letter is read as noise over a clean
   spelling: each sign opens its possible letters, a run opens one or two
   letters, a spelt-out word may break anywhere. Viterbi decoding of that
   lattice under the character model gives the restored spelling.
3. Words and word beginnings of restored texts are counted by label over all
   different labelled training texts (a text once per label). A feature is kept
   if its log-likelihood ratio is beyond what chance gives among all features
   seen (2 ln of their number), however rare or mixed it is. What edited copies
   share is one piece of evidence: a kept feature counts at most once for each
   label and pair of neighbouring tokens, and has to be beyond chance with these
   counts as well. Its weight is its log ratio, of either sign, drawn towards 0.
4. A text's evidence is the sum of the weights of its distinct words, and the
   strongest one alone (a sum of weak ones does not outdo it); a word
   without a weight of its own takes that of its most telling beginning. Words
   broken in two to four are put together where the whole is a strongly telling
   word and the character model does not break it.
5. The training texts, each summed without its own share in the counts, give the
   share of toxic ones by evidence, made to rise throughout (pooled adjacent
   violators): the score of a text is the larger of the shares at its sum and at
   its strongest word.

Labels, language, source and id are no inputs of a score. Label counts use
every labelled training row; the kept features are the ``MAX_FEATURES`` most
telling ones, a bound on the model only.

Defined cases: null and empty texts have no words and get the score of no
evidence; a null id is never held out and never learnt from; null labels are
left out; a text with both labels counts once for each; without labels of both
kinds all texts score 0.02; repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from eventloom.llm.registry import query, table
from eventloom.llm.text import remainder, shuffle_partitions, sorted_runs, write_read
from eventloom.session import shared_dir

THRESHOLD = 0.7
MAX_FEATURES = 20_000
# Labels are broadcast up to this many rows (12 bytes each), joined by shuffle beyond.
BROADCAST_LABELS = 500_000
# Numbers of (feature, label, context) that one bucket of a shuffle is to hold.
BUCKET_CODES = 20_000_000
PREFIXES = (4, 5, 6)
# Tokens a worker remembers: those that return are common, the rest only costs memory.
MEMO = 100_000
# Score where nothing can be learnt.
UNKNOWN = 0.02
# Pseudo-rows that draw a ratio towards 0.
SHRINK = 2.0
# Least weight of a word that may be put together from fragments, and most fragments.
STRONG, FRAGMENTS = math.log(10), 4
# Evidence is held in steps of 1/STEPS between the bounds where shares are learnt.
STEPS, LEAST, MOST = 10, -100.0, 300.0

# Letters that get a class of their own (0 is the word border, 63 any other letter) ...
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß"
# ... and the letters a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il",
    "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "abcdefghijklmnopqrstuvwxyz", "#": "h", "?": "abcdefghijklmnopqrstuvwxyz",
}
SIGN_LETTERS = frozenset(SIGNS)
CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}
OTHER = 63

TRIM_FRONT = "\"'([{<*#%&~_-.,;:=/\\"
TRIM_BACK = "\"')]}>*#%&~_-.,;:!?=/\\|"
MIXED = re.compile(r"[^\W\d_].*[0-9@$!|+(<€£*#?]|[0-9@$!|+(<€£*#?].*[^\W\d_]", re.S)
REPEATED = re.compile(r"([^\W\d_])\1\1")
# Bytes that part tokens: white space and marks that stand for no letter.
PARTS = bytes(b if chr(b) not in " \t\n\r\v\f.,;:?\"')]}{[>%&~_-=/\\^`" else 32 for b in range(256))
LETTER = rb"(?:[!-~]|[\xc2-\xdf][\x80-\xbf])"
SPELT_OUT = re.compile(rb" " + LETTER + rb"(?: " + LETTER + rb"){2,}(?= )")
WIDE = (b"\xc2\xa0", b"\xe2\x80", b"\xe3\x80\x80")
BLANK = re.compile(rb"\xc2\xa0|\xe2\x80[\x80-\x8a\xaf]|\xe3\x80\x80")
TRIPLE = re.compile(rb"([a-z])\1\1")
DOTTED = re.compile(r"\w(?:[._\-]\w){2,}")
SPELT = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
WORDS = re.compile(r"[^\W_]+")


# -- character model ---------------------------------------------------------

def _class_table() -> np.ndarray:
    """Class of each code point below 0x250; above that letters are OTHER."""
    out = np.zeros(0x250, np.int64)
    for point in range(0x250):
        c = chr(point).lower()
        if c.isalpha():
            out[point] = CLASS.get(c[0], OTHER)
    return out


def classes(text: str, table_: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < 0x250, table_[np.minimum(points, 0x24F)], OTHER)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(code, n): character trigrams of all texts; code is c1*4096 + c2*64 + c3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, total = _class_table(), np.zeros(64**3, np.int64)
        held: list[str] = []
        size = 0

        def count() -> None:
            # Borders at either end and between texts; what spans two texts has a border in its middle.
            c = classes(" " + "  ".join(held) + " ", kinds)
            code = c[:-2] * 4096 + c[1:-1] * 64 + c[2:]
            total[:] += np.bincount(code, minlength=64**3)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                # A long text goes piece by piece; a cut acts as a word border.
                for lo in range(0, len(text or ""), 1 << 20):
                    held.append(text[lo:lo + (1 << 20)])
                    size += len(held[-1])
                    if size >= 1 << 20:
                        count()
                        held, size = [], 0
        if held:
            count()
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    schema = StructType([StructField("code", LongType()), StructField("n", LongType())])
    return docs.select("text").mapInArrow(run, schema).groupBy("code").agg(F.sum("n").alias("n"))


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(c3 | c1, c2), interpolated with shorter contexts; 64 x 64 x 64."""
    counts = np.zeros(64**3)
    for row in trigram_counts(docs).collect():  # at most 64^3 rows
        counts[row["code"]] = row["n"]
    counts = counts.reshape(64, 64, 64)
    two, one = counts.sum(0), counts.sum((0, 1))
    p1 = (one + 0.5) / (one.sum() + 32)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (counts + 20 * p2[None]) / (counts.sum(2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32)


# -- decoding ----------------------------------------------------------------

def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters the possible letters with the channel's log cost."""
    out = []
    i = 0
    token = token.lower()
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        c, run = token[i], j - i
        letters = SIGNS.get(c) or (c if c.isalpha() else "")
        sign = 0.0 if c.isalpha() else -0.5 - math.log(max(1, len(letters)))
        options = []
        for letter in letters:
            options.append((letter, sign - (0.0 if run == 1 else 4.0 if run == 2 else 0.3)))
            if run > 1:
                options.append((letter * 2, sign - (0.0 if run == 2 else 0.7)))
        if options:
            out.append(options)
        i = j
    return out


def decode(steps: list[list[tuple[str, float]]], logp: np.ndarray, breaks: bool = False) -> str:
    """Most likely clean spelling of a lattice; with ``breaks`` it may hold spaces."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in steps:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (c1, c2), (score, path) in best.items():
            starts = [(c1, c2, score, path)]
            if breaks and c2:
                starts.append((c2, 0, score + float(logp[c1, c2, 0]), (path, " ")))
            for p1, p2, base, way in starts:
                for letters, cost in options:
                    a, b, value = p1, p2, base + cost
                    for letter in letters:
                        k = CLASS.get(letter, OTHER)
                        value += float(logp[a, b, k])
                        a, b = b, k
                    if (a, b) not in new or new[a, b][0] < value:
                        new[a, b] = (value, (way, letters))
        best = new
    end, back = -math.inf, ()
    for (c1, c2), (score, path) in best.items():
        value = score + float(logp[c1, c2, 0])
        if value > end:
            end, back = value, path
    parts = []
    while back:
        back, letters = back
        parts.append(letters)
    return "".join(reversed(parts))


def restore_token(token: str, logp: np.ndarray) -> str:
    """A token between white space with its noise taken out."""
    core = token.lstrip(TRIM_FRONT).rstrip(TRIM_BACK)
    if DOTTED.fullmatch(core) and not core.isdigit():
        return decode(lattice(re.sub(r"[._\-]", "", core)), logp, breaks=True)
    if not MIXED.search(core) and not REPEATED.search(core):
        return token
    return " ".join(decode(lattice(part), logp) if MIXED.search(part) or REPEATED.search(part) else part for part in re.split(r"[.,;:/\\_\-=]+", core))


def restore(text: str | None, logp: np.ndarray) -> str:
    """The whole text, noisy tokens and spelt-out words decoded."""
    if not text:
        return ""

    def spelt(m: re.Match) -> str:
        joined = re.sub(r"\s", "", m.group())
        return decode(lattice(joined), logp, breaks=True) if any(c.isalpha() for c in joined) else m.group()

    text = SPELT.sub(spelt, text)
    return re.sub(r"\S+", lambda m: restore_token(m.group(), logp), text)


def word_features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *[f"{word[:k]}~" for k in PREFIXES if len(word) > k]]


def token_words(token: bytes, logp: np.ndarray) -> list[str]:
    """Lower-case words of a token, restored."""
    if token.isalpha() and not TRIPLE.search(token):
        return [token.decode()]
    text = token.decode("utf-8", "replace").lower()
    if text.isalpha() and not REPEATED.search(text):
        return [text]
    return WORDS.findall(restore_token(text, logp).lower())


def word_weight(word: str, weights: dict[str, float]) -> float:
    """Log likelihood ratio of a word: its own, or else that of its most telling beginning."""
    if word in weights:
        return weights[word]
    return max((weights[f] for f in word_features(word)[1:] if f in weights), key=abs, default=0.0)


class Told:
    """The weights of a model, as texts are looked up in them."""

    def __init__(self, weights: dict[str, float], strong: set[bytes]):
        self.weights, self.strong, self.trie = weights, strong, word_trie(strong)
        # What a word with a known beginning starts with, and what a strong word in fragments does.
        self.heads = {f[:PREFIXES[0]] for f in weights if f.endswith("~")}
        self.starts = {w[:k] for w in strong for k in range(1, len(w))}

    def weight(self, word: str) -> float:
        own = self.weights.get(word)
        if own is not None:
            return own
        return word_weight(word, self.weights) if word[:PREFIXES[0]] in self.heads else 0.0


def word_trie(words: set[bytes]) -> dict:
    """Letters as nested keys; the empty key ends a word."""
    root: dict = {}
    for word in words:
        node = root
        for c in word.decode("utf-8", "replace"):
            node = node.setdefault(c, {})
        node[""] = {}
    return root


def spells(token: str, trie: dict) -> bool | None:
    """Whether the lattice of a token (without breaks) can spell a word of the trie; None if not even the beginning of one."""
    nodes = [trie]
    i, size = 0, len(token)
    while i < size:
        c, j = token[i], i + 1
        while j < size and token[j] == c:
            j += 1
        letters = SIGNS.get(c) or (c if c.isalpha() else "")
        if letters:
            after = []
            for node in nodes:
                for letter in letters:
                    child = node.get(letter)
                    if child is not None:
                        after.append(child)
                        if j - i > 1 and letter in child:
                            after.append(child[letter])
            if not after:
                return None
            nodes = after
        i = j
    return any("" in node for node in nodes)


class Features:
    """Distinct features of a text; what a token gives is remembered within a worker."""

    def __init__(self, logp: np.ndarray):
        self.logp = logp
        self.memo: dict[bytes, tuple] = {}
        self.whole: dict[bytes, str] = {}
        self.dull: set[bytes] = set()

    def parts(self, text: str) -> list[bytes]:
        """Tokens in order, A-Z lower-cased."""
        data = text.encode("utf-8", "surrogatepass").lower()
        if any(w in data for w in WIDE):
            data = BLANK.sub(b" ", data)
        return data.translate(PARTS).split()

    def spelt(self, parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words spelt letter by letter, decoded, and what stands around them; blanks and marks between letters may be any."""
        data = b" " + b" ".join(parts) + b" "
        for m in SPELT_OUT.finditer(data):
            joined = m.group().replace(b" ", b"").decode("utf-8", "replace")
            if any(c.isalpha() for c in joined):
                around = data[max(0, m.start() - 8):m.start()] + b" " + data[m.end():m.end() + 8]
                for token in decode(lattice(joined), self.logp, breaks=True).encode().split():
                    yield token, around

    def tokens(self, text: str) -> set[bytes]:
        """Distinct tokens and words spelt letter by letter."""
        parts = self.parts(text)
        return {*parts, *(token for token, _ in self.spelt(parts))}

    def known(self, token: bytes, make) -> tuple:
        known = self.memo.get(token)
        if known is None:
            known = make(token)
            # Common tokens come early: what is full stays, it is not emptied.
            if len(self.memo) < MEMO:
                self.memo[token] = known
        return known

    def words(self, token: bytes) -> list[str]:
        return token_words(token, self.logp)

    def of(self, text: str | None) -> set[str]:
        """Distinct features."""
        found: set[str] = set()
        memo = self.memo
        for token in self.tokens(text) if text else ():
            own = memo.get(token)
            if own is None:
                own = self.known(token, lambda t: tuple(f for w in self.words(t) for f in word_features(w)))
            found.update(own)
        return found

    def placed(self, text: str | None, kept: set[str]) -> tuple[dict[str, int], dict[str, int]]:
        """Words and features among ``kept``, each with a hash of the tokens beside its first place."""
        words: dict[str, int] = {}
        found: dict[str, int] = {}
        if not text:
            return words, found

        def make(token: bytes) -> tuple:
            out = ((w, tuple(f for f in word_features(w) if f in kept)) for w in self.words(token))
            return tuple((w, own) for w, own in out if own)

        def put(token: bytes, around: bytes) -> None:
            for word, own in self.known(token, make):
                context = zlib.crc32(around)
                words.setdefault(word, context)
                for f in own:
                    found.setdefault(f, context)

        parts = self.parts(text)
        seen: set[bytes] = set()
        for before, token, after in zip([b"", *parts], parts, [*parts[1:], b""]):
            if token not in seen:
                seen.add(token)
                put(token, before + b" " + after)
        for token, around in self.spelt(parts):
            put(token, around)
        return words, found

    @staticmethod
    def opens(token: bytes) -> bool:
        """A token that holds signs, but no plain number."""
        return not token.isalpha() and not token.isdigit() and not SIGN_LETTERS.isdisjoint(token.decode("utf-8", "replace"))

    def restored(self, joined: bytes) -> str:
        """Fragments put together, as the lattice with breaks has them."""
        known = self.whole.get(joined)
        if known is None:
            known = decode(lattice(joined.decode("utf-8", "replace")), self.logp, breaks=True)
            if len(self.whole) < MEMO:
                self.whole[joined] = known
        return known

    def together(self, parts: list[bytes], distinct: set[bytes], signs: set[bytes], told: Told) -> set[bytes]:
        """Strong words that stand in fragments side by side, or in one token of signs; ``signs`` are the tokens that open a lattice.

        Only windows whose lattice can spell such a word are decoded; from a
        beginning that spells none no longer window is tried.
        """
        found: set[bytes] = set()
        strong = told.strong
        if heads := told.starts & distinct:
            for lo, whole in enumerate(parts):
                if whole in heads:
                    for part in parts[lo + 1:lo + FRAGMENTS]:
                        whole += part
                        if whole in strong and self.restored(whole).encode() == whole:
                            found.add(whole)
                        if whole not in told.starts:
                            break
        tried: dict[int, int] = {}
        for i in [i for i, t in enumerate(parts) if t in signs] if signs else ():
            for lo in range(max(0, i - FRAGMENTS + 1), i + 1):
                end = min(len(parts), lo + FRAGMENTS)
                for hi in range(max(i + 1, tried.get(lo, 0)), end + 1):
                    whole = b"".join(parts[lo:hi])
                    can = spells(whole.decode("utf-8", "replace").lower(), told.trie)
                    if can is None:
                        tried[lo] = end + 1
                        break
                    tried[lo] = hi + 1
                    if can and (word := self.restored(whole).encode()) in strong:
                        found.add(word)
        return found

    def telling(self, text: str | None, told: Told) -> set[tuple[str, float]]:
        """Distinct words that carry weight."""
        found: set[tuple[str, float]] = set()
        if not text:
            return found

        def make(token: bytes) -> tuple:
            pairs = tuple((w, x) for w in self.words(token) if (x := told.weight(w)))
            return pairs, self.opens(token)

        parts = self.parts(text)
        distinct = set(parts)
        signs: set[bytes] = set()
        # Most tokens say nothing and are passed over together.
        for token in distinct - self.dull:
            pairs, opens = self.known(token, make)
            if pairs:
                found.update(pairs)
            if opens:
                signs.add(token)
            elif not pairs:
                if len(self.dull) < MEMO:
                    self.dull.add(token)
        for token in {*(token for token, _ in self.spelt(parts)), *self.together(parts, distinct, signs, told)}:
            found.update(self.known(token, make)[0])
        return found


# -- learning and scoring ----------------------------------------------------

def labelled(docs: DataFrame, labels: DataFrame, training: Column) -> DataFrame:
    """(text, toxic) of labelled training rows, each text once per label."""
    own = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("_toxic"))
    if own.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    return docs.where(training).select("doc_id", "text").join(own, "doc_id").select("text", F.col("_toxic").alias("toxic")).distinct()


def feature_counts(rows: DataFrame, logp) -> DataFrame:
    """(feature, pos, neg): labelled rows that have it; the null feature counts all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(logp.value)

        pos: Counter[str | None] = Counter()
        neg: Counter[str | None] = Counter()

        def out() -> pa.RecordBatch:
            seen = list(pos.keys() | neg.keys())
            columns = [pa.array(seen, pa.string()), *(pa.array([c[f] for f in seen], pa.int64()) for c in (pos, neg))]
            pos.clear()
            neg.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", "pos", "neg"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                side = pos if toxic else neg
                side.update(features.of(text))
                side[None] += 1
            if len(pos) + len(neg) > 250_000:
                yield out()
        if pos or neg:
            yield out()

    schema = StructType([StructField("feature", StringType()), StructField("pos", LongType()), StructField("neg", LongType())])
    return rows.mapInArrow(run, schema).groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def significance(pos: Column, neg: Column, whole_pos: int, whole_neg: int) -> Column:
    """Log-likelihood ratio of a feature that stands in ``pos`` toxic and ``neg`` other texts."""

    def part(n: Column, of: Column) -> Column:
        return F.when(n > 0, n * F.log(n / of)).otherwise(0.0)

    base = whole_pos / (whole_pos + whole_neg)
    have = pos + neg
    rest = F.lit(float(whole_pos + whole_neg)) - have
    return 2 * (
        part(pos, have * base) + part(neg, have * (1 - base))
        + part(F.lit(float(whole_pos)) - pos, rest * base) + part(F.lit(float(whole_neg)) - neg, rest * (1 - base))
    )


def log_ratio(pos: float, neg: float, base: float) -> float:
    """Log likelihood ratio drawn towards 0; ``base`` is the share of toxic texts."""
    return math.log((max(pos, 0) + SHRINK * base) / (max(neg, 0) + SHRINK * (1 - base))) - math.log(base / (1 - base))


EVIDENCE = StructType([
    StructField("toxic", LongType()), StructField("words", ArrayType(StringType())), StructField("features", ArrayType(StringType())), StructField("contexts", ArrayType(LongType())),
])


def evidence(rows: DataFrame, kept, logp) -> DataFrame:
    """Words and features of each training text that are among ``kept``, with the features' contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, wanted = Features(logp.value), kept.value
        for batch in batches:
            out = {"toxic": batch.column(1).cast(pa.int64()), "words": [], "features": [], "contexts": []}
            for text in batch.column(0).to_pylist():
                words, found = features.placed(text, wanted)
                out["words"].append(list(words))
                out["features"].append(list(found))
                out["contexts"].append(list(found.values()))
            kinds = {"words": pa.list_(pa.string()), "features": pa.list_(pa.string()), "contexts": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([out["toxic"], *(pa.array(out[k], kind) for k, kind in kinds.items())], names=list(out))

    return rows.select("text", "toxic").mapInArrow(run, EVIDENCE)


def context_counts(given: DataFrame, index, rows: int) -> DataFrame:
    """(feature, pos, neg): different contexts of each feature by label.

    A (feature, label, context) is one number. Tasks hand on each of theirs
    once, packed by buckets of a hash, so a feature of very many texts is dealt
    out too, and a bucket holds some ``BUCKET_CODES`` numbers.
    """
    buckets = max(shuffle_partitions(given.sparkSession), rows * 64 // BUCKET_CODES)
    packed = StructType([StructField("bucket", LongType()), StructField("codes", BinaryType())])
    counts = StructType([StructField("feature", StringType()), StructField("pos", LongType()), StructField("neg", LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = index.value, [], 0

        def ready() -> pa.RecordBatch:
            codes = np.unique(np.concatenate(held))
            to = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            codes, to = codes[order], to[order]
            own, at = np.unique(to, return_index=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int64)), pa.array([x.tobytes() for x in np.split(codes, at[1:])], pa.binary())], names=packed.names
            )

        for batch in batches:
            for toxic, features, contexts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if features:
                    label = 1 if toxic else 0
                    held.append(np.array([(2 * number[f] + label) << 32 | c for f, c in zip(features, contexts)], np.int64))
                    size += len(features)
            if size > 2_000_000:
                yield ready()
                held, size = [], 0
        if held:
            yield ready()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(index.value, key=index.value.get)
        total = np.zeros(2 * len(names), np.int64)
        for _, part in sorted_runs(batches, 1):
            codes = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]))
            total += np.bincount(codes >> 32, minlength=len(total))
        by_feature = total.reshape(-1, 2)
        seen = np.flatnonzero(by_feature.sum(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[k] for k in seen], pa.string()), pa.array(by_feature[seen, 1]), pa.array(by_feature[seen, 0])], names=counts.names
        )

    dealt = given.select("toxic", "features", "contexts").mapInArrow(deal, packed).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, counts).groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def sums_by_label(given: DataFrame, counts, base: float) -> DataFrame:
    """(alone, step, pos, neg): training texts by their sum and (alone = 1) by their strongest word, each without its own share in the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [{f: log_ratio(p, n - 1, base) for f, (p, n) in counts.value.items()}, {f: log_ratio(p - 1, n, base) for f, (p, n) in counts.value.items()}]
        found: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for toxic, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                weights = [word_weight(w, own[1 if toxic else 0]) for w in words]
                for alone, x in enumerate((math.fsum(weights), max(weights, default=0.0))):
                    found.setdefault((alone, round(min(MOST, max(LEAST, x)) * STEPS)), [0, 0])[0 if toxic else 1] += 1
        columns = [[k[0] for k in found], [k[1] for k in found], [c[0] for c in found.values()], [c[1] for c in found.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["alone", "step", "pos", "neg"])

    schema = StructType([StructField(name, LongType()) for name in ("alone", "step", "pos", "neg")])
    return given.select("toxic", "words").mapInArrow(run, schema).groupBy("alone", "step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def rising_shares(steps: list[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """(evidence, log odds) through the shares of (evidence, toxic, other), neighbours pooled until the shares rise."""
    base = sum(p for _, p, _ in steps) / sum(p + n for _, p, n in steps)
    blocks: list[list[float]] = []
    for x, p, n in sorted(steps):
        blocks.append([x, x, p, n])
        while len(blocks) > 1 and blocks[-2][2] * (blocks[-1][2] + blocks[-1][3]) >= blocks[-1][2] * (blocks[-2][2] + blocks[-2][3]):
            _, hi, p2, n2 = blocks.pop()
            blocks[-1][1:] = [hi, blocks[-1][2] + p2, blocks[-1][3] + n2]
    out, least = [], -math.inf
    for lo, hi, p, n in blocks:
        least = max(least, math.log((p + base) / (n + 1 - base)))
        out += [(lo, least), (hi, least)]
    return out


class Model:
    """Weights of features and the log odds that go with their sum and with the strongest one."""

    def __init__(self, weights: dict[str, float], odds: list[list[tuple[float, float]]]):
        self.weights, self.odds = weights, odds
        self.strong = {f.encode() for f, x in weights.items() if x >= STRONG and not f.endswith("~")}


def fit(spark: SparkSession, rows: DataFrame, logp, max_features: int = MAX_FEATURES) -> Model:
    """Learn from (text, toxic)."""
    folder = shared_dir(spark, "toxicity")
    rows = write_read(rows, f"{folder}/rows")
    counts = write_read(feature_counts(rows, logp), f"{folder}/features")
    whole = counts.where("feature is null").first()
    pos, neg, seen = (whole["pos"], whole["neg"], counts.count()) if whole else (0, 0, 0)
    if not pos or not neg:
        return Model({}, [[(0.0, math.log(UNKNOWN / (1 - UNKNOWN)))]] * 2)
    base, chance = pos / (pos + neg), 2 * math.log(seen)
    kept = counts.where("feature is not null").withColumn("g2", significance(F.col("pos"), F.col("neg"), pos, neg)).where(F.col("g2") >= chance)
    kept = {r["feature"]: (r["pos"], r["neg"]) for r in kept.orderBy(F.desc("g2"), "feature").limit(max_features).collect()}
    given = write_read(evidence(rows, spark.sparkContext.broadcast(set(kept)), logp), f"{folder}/evidence")
    apart = context_counts(given, spark.sparkContext.broadcast({f: k for k, f in enumerate(sorted(kept))}), pos + neg)
    apart = apart.where(significance(F.col("pos"), F.col("neg"), pos, neg) >= chance)
    told = {r["feature"]: (r["pos"], r["neg"]) for r in apart.collect()}  # at most MAX_FEATURES rows
    steps = sums_by_label(given, spark.sparkContext.broadcast(told), base).collect()
    odds = [rising_shares([(r["step"] / STEPS, r["pos"], r["neg"]) for r in steps if r["alone"] == k]) for k in (0, 1)]
    return Model({f: log_ratio(p, n, base) for f, (p, n) in told.items()}, odds)


def score_texts(docs: DataFrame, model: Model, logp) -> DataFrame:
    """All columns of ``docs`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.strong, model.odds))  # at most MAX_FEATURES entries

    @F.pandas_udf(DoubleType())
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, (weights, strong, odds) = Features(logp.value), shared.value
        told = Told(weights, strong)
        for texts in series:
            found = [[x for _, x in features.telling(t, told)] for t in texts]
            by_kind = ([math.fsum(x) for x in found], [max(x, default=0.0) for x in found])
            level = np.max([np.interp(np.array(x, dtype="float64"), *np.array(o).T) for x, o in zip(by_kind, odds)], axis=0)
            yield pd.Series(1 / (1 + np.exp(-level)), dtype="float64")

    return docs.withColumn("score", score("text"))


def toxicity(docs: DataFrame, corpus: DataFrame, labels: DataFrame, training: Column | None = None) -> DataFrame:
    """``docs`` with ``score``; learnt from ``corpus`` and ``labels`` where ``training`` holds (default: remainder 3 is not 1)."""
    spark = docs.sparkSession
    training = remainder("doc_id", 3) != 1 if training is None else training
    logp = spark.sparkContext.broadcast(character_model(corpus))
    return score_texts(docs, fit(spark, labelled(corpus, labels, training), logp), logp)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score below ``threshold``, columns as given."""
    scored = toxicity(docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")), docs, labels)
    return scored.where(F.col("score") < threshold).select("_row.*")


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs.select("doc_id", "text"), docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
