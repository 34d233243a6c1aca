"""Toxicity of texts behind leetspeak, spacing and repetition.

A noisy channel: what an author meant passed through substitutions (leetspeak), inserted
separators and repeated letters. A suspicious token becomes a lattice of what its
characters may stand for; Viterbi decodes the best path under a character trigram model
counted over all documents. The restored text is scored by the words and word beginnings
that mark toxic documents among labelled ones. Look-alike letters are folded first. White
space may part a word anywhere: neighbouring tokens that together may be a marked word form
one lattice, in which each space is a separator or a real one.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_few, cut, forget, fresh, portions, small_batches, table
from .encoders import Remembered

#: At most so many labelled rows, the smallest by a hash of their id, fit the classifier.
MAX_TRAINING_ROWS = 10_000
#: A word or beginning marks toxicity if it has this log-odds and so many toxic documents, which are this share of its documents.
MIN_LOG_ODDS, MIN_TOXIC_DOCS, MIN_PURITY = 2.0, 4, 0.8
#: A part of a marked word is a word of its own if so many labelled documents that aren't toxic hold it.
MIN_PART_DOCS = 2

#: Tokens that a worker remembers.
TOKENS = 200_000

#: Symbols of the character model: word boundary, a to z (accents folded), any other letter.
BOUNDARY, OTHER, SYMBOLS = 0, 27, 28

#: Letters that signs stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l",
}
SUBSTITUTED, REPEATED, KEPT_DOUBLE, DROPPED, PARTED = 1.0, 0.5, 1.0, 1.0, 2.0

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɡ": "g",
}


# -- character model ----------------------------------------------------------------

@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """Symbol of each code point of the basic plane."""
    out = np.zeros(0x10000, np.int64)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            base = unicodedata.normalize("NFKD", ch.lower())[:1]
            out[c] = ord(base) - 96 if "a" <= base <= "z" else OTHER
    out[ord("ß")] = ord("s") - 96
    return out


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 0x10000, _symbol_table()[np.minimum(points, 0xFFFF)], BOUNDARY)


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each three symbols follow one another, over all texts. The table's size is fixed by the alphabet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                before = np.full(2, BOUNDARY)
                for at in range(0, len(text or ""), 1_000_000):  # bounded working arrays; the last two symbols go on
                    s = np.concatenate([before, symbols(text[at : at + 1_000_000]), [BOUNDARY] * (at + 1_000_000 >= len(text))])
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
                    before = s[-2:]
        yield pa.RecordBatch.from_pydict({"gram": np.flatnonzero(total), "n": total[total > 0]})

    out = np.zeros(SYMBOLS**3)
    with small_batches(docs.sparkSession):
        counted = docs.select(text_col).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    for gram, n in counted:
        out[gram] = n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_model(counts: np.ndarray, k: float = 5.0) -> np.ndarray:
    """Log chance of the third symbol after two others; rare contexts lean on the shorter ones."""
    one = counts.sum(axis=(0, 1)) + 1.0
    one = one / one.sum()
    two = counts.sum(axis=0) + k * one
    two = two / two.sum(axis=1, keepdims=True)
    three = counts + k * two[None]
    return np.log(three / three.sum(axis=2, keepdims=True))


# -- restoring ----------------------------------------------------------------------

@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """The letter a to z that a lower-case code point is a form of or looks like, else itself; 0 is left out."""
    out = np.arange(0x20000, dtype=np.uint32)
    for c in range(0x80, 0x20000):
        ch = chr(c)
        base = LOOK_ALIKES.get(ch) or unicodedata.normalize("NFKD", ch)[0].lower()
        if ch.isalpha() and "a" <= base <= "z":
            out[c] = ord(base)
    out[0x300:0x370] = 0  # accents that stand alone
    out[[0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]] = 0  # signs without a width
    return out


def fold(text: str) -> str:
    """Lower case; accented, wide and look-alike letters as a to z; marks without a width are left out."""
    text = text.lower()
    if text.isascii():
        return text
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(points < 0x20000, _fold_table()[np.minimum(points, 0x1FFFF)], points)
    return out[out > 0].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


_LETTERS = re.compile(r"[^\W\d_]+")
_LEET_INSIDE = re.compile("[" + re.escape("".join(LEET)) + "]")
_REPEATED = re.compile(r"([^\W\d_])\1")
#: What may end a token without being meant as a letter: all signs, those that seldom stand for one, those that never do.
_ENDS = ["!|+()$.,;:?\"'", "!|+().,;:?\"'", ").,;:?\"'"]
#: What a token may have before and behind the part of a word that it holds.
_EDGES = "\"'.,;:?!-_*~·/|+()[]{}"
_EDGE_SIGNS = re.compile(r"[!|+($]")
_RUN = re.compile(r"(.)\1*", re.S)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per run of equal characters, what it may stand for and at what cost; a space parts words."""
    out = []
    for run in _RUN.finditer(token):
        c, n = run[1], len(run[0])
        meant = [(c, 0.0)] if c.isalpha() else [(x, SUBSTITUTED) for x in LEET.get(c, "")]
        if not meant:
            out.append([("", DROPPED), (" ", DROPPED)] if c != " " else [("", 0.0), (" ", PARTED)])
        elif n == 1:
            out.append(meant)
        else:
            if c == "v" and n == 2:
                meant.append(("w", SUBSTITUTED - REPEATED * 2))  # drawn with two signs, not repeated
            out.append([(x, cost + REPEATED * 2 if n == 2 else cost + REPEATED) for x, cost in meant] + [(x + x, cost + (0.0 if n == 2 else KEPT_DOUBLE)) for x, cost in meant])
    return out


def decode(token: str, model: list) -> str:
    """The best path through the token's lattice: Viterbi over the last two symbols."""
    table_ = _symbol_table()
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(BOUNDARY, BOUNDARY): (0.0, None)}
    for options in lattice(token):
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, back) in states.items():
            for text, cost in options:
                x, y, s = a, b, score - cost
                for ch in text:
                    z = int(table_[ord(ch)]) if ord(ch) < 0x10000 else OTHER
                    s += model[x][y][z]
                    x, y = y, z
                if (x, y) not in following or s > following[x, y][0]:
                    following[x, y] = (s, (text, back))
        states = following
    back = max(((s + model[a][b][BOUNDARY], back) for (a, b), (s, back) in states.items()), key=lambda x: x[0])[1]
    out = []
    while back is not None:
        out.append(back[0])
        back = back[1]
    return "".join(reversed(out))


def cores(token: str) -> list[str]:
    """The token without what may end it, by its likeliest reading first: a dollar sign stands for a letter, other signs end a word."""
    token = token.lstrip("\"'.,;:?-_*~·/")
    return list(dict.fromkeys(token.rstrip(_ENDS[k]) for k in (1, 0, 2)))


def suspicious(core: str) -> bool:
    """Letters with a sign or separator among them, or a letter twice in a row; or signs alone that are no number."""
    if not any(map(str.isalpha, core)):
        return len(_LEET_INSIDE.findall(core)) > 1 and any(c in LEET and not c.isdigit() for c in core)
    return not core.isalpha() or bool(_REPEATED.search(core))


def split(text: str | None) -> list[str]:
    """White-space tokens of the folded text."""
    return fold(text or "").split()


def single_character(token: str) -> str:
    """The one letter, digit or sign for a letter that a token holds between its edges; nothing if it holds more."""
    inner = token.strip(_EDGES) or token
    return inner if len(inner) == 1 and (inner.isalnum() or inner in LEET) else ""


class Restorer:
    """Words of a text, with suspicious tokens decoded; decisions on tokens are remembered."""

    def __init__(self, log_chances: np.ndarray):
        self.model = log_chances.tolist()
        self.known = Remembered(self._readings)
        self.single = Remembered(single_character)
        self.ones: set[str] = set()

    def _readings(self, token: str) -> tuple[tuple[str, ...], ...]:
        """The words of each reading, the likeliest first. Whole words between signs are read as they stand, too."""
        out: dict[tuple[str, ...], None] = {}
        for core in cores(token):
            plain = tuple(_LETTERS.findall(core))
            if suspicious(core):
                out[tuple(_LETTERS.findall(decode(core, self.model)))] = None
            if plain and (not suspicious(core) or min(map(len, plain)) > 1):
                out[plain] = None
        return tuple(out) or ((),)

    def single_characters(self, tokens: Iterable[str]) -> set[str]:
        return {t for t in tokens if len(t) < 5 and self.single[t]}

    def tokens(self, raw: list[str], different: set[str] | None = None) -> list[str]:
        """The tokens; three or more single characters in a row become one, with spaces. What stands at their edges is left out.

        A stop behind one ends such a row, if the character before has none. Where the set of tokens is given,
        its single characters are in ``ones``.
        """
        ones = self.single_characters(set(raw)) if different is None else self.ones & different
        if len(ones) < 2:
            return raw
        single = bytes(map(ones.__contains__, raw))
        if b"\1\1\1" not in single:
            return raw
        out: list[str] = []
        run: list[str] = []

        def end() -> None:
            own = [self.single[t] for t in run]
            out.extend([" ".join(own)] if len(own) >= 3 and len(set(own)) > 1 else run)
            run.clear()

        for t, one in zip(raw, single, strict=True):
            if one:
                run.append(t)
                if t[-1] in ".,;:?!" and len(run) > 1 and len(t) > 1 and (len(run[-2]) == 1 or run[-2][-1] not in ".,;:?!"):
                    end()
            else:
                end()
                out.append(t)
        end()
        return out

    def readings(self, token: str) -> tuple[tuple[str, ...], ...]:
        return (tuple(_LETTERS.findall(decode(token, self.model))),) if " " in token else self.known[token]

    def words(self, text: str | None, joiner: Joiner | None = None) -> list[str]:
        """The likeliest reading of each token, and of neighbouring tokens that ``joiner`` finds to be one marked word."""
        raw = split(text)
        if joiner:
            joiner.clear()
            tokens = list(set(raw))
            joiner.look_at(tokens, skeletons(tokens).split("\n")[1:])
        merged, at = [], 0
        for first, last, joined in joiner.spans(raw) if joiner else []:
            marked = [t for t in joined if any(w in joiner.lexicon for w in self.readings(t)[0])]
            if marked and first >= at:
                merged += [*raw[at:first], marked[0]]
                at = last + 1
        return [w for t in self.tokens(merged + raw[at:]) for w in self.readings(t)[0]]

    def read(self, text: str | None) -> set[str]:
        """Words of all readings."""
        return {w for t in set(self.tokens(split(text))) for own in self.readings(t) for w in own}


# -- classifier ---------------------------------------------------------------------

def features(word: str) -> list[str]:
    """The word itself, and of longer words the first four and five letters."""
    return [word, word[:4] + "*", word[:5] + "*"] if len(word) >= 4 else [word]


@lru_cache(maxsize=1)
def _skeleton_table() -> np.ndarray:
    """What becomes of each code point of the basic plane in a skeleton: 0 is left out."""
    signs = {sign: letters[0] for sign, letters in LEET.items()} | {"l": "i", "£": "i", "ς": "σ", "w": "v"}
    out = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        low = chr(c).lower()[0]
        low = signs.get(low, low)
        out[c] = ord(low) if low.isalpha() and not 0xD800 <= c < 0xE000 else 0
    out[ord("\n")] = ord("\n")
    return out


def skeletons(tokens: list[str]) -> str:
    """The skeletons of the tokens, each after a line end: one letter for all letters that a sign may stand for (i for l,
    v for w, too), repeats as one letter, separators left out."""
    points = np.frombuffer(("\n" + "\n".join(tokens)).encode("utf-32-le", "surrogatepass"), "<u4")
    out = _skeleton_table()[np.minimum(points, 0xFFFF)]
    beyond = np.flatnonzero(points > 0xFFFF)
    out[beyond] = [c if chr(c).isalpha() else 0 for c in points[beyond].tolist()]
    out = out[out > 0]
    line = out == ord("\n")
    return out[line | np.concatenate([[True], out[1:] != out[:-1]])].tobytes().decode("utf-32-le")


class Joiner:
    """Neighbouring tokens that may be one marked word, parted by white space.

    The skeletons of the tokens are put together as long as they begin a marked word's
    skeleton; each such beginning is kept with its latest start, so the work is linear in
    the tokens. Tokens that all are ordinary words or numbers stay apart, but for three or
    more single characters.
    """

    def __init__(self, lexicon: dict[str, float], ordinary: set[str]):
        self.lexicon, self.ordinary = lexicon, ordinary
        words = [w for w in lexicon if not w.endswith("*")]
        self.marks = {m for m in skeletons(words).split("\n") if len(m) > 1} if words else set()
        self.beginnings = {m[:k] for m in self.marks for k in range(1, len(m) + 1)}
        self.inner = {m[j:k] for m in self.marks for k in range(len(m) + 1) for j in range(k)} | {""}
        self.seen: set[str] = set()
        self.forms: dict[str, tuple[str, ...]] = {}
        self.begins: set[str] = set()

    def clear(self) -> None:
        for known in (self.seen, self.forms, self.begins):
            known.clear()

    def look_at(self, tokens: list[str], whole: list[str]) -> None:
        """Remember the skeletons by which tokens may be parts of marked words: that of the ``whole``, or others if signs stand at the edges."""
        self.seen.update(tokens)
        forms = {t: {x: None} for t, x in zip(tokens, whole, strict=True) if x in self.inner}
        cut_off = [(t, c) for t in filter(_EDGE_SIGNS.search, tokens) for c in {*cores(t), t.strip(_EDGES)} if c and c != t]
        for (t, _), x in zip(cut_off, skeletons([c for _, c in cut_off]).split("\n")[1:] if cut_off else [], strict=True):
            if x in self.inner:
                forms.setdefault(t, {})[x] = None
        for t, own in forms.items():
            self.forms[t] = tuple(own)
            if not self.beginnings.isdisjoint(own):
                self.begins.add(t)

    def spans(self, raw: list[str]) -> list[tuple[int, int, list[str]]]:
        """First and last token of each span of tokens that were looked at, and what it may be as one token.

        Viterbi decides on each space between larger parts; single characters are put together.
        """
        if not self.marks:
            return []
        ends: dict[tuple[int, str], int] = {}
        at = 0
        for start in [k for k, (t, following) in enumerate(zip(raw, raw[1:])) if t in self.begins and following in self.forms]:
            if start < at:
                continue
            states: dict[str, int] = {}
            for at in range(start, len(raw)):
                following: dict[str, int] = {}
                own = self.forms.get(raw[at], ())
                for x in own:
                    for state, first in states.items():
                        both = state + x[state[-1:] == x[:1] :] if x else state
                        if both in self.beginnings and first > following.get(both, -1):
                            following[both] = first
                            if both in self.marks and x:
                                ends[first, both] = at
                for x in own:
                    if x in self.beginnings:
                        following[x] = at
                states = following
                if not states:
                    break
            at += 1
        out = []
        for first, last in sorted({(first, last) for (first, _), last in ends.items()}):
            own = [t for t in raw[first : last + 1] if any(c.isalnum() or c in LEET for c in t)]
            inner = [t.strip(_EDGES) or t for t in own]
            if len(inner) > 2 and max(map(len, inner)) == 1:
                out.append((first, last, ["".join(inner)]))
            elif not all(x in self.ordinary or not any(map(str.isalpha, x)) for x in inner):
                out.append((first, last, list(dict.fromkeys([" ".join(inner), " ".join([*own[:-1], cores(own[-1])[0]])]))))
        return out


class Scorer:
    """Scores of texts.

    A token is decoded only if its lattice may hold a marked word at all: its skeleton must
    hold the skeleton of a mark. All other tokens have no weight however they are read, so
    the score is the same.
    """

    def __init__(self, log_chances: np.ndarray, lexicon: dict[str, float], weights: list[float], ordinary: set[str] = frozenset()):
        import ahocorasick

        self.restorer = Restorer(log_chances)
        self.lexicon, self.weights = lexicon, weights
        self.joiner = Joiner(lexicon, ordinary)
        marks = skeletons([f.rstrip("*") for f in lexicon]).split("\n")[1:] if lexicon else []
        self.marks = ahocorasick.Automaton()
        for mark in filter(None, marks):
            self.marks.add_word(mark, 1)
        self.marks.make_automaton()
        self.unmarked: set[str] = set()
        self.all_hold = "" in marks  # a mark without a skeleton says nothing
        self.weight = Remembered(lambda w: max(self.lexicon.get(f, 0.0) for f in features(w)))
        self.token_weight = Remembered(lambda t: max((self.weight[w] for own in self.restorer.readings(t) for w in own), default=0.0))

    def skip_unmarked(self, tokens: list[str], text: str) -> None:
        """Give weight 0 to those tokens whose skeletons, in ``text``, hold no mark."""
        if self.all_hold or not tokens:
            return
        starts = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == ord("\n"))
        ends = [end for end, _ in self.marks.iter(text)] if len(self.marks) else []
        hit = np.zeros(len(tokens), bool)
        hit[np.searchsorted(starts, np.array(ends, np.int64)) - 1] = True
        self.unmarked.update(compress(tokens, (~hit).tolist()))

    def scores(self, texts: list[str | None]) -> list[float]:
        return [self.score(x) for x in self.summaries(texts)]

    def summaries(self, texts: list[str | None]) -> list[tuple[float, float, float]]:
        raw = [split(t) for t in texts]
        sets = [set(x) for x in raw]
        if max(map(len, (self.joiner.seen, self.token_weight, self.unmarked))) > TOKENS:
            self.joiner.clear()
            for known in (self.token_weight, self.unmarked, self.restorer.ones):
                known.clear()
        for known in (self.weight, self.restorer.known, self.restorer.single):
            if len(known) > TOKENS:
                known.clear()
        new = list(set().union(*sets).difference(self.joiner.seen))
        if new:
            text = skeletons(new)
            self.joiner.look_at(new, text.split("\n")[1:])
            self.skip_unmarked(new, text)
            self.restorer.ones |= self.restorer.single_characters(new)
        own = [self.restorer.tokens(x, d) for x, d in zip(raw, sets, strict=True)]
        different = [(d if x is r else set(x)).union(*(joined for _, _, joined in self.joiner.spans(r))) for x, r, d in zip(own, raw, sets, strict=True)]
        rest = list(set().union(*(d - self.unmarked for d in different)).difference(self.token_weight))
        self.skip_unmarked(rest, skeletons(rest))
        return [self.summary(d, len(x)) for d, x in zip(different, own, strict=True)]

    def summary(self, tokens: set[str], n: int) -> tuple[float, float, float]:
        """Largest weight, log of the sum of weights over different tokens, share of marked tokens."""
        marked = [w for w in map(self.token_weight.__getitem__, sorted(tokens - self.unmarked)) if w]
        return (max(marked), math.log1p(sum(marked)), len(marked) / math.sqrt(n)) if marked else (0.0, 0.0, 0.0)

    def score(self, summary: tuple[float, float, float]) -> float:
        x = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], summary, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton steps on a few columns."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAINING_ROWS) -> dict:
    """Character model over all of ``docs``; lexicon and weights from at most ``max_rows`` labelled rows.

    Three quarters of these rows make the lexicon, the others the weights, so that words
    which mark toxicity by chance don't count. Rows whose crc32(id as text) is divisible by
    5 are never learnt from. Rows with a null id or label are not used; of labels repeated
    for an id the largest holds. Without both classes, every score is the share of toxic
    rows, or 0.
    """
    log_chances = log_model(count_trigrams(docs, text_col))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    # at most max_rows small rows: a bounded broadcast
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) == 0
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = cut(rows.select(fold.alias("weighs"), "y", "text"), "labelled")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(log_chances)
        for batch in batches:
            found = [sorted({f for w in restorer.read(t) for f in features(w)}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.string()))], ["y", "features"])

    learnt = rows.where(~F.col("weighs")).select("y", "text").mapInArrow(extract, "y int, features array<string>")
    counts = learnt.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    totals = {r.weighs: (r.n, r.t) for r in rows.groupBy("weighs").agg(F.count("*").alias("n"), F.sum("y").alias("t")).collect()}
    (n, n_toxic), (m, m_toxic) = totals.get(False, (0, 0)), totals.get(True, (0, 0))
    if not 0 < n_toxic < n or not 0 < m_toxic < m:
        share = (n_toxic + m_toxic) / (n + m) if n + m else 0.0
        return {"log_chances": log_chances, "lexicon": {}, "weights": [math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0, 0.0], "ordinary": set()}
    lexicon = {}
    for f, t, k in counts.where(F.col("toxic") >= MIN_TOXIC_DOCS).collect():  # at most the features of max_rows rows that recur in toxic ones
        odds = math.log((t + 0.5) / (n_toxic - t + 0.5)) - math.log((k - t + 0.5) / (n - n_toxic - k + t + 0.5))
        if odds >= MIN_LOG_ODDS and t >= MIN_PURITY * k:
            lexicon[f] = odds

    parts = {w[j:k] for w in lexicon if not w.endswith("*") for k in range(len(w) + 1) for j in range(k)}

    def parts_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parts.intersection(x.strip(_EDGES) for x in set(split(t))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"part": pa.array([x for own in found for x in own], pa.string())})

    # no more rows than the marked words have parts
    held = rows.where(~F.col("weighs") & (F.col("y") == 0)).select("text").mapInArrow(parts_held, "part string").groupBy("part").count()
    ordinary = {r.part for r in held.where(F.col("count") >= MIN_PART_DOCS).collect()}

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(log_chances, lexicon, [0.0] * 4, ordinary)
        for batch in batches:
            found = [x for part in portions(batch) for x in scorer.summaries(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array([x[k] for x in found], pa.float64()) for k in range(3))], ["y", "a", "b", "c"])

    found = np.array(rows.where("weighs").select("y", "text").mapInArrow(summarise, "y int, a double, b double, c double").collect(), np.float64).reshape(-1, 4)
    return {"log_chances": log_chances, "lexicon": lexicon, "weights": _fit_logistic(found[:, 1:], found[:, 0]), "ordinary": ordinary}


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, score and predicted for every row; only the text makes the score.

    Null and empty texts have no marks and the score of such texts; repeated rows and null
    ids are carried along, one result row per input row; other columns are not read; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorer = Scorer(**model)
        for batch in batches:
            scores = [x for part in portions(batch) for x in scorer.scores(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(scores, pa.float64())], ["doc_id", "text_key", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def restore_texts(docs: DataFrame, log_chances: np.ndarray, id_col: str = "doc_id", text_col: str = "text", lexicon: dict[str, float] | None = None, ordinary: set[str] = frozenset()) -> DataFrame:
    """doc_id, restored: the words of each text after decoding, the likeliest reading of each token.

    With a ``lexicon``, tokens that together are one of its words are joined, unless all are ``ordinary``.
    Null and empty texts give an empty string; null and repeated ids are carried along; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, joiner = Restorer(log_chances), Joiner(lexicon, ordinary) if lexicon else None
        for batch in batches:
            for part in portions(batch):
                texts = [" ".join(restorer.words(t, joiner)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "restored"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, restored string")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` not predicted toxic, all columns; the model is trained here.

    A row is known by its id and a hash of its text, so rows repeated with both share one
    verdict. Null texts are empty; null ids are kept or dropped by their texts. Empty tables
    give an empty result or, without labels, drop nothing.
    """
    model = train(docs, labels, id_col, text_col)
    doc_id, key = fresh(docs, "__id", "__key")
    toxic = score_toxicity(docs, model, id_col, text_col).where("predicted = 1").select(F.col("doc_id").alias(doc_id), F.col("text_key").alias(key)).distinct()
    return docs.join(broadcast_if_few(toxic), F.col(id_col).cast("long").eqNullSafe(F.col(doc_id)) & (F.xxhash64(text_col) == F.col(key)), "left_anti")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")
