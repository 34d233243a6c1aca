"""SentencePiece encoding and decoding with batched numpy Viterbi.

Texts are cut into units that no piece can cross; different units of about one length are
encoded together. For each end position and each piece length, the hashes of the
substrings probe the sorted hashes of the pieces, and the best predecessor of every unit
is stored as a backpointer.

Unigram models take the path with the largest sum of scores. For BPE models the path of
the model's own merges is wanted, which no sum of scores gives; there, a step from one
piece to the next is allowed only if merging their joint characters gives these two
pieces again. Prefixes of a unit then have exactly one path each, the same dynamic
program finds it, and its ids are those of the library.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, remembered, table

#: Units that a worker remembers, and places (a power of two) where it remembers pairs of pieces.
UNITS, PAIRS = 200_000, 1 << 21

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * _MIX
    return x ^ (x >> np.uint64(32))


class Pieces:
    """A model's pieces as sorted substring hashes, with scores, byte pieces and the kind of the model."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {self.text[i]: i for i in normal}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if sp.is_control(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]
        self.prefixed = sp.normalize("a").startswith(SPACE)
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.longest = max(len(self.text[i]) for i in normal)
        keys = np.array([self._key(self.text[i]) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int64)[order]
        self.filter = np.zeros(1 << 20, bool)  # whether any piece's hash has these upper bits
        self.filter[self.keys >> np.uint64(44)] = True
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.crosses = any(SPACE in t.lstrip(SPACE) for t in self.id_of)
        self.letters = {c for t in self.id_of for c in t}
        # scores of a BPE model are negative ranks of merges: whole numbers, log chances are not
        self.bpe = bool(np.all(self.score[normal] == np.rint(self.score[normal])))
        self.pair, self.allowed = np.full(PAIRS, -1, np.int64), np.ones(PAIRS, bool)  # a pair's code at its place, and whether it is allowed
        self.whole: dict[int, bool] = {}
        self.halves: dict[str, list[str]] = {}
        # ranks are an order of merges, but for pieces of equal ranks
        self.rank = (-self.score).tolist()
        merged = Counter(self.rank[i] for i in normal if len(self.text[i]) > 1)
        self.tied = [self.text[i] for i in normal if len(self.text[i]) > 1 and merged[self.rank[i]] > 1]
        self.ranked = len(self.tied) <= 16 and min(merged, default=0) >= 0

    def _key(self, text: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in text:
            h = h * _BASE + _mixed(np.array([ord(c)], np.uint64))
        return int(h[0])

    # -- which pieces may follow one another in a BPE model

    def merge(self, text: str, least: int = 1) -> list[str]:
        """Pieces of a short text by its merges, until so few are left: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > least:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether a BPE of the two pieces' text keeps them apart; -1 stands for an unknown character or the start."""
        codes = np.where((left >= 0) & (right >= 0), left * len(self.text) + right, -1)
        at = self._places(codes)
        out = (codes < 0) | self.allowed[at]
        new = np.flatnonzero((codes >= 0) & (self.pair[at] != codes))
        if len(new):
            fresh, which = np.unique(codes[new], return_inverse=True)
            said = np.array([self._apart(*divmod(c, len(self.text))) for c in fresh.tolist()], bool)
            out[new] = said[which]
            # of pairs with one place the last is remembered, with its own answer
            place = self._places(fresh)
            self.pair[place] = fresh
            own = self.pair[place] == fresh
            self.allowed[place[own]] = said[own]
        return out

    @staticmethod
    def _places(codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * _MIX) >> np.uint64(40)).astype(np.int64) & (PAIRS - 1)

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the characters of both gives the two again.

        The merges that made them are taken back, the last first: none across the border may be due before the one taken back.
        """
        whole = self.text[a] + self.text[b]
        if not self.ranked or any(t in whole for t in self.tied):
            return self.merge(whole) == [self.text[a], self.text[b]]
        if not (self._stands(a) and self._stands(b)):
            return False
        left, right, due = self.text[a], self.text[b], math.inf
        while True:
            i = self.id_of.get(left + right)
            if i is not None and self.rank[i] < due:
                return False
            x, y = (self.rank[self.id_of[t]] if len(t) > 1 else -1.0 for t in (left, right))
            if x > y:
                due, left = x, self._halves(left)[1]
            elif y < 0:
                return True
            else:  # of equal merges the left one is due first
                due, right = y + 0.5, self._halves(right)[0]

    def _halves(self, text: str) -> list[str]:
        """The two pieces that the last merge joined."""
        if text not in self.halves:
            self.halves[text] = self.merge(text, 2)
        return self.halves[text]

    def _stands(self, i: int) -> bool:
        if i not in self.whole:
            self.whole[i] = self.merge(self.text[i]) == [self.text[i]]
        return self.whole[i]

    def stands(self, ids: np.ndarray) -> np.ndarray:
        """Whether a BPE of the piece's own text is the piece."""
        return np.array([self._stands(i) for i in ids.tolist()], bool)

    # -- Viterbi over units of about one length

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of units, of which the longest come first."""
        lengths = np.array([len(u) for u in units], np.int64)
        n, length = len(units), int(lengths[0])
        points = np.frombuffer("".join([u.ljust(length, "\0") for u in units]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length)
        mixed = _mixed(points.astype(np.uint64))
        score = np.full((length + 1, n), -np.inf)
        score[0] = 0.0
        last = np.full((length + 1, n), -1, np.int64)  # the piece that ends here; -1 for an unknown character
        step = np.ones((length + 1, n), np.int64)  # its length: the backpointer
        floor = float(self.score.min()) - 10.0
        for end in range(1, length + 1):
            m = int(np.searchsorted(-lengths, -end, side="right"))  # the others have ended
            key, power = np.zeros(m, np.uint64), np.ones(1, np.uint64)
            score[end, :m] = score[end - 1, :m] + floor  # as an unknown character, unless a piece does better
            for size in range(1, min(end, self.longest) + 1):
                start = end - size
                key = key + mixed[:m, start] * power
                power = power * _BASE
                rows = np.flatnonzero(self.filter[key >> np.uint64(44)] & np.isfinite(score[start, :m]))
                at = np.minimum(np.searchsorted(self.keys, key[rows]), len(self.keys) - 1)
                hit = self.keys[at] == key[rows]
                rows, piece = rows[hit], self.ids[at[hit]]
                if size == 1:
                    score[end, rows] = -np.inf
                if self.bpe:
                    ok = self.stands(piece) if start == 0 else self.may_follow(last[start, rows], piece)
                    rows, piece = rows[ok], piece[ok]
                    value = np.zeros(len(rows))
                else:
                    value = score[start, rows] + self.score[piece]
                better = value > score[end, rows]
                rows, piece = rows[better], piece[better]
                score[end, rows], last[end, rows], step[end, rows] = value[better], piece, size
        # follow the backpointers of all units together; the ids of a unit end at the right edge of its row
        ids, at, count = np.zeros((n, length), np.int64), lengths.copy(), np.zeros(n, np.int64)
        for column in range(length - 1, -1, -1):
            rows = np.flatnonzero(at)
            if not len(rows):
                break
            ids[rows, column] = last[at[rows], rows]
            count[rows] += 1
            at[rows] -= step[at[rows], rows]
        strange = (ids < 0).any(axis=1).tolist()
        raw, width = ids.astype("<u4").tobytes(), 4 * length
        out = [raw[(r + 1) * width - 4 * c : (r + 1) * width] for r, c in enumerate(count.tolist())]
        for r in (r for r, odd in enumerate(strange) if odd):
            out[r] = self._with_bytes(units[r], ids[r, length - count[r] :].tolist())
        return out

    def _with_bytes(self, unit: str, ids: list[int]) -> bytes:
        """Ids whose unknown characters (-1) are spelt in byte pieces, or the unknown piece without those."""
        whole, at = [], 0
        for i in ids:
            if i >= 0:
                whole.append(i)
                at += len(self.text[i])
            else:
                whole += [self.bytes[b] for b in unit[at].encode("utf-8", "surrogatepass")] if self.bytes else [self.processor.unk_id()]
                at += 1
        return np.array(whole, "<u4").tobytes()

    def units(self, text: str) -> list[str]:
        """Parts of a normalised text that no piece crosses: each is a word with the spaces before it, or a line end."""
        if self.crosses:
            return [text] if text else []
        return (_UNIT if "\n" in self.letters else _UNIT_OF_LINE).findall(text)


_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_UNIT_OF_LINE = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


@remembered(2)
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    def __init__(self, path: str):
        self.pieces = load_pieces(path)
        # units of this and the last generation: those in use stay when the others are forgotten
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text (little-endian, 32 bits), as the library gives them."""
        p = self.pieces
        cut = [self._units(t) for t in texts]
        if len(self.known) > UNITS // 2:
            self.known, self.older = {}, self.known
        fresh: dict[int, list[str]] = {}
        for unit in set().union(*cut).difference(self.known):
            if unit in self.older:
                self.known[unit] = self.older[unit]
            else:
                fresh.setdefault(max(3, len(unit).bit_length()), []).append(unit)
        for own in fresh.values():
            own.sort(key=len, reverse=True)
            width = max(1, 4_000_000 // (len(own[0]) + 1) // 8)  # bounded working arrays
            for at in range(0, len(own), width):
                part = own[at : at + width]
                self.known.update(zip(part, p.encode_units(part), strict=True))
        return [b"".join(map(self.known.__getitem__, own)) for own in cut]

    def _units(self, text: str) -> list[str]:
        return self.pieces.units(self.pieces.processor.normalize(text)) if text else []

    def decode(self, ids: bytes) -> str:
        """Text of the ids: spaces for their sign, bytes joined, the space put before the text taken off."""
        p = self.pieces
        text = b"".join(map(p.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if p.prefixed and text.startswith(" ") else text


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (ids as little-endian unsigned 32 bit), round_trip and, if asked for, ids and decoded.

    ``round_trip``: decoding the ids gives the text. Null texts are empty: no ids. Null and
    repeated ids are carried along, one result row per input row; other columns are not
    read; an empty table gives an empty result. Texts are encoded whole.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path)
        for big in batches:
            for batch in portions(big):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = encoder.encode(texts)
                decoded = [encoder.decode(x) for x in ids]
                columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([a == b for a, b in zip(texts, decoded, strict=True)])]
                if with_ids:
                    ends = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32))
                    columns += [pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4"))), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


@remembered(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
