"""Exact encoding of whole texts by chunks, whose results are remembered.

A tokenizer splits a text before it merges pieces, and never merges across such a
split. A text is cut at spaces where the tokenizer always splits; each distinct chunk is
encoded once by the library and looked up afterwards. The memory is bounded: it is
emptied when it holds ``MEMORY`` chunks.
"""

from __future__ import annotations

import array
import os
import re
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMORY = 700_000


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Remembered(dict):
    """Key -> value, made on first use; emptied between texts when it holds ``MEMORY`` keys."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        value = self[key] = self.make(key)
        return value

    def values_of(self, keys: list[str]) -> Iterator:
        if len(self) > MEMORY:
            self.clear()
        return map(self.__getitem__, keys)


#: A space after which the text doesn't go on with a visible character: no split there.
_OPEN_SPACE = re.compile(r" (?=\s|$)")


def space_chunks(text: str) -> list[str]:
    """Chunks of a text for byte-level splitting, where a space belongs to the word after it.

    A space before a visible character always starts a new piece there, whatever white
    space stands before it. Other spaces stay inside their chunk.
    """
    parts = text.split(" ")
    if len(parts) == 1:
        return parts
    if _OPEN_SPACE.search(text) is None:
        return [parts[0], *[" " + p for p in parts[1:]]]
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


def _spec(tok) -> dict:
    import json

    return json.loads(tok.to_str())


def _plain_added(spec: dict) -> bool:
    return not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or not t["content"].startswith("<|") for t in spec["added_tokens"])


def _byte_level(spec: dict) -> bool:
    """Whether the tokenizer splits as ``space_chunks`` assumes: byte level, own pattern, text unchanged."""
    pre = spec["pre_tokenizer"] or {}
    return spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and not pre.get("add_prefix_space", True) and _plain_added(spec)


def _drops_space(spec: dict) -> bool:
    """Whether white space only separates: removed by the split, never part of a token."""
    normal = (spec["normalizer"] or {}).get("normalizers", [])
    steps = [x["type"] for x in normal]
    if any((x.get("pattern"), x.get("content")) != ({"Regex": r"\s+"}, " ") for x in normal if x["type"] == "Replace"):
        return False
    first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    return steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and _plain_added(spec)


#: Chunks of these characters alone are split here; all others go to the library whole.
_SIMPLE = re.compile("[\\t\\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u01c3]+")

#: The split pattern of byte-level tokenizers.
_BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _chunk_values(path: str, pack: Callable[[list[int]], object], join: Callable[[list], object]) -> tuple[bool, Remembered] | None:
    """Whether the tokenizer drops spaces, and the values of chunks; None where it is of another kind."""
    import regex

    tok = load(path)
    spec = _spec(tok)
    spaced, byte_level = _drops_space(spec), _byte_level(spec)
    if not spaced and not byte_level:
        return None
    pattern = _BYTE_LEVEL_PATTERN if byte_level else spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    pieces_of, letters, tokenize = regex.compile(pattern).findall, _byte_letters(), tok.model.tokenize

    def piece(p: str):
        return pack([t.id for t in tokenize(p if p.isascii() and p.isalpha() else p.encode().decode("latin-1").translate(letters))])

    def value(chunk: str):
        if chunk.isascii() and chunk.isalpha():
            return piece(chunk.lower() if spaced else chunk)
        if _SIMPLE.fullmatch(chunk) is None or "<|" in chunk:
            return pack(tok.encode(chunk, add_special_tokens=False).ids)
        parts = pieces_of(chunk.lower() if spaced else chunk)
        return piece(parts[0]) if parts == [chunk] else join(list(map(known.__getitem__, parts)))

    known = Remembered(value)
    return spaced, known


def _chunk_ids(path: str, pack: Callable[[list[int]], object], join: Callable[[list], object]) -> Callable[[str], object] | None:
    """Function from a text to the joined values of its pieces, or None where the tokenizer is of another kind."""
    found = _chunk_values(path, pack, join)
    if found is None:
        return None
    spaced, chunks = found
    if spaced:
        return lambda text: join(chunks.values_of(text.replace("\n", " ").split(" ")))
    return lambda text: join(chunks.values_of(space_chunks(text)))


@lru_cache(maxsize=4)
def chunk_counter(path: str) -> Callable[[str], int]:
    """Function from a text to its number of tokens, as the library counts them without added special tokens."""
    tok = load(path)
    if path.endswith(".model"):
        return lambda text: len(tok.encode(text, num_threads=1))
    return _chunk_ids(path, len, sum) or (lambda text: len(tok.encode(text, add_special_tokens=False).ids))


@lru_cache(maxsize=4)
def text_encoder(path: str, dtype: str) -> Callable[[str], bytes]:
    """Function from a text to its ids as little-endian bytes of ``dtype``, without added special tokens."""
    tok, pack = load(path), lambda ids: np.array(ids, dtype).tobytes()
    if path.endswith(".model"):
        return lambda text: pack(tok.encode(text, num_threads=1))
    return _chunk_ids(path, pack, b"".join) or (lambda text: pack(tok.encode(text, add_special_tokens=False).ids))


@lru_cache(maxsize=4)
def batch_encoder(path: str, dtype: str) -> Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]]:
    """Function from texts (no nulls) to all their ids, one text after the other, and each text's number of ids.

    Where white space only separates, the texts of a batch are split at once, and of their
    words the different ones are looked up or encoded.
    """
    kind = array.array({2: "H", 4: "I"}[np.dtype(dtype).itemsize])
    pack = lambda ids: array.array(kind.typecode, ids).tobytes()
    found = None if path.endswith(".model") else _chunk_values(path, pack, b"".join)
    if found is None or not found[0] or sys.byteorder != "little":
        encode, width = text_encoder(path, dtype), np.dtype(dtype).itemsize

        def one_by_one(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
            ids = [encode(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(ids), dtype), np.array([len(x) // width for x in ids], np.int64)

        return one_by_one
    chunks, width = found[1], kind.itemsize

    def together(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)  # never joins or parts letters; special tokens alone know upper case
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        # no chunk holds white space: joined and split again, they become Python strings fastest
        different = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")[0].as_py()
        values = list(chunks.values_of(different.split(" ") if len(coded.dictionary) else []))
        known = np.frombuffer(b"".join(values), dtype)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
        which = coded.indices.to_numpy()
        size = sizes[which]
        ends = np.cumsum(size)
        # where each chunk's ids stand among those of the different chunks
        ids = known[np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()])

    return together
