"""Units of several lengths in one pass, pairs of pieces by undone merges, and the units that stay remembered."""

import random

import numpy as np
import public_tokenizers

from sigmaspark.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_units_of_several_lengths():
    p = sentencepieces.load_pieces(PATH)
    units = sorted(["▁" + w for w in ["internationalization", "tokens", "a", "naïve", "\U0001f600x", "zzzzq", "\0"]] + ["▁▁▁", "▁"], key=len, reverse=True)
    assert p.encode_units(units) == [p.encode_units([u])[0] for u in units]
    words = [u for u in units if "▁▁" not in u and len(u) > 1 and "\0" not in u]
    assert [np.frombuffer(x, "<u4").tolist() for x in p.encode_units(words)] == [p.processor.encode(u[1:]) for u in words]


def test_pairs_by_undone_merges():
    p, r = sentencepieces.load_pieces(PATH), random.Random(4)
    assert p.ranked
    ids, said = list(p.id_of.values()), set()
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(1000)] + [(a, b) for t in p.tied for u in (p.id_of[t], p.id_of["▁"]) for a, b in ((p.id_of[t], u), (u, p.id_of[t]))]
    for t in r.sample([t for t in p.id_of if len(t) > 1], 2000):
        k = r.randrange(1, len(t))
        if t[:k] in p.id_of and t[k:] in p.id_of:
            pairs.append((p.id_of[t[:k]], p.id_of[t[k:]]))
    for a, b in pairs:
        said.add(p._apart(a, b))
        assert p._apart(a, b) == (p.merge(p.text[a] + p.text[b]) == [p.text[a], p.text[b]])
    assert said == {True, False}


def test_units_in_use_stay(monkeypatch):
    monkeypatch.setattr(sentencepieces, "UNITS", 20)
    encoder, made = sentencepieces.Encoder(PATH), []
    encode = encoder.pieces.encode_units
    monkeypatch.setattr(encoder.pieces, "encode_units", lambda units: made.extend(units) or encode(units))
    for n in range(12):
        text = "always there " + " ".join(f"q{n}x{k}" for k in range(12))
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.pieces.processor.encode(text)
    assert made.count("▁always") == made.count("▁there") == 1
    assert len(encoder.known) + len(encoder.older) < 60
