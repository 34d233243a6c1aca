"""Repeated strings against a set of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from sigmaspark.llm import suffixes
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, key string, at long, hash long, spans string"


def by_hand(texts):
    n, data = Counter(), [(t or "").encode() for t in texts]
    for d in data:
        n.update(d[i : i + 200] for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if n[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def found(spark, texts):
    docs = spark.createDataFrame([(k, t, "en", "k", 1, 2, "s") for k, t in enumerate(texts)], DOCS)
    out = suffixes.repeated_spans(docs)
    joined = docs.select("doc_id", suffixes.content_key(F.col("text")).alias("key")).join(out, "key")
    return sorted((r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in joined.collect())


def planted(seed, n):
    r = random.Random(seed)
    prose = lambda k: "".join(r.choice("abcdé \n") for _ in range(k))
    passages = [prose(k) for k in (195, 198, 199, 200, 201, 205, 230, 300, 420, 700)]
    out = [None, "", "short", "é" * 99, "é" * 100, "é" * 101, "ab" * 150, "x" * 700]
    for _ in range(n):
        out.append(prose(r.randint(0, 150)) + "".join(r.choice(passages)[r.choice([0, 0, 0, 3, 40]) :] + prose(r.choice([0, 1, 2, 60, 200])) for _ in range(r.randint(0, 3))))
    near = list(prose(2500))
    for _ in range(4):
        for _ in range(4):
            near[r.randrange(len(near))] = "z"
        out.append("".join(near))
    return [*out, *out[12:15], out[12]]


def test_runs_and_merge():
    r = random.Random(2)
    for _ in range(200):
        runs = [sorted({bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 9))}) for _ in range(r.randint(1, 7))]
        coded = [[(n, s[:n] + x) for s, n, x in zip(run, *suffixes.front_coded(run), strict=True)] for run in runs]
        assert [[s for _, s in c] for c in coded] == runs
        out = list(suffixes.merged([iter(c) for c in coded]))
        strings = [item[1] for _, item in out]
        assert strings == sorted(s for run in runs for s in run)
        assert [n for n, _ in out[1:]] == [suffixes.common_prefix(a, b) for a, b in zip(strings, strings[1:], strict=False)]


def test_anchors_of_equal_windows(monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice("ab ") for _ in range(k)).encode() for k in (0, 5, 199, 200, 201, 900)] + [b"ab" * 300]
    for block in (suffixes.BLOCK, 333):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        text, _, at = suffixes.anchors(texts)
        windows = sorted((int(t), int((a >> 16) - d)) for t, a in zip(text, at, strict=True) for d in range(int(a) & 255, (int(a) >> 8 & 255) + 1))
        assert windows == [(t, i) for t, x in enumerate(texts) for i in range(len(x) - 199)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed, monkeypatch):
    texts = planted(seed, 60)
    monkeypatch.setattr(suffixes, "REDUCER_BYTES", 9_000 if seed == 1 else 10**9)
    monkeypatch.setattr(suffixes, "RUN_BYTES", 20_000)
    assert found(spark, texts) == by_hand(texts)


def test_edges(spark):
    assert found(spark, []) == []
    assert found(spark, [None, "", "a"]) == by_hand([None, "", "a"])
    long = "".join(random.Random(9).choice("abc ") for _ in range(60_000))
    assert found(spark, [long, "q" + long[30_000:30_400]]) == by_hand([long, "q" + long[30_000:30_400]])
