"""Collocations against counting by hand."""

import random
import re
from collections import Counter

from sigmaspark.llm import collocations

DOCS = "doc_id long, text string, lang string, source string, f long, words string, part int, phrase string"


def by_hand(rows, least, most, covered=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    out = []
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for lang in n:
        own = []
        for (g, ws), a in cands.items():
            if g != lang or any(h == g and len(v) > len(ws) and 100 * b >= covered * a and any(v[i : i + len(ws)] == ws for i in range(len(v))) for (h, v), b in cands.items()):
                continue
            s, k = min((2_000_000 * a // (f[g, ws[:k]] + f[g, ws[k:]]), k) for k in range(1, len(ws)))
            own.append((-s, -a, " ".join(ws).encode(), f[g, ws[:k]], f[g, ws[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(own)[:most])]
    return sorted(out)


def rows_of(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "New", "york", "é", "São", "in", "a\x01b", "漢字", "co"]
    out = [(None, "a b"), ("en", None), ("en", ""), ("en", " \t\n"), ("x", "...")]
    for _ in range(n):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\r\n", ",", "\xa0 "]) for _ in range(r.randint(1, 30)))
        out.append((r.choice(["en", "en", "en", None, "und", "de"]), t))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, t, g, "s", 1, "w", 0, "p") for k, (g, t) in enumerate(rows)], DOCS)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_against_counting(spark, monkeypatch):
    rows = rows_of(1, 300)
    assert got(collocations.collocations(frame(spark, rows), least=5, most=50)) == by_hand(rows, 5, 50)
    # many runs and ranges, so that groups of equal prefixes are cut
    monkeypatch.setattr(collocations, "RUN_BYTES", 300)
    monkeypatch.setattr(collocations, "REDUCER_BYTES", 1500)
    monkeypatch.setattr(collocations, "STREAM_ROWS", 20)
    assert got(collocations.collocations(frame(spark, rows), least=3, most=2000)) == by_hand(rows, 3, 2000)


def test_edges(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [("en", None), ("en", "")])).count() == 0
    long = "of the old town " * 40_000  # one very long text without an end of a piece
    (a, b, *_), = [got(collocations.collocations(frame(spark, [("en", long)]), most=2))]
    assert a[0] == "en" and a[6] == 160_000 and a[3] >= 39_999 and b[1] == 2


def test_large_numbers(spark):
    df = spark.createDataFrame([(10**13,)], "f long")
    assert df.selectExpr("cast(2000000 as decimal(7,0)) * cast(f as decimal(20,0)) div (cast(f as decimal(20,0)) + cast(f as decimal(20,0))) as s").first().s == 1_000_000
