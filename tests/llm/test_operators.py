"""Small tests of every operator: defined results for nulls, empties, ties and repeats, and brute force."""

import base64
import hashlib
import io
import random
import re
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sigmaspark.llm import common, decontamination, encoders, licenses, quality, sentencepieces, sharding, simhash, token_counts, token_files, toxicity, warc_zip
from sigmaspark.llm.common import shared_dir

WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, words int, key double"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ta", "lo", "mi", "re", "st", "un", "ke"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = words(5, 6000)
    rows = [(1, words(1, 60)), (2, words(1, 60)), (2, words(1, 60)), (3, None), (4, ""), (None, words(2, 40)), (None, None), (5, long), (6, "one two"), (7, "  \n\t "), (8, words(3, 50) + "\n" + words(4, 30))]
    return spark.createDataFrame([(i, t, "en", None if i == 1 else "s", 1, "x", 1, 1.0) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_chunks_encode_as_the_library():
    count, encode = encoders.chunk_counter(BYTE_BPE), encoders.text_encoder(WORD_BPE, "<u2")
    byte, word = encoders.load(BYTE_BPE), encoders.load(WORD_BPE)
    r = random.Random(1)
    letters = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "é", "é", "́", "1", "<|endoftext|>", "\x1c", "\xa0", "　", "!", "ß", "İ", "<|startoftext|>", ".", "漢", "'LL"]
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 12)))
        assert count(t) == len(byte.encode(t, add_special_tokens=False).ids), repr(t)
        assert encode(t) == np.array(word.encode(t, add_special_tokens=False).ids, "<u2").tobytes(), repr(t)


def test_token_files(spark, docs, none):
    path = f"{shared_dir(spark)}/t"
    index = token_files.write_token_files(docs, WORD_BPE, path, end_id=2)
    got = sorted(token_files.read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    tok = encoders.load(WORD_BPE)
    expected = {}
    for i, t in texts_of(docs):
        expected.setdefault(i, []).append([*tok.encode(t, add_special_tokens=False).ids, 2])
    assert [r.doc_id for r in got] == sorted((i for i, _ in texts_of(docs)), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        expected[r.doc_id].remove(list(r.ids))
        at += r.n_tokens
    assert not any(expected.values()) and sum(p["n_tokens"] for p in index["parts"]) == at
    empty = f"{shared_dir(spark)}/e"
    assert token_files.write_token_files(none, WORD_BPE, empty, 2)["parts"] == [] and token_files.read_token_files(spark, empty).count() == 0


def test_token_counts_use_the_cache(spark, docs, none):
    cache = f"{shared_dir(spark)}/cache"
    tok = encoders.load(BYTE_BPE)
    expected = sorted((str(i), len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in texts_of(docs))
    for _ in range(2):
        got = token_counts.token_counts(docs, BYTE_BPE, cache, max_tokens=50)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == expected
        assert all(r.over_limit == (r.n_tokens > 50) for r in got.collect())
        assert spark.read.parquet(cache).count() == len({t for _, t in texts_of(docs)})  # the second run encodes nothing
    assert token_counts.token_counts(none, BYTE_BPE).count() == 0


def test_sentencepiece_is_the_library(spark, docs, none):
    coder = sentencepieces.Encoder(PIECES)
    sp = coder.pieces.processor
    r = random.Random(2)
    letters = ["a", " ", "  ", "\n", "th", "er", "é", "é", "<s>", "▁", "\x00", "\xa0", "　", "ing", "漢", "😀", "<0x41>", " the", "tion"]
    made = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(1500)] + ["", "a" * 5000]
    ids = coder.encode(made)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == sp.encode(made)
    assert [coder.decode(x) for x in ids] == [sp.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
    got = sentencepieces.encode_decode(docs, PIECES).collect()
    assert sorted((str(x.doc_id), list(x.ids)) for x in got) == sorted((str(i), sp.encode(t)) for i, t in texts_of(docs))
    assert sentencepieces.encode_decode(none, PIECES).count() == 0


def test_warc_packages(spark):
    rows = [(1, "u", "same"), (5, "u", "same"), (5, "u", "same"), (3, None, None), (4, "v", ""), (None, "w", "same"), (None, "w", "lone"), (9, "x\r\ny", "ü" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("holder", F.lit(1))
    path = f"{shared_dir(spark)}/w"
    got = warc_zip.read_packages(warc_zip.write_packages(pages, path), path).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.payload_digest): r for r in got}
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert by[1, sha("same")].record_type == "revisit" and by[1, sha("same")].refers_to == 5 and by[1, sha("same")].payload_bytes == 4
    assert by[None, sha("same")].refers_to == 5 and by[None, sha("lone")].record_type == "response"
    assert by[3, sha("")].refers_to == 4 and by[4, sha("")].record_type == "response"
    assert bytes(by[9, sha("ü" * 5000)].payload).decode() == "ü" * 5000
    assert sum(r.record_type == "response" and r.page_id == 5 for r in got) == 2
    assert warc_zip.read_packages(warc_zip.write_packages(pages.limit(0), path + "e"), path + "e").count() == 0
    small = warc_zip.read_packages(warc_zip.write_packages(pages, path + "m", min_bytes=10), path + "m").collect()
    assert all(r.record_type == "response" for r in small)


def test_zip64_directory():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("a/b"), "w", force_zip64=True) as f:
            f.write(b"hello")
        z.writestr("c", b"x" * 100, zipfile.ZIP_DEFLATED)
    data = held.getvalue()
    start, size, method = warc_zip.read_directory(len(data), lambda at, n: data[at : at + n])["a/b"]
    assert (data[start : start + size], method) == (b"hello", 0)
    # a directory whose 32-bit fields are full: counts, sizes and offsets stand in ZIP64 records
    at = data.rfind(b"PK\x05\x06")
    count, length, offset = int.from_bytes(data[at + 10 : at + 12], "little"), int.from_bytes(data[at + 12 : at + 16], "little"), int.from_bytes(data[at + 16 : at + 20], "little")
    end64 = b"PK\x06\x06" + (44).to_bytes(8, "little") + bytes(12) + count.to_bytes(8, "little") * 2 + length.to_bytes(8, "little") + offset.to_bytes(8, "little")
    wide = data[:at] + end64 + b"PK\x06\x07" + bytes(4) + at.to_bytes(8, "little") + bytes(4) + data[at : at + 8] + b"\xff" * 12 + b"\0\0"
    assert warc_zip.read_directory(len(wide), lambda a, n: wide[a : a + n])["a/b"] == (start, size, method)
    # an end signature inside the comment of the end record
    noted = data[: at + 20] + (30).to_bytes(2, "little") + b"PK\x05\x06" + bytes(26)
    assert warc_zip.read_directory(len(noted), lambda a, n: noted[a : a + n])["a/b"] == (start, size, method)
    with pytest.raises(ValueError):
        warc_zip.read_directory(10, lambda a, n: b"x" * 10)


def test_runs_of_records_are_bounded():
    entries = [{"length": n} for n in (5, 5, 30, 5, 5, 5)]
    assert [[e["length"] for e in r] for r in warc_zip._runs(entries, 2, 20)] == [[5, 5], [30], [5, 5], [5]]
    assert list(warc_zip._runs([], 2, 20)) == []


def test_masks_find_all_tolerated_substitutions():
    from itertools import combinations

    for length, allowed in ((decontamination.WINDOW, 2), (11, 1), (decontamination.SEEDED, 1)):
        for gone in combinations(range(length), allowed):
            assert any(all(o + p not in gone for p in m) for m in decontamination.MASKS for o in range(length - max(m)))


def test_decontamination(spark, docs, none):
    item, brief = words(11, 30), "alpha beta gamma delta"
    bench = spark.createDataFrame([(1, item), (1, item), (2, brief), (3, None), (4, ""), (5, words(12, 9))], "item_id long, text string")
    w = item.split()
    near, far = [*w], [*w]
    near[4] = near[15] = near[26] = "zzz"  # at most two in any window
    for k in range(0, 30, 3):
        far[k] = "zzz"
    texts = {1: item.upper(), 2: "x " + " ".join(near) + " y", 3: "x " + " ".join(far), 4: f"({brief})!", 5: "alpha beta gamma x delta", 6: None, 7: "", 8: words(77, 500) + " " + item[: len(item) // 2]}
    d = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(1, item)], "doc_id long, text string").withColumn("item_id", F.lit(9))
    got = {(r.doc_id, tuple(r.item_ids)) for r in decontamination.find_leaks(d, bench).collect()}
    assert got == {(1, (1,)), (2, (1,)), (3, ()), (4, (2,)), (5, ()), (6, ()), (7, ()), (8, (1,))}
    assert sorted(r.doc_id for r in decontamination.drop_leaks(d, bench).collect()) == [3, 5, 6, 7]
    limit, decontamination.BROADCAST_BYTES = decontamination.BROADCAST_BYTES, 0
    try:  # the way for benchmarks too large to broadcast
        assert {(r.doc_id, tuple(r.item_ids)) for r in decontamination.find_leaks(d, bench).collect()} == got
    finally:
        decontamination.BROADCAST_BYTES = limit
    assert decontamination.find_leaks(none, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.find_leaks(docs, bench.limit(0)).collect())
    assert decontamination.find_leaks(docs, bench).count() == docs.count()


@pytest.mark.parametrize("limit", [0, 64_000_000])
def test_all_texts_of_an_item_are_sought(spark, limit, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
    texts = [words(20 + k, 20) for k in range(6)]
    bench = spark.createDataFrame([(1, t) for t in texts] + [(None, words(30, 20))], "item_id long, text string")
    d = spark.createDataFrame([(k, f"x {t} y") for k, t in enumerate([*texts, words(31, 20)])], "doc_id long, text string")
    assert sorted(r.doc_id for r in decontamination.find_leaks(d, bench).where("contaminated").collect()) == list(range(6))


@pytest.mark.parametrize("limit", [0, 64_000_000])
def test_very_short_items_are_whole_documents(spark, limit, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
    bench = spark.createDataFrame([(1, "the"), (2, "Yes, sir!")], "item_id long, text string")
    d = spark.createDataFrame([(1, "the"), (2, "over the hill"), (3, "yes sir"), (4, "he said yes sir"), (5, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in decontamination.find_leaks(d, bench).where("contaminated").collect()) == [1, 3]


def test_copies_of_an_item_cost_no_more_than_one(spark, monkeypatch):
    """One text under many ids is sought once: nothing else of the job grows with its copies, and no document's words are written or exchanged."""
    written = []
    monkeypatch.setattr(decontamination, "cut", lambda df, name="cut": written.append((name, df.count())) or common.cut(df, name))
    item = words(40, 40)
    bench = spark.range(4000).select(F.col("id").alias("item_id"), F.lit(item).alias("text"))
    d = spark.createDataFrame([(1, f"x {item} y"), (2, words(41, 60))], "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.find_leaks(d, bench).collect()}
    assert got == {1: list(range(4000)), 2: []} and written == [("items", 1)]


def test_hits_leave_without_their_document(spark):
    """A long document's words times its hits, held at once, would be some 5 GB here."""
    r, some = random.Random(3), words(60, 90).split()
    items = [" ".join(r.choices(some, k=12)) for _ in range(1500)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontamination.find_leaks(spark.createDataFrame([(1, " ".join(items))], "doc_id long, text string"), bench).collect()
    assert [(x.doc_id, x.item_ids) for x in found] == [(1, list(range(1500)))]


@pytest.mark.parametrize(("limit", "piece"), [(0, 512), (64_000_000, 512), (64_000_000, 1)])
def test_leaks_equal_the_sql(spark, limit, piece, monkeypatch):
    """Changed, shifted and cut passages, several texts of an id and several ids of a text, both ways, also over several pieces of a document."""
    import duckdb

    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(decontamination, "PIECE", piece)
    r = random.Random(7)
    some = [words(300 + k, n).split() for k, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 11, 12, 13, 20, 40, 90])]
    items = [(k % 11, " ".join(w)) for k, w in enumerate(some)] + [(k + 50, " ".join(w)) for k, w in enumerate(some[6:])]
    texts = []
    for k in range(400):
        w = list(r.choice(some))
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice(["zzz", "alpha"])
        gone = r.randrange(0, max(1, len(w) // 2))
        w = w[gone:] if k % 3 == 0 else w[: len(w) - gone] if k % 3 == 1 else w
        texts.append((k % 390, " ".join(words(900 + k, r.randrange(6) + 100 * (k % 5 == 0)).split() * (k % 2) + w + words(1400 + k, r.randrange(6)).split() * (k % 4 > 1))))
    con = duckdb.connect()
    for name, key, made in (("documents", "doc_id", texts), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", made)
    found = decontamination.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((x.doc_id, x.contaminated, x.n_items, ",".join(map(str, x.item_ids))) for x in found.collect())
    assert got == sorted(con.execute(decontamination.OP5_SQL).fetchall()) and 50 < sum(x[1] for x in got) < 390


def test_filter_of_seeds_loses_none(spark, monkeypatch):
    """Documents' positions that no seed equals hardly leave their tasks."""
    seeds = spark.range(5000).select(F.xxhash64("id").alias("seed"))
    probes = spark.range(100_000).select(F.col("id").alias("row"), F.lit(0).alias("i"), F.xxhash64("id").alias("seed"))
    for slices in (2048, 1):
        monkeypatch.setattr(decontamination, "SLICES", slices)
        passed = {x.row for x in decontamination._passed(probes, seeds, 5000 * (20 if slices > 1 else 1)).collect()}
        assert passed >= set(range(5000)) and len(passed) < 5000 + 0.03 * 95_000


def test_sharding(spark, docs, none):
    many = spark.createDataFrame([(i, words(i % 700, 20 + i % 50) if i % 3 else "copy of one text") for i in range(3000)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = sharding.shard_documents(many, 8).collect()
    assert len(got) == many.count()
    sizes, slots = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(sizes.values()) / 8, max(r["size"] for r in got)
    assert all(abs(s - mean) <= 0.05 * mean + largest for s in sizes.values())
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts_of(many)}
    assert sharding.shard_documents(none, 8).count() == 0
    path = f"{shared_dir(spark)}/shards"
    sharding.write_shards(docs, path, 3)
    assert spark.read.parquet(path).count() == docs.count()


def test_equal_texts_share_a_shard(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAF_ROWS", 50)  # the large group's rows are numbered in many intervals
    many = spark.createDataFrame([(i, "one text of a third" if i % 3 == 0 else words(i % 400, 30)) for i in range(1500)], "doc_id long, text string").withColumn("shard", F.lit(1))
    got = sharding.shard_documents(many, 5).collect()
    shards, slots = {}, {}
    for r in got:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 1500 and all(len(x) == 1 for x in shards.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def fingerprint(t, n):
    w = t.encode().lower().split()
    grams = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def smallest_reachable(ids, linked):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    groups = {}
    for k, i in enumerate(ids):
        groups.setdefault(find(k), []).append(i)
    return [min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(ids))]


@pytest.mark.parametrize("tau", [0, 1, 2])
@pytest.mark.parametrize("bucket", [0, 32])
def test_near_duplicates_are_brute_force(spark, docs, none, tau, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_BUCKET", bucket)
    r = random.Random(3)
    base = words(50, 300).split()
    rows = texts_of(docs)
    for k in range(60):
        w = [*base]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed"
        rows.append((100 + k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit(1))
    fps = [fingerprint(t, 3) for _, t in rows]
    expected = smallest_reachable([i for i, _ in rows], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= tau)
    got = simhash.near_duplicates(d, tau, 3).select("doc_id", simhash.hex16(F.col("fp")).alias("fp"), "component_id").collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=i, fp=f"{f:016x}", component_id=c)) for (i, _), f, c in zip(rows, fps, expected, strict=True))
    assert simhash.near_duplicates(none, tau).count() == 0


def test_thresholds_keep_the_pigeonhole():
    agree = simhash._agreement(0, np.zeros((64, 64)))
    for n in (10, 10**5, 10**9, 10**12):
        plan = simhash.allocate(n, agree, 2)
        bits = [b for g, _ in plan for b in g]
        assert len(bits) == len(set(bits))
        # any two differing bits leave some partition within its threshold
        where = {b: k for k, (g, _) in enumerate(plan) for b in g}
        for a in range(64):
            for b in range(a):
                hits = [where.get(a), where.get(b)]
                assert any(hits.count(k) <= t for k, (_, t) in enumerate(plan))


def test_similar_texts_and_dropping(spark, docs, none):
    base = words(60, 200).split()
    rows = [(1000, " ".join(base))]
    for k in range(40):
        w = [*base]
        w[5 * k % 200] = "changed"
        rows.append((1001 + k, " ".join(w)))
    d = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    kept = simhash.drop_near_duplicates(d).collect()
    ids = [r.doc_id for r in kept]
    assert 1000 in ids and not any(1001 <= (i or 0) <= 1040 for i in ids)
    assert ids.count(1) == 1 and 2 not in ids and 5 in ids and 6 in ids and 8 in ids and ids.count(None) == 1
    assert simhash.drop_near_duplicates(d, similarity=None).columns == d.columns
    assert simhash.drop_near_duplicates(none).count() == 0


def roots_of(spark, texts):
    got = simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: r.root for r in got}


def test_pairs_inside_a_template_family_are_linked(spark):
    base = words(61, 80).split()
    texts = []
    for k in range(60):  # pages are 0.67 alike; each has a partner that differs in the last word
        w = [*base]
        w[10], w[35], w[60] = f"own{k}a", f"own{k}b", f"own{k}c"
        texts += [" ".join(w), " ".join([*w[:-1], "other"])]
    root = roots_of(spark, texts)
    assert all(root[2 * k] == root[2 * k + 1] for k in range(60)) and len(set(root.values())) == 60


def test_texts_with_changed_blocks_are_linked(spark):
    texts = []
    for k in range(60):  # a fifth of another text is appended, or a block is replaced
        w = words(7000 + k, 200).split()
        other = words(8000 + k, 40).split()
        texts += [" ".join(w), " ".join(w + other)] if k % 2 else [" ".join(w), " ".join(w[:100] + other[:16] + w[116:])]
    root = roots_of(spark, texts)
    assert all(root[2 * k] == root[2 * k + 1] for k in range(60)) and len(set(root.values())) == 60


def test_families_about_the_limit_are_those_of_brute_force(spark):
    """Edited, shortened and prolonged texts of few families, copies and shared edits among them: every link at 0.8, and no other."""
    r = random.Random(11)
    texts = []
    for family in range(3):
        base = words(7000 + family, 120 + 40 * family).split()
        variants = [base]
        for k in range(3):  # edits that part of the family shares
            v = list(base)
            for at in r.sample(range(len(v)), 4):
                v[at] = f"shared{k}"
            variants.append(v)
        for k in range(90):
            w = list(r.choice(variants))
            for at in r.sample(range(len(w)), r.randint(0, 5)):
                w[at] = f"own{family}x{k}x{at}"
            cut_off = r.randint(0, 25)
            w = w[cut_off:] if k % 3 == 0 else w + words(7100 + k, cut_off).split() if k % 3 == 1 else w
            texts += [" ".join(w)] * (1 + (k % 20 == 0))
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    lows, near = list(range(len(texts))), 0

    def low(i):
        while lows[i] != i:
            i = lows[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            same = 5 * len(x & y) >= 4 * len(x | y)
            near += 0.6 <= len(x & y) / len(x | y) < 0.8
            if same:
                a, b = sorted((low(i), low(j)))
                lows[b] = a
    assert near > 3000 and 3 < len({low(i) for i in range(len(texts))}) < len(texts) - 50
    got = simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    first = {}
    for x in sorted(got, key=lambda x: x.doc_id):
        first.setdefault(x.root, x.doc_id)
    assert [first[x.root] for x in sorted(got, key=lambda x: x.doc_id)] == [low(i) for i in range(len(texts))]


def test_what_two_texts_may_share_is_never_underrated(spark):
    """The bound from differences against a third text, over small and large sets, none of whose pairs may exceed it."""
    r = random.Random(5)
    sets = {k: r.sample(range(1 << 62), 3) + [h * 0x9E3779B97F4A7C15 % (1 << 63) for h in r.sample(range(900), r.choice([0, 1, 40, 300, 700]))] for k in range(25)}
    held = spark.createDataFrame([(k, v) for k, v in sets.items()], "node long, hashes array<long>")
    rows = spark.createDataFrame([(1, k, float(k == 7), len(v)) for k, v in sets.items()], "shingle long, node long, score float, n int")
    against = simhash._against_middle(rows, held)
    found = {x.node: x for x in against.collect()}
    assert {x.ref for x in found.values()} == {7} and all(x.common == len(set(sets[k]) & set(sets[7])) for k, x in found.items())
    both = rows.join(against, "node")
    for p in both.alias("x").crossJoin(both.alias("y")).select("x.node", F.col("y.node").alias("other"), simhash._most_shared().alias("most")).collect():
        assert p.most >= len(set(sets[p.node]) & set(sets[p.other]))
        assert p.node != p.other or p.most == len(sets[p.node])


def test_long_texts_are_linked_at_the_very_similarity(spark):
    texts, linked = [], []
    for k in range(40):  # 1196 shingles shared by both, of 1494 or 1500 together
        w = words(9000 + k, 1200).split()
        extra = [f"x{k}y{j}" for j in range(299 if k % 2 else 300)]
        texts += [" ".join(w), " ".join(w + extra)]
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts[-2:])
        linked.append(len(a & b) / len(a | b) >= 0.8)
    root = roots_of(spark, texts)
    assert [root[2 * k] == root[2 * k + 1] for k in range(40)] == linked and 0 < sum(linked) < 40


def test_quality_rules(spark, docs, none):
    r = quality.quality_rules(docs).collect()
    assert len(r) == docs.count()
    by = {x.doc_id: x for x in r if x.doc_id is not None}
    assert by[3].n_words == 0 and by[3].base_failed and not by[3].kept and by[7].n_words == 0 and by[5].n_words == 6000 and by[5].kept
    line = "this very line stands in all documents of the host and is long enough"
    rows = [(k, f"{words(k, 30)}\n{line} {k % 7}\n{words(k + 900, 30)}", "h") for k in range(100)] + [(500, f"{line}\n{words(500, 5)}", "h"), (501, f"{line}\n{line}", "other")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    got = {x.doc_id: x for x in quality.quality_rules(d).collect()}
    assert all(got[k].removed_words == 15 and got[k].kept for k in range(100))  # digits count alike
    assert got[501].kept is False or got[501].n_dup_lines == 1
    kept = {x.doc_id: x for x in quality.apply_quality_rules(d).collect()}
    assert line not in kept[3].text and kept[3].n_chars == len(kept[3].text) and kept[3].text.split("\n")[0] == words(3, 30)
    copies = spark.createDataFrame([(k, words(7, 20) + "\n" + words(8, 20), "h") for k in range(300)], "doc_id long, text string, source string")
    assert all(x.kept for x in quality.quality_rules(copies).collect())  # copies of one document are one document
    assert quality.quality_rules(none).count() == 0 and quality.apply_quality_rules(none).columns == none.columns


def test_pages_with_the_same_header_and_footer_are_different(spark):
    common = [words(600 + k, 12) for k in range(20)]
    d = spark.createDataFrame([(k, "\n".join([*common[:10], words(k + 3000, 200), *common[10:]]), "h") for k in range(400)], "doc_id long, text string, source string")
    assert {x.removed_words for x in quality.quality_rules(d).collect()} == {240}


def test_lines_are_counted_by_brute_force(spark):
    menu = [words(800 + k, 6) for k in range(40)]
    rows = [(k, "\n".join([*menu, words(k + 4000, 300)]), "a") for k in range(200)] + [(k, "\n".join([menu[0], words(k + 4000, 30)]), "b") for k in range(300, 315)]
    rows += [(1000 + k, rows[0][1], "a") for k in range(30)]  # exact copies are one document
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    holders, hosts = {}, {}
    for _, t, h in rows:
        hosts[h] = hosts.get(h, 0) + 1
        for line in set(t.split("\n")):
            holders.setdefault((h, line), set()).add(t)
    gone = {x for x, ts in holders.items() if len(ts) > quality.MIN_DOCS and len(ts) > quality.HOST_SHARE * hosts[x[0]]}
    want = {i: sum(len(line.split()) for line in t.split("\n") if (h, line) in gone) for i, t, h in rows}
    got = {x.doc_id: x.removed_words for x in quality.quality_rules(d).collect()}
    assert got == want and got[0] == 240 and got[300] == 0


def test_repeated_words_by_brute_force():
    r = random.Random(4)
    for _ in range(300):
        w = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 40))]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        marked = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 5)}
        assert quality._repeated_words(w) == len(marked)


def test_licenses(spark, docs, none):
    texts = {1: "Released under the MIT License.", 2: "x Licensed under the Apache License, Version 2.0. CC BY-NC cc by nc", 3: None, 4: "", 5: "This work is licensed under the GNU General Public License, version 3.", 6: "licensed under the GNU General Public License, version 9",
             7: "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files", 8: "cc by nc " * 50}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("label", F.lit("x"))
    got = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].base_labels) == (5, 1, 1, "mit")
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels, got[2].labels) == (3, 4, 12, "apache-2,cc-by-nc", "apache-2,cc-by-nc")
    assert got[3].n_words == got[4].n_words == 0 and got[3].first_word is None and got[3].score == 0 and got[3].labels == ""
    assert got[5].labels == "gpl-3" and got[5].base_labels == "" and got[6].labels == "" and got[7].labels == "mit" and got[8].n_base == 50
    for i, t in texts_of(docs):
        n = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t))
        assert any(r.doc_id == i and r.n_words == n for r in licenses.scan_licenses(docs).collect())
        break
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(none).count() == 0


def test_toxicity(spark, docs, none):
    r = random.Random(6)
    rows, labels = [], []
    for k in range(1500):
        w = words(k + 5000, 40).split()
        if k % 6 == 0:
            w[r.randrange(40)] = r.choice(["stupid", "moron", "idiot"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 6 == 0)))
    hidden = {9001: "st4t s t u p i d", 9002: "a m0r0n lo", 9003: "you 1d1ot", 9004: "stuuuupid", 9005: "m.o.r.o.n", 9006: "lota mire 2024 10:30 3.14"}
    d = spark.createDataFrame(rows + list(hidden.items()) + [(9007, None), (9008, ""), (None, "stupid talo")], "doc_id long, text string").withColumn("score", F.lit("x"))
    model = toxicity.train(d, spark.createDataFrame([*labels, (None, 1), (3, None), (3, 0)], "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score_toxicity(d, model).collect()}
    assert all(got[i].predicted == 1 for i in (9001, 9002, 9003, 9004, 9005, None)) and not any(got[i].predicted for i in (9006, 9007, 9008))
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k].predicted == int(k % 6 == 0) for k in held) >= 0.99 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values())
    left = {x.doc_id for x in toxicity.drop_toxic(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert 9006 in left and 9007 in left and 9001 not in left and 0 not in left
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.train(docs, empty)).count() == docs.count()
    assert toxicity.drop_toxic(none, empty).count() == 0
    assert "stupid" in toxicity.restore_texts(d.where("doc_id = 9001"), model["log_chances"]).first().restored


ENGLISH = "you are the most useful person and should go to a school that is not in our town while other people read books about birds or walk over hills".split()


@pytest.fixture(scope="module")
def insults(spark):
    r = random.Random(7)
    rows = []
    for k in range(1500):
        w = [r.choice(ENGLISH) for _ in range(40)]
        if k % 6 == 0:
            w[r.randrange(40)] = r.choice(["stupid", "worthless", "idiot", "moron", "loser", "trash", "ass", "twat"])
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.train(d, spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(1500)], "doc_id long, toxic int"))


def predicted(spark, model, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.predicted for r in toxicity.score_toxicity(d, model).collect()}
    return [t for k, t in enumerate(texts) if found[k]]


def test_every_disguise_is_decoded(spark, insults):
    hidden = ["stup" + "i" * 30 + "d", "w.o.r.t.h.l.e.s.s.i.d.i.o.t.m.o.r.o.n", "1d10t", "l053r", "7r45h", "w0r7hl355", "tw@t", "stuupiid", "s--t--u--p--i--d", "st.up.id", "you are a " + " ".join("uselesspersonandothermostusefulstupid")]
    assert predicted(spark, insults, [f"go to our town {x} and read" for x in hidden]) == [f"go to our town {x} and read" for x in hidden]
    assert predicted(spark, insults, ["2024 10:30 3.14 books, birds!", "the school is not in our town!", None, "well-known hills (see a school)"]) == []


def test_unmarked_tokens_are_skipped_without_loss(insults):
    r = random.Random(9)
    signs = ["s", "t", "u", "p", "i", "d", "1", "$", "!", ".", "m", "o", "r", "n", "0", "é", "ß", "-", "@", "x", "ς", "😀", "²"]
    texts = [" ".join("".join(r.choice(signs) for _ in range(r.randint(1, 9))) for _ in range(20)) for _ in range(300)] + ["stup" + "i" * 10_000 + "d", "m0r0n" + "_" * 6, "s.t.u.p.i.d" * 50]
    quick, full = toxicity.Scorer(**insults), toxicity.Scorer(**insults)
    full.all_hold = True
    found = quick.summaries(texts)
    assert found == full.summaries(texts) and all(x[0] > 0 for x in found[-3:])


def test_short_words_are_learnt(spark, insults):
    hidden = ["ass", "a$$", "a s s", "a.s.s", "aaassss"]
    assert predicted(spark, insults, [f"go to our town {x} and read" for x in hidden]) == [f"go to our town {x} and read" for x in hidden]
    assert predicted(spark, insults, ["go to our town and read as you are"]) == []


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    folder = "/root/testdata/sf0.001"
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, folder)
        assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert {1, 5, 8, None} == kept  # the repeats of 1 and the short texts go
    final = corpus_pipeline.STAGES[-1][1](spark, out, folder).collect()
    assert {r.doc_id for r in final} == kept and all(r.round_trip for r in final)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
