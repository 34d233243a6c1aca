"""White space within words, look-alike letters, and the decoder against all paths of small lattices."""

import itertools
import random

import numpy as np
import pytest

from sigmaspark.llm import toxicity

PLAIN = "you are the most useful person as far as we know and should go to a school at a town while that which it was is in our ship worth less use of id or on so if more people pay it up".split()
MARKED = ["stupid", "worthless", "idiot", "moron", "loser", "trash", "ass", "twat"]


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(11)
    rows = []
    for k in range(1500):
        w = [r.choice(PLAIN) for _ in range(40)]
        if k % 6 == 0:
            w[r.randrange(40)] = r.choice(MARKED)
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.train(d, spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(1500)], "doc_id long, toxic int"))


SPACED = ["s t u p i d,", "i d i o t.", "s t u p 1 d!", "you a s s. i am", "a t w a t!", "stu pid", "st up id", "id iot", "(s t u p i d)", "s - t - u - p - i - d", "s. t. u. p. i. d.", "tra $h", "st up 1d!", "s t u p i d so i d i o t"]


def test_parted_words_are_restored(spark, model):
    d = spark.createDataFrame(list(enumerate(SPACED)), "doc_id long, text string")
    restored = {r.doc_id: r.restored.split() for r in toxicity.restore_texts(d, model["log_chances"], lexicon=model["lexicon"], ordinary=model["ordinary"]).collect()}
    assert [t for k, t in enumerate(SPACED) if not set(restored[k]) & set(MARKED)] == []
    assert restored[3] == ["you", "ass", "i", "am"] and restored[4] == ["a", "twat"] and restored[13] == ["stupid", "so", "idiot"]
    texts = [f"we know that person {t} and go to our school" for t in SPACED]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in toxicity.score_toxicity(d, model).collect() if r.predicted} == set(range(len(texts)))


def test_look_alike_letters(model):
    assert toxicity.fold("ŝtüpïd ѕtuріd ｓｔｕｐｉｄ st​upid STÚPID 𝐬𝐭𝐮𝐩𝐢𝐝") == " ".join(["stupid"] * 6)
    assert toxicity.fold("漢字 ß 😀 한국") == "漢字 ß 😀 한국"
    restorer = toxicity.Restorer(model["log_chances"])
    assert restorer.words("tvvat, ѕtuріd") == ["twat", "stupid"]


def test_words_of_their_own_stay_apart(spark, model):
    clean = ["that is worth less to me", "as 5 people know", "it was as so many", "vitamin a. i am", "as $5 is more", "id or on", "a 1 2 3 4 5", "", None, "s " * 50, "- " * 50, "a s " * 5 + "x"]
    d = spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string")
    assert [r.doc_id for r in toxicity.score_toxicity(d, model).collect() if r.predicted] == []


def test_joined_tokens_are_all_spans(model):
    """Against all spans of all readings of the tokens: each marked word whose skeleton a span spells is found."""
    r = random.Random(3)
    joiner = toxicity.Joiner(dict.fromkeys(MARKED, 1.0), set())
    pieces = ["s", "tu", "st", "up", "pid", "id", "i", "d", "iot", "1", "d!", "a", "s", "ss", "-", "$", "t", "wa", "w", "t.", "mo", "ron", "zz", "or"]
    skeleton = lambda t: toxicity.skeletons([t]).removeprefix("\n")
    hits = 0
    for _ in range(3000):
        word = r.choice(MARKED)
        cuts = sorted(r.sample(range(1, len(word)), r.randint(1, min(3, len(word) - 1))))
        raw = [r.choice(pieces) for _ in range(r.randint(0, 2))] + [word[a:b] for a, b in zip([0, *cuts], [*cuts, None])] + [r.choice(pieces) for _ in range(r.randint(0, 2))]
        joiner.look_at(raw, [skeleton(t) for t in raw])
        found = [(a, b) for a, b, _ in joiner.spans(raw)]
        forms = [{skeleton(c) for c in [t, *toxicity.cores(t), t.strip(toxicity._EDGES)] if c} for t in raw]
        for a, b in itertools.combinations(range(len(raw)), 2):
            if all(x == "" for x in forms[a]) or all(x == "" for x in forms[b]):
                continue
            inner = [t.strip(toxicity._EDGES) or t for t in raw[a : b + 1] if any(c.isalnum() or c in toxicity.LEET for c in t)]
            if not any(any(map(str.isalpha, x)) for x in inner):
                continue
            for spelt in itertools.product(*forms[a : b + 1]):
                if spelt[0] and spelt[-1] and skeleton("".join(spelt)) in joiner.marks:
                    hits += 1
                    # a later start or a longer end may stand for the same word
                    assert any(x < b and a < y for x, y in found) or any(x <= b and a <= y for x, y in found), (raw, a, b, found)
    assert hits > 500


def test_long_rows_of_single_characters_take_linear_time(model):
    joiner = toxicity.Joiner(model["lexicon"], model["ordinary"])
    for text in ["s ", "s s! ", "a s s ", "s - ", "- "]:
        raw = toxicity.split(text * 100_000)
        joiner.look_at(sorted(set(raw)), toxicity.skeletons(sorted(set(raw))).split("\n")[1:])
        assert len(joiner.spans(raw)) <= 100_000


def path_scores(token, table, log_chances):
    """Score and text of every path."""
    for path in itertools.product(*toxicity.lattice(token)):
        text, cost = "".join(x for x, _ in path), sum(c for _, c in path)
        s = [0, 0, *(int(table[ord(c)]) for c in text), 0]
        yield sum(log_chances[a][b][c] for a, b, c in zip(s, s[1:], s[2:])) - cost, text


def test_decoder_finds_the_best_path(model):
    r = random.Random(4)
    table, log_chances = toxicity._symbol_table(), np.asarray(model["log_chances"])
    for _ in range(400):
        token = "".join(r.choice("stupid10$!|.- vaé") for _ in range(r.randint(1, 7)))
        scores = {}
        for score, text in path_scores(token, table, log_chances):
            scores[text] = max(score, scores.get(text, -1e9))
        assert scores[toxicity.decode(token, log_chances.tolist())] >= max(scores.values()) - 1e-9, token
