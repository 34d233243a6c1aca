"""License scans: notices and their nearest relatives, base phrases by hand, long and crowded texts."""

import random
import re

import pytest

from sigmaspark.llm import licenses

GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.\n\n"
REST = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {1} General Public License for more details."
CC = "This work is licensed under a Creative Commons Attribution{0} 4.0 International License."
NOTICES = {
    "cc-by": CC.format(""), "cc-by-nc": CC.format("-NonCommercial"), "cc-by-sa": CC.format("-ShareAlike"), "cc-by-nd": CC.format("-NoDerivatives"),
    "cc-by-nc-nd": CC.format("-NonCommercial-NoDerivatives"), "cc-by-nc-sa": CC.format("-NonCommercial-ShareAlike"),
    "agpl-3": (GNU + REST).format("program", "Affero", "3"), "lgpl-3": (GNU + REST).format("library", "Lesser", "3"), "lgpl-2": (GNU + REST).format("library", "Lesser", "2.1"),
    "gpl-3": (GNU + REST).format("program", "", "3"), "gpl-2": (GNU + REST).format("program", "", "2"),
}
SPDX = {"apache-2": "Apache-2.0", "mit": "MIT", "gpl-3": "GPL-3.0-or-later", "lgpl-2": "LGPL-2.1-only", "cc-by-nc": "CC-BY-NC-4.0", "cc-by": "CC-BY-4.0"}


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", 1, 2, 3) for k, t in enumerate(texts)], "doc_id long, text string, label string, row int, span int, score int")


def labels(spark, texts):
    return [r.labels for r in sorted(licenses.scan_licenses(frame(spark, texts)).collect(), key=lambda r: r.doc_id)]


def test_each_notice_has_its_own_label(spark):
    assert labels(spark, list(NOTICES.values())) == list(NOTICES)
    assert labels(spark, [f"// SPDX-License-Identifier: {x}\nint main" for x in SPDX.values()]) == list(SPDX)
    assert labels(spark, ["Intro. " + NOTICES["agpl-3"] + " And also: " + NOTICES["cc-by-nc"] + " Permission."]) == ["agpl-3,cc-by-nc"]


def test_notices_with_a_word_changed(spark):
    """A word put in, left out or changed, away from the words that tell licenses apart."""
    r = random.Random(8)
    want, texts = [], []
    for label in ("agpl-3", "lgpl-3", "lgpl-2", "gpl-3", "gpl-2"):
        for _ in range(4):
            words = NOTICES[label].split()
            at = r.randrange(5, 12)
            words[at : at + 1] = r.choice([[], ["zzz"], [words[at], "zzz"]])
            texts.append(" ".join(words))
            want.append(label)
    assert labels(spark, texts) == want


def by_hand(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    found = [(i, label) for label, phrase in licenses.BASE_PHRASES for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


@pytest.mark.parametrize("seed", [1, 2])
def test_base_phrases_by_hand(spark, seed):
    r = random.Random(seed)
    pieces = ["under the MIT license", "Apache License, Version 2", "cc by nc", "cc", "by", "under the", "mit", "2.0", "é", ".", "license", "version 2"]
    texts = [None, "", " ", "cc by nc " * 3000] + [" ".join(r.choice(pieces) for _ in range(r.randint(0, 25))) for _ in range(80)]
    got = sorted(licenses.scan_licenses(frame(spark, texts)).collect(), key=lambda x: x.doc_id)
    assert [(x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in got] == [by_hand(t) for t in texts]
    assert all(set(x.base_labels.split(",")) - {""} <= set(x.labels.split(",")) and 0 <= x.score <= 1 for x in got)


def test_long_text(spark):
    r = random.Random(4)
    noise = lambda n: " ".join(r.choice(["lo", "mi", "the", "license", "of"]) for _ in range(n))
    assert labels(spark, [noise(30_000) + " " + NOTICES["agpl-3"] + " " + noise(30_000)]) == ["agpl-3"]
