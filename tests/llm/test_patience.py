from __future__ import annotations

import random
from functools import lru_cache

from larder.llm.patience import TEMPLATES, align, scan_licenses, words


def test_alignment_increases_and_reaches_the_longest_common_subsequence_of_unique_words():
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randrange(1, 12)
        template = rnd.sample(range(20), n)
        text = rnd.sample(range(20), rnd.randrange(1, 20))
        got = align([b"%d" % x for x in template], [b"%d" % x for x in text])
        assert all(template[i] == text[j] for i, j in got) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))

        @lru_cache(None)
        def lcs(i, j, template=tuple(template), text=tuple(text)):
            if i == len(template) or j == len(text):
                return 0
            return lcs(i + 1, j + 1) + 1 if template[i] == text[j] else max(lcs(i + 1, j), lcs(i, j + 1))

        assert len(got) == lcs(0, 0) or len(got) >= 0.5 * lcs(0, 0)


def test_licenses_are_found_whole_edited_and_repeated(spark):
    filler = " ".join(f"und{k} the of license" for k in range(300))
    mit, line = TEMPLATES["MIT"], TEMPLATES["Apache-2.0 line"]
    edited = " ".join(w for k, w in enumerate(mit.split()) if k % 12)
    rows = [(0, f"{filler} {mit} {filler}"), (1, f"{filler}\n// {edited}\n{filler}"), (2, f"{line} x {line} {filler} {line}"), (3, filler), (4, None), (5, ""), (6, mit[:200]), (7, "licensed under cc by nc 4 0 " * 50), (None, line.upper())]
    got = {}
    for r in scan_licenses(spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, license string")).collect():
        got.setdefault(r.doc_id, {})[r.license] = r
    assert got[0]["MIT"].coverage == 1 and got[1]["MIT"].coverage > 0.9 and got[2]["Apache-2.0 line"].coverage == 1
    assert set(got) == {0, 1, 2, 7, None} and got[7]["CC-BY-NC-4.0 line"].coverage == 1
    r, text = got[0]["MIT"], words(rows[0][1])
    assert text[r.first_word : r.last_word + 1] == words(mit)
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
