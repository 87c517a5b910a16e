"""The scan against a plain longest common subsequence and against planted passages."""

from __future__ import annotations

import random

from larder.llm.patience import TEMPLATES, scan_text, words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_nothing_beyond_the_longest_common_subsequence_and_every_planted_passage():
    rnd = random.Random(11)
    for _ in range(150):
        templates = {str(k): [rnd.choice("abcdefghijkl").encode() for _ in range(rnd.randrange(4, 14))] for k in range(3)}
        text = [rnd.choice("abcdefghijklmnopqrstuvwxyz").encode() for _ in range(rnd.randrange(60))]
        planted = set()
        for name, template in templates.items():
            for _ in range(rnd.choice([0, 1, 3])):
                copy = template[:]
                for at in rnd.sample(range(len(copy)), int(0.2 * len(copy) + 1e-9)):
                    copy[at] = b"edited"
                at = rnd.randrange(len(text) + 1)
                text = [*text[:at], b"|", *copy, b"|", *text[at:]]
                planted.add((name, tuple(copy)))
        got = {name: matched for name, _, matched, *_ in scan_text(text, templates, 0.8)}
        joined = b" ".join(text)
        for name, matched in got.items():
            assert 0.8 * len(templates[name]) <= matched <= lcs(templates[name], text)
        for name, copy in planted:
            if b" ".join(copy) in joined:  # no later passage was put into it
                assert name in got


def test_whole_licenses_are_covered_and_halves_are_not():
    split = {name: words(t) for name, t in TEMPLATES.items()}
    for name, own in split.items():
        assert max(r[1] for r in scan_text([b"before", *own, b"after"], split, 0.8) if r[0] == name) == 1.0
        if len(own) > 60:
            assert name not in {r[0] for r in scan_text(own[: len(own) // 2], split, 0.8)}
