from __future__ import annotations

import random

from larder.llm.patience import TEMPLATES, scan_text, words

SPLIT = {name: words(t) for name, t in TEMPLATES.items()}


def found(text):
    return {name: (share, first, last) for name, share, _, first, last in scan_text(words(text), SPLIT, 0.8)}


def test_repeated_passages_without_the_rarest_word_are_found():
    line = "released under the MIT licence"
    text = f"one license two {line} und der {line} aaa bbb"
    assert found(text)["MIT line"][0] == 0.8
    assert found(f"some license here {line} {line} {line}")["MIT line"][0] == 0.8


def test_repeated_edited_notices_are_found():
    rnd = random.Random(7)
    for name in ("MIT", "Apache-2.0 notice", "GPL-3.0 notice", "ISC", "BSD-2-Clause"):
        template = SPLIT[name]
        rarest = next(k for k in range(10, len(template)) if template.count(template[k]) == 1)
        for between in (0, 3, 40, 400):
            text = [template[rarest]] + [b"start%d" % k for k in range(2 * len(template))]  # no passage has that word
            for copy in range(6):
                gone = set(rnd.sample(range(len(template)), len(template) // 8)) | {rarest}
                text += [b"edit%d" % k if k in gone else w for k, w in enumerate(template)] + [b"code%d" % rnd.randrange(50) for _ in range(between)]
            got = found(b" ".join(text).decode())
            assert name in got and got[name][0] >= 0.85, (name, between)
