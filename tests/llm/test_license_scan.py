"""Licenses by compression against every place of every template, aligned without compression."""

from __future__ import annotations

import random
from collections import Counter

from corpuscle.llm import license_scan as L

FILL = "lorem ipsum version 2 dolor 3.0 code the of author team files project copyright software may use".split()


def every_place(text, anywhere=False):
    """Licenses of a text, each template tried at each word; only of notices that hold a mention unless anywhere."""
    words = L._words(text)
    spans = [m.span() for m in L._WORD.finditer(text)]
    plain, primed = L._compressors()
    rows = []
    for k, (a, _) in enumerate(L._templates()):
        slack = max(2, len(a) // 5)
        proven = []
        for i in range(-slack, len(words)):
            for low, high in ((max(0, i), i + len(a)), (max(0, i - slack), i + len(a) + slack)):
                if sure := L.confirm(a, words[low : max(0, high)]):
                    proven.append((low + sure[3], low + sure[4], sure[:3]))
        for i, j, sure in L._apart(sorted(proven, key=lambda r: (-r[2][0], len(r[2][2]), r[0], r[1]))):
            data = " ".join(words[i : j + 1]).encode()
            differ = sum(len(w) for w in sure[1] + sure[2] if w not in L._SOFT)
            if anywhere or L._TRIGGER.search(text, spans[i][0], spans[j][1]):
                rows.append((i, j, len(plain.compress(data)) - len(primed[k].compress(data)) - differ, k, sure[0]))
    best = L._apart(sorted(rows, key=lambda r: (-r[2], -r[4], r[3], r[0])))
    return [L.TEMPLATES[r[3]][0] for r in sorted(best)]


def changed(pick, template):
    words = template.split()
    for _ in range(pick.randrange(0, max(2, len(words) // 6))):
        at, how = pick.randrange(len(words)), pick.random()
        if how < 0.35:
            del words[at]
        elif how < 0.7:
            words.insert(at, pick.choice(["the", "a", "of", "and", "lorem"]))
        else:
            words[at] = pick.choice(["the", "software", "file", "x"])
    return " ".join(words).upper() if pick.random() < 0.2 else " ".join(words)


def test_compression_finds_what_every_place_finds():
    pick = random.Random(4)
    fill = lambda: " ".join(pick.choice(FILL) for _ in range(pick.randrange(0, 40)))
    found = 0
    for _ in range(60):
        text = " ".join(f"{fill()} {changed(pick, pick.choice(L.TEMPLATES)[1])}" for _ in range(pick.randrange(0, 3))) + " " + fill()
        got = Counter(f[0] for f in L.scan(text))
        assert Counter(every_place(text)) <= got <= Counter(every_place(text, anywhere=True)), text
        found += got.total()
    assert found > 30


def test_templates_are_ranked_by_bytes_saved():
    own = L._own_gains()
    for k, (words, _) in enumerate(L._templates()):
        saved, first = L.ranked(words)[0]
        assert first == k and saved == own[k]
    assert all(saved < L.MIN_GAIN * own[k] for saved, k in L.ranked("rivers carry silt down to wide quiet deltas".split()))


def test_blocks_cover_every_place():
    for near in ([0], [5], [200], [3, 77]):
        for c in L.WIDTHS:
            blocks = [(a, b) for a, b, w in L._blocks(near) if w == c]
            for i in near:  # any span of a notice's length that holds the place lies in one block
                for first in range(max(0, i - c + 1), i + 1):
                    assert any(a <= first and first + c <= b for a, b in blocks)


def test_many_notices_and_odd_texts():
    mit, long = "Released under the MIT License. ", L.TEMPLATES[1][1] + "\n"
    assert [f[0] for f in L.scan(mit * 40)] == ["MIT"] * 40
    assert [f[0] for f in L.scan(long * 12)] == ["MIT"] * 12
    text = "word " * 50_000 + mit + "word " * 50_000
    assert [(f[0], text[f[1] : f[1] + f[2]]) for f in L.scan(text)] == [("MIT", mit.strip())]
    assert L.scan(None) == L.scan("") == L.scan("license " * 300) == L.scan("permission\n\t ") == []
