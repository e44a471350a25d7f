import re
import time

import numpy as np

from gapkit.llm.license_scan import TEMPLATES, LicenseParams, best_window, scanned

from .helpers import documents, empty, frame, with_clashes


def bigrams(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))
    return {(a, b) for a, b in zip(w, w[1:])}


def brute(text, threshold=0.8):
    """The best score of the whole text, its paragraphs and its lines; larger, earlier units and earlier templates first."""
    lines = (text or "").split("\n")
    blocks = [(0, [])]
    for i, line in enumerate(lines):
        if line.strip(" \t\x0b\x0c\r"):
            blocks[-1][1].append(line)
        else:
            blocks.append((i + 1, []))
    units = [(0, 0, text or ""), *((1, i, "\n".join(b)) for i, b in blocks if len(b) > 1), *((2, i, x) for i, x in enumerate(lines))]
    found = [(0.0, 0, 0, 0, None)]
    for kind, at, unit in units:
        a = bigrams(unit)
        for n, (name, template) in enumerate(TEMPLATES):
            b = bigrams(template)
            score = 2 * len(a & b) / (len(a) + len(b))
            if score >= threshold:
                found.append((-score, kind, at, n, name))
    best = min(found, key=lambda f: f[:4])
    return -best[0], best[4]


def test_equals_brute_force(spark):
    rows = documents(9, 40)
    mit = TEMPLATES[0][1]
    texts = [
        mit, mit.upper().replace(" ", "  "), "Copyright (c) 2020 me\n\n" + mit.replace(". ", ".\n") + "\n\nmore text here",
        "some words\nReleased under the MIT License.\nother words", "Licensed under the Apache License, Version 2.0", "released under MIT",
        mit[:len(mit) // 2], " ".join(mit.split()[::-1]), "x\n\n\ny", "\n", mit + " " + mit,
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.", TEMPLATES[5][1] + "\n" + TEMPLATES[0][1],
    ]
    rows += [(3000 + i, t, None, None, None) for i, t in enumerate(texts)] + [(3000, mit, None, None, None)]
    got = scanned(with_clashes(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    want = {}
    for r in rows:
        want[r[0]] = brute(r[1])
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]][0]) < 1e-12, r
        assert r["license"] == want[r["doc_id"]][1] or r["score"] == 0


def test_place_and_empty_table(spark):
    assert scanned(empty(spark)).collect() == []
    row = scanned(frame(spark, [(1, "a b c\nReleased under the MIT License.", None, None, None)])).first()
    assert tuple(row) == (1, "MIT", 1.0, "line", 3, 5)
    none = scanned(frame(spark, [(1, "Released under the MIT License.", None, None, None)]), LicenseParams(templates=())).first()
    assert (none["license"], none["score"]) == (None, 0.0)


def test_licences_in_paragraphs_and_in_lines(spark):
    text = {name: t for name, t in reversed(TEMPLATES)}
    noise = " ".join(f"other{i}" for i in range(400))
    parts = {name: re.sub(r"(copies\.|conditions:|Software\.|LICENSE-2\.0|version\.|details\.) ", r"\1\n\n", text[name])
             for name in ("MIT", "ISC", "Apache-2.0", "GPL-3.0-or-later")}
    rows = [(i, f"{noise}\n\n{t}\n\n{noise}", None, None, None) for i, t in enumerate(parts.values())]
    rows += [(10 + i, f"{noise} {text[name]} {noise}", None, None, None) for i, name in enumerate(parts)]
    rows += [(20, f"{noise} {text['MIT']} " * 2, None, None, None), (21, noise, None, None, None)]
    assert all(t.count("\n\n") for t in parts.values())
    got = {r["doc_id"]: tuple(r)[1:] for r in scanned(frame(spark, rows)).collect()}
    for i, name in enumerate(parts):
        n = len(re.findall("[A-Za-z0-9]+", text[name]))
        assert got[i] == got[10 + i] and got[i][:4] == (name, 1.0, "window", 400)
        assert n - 3 <= got[i][4] <= n  # words at the end whose bigrams have occurred add nothing
    assert got[20][:4] == ("MIT", 1.0, "window", 400) and got[21][0] is None


def test_best_window_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(150):
        hashes = rng.integers(0, 14, rng.integers(1, 40)).astype(np.uint64)
        hit, size = hashes < 6, 6
        want = 0.0
        for s in range(len(hashes)):
            for e in range(s + 1, len(hashes) + 1):
                own = set(hashes[s:e].tolist())
                want = max(want, 2 * sum(x < 6 for x in own) / (len(own) + size))
        got = best_window(hashes, hit, size, 0.8)
        assert (got[0] if got else 0.0) == (want if want >= 0.8 else 0.0)


def test_best_window_is_the_first_and_shortest_of_equals():
    rng = np.random.default_rng(5)
    for _ in range(150):
        hashes = rng.integers(0, 9, rng.integers(1, 25)).astype(np.uint64)
        hit, size, best = hashes < 4, 4, (0.0, 0, 0)
        for s in np.flatnonzero(hit).tolist():
            for e in range(s + 1, len(hashes) + 1):
                own = set(hashes[s:e].tolist())
                score = 2 * sum(x < 4 for x in own) / (len(own) + size)
                if score > best[0]:
                    best = score, s, e
        assert best_window(hashes, hit, size, 0.5) == (best if best[0] >= 0.5 else None)


def test_long_texts_of_few_bigrams_take_no_square(spark):
    text = "under the " * 60_000 + "mit license"
    start = time.time()
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.unit) for r in scanned(df).collect()] == [(1, "MIT", "window")]
    assert time.time() - start < 60
