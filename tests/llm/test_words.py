import random

import numpy as np
import pyarrow as pa

from gapkit.llm.words import slices, whole, windows, words_of

from .helpers import documents, thue_morse, words


def test_words_and_windows_equal_plain_ones():
    texts = [r[1] for r in documents(3)] + [None, "x" * 3_000_000 + " y", "ab ba", "ba ab"]
    w = words_of(pa.array(texts))
    got = [w.data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends)]
    want = [x for t in texts for x in words(t)]
    assert got == want and w.counts.tolist() == [len(words(t)) for t in texts]
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(want))
    assert dict(zip(want, h.tolist())) == {x: v for x, v in zip(want, h.tolist())}
    lower = w.hashes(lower=True)
    fold = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    assert len(set(lower.tolist())) == len({x.translate(fold) for x in want})
    hashes, at = windows(h, w.bounds, 3)
    plain = [tuple(words(t)[i:i + 3]) for t in texts for i in range(len(words(t)) - 2)]
    assert len(hashes) == len(plain) and len(set(hashes.tolist())) == len(set(plain))
    sequences = whole(h, w.bounds)
    assert len(set(sequences.tolist())) == len({tuple(words(t)) for t in texts})


def test_slices_keep_rows_in_order():
    rng = random.Random(2)
    texts = [None if rng.random() < 0.1 else "x" * rng.randint(0, 50) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(slices(iter([batch, batch.slice(0, 0)]), limit=100))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(500))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 150 for p in parts)


def test_hash_of_a_word_does_not_depend_on_its_place():
    w = words_of(pa.array(["alpha beta", "beta", " beta alpha"]))
    h = w.hashes()
    assert h[0] == h[4] and h[1] == h[2] == h[3] and np.unique(h).size == 2


def test_words_made_to_clash_do_not():
    x, y = thue_morse()
    w = words_of(pa.array([f"{x} {y} {x}"]))
    first, second = w.wide_hashes()
    assert first[0] == first[2] != first[1] and second[0] == second[2] != second[1]
    assert w.hashes().tolist() == first.tolist()
