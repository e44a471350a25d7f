import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from gapkit.llm.alignment import Aligner, AlignParams, aligned, segments_of

from .helpers import documents, empty, frame, with_clashes

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
HARD = ["<|endoftext|> a<|endoftext|>b <s> </s> <unk> <0x41>", "don't  it's   we'LL \n x\n\n y", "É é\u3000 nb\xa0 sp\u2003 em", "a \u2581 b", "\u2581",
        " lead", "trail  ", "a\x00b \x1fc \x85 d", "12345 6.7e8 ½ ﬁ İ", "日本語テキスト。 と 漢字", "🙂🙂 👩‍👩‍👧 \u200b x", "\t\ttab \r\nline"]


def plain(text):
    """All groups and links of a text, from the tokens of the whole text."""
    if not text:
        return None
    back = {c: b for b, c in zip(range(256), _alphabet())}
    a_ids = A.encode(" " + text, add_special_tokens=False).ids
    a = [bytes(back[c] for c in A.id_to_token(i)) for i in a_ids]
    b_ids = B.encode(text)
    b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("\u2581", " ").encode() for i in b_ids]
    if b"".join(a) != (" " + text).encode() or b"".join(b) != (" " + text).encode():
        return None
    ends = [[sum(map(len, x[:i + 1])) for i in range(len(x))] for x in (a, b)] if len(a) < 400 else [_sums(a), _sums(b)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    of = [dict(zip(e, i)) for e, i in zip(ends, (a_ids, b_ids))]
    groups, lo = [], 0
    for c in cuts:
        groups.append("|".join(",".join(str(i) for e, i in zip(x, ids) if lo < e <= c) for x, ids in zip(ends, (a_ids, b_ids))) if len(a) < 400 else None)
        lo = c
    return len(a), len(b), groups, [(of[0][c], of[1][c]) for c in cuts]


def _sums(x):
    out, n = [], 0
    for y in x:
        n += len(y)
        out.append(n)
    return out


def _alphabet():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(other)) for b in range(256)]


@pytest.mark.parametrize("params", [AlignParams(), AlignParams(hot=40), AlignParams(hot=0)])
def test_equals_plain_alignment(spark, params):
    rows = documents(5, 50) + [(3000 + i, t, None, None, 0) for i, t in enumerate(HARD * 2)] + [(None, "no id", None, None, 0)]
    got = aligned(with_clashes(frame(spark, rows)), params).collect()
    each = [(r[0], plain(r[1])) for r in rows]
    counts = Counter(pair for _, x in each if x for pair in x[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = []
    for doc_id, x in each:
        if x is None:
            want.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        text = ";".join(groups) if n_a < 400 else None
        want.append((doc_id, n_a, n_b, len(links), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), text))
    key = lambda r: (str(r[0]), r[1:7])
    mine = [tuple(r)[:7] + (None if r["n_a"] >= 400 else r["groups"],) for r in got]
    assert sorted(mine, key=key) == sorted(want, key=key)
    assert sum(x is None for _, x in each) > 5 and any("\u2581" in t for t in HARD)


def test_segments_give_the_tokens_of_the_whole_text():
    of, rng = Aligner(AlignParams()), random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", "\xa0", "\u3000", "\u2028", "é", "日本", "'s", " it's", "12", "<s>", "🙂", "\x00", "x" * 30, " the", ".\n", "\u200b",
             "\u0301", "\r\n", "\x85", "\x1f", "ﬁ", "İ", "ç e", "è f"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        segments = segments_of(pa.array([text]))[0].to_pylist()
        assert b"".join(segments) == (" " + text).encode()
        found, whole = of(pa.array(segments, pa.large_binary())), of(pa.array([(" " + text).encode()], pa.large_binary()))
        assert not found.bad.any() and not whole.bad.any()
        assert ";".join(found.groups.to_pylist()) == whole.groups[0].as_py()
        assert found.exact.tolist() == whole.exact.tolist() and found.pairs.tolist() == whole.pairs.tolist()


def test_digest_and_awkward_rows(spark):
    assert aligned(empty(spark)).collect() == []
    rows = [(1, "one two", None, None, 0)] * 2 + [(1, None, None, None, 0), (2, "", None, None, 0), (3, "word" * 50_000, None, None, 0)]
    plain_rows, digests = (sorted(aligned(frame(spark, rows), digest=d).collect(), key=lambda r: (r["doc_id"], r["n_a"])) for d in (False, True))
    assert [r["groups"] and hashlib.sha256(r["groups"].encode()).hexdigest() for r in plain_rows] == [r["groups"] for r in digests]
    assert [(r["doc_id"], r["n_groups"], r["count_sum"]) for r in digests[:4]] == [(1, 0, 0), (1, 2, 4), (1, 2, 4), (2, 0, 0)]
