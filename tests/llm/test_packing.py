import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gapkit.llm.packing import Deal, PackParams, WordTokens, packed
from gapkit.llm.words import words_of

from .helpers import documents, empty, frame, thue_morse, with_clashes

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
HARD = ["<|endoftext|> a<|endoftext|>b", "don't it's   we'LL", "É é  nbsp em", "İSTANBUL ﬁ Σίσυφος", "a\x00b\x1fc", "12345 6.7e8 ½", "日本語テキスト。",
        "🙂🙂 👩‍👩‍👧"]


def check(got, rows, window=2048):
    want = {r[0]: np.array(TOKENIZER.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4") for r in rows}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"]))
    assert set(pieces) == set(want)
    for doc, parts in pieces.items():
        parts.sort(key=lambda r: r["start"])
        assert [r["start"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist()
        assert b"".join(bytes(r["ids"]) for r in parts) == want[doc].tobytes()
        assert all(r["doc_tokens"] == len(want[doc]) for r in parts)
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts)])[:-1].tolist()
        size = sum(p[1] for p in parts)
        assert size <= window and size & (size - 1) == 0  # a power of two: no padding
    return sequences


def test_round_trip_and_mixture(spark):
    rows = documents(6, 60) + [(4000 + i, t, "en", "b", 1) for i, t in enumerate(HARD)]
    sequences = check(packed(with_clashes(frame(spark, rows))).collect(), rows)
    source = {r[0]: r[3] for r in rows}
    totals = {}
    for parts in sequences.values():
        for _, n, d in parts:
            totals[source[d]] = totals.get(source[d], 0) + n
    whole = sum(totals.values())
    for s in (p for p in sequences.values() if sum(x[1] for x in p) == 2048):
        for name, total in totals.items():
            assert abs(sum(n for _, n, d in s if source[d] == name) - 2048 * total / whole) <= 3 * 64


@pytest.mark.parametrize("params", [PackParams(window=64, quantum=8), PackParams(queues=1), PackParams(weights={"a": 3, "b": 1, "c": 1})])
def test_other_parameters(spark, params):
    rows = documents(6, 40)
    check(packed(frame(spark, rows), params).collect(), rows, params.window)


def test_awkward_rows(spark):
    assert packed(empty(spark)).collect() == []
    rows = [(1, "same text", None, "a", 1), (1, "same text", None, "a", 1), (None, None, None, None, None)]
    got = packed(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in got if r["start"] == 0) == [("1", 3), ("1", 3), ("None", 1)]
    assert sum(r["length"] for r in got) == 7


def test_words_made_to_clash_keep_their_ids(spark):
    x, y = thue_morse()
    rows = [(1, f"{x} one", None, "a", 1), (2, f"{y} one", None, "a", 1)]
    check(packed(frame(spark, rows, 1)).collect(), rows)


def test_ranks_are_the_order_of_due_times():
    deal = Deal(np.array([64 * 7, 64 * 30 + 5, 63, 64 * 3]), np.array([3, 10, 1, 2]), PackParams())
    due = sorted(((2 * j + 1) / deal.weights[q], q, j) for q in range(4) for j in range(int(deal.quanta[q])))
    queue, j = np.array([d[1] for d in due]), np.array([d[2] for d in due])
    assert deal.rank(queue, j).tolist() == list(range(len(due)))


def test_words_go_to_the_tokenizer_in_blocks():
    """New words are not encoded one by one, and each still has its own ids, the ones of marks that join and of none as well."""
    marks = ["\u0301e", "e\u0301", "\u1100\u1161", "\u00a0", "a\u2003b", "\u200b", "\u212a", "x" * 300, "<|endof", "text|>"]
    texts = [" ".join([f"word{i}", marks[i % len(marks)], f"{i}th's"]) for i in range(400)] + HARD + [""]
    sent = []

    class Counted:
        def encode_batch(self, some, **kw):
            sent.extend(some)
            return TOKENIZER.encode_batch(some, **kw)

        encode_batch_fast = encode_batch

    tokens = WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    tokens.tokenizer = Counted()
    words = words_of(pa.array(texts))
    for _ in range(2):  # the second time all words are known
        ids, counts = tokens(words)
        at = np.concatenate([[0], np.cumsum(counts)])[words.bounds]
        for text, lo, hi in zip(texts, at, at[1:]):
            assert ids[lo:hi].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
        assert len(sent) <= len(words.starts) // 50
    each = [len(TOKENIZER.encode(bytes(words.data[a:b]).decode(), add_special_tokens=False).ids) for a, b in zip(words.starts, words.ends)]
    assert counts.tolist() == each
