import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from gapkit.llm.shared import stored

from .helpers import documents, empty, frame, with_clashes, words
from .test_language_id import rows as spoken
from .test_near_dedup import brute


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output over one small table."""
    rows = spoken(160) + [(i + 1000, t, l, s, n) for i, t, l, s, n in documents(12, 60) if t is None or len(t) < 5000]
    rows += [(5000, "call +1 (487) 555-7209 or " + " ".join(reversed(rows[0][1].split())), "en", "a", 1), (5001, "12 34 56", "en", "a", 8), rows[3]]
    docs, out = frame(spark, rows), []
    for name, stage in pipeline.STAGES:
        after = stored(stage(spark, with_clashes(docs), ""), name)
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [s[0] for s in stages] == ["language_id", "near_dedup", "pseudonyms", "mixing", "packing"]
    assert all(tuple(s[3]) == pipeline.COLUMNS for s in stages[:-1])


def test_language_stage_drops_what_has_no_letter(stages):
    _, before, after, _ = stages[0]
    assert sorted(r["text"] for r in after) == sorted(r["text"] for r in before if r["text"] and any(c.isalpha() for c in r["text"]))
    assert {r["lang"] for r in after} <= {"en", "de", "fr", "es"}


def test_one_of_each_group_stays(stages):
    _, before, after, _ = stages[1]
    want = {d for d, (_, component, kept) in brute([tuple(r) for r in before], 5, 80).items() if kept}
    assert sorted(r["doc_id"] for r in after) == sorted(want)
    texts = {r["doc_id"]: tuple(r) for r in before}
    assert all(tuple(r) == texts[r["doc_id"]] for r in after)


def test_private_values_are_replaced(stages):
    _, before, after, _ = stages[2]
    old, new = ({r["doc_id"]: r["text"] for r in x} for x in (before, after))
    assert {d for d in old if old[d] != new[d]} == {5000} and "555-7209" not in new[5000]


def test_mixture_reaches_targets(stages):
    from .test_mixing import brute_targets

    _, before, after, _ = stages[3]
    sizes = {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    got = {}
    for r in after:
        got[r["source"]] = got.get(r["source"], 0) + len(words(r["text"]))
    assert all(abs(got.get(s, 0) - t) <= 1 for s, t in brute_targets(sizes).items())
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_all_tokens_are_packed(stages):
    _, before, after, _ = stages[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [tokenizer.encode(r["text"], add_special_tokens=False).ids + [1] for r in before]
    assert sum(map(len, ids)) == sum(r["length"] for r in after)
    whole = {zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids}
    assert {r["ids_crc32"] for r in after if r["length"] == r["doc_tokens"]} <= whole


def test_empty_tables(spark):
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty(spark), "").collect() == [], name


def test_registration():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
