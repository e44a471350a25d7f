"""Small document tables with all awkward cases, and plain versions of what operators share."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def invented(rng: random.Random, n: int, syllables: list[str] | None = None) -> list[str]:
    parts = syllables or "ka lo mi ter un sa vel dor pi nu gra she fo wy".split()
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and blank texts, one very long text."""
    rng = random.Random(seed)
    passage = " ".join(invented(rng, 40))
    out = []
    for i in range(n):
        body = invented(rng, rng.randint(1, 120))
        kind = i % 10
        if kind == 1 and out:
            body = words(out[-1][1])
        elif kind == 2 and out:
            body = words(out[-1][1])
            for _ in range(len(body) // 60):
                body[rng.randrange(len(body))] = "changed"
        elif kind == 3:
            body = body[:30] + passage.split() + body[30:]
        elif kind == 4:
            body = body + body
        text = " ".join(body)
        out.append((i * 3, text, ["en", "de", "fr", None][i % 4], ["a", "b", None, "c"][i % 4 if i % 3 else 0], len(text)))
    extra = [None, "", " \t\n", "one", "one two", "ONE  two\nthree", "日本語 テキスト ñandú", "\x1f unit\x85sep"]
    out += [(1000 + i, t, None, None, None) for i, t in enumerate(extra)]
    long = " ".join(invented(rng, 20_000))
    return out + [(2000, long, "en", "a", len(long)), (2001, "", None, None, 0)]


def frame(spark, rows, partitions: int = 3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_clashes(df):
    """The same table with columns under names that operators use inside."""
    from pyspark.sql import functions as F

    for name in ("g", "i", "j", "h", "n", "label", "place", "part", "copy", "range", "size", "start", "rank", "key", "own", "node",
                 "score", "kept", "shard", "position", "n_words", "component_id", "queue", "bits", "body"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def thue_morse(n: int = 11) -> tuple[str, str]:
    """Two different words of 2**n letters that clash under polynomial hashes modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
