"""Language of texts by hierarchical discrimination: first the family, then one-versus-one linear SVMs inside it.

Features are counts of hashed byte trigrams of the lower-cased whole text, with everything ASCII but letters read as a
space, divided by the root of their number. A score is then a sum of weights over the text's trigrams, so prediction is
one pass of table look-ups. The classifiers are fitted on a bounded sample (``LanguageParams``), its texts whole and in
short pieces, so that short texts are judged well too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gapkit.llm.words import raw, slices

# Families of languages by ISO 639-1 code. A language that is not listed belongs to the family "other".
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "pt", "it", "ca", "gl", "ro"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu"),
}
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParams:
    """The fit sees about ``per_language`` texts of each language at most, and about ``sample`` in all or two of each language,
    whichever is more. Every language of the labelled rows is learned."""

    per_language: int = 300
    sample: int = 2000
    pieces: int = 4
    piece_bytes: int = 90
    bits: int = 12
    families: dict = field(default_factory=lambda: FAMILIES)

    def family(self, lang: str) -> str:
        return next((name for name, members in self.families.items() if lang in members), "other")


def _fold() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for i in range(128):
        out[i] = i | 32 if chr(i).isalpha() else 32
    return out


_FOLD = _fold()


def trigrams(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram, and each text's bounds among them."""
    counts = np.maximum(np.diff(at) - 2, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if len(data) < 3 or not bounds[-1]:
        return np.empty(0, np.uint32), bounds
    b = _FOLD[data]
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    inside = np.ones(len(code), bool)
    for back in (1, 2):
        edge = at[1:-1] - back
        inside[edge[(edge >= 0) & (edge < len(code))]] = False
    return (code[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), bounds


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"), *more)


def _sampled(docs: DataFrame, p: LanguageParams) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Language, buckets and counts of the sampled texts and their pieces."""
    labelled = docs.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    drawn = F.pmod(F.xxhash64(key, F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(drawn).alias("least")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return []
    each = max(2, min(p.per_language, p.sample // len(counts)))
    # the smallest draw of a language is always in
    chance = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(r["least"], min(1.0, 1.2 * each / r["n"])))])
    chosen = labelled.where(drawn <= chance[F.col("lang")])
    most = 2 * each  # texts of a language; only rows that share an id or a text reach it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for part in slices(batches):
            data, at = raw(part.column(0))
            langs, buckets, numbers = [], [], []
            for i, lang in enumerate(part.column(1).to_pylist()):
                seen[lang] += 1
                if seen[lang] > most:
                    continue
                text = data[at[i]:at[i + 1]]
                steps = np.linspace(0, max(0, len(text) - p.piece_bytes), p.pieces).astype(int)
                for piece in [text, *(text[s:s + p.piece_bytes] for s in (steps if len(text) > p.piece_bytes else ()))]:
                    code, _ = trigrams(piece, np.array([0, len(piece)]), p.bits)
                    found, number = np.unique(code, return_counts=True)
                    langs.append(lang)
                    buckets.append(found.astype(np.uint16).tobytes())
                    numbers.append(number.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(buckets, pa.binary()), pa.array(numbers, pa.binary())],
                                             names=["lang", "buckets", "numbers"])

    rows = _texts(chosen, F.col("lang").cast("string")).mapInArrow(run, "lang string, buckets binary, numbers binary")
    out, held = [], Counter()
    for r in rows.toLocalIterator():
        held[r[0]] += 1
        if held[r[0]] <= most * (p.pieces + 1):
            out.append((r[0], np.frombuffer(r[1], np.uint16), np.frombuffer(r[2], np.uint32)))
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 120) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by accelerated gradient steps."""
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    pull = 2 * cost / len(x)
    rate = 1 / (1e-2 + pull * float(np.linalg.norm(x.T @ (x @ v))))
    w = ahead = np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - rate * (1e-2 * ahead - pull * (x.T @ (slack * y)))
        ahead = step + (t / (t + 3)) * (step - w)
        w = step
    return w.astype(np.float32)


@dataclass
class LanguageModel:
    """Pairs of names with the weights that are positive for the first, for families and for each family's languages."""

    params: LanguageParams
    members: dict[str, list[str]]
    families: list[tuple[str, str, np.ndarray]]
    languages: dict[str, list[tuple[str, str, np.ndarray]]]

    def predict(self, code: np.ndarray, bounds: np.ndarray) -> tuple[list[str | None], np.ndarray]:
        """Language and confidence of each text of at least one language learned; both levels vote pair by pair."""
        n = len(bounds) - 1
        size = np.maximum(np.diff(bounds), 1)
        filled = np.flatnonzero(np.diff(bounds) > 0)

        def vote(names: list[str], pairs) -> tuple[np.ndarray, np.ndarray]:
            wins, sums, sure = np.zeros((n, len(names))), np.zeros((n, len(names))), np.ones((n, len(names)))
            for a, b, w in pairs:
                margin = np.zeros(n)
                if len(filled):
                    margin[filled] = np.add.reduceat(w[code].astype(np.float64), bounds[:-1][filled])
                margin /= np.sqrt(size)
                for name, m in ((names.index(a), margin), (names.index(b), -margin)):
                    wins[:, name] += m > 0
                    sums[:, name] += m
                    sure[:, name] = np.minimum(sure[:, name], 1 / (1 + np.exp(-np.clip(3 * m, -30, 30))))
            best = np.lexsort(np.stack([np.broadcast_to(-np.arange(len(names)), (n, len(names))), sums, wins]), axis=1)[:, -1]
            return best, sure[np.arange(n), best]

        names = list(self.members)
        family, score = vote(names, self.families)
        out = np.empty(n, object)
        for i, name in enumerate(names):
            own = family == i
            best, sure = vote(self.members[name], self.languages[name])
            out[own] = np.array(self.members[name], object)[best[own]]
            score[own] *= sure[own]
        return out.tolist(), score


def fit_languages(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel | None:
    """Fit on the rows of ``docs`` (``doc_id, text, lang``) that have a language; None if no text with a letter has one."""
    p = params
    rows = _sampled(docs, p)
    if not rows:
        return None
    x = np.zeros((len(rows), 1 << p.bits), np.float32)
    for i, (_, bucket, number) in enumerate(rows):
        x[i, bucket] = number / np.sqrt(max(1, number.sum()))
    langs = np.array([r[0] for r in rows], object)
    kin = np.array([p.family(l) for l in langs], object)

    def pairs(labels: np.ndarray, names: list[str]):
        out = []
        for a, b in combinations(names, 2):
            chosen = np.isin(labels, [a, b])
            out.append((a, b, _svm(x[chosen], np.where(labels[chosen] == a, 1, -1).astype(np.float32))))
        return out

    members = {f: sorted(set(langs[kin == f])) for f in sorted(set(kin))}
    return LanguageModel(p, members, pairs(kin, list(members)), {f: pairs(langs, m) for f, m in members.items()})


def identify_languages(docs: DataFrame, model: LanguageModel | None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, ``lang_pred`` and ``score`` (0 to 1) for each row, from ``text`` alone.

    Null texts and texts without a letter are ``und`` with score 0, as is everything when no language was learned. An
    empty table gives no rows.
    """
    fields = [docs.schema[c] for c in keep]
    if model is None:
        return docs.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, "__text"):
            code, bounds = trigrams(*raw(part.column(0)), m.params.bits)
            langs, score = m.predict(code, bounds)
            letter = part.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*part.columns[2:], pa.array([l if ok else UNDETERMINED for l, ok in zip(langs, letter)], pa.string()),
                 pa.array(np.where(letter, score, 0.0))],
                names=[*keep, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string", "score double"])
    letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("__letter")
    lowered = F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__text")
    return docs.select(lowered, letter, *keep).mapInArrow(run, schema)


def fold(column: Column) -> Column:
    """The fold of a document, 0 to 2; fold 1 is held out of the fit."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(3))


def languages_of(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """Fit outside fold 1, then predict every row: ``doc_id, held_out, lang_pred, score``. A null id counts as an empty one."""
    number = fold(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    model = fit_languages(docs.where(number != 1), params)
    return identify_languages(docs, model).select(
        "doc_id", (fold(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) == 1).alias("held_out"), "lang_pred", "score")
