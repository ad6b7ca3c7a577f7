"""Quality by the nearest labelled examples in a latent semantic space.

Terms of a text are its words, runs of character classes (how it is written) and how often
its words come back. Their TF-IDF vectors over a bounded sample of labelled rows give, by
truncated SVD, the space; the examples' vectors in it go to every executor. Each document is
projected, compared with every example by blocked matrix products, and its nearest examples
vote by their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsift.llm.common import (
    column,
    crc32_of_id,
    hashed_words,
    map_rows,
    pack,
    shipped,
    stored,
    unpack,
)

# Character classes by byte: groups of ASCII characters of one class each, in order; letters
# beyond ASCII, controls and all else follow. Fixed values.
_CLASSES = [" \t", "\n\r", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_CLASSES += ["0123456789", ".", ",", "!?", "\"'`()-", ":;", "#*$%&@^~+=_", "|<>[]{}\\/"]
_BEYOND, _CONTROL, _N_CLASSES = len(_CLASSES), len(_CLASSES) + 1, 16
_CLASS_OF = np.full(256, _CONTROL, np.int64)
_CLASS_OF[128:] = _BEYOND
for _number, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members.encode())] = _number
# Runs of these count as one character: blanks, line ends, letters, digits, letters beyond.
_RUNS = np.isin(np.arange(_N_CLASSES), [0, 1, 2, 3, 4, _BEYOND])
_GRAMS = _N_CLASSES**3
_AGAIN = 16  # classes of word frequencies in a text: 1, 2, 3-4, 5-8, ...


@dataclass(frozen=True)
class Settings:
    """`max_examples`: labelled rows used per class. `words`: buckets that words are hashed
    into. `rank`: dimensions of the space. `neighbours`: how many vote. `power` of the
    similarity is a vote's weight. `prior`: weight of the share of label 1 in the vote.
    `piece`: bytes of a text looked at at a time, `block`: documents per matrix product."""

    max_examples: int = 2000
    words: int = 4096
    rank: int = 64
    neighbours: int = 25
    power: float = 4.0
    prior: float = 0.05
    threshold: float = 0.3
    piece: int = 1 << 20
    block: int = 256

    @property
    def terms(self) -> int:
        return self.words + _GRAMS + _AGAIN

    @property
    def families(self) -> np.ndarray:
        """First term of each family: words, character classes, repetition; and the end."""
        return np.array([0, self.words, self.words + _GRAMS, self.terms])


def _pieces(values: pa.LargeStringArray, most: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Texts cut at blanks into pieces of at most `most` bytes, some of about that size
    together, and the text each piece belongs to. Where a text is cut depends on it alone."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)
    offsets = offsets[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = memoryview(data) if data is not None else memoryview(b"")
    owner, ends, size = [], [int(offsets[0])], 0

    def group() -> tuple[np.ndarray, pa.Array]:
        bounds = pa.py_buffer(np.array(ends, np.int64).tobytes())
        return np.array(owner), pa.LargeStringArray.from_buffers(len(owner), bounds, data)

    for i, (begin, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while begin < stop:
            end = min(stop, begin + most)
            if end < stop:
                tail = bytes(raw[max(begin, end - 4096) : end])
                blank = max(tail.rfind(b" "), tail.rfind(b"\n"))
                end = end - len(tail) + blank + 1 if blank >= 0 else end
            if owner and size + end - begin > most:
                yield group()
                owner, ends, size = [], [begin], 0
            owner.append(i)
            ends.append(end)
            size += end - begin
            begin = end
    if owner:
        yield group()


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of `n`."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _class_runs(values: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Piece and number of every three character classes in a row, runs taken as one."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1]
    raw = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    kind = _CLASS_OF[raw]
    begins = np.zeros(len(raw), bool)
    begins[offsets[:-1] - offsets[0]] = True
    kept = np.flatnonzero(begins | ~_RUNS[kind] | (kind != np.r_[-1, kind[:-1]]))
    kind = kind[kept]
    piece = np.searchsorted(offsets - offsets[0], kept, side="right") - 1
    whole = piece[2:] == piece[:-2]
    code = kind[:-2] * _N_CLASSES**2 + kind[1:-1] * _N_CLASSES + kind[2:]
    return piece[:-2][whole], code[whole]


def term_counts(values: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of all texts of a column, in order; null texts have none."""
    values = values.cast(pa.large_string()).fill_null("")
    texts, hashes, times, keys, sums = [], [], [], [], []
    for owner, pieces in _pieces(values, settings.piece):
        word, per = hashed_words(pa.RecordBatch.from_arrays([pieces], names=["text"]))
        text = np.repeat(owner, per)
        order = np.lexsort((word, text))
        word, text = word[order], text[order]
        new = np.r_[True, (word[1:] != word[:-1]) | (text[1:] != text[:-1])] if len(word) else word
        first = np.flatnonzero(new)
        texts.append(text[first])
        hashes.append(word[first])
        times.append(np.diff(np.r_[first, len(word)]))
        piece, code = _class_runs(pieces)
        key, n = _summed(owner[piece] * settings.terms + settings.words + code, np.ones(len(code), np.int64))
        keys.append(key)
        sums.append(n)
    if not texts:
        return (np.empty(0, np.int64),) * 3
    text, word, n = np.concatenate(texts), np.concatenate(hashes), np.concatenate(times)
    if len(texts) > 1:  # words of a text in several pieces
        order = np.lexsort((word, text))
        text, word, n = text[order], word[order], n[order]
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (text[1:] != text[:-1])])
        text, word, n = text[first], word[first], np.add.reduceat(n, first)
    often = np.minimum(np.ceil(np.log2(n)).astype(np.int64), _AGAIN - 1)
    bucket = (word % np.uint64(settings.words)).astype(np.int64)
    keys += [text * settings.terms + bucket, text * settings.terms + settings.words + _GRAMS + often]
    key, n = _summed(np.concatenate(keys), np.concatenate([*sums, n, n]))
    return key // settings.terms, key % settings.terms, n


def weighted(
    text: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray, settings: Settings
) -> np.ndarray:
    """Weights of the terms: root of their share of a family times IDF, each family of a text
    scaled to the same length."""
    family = np.searchsorted(settings.families, term, side="right") - 1
    group = text * 3 + family
    weight = np.sqrt(n / np.bincount(group, n)[group]) * idf[term]
    length = np.sqrt(np.bincount(group, weight**2))
    return weight / length[group] / np.sqrt(3.0)


def _rows_of(text: np.ndarray, n_texts: int) -> np.ndarray:
    return np.searchsorted(text, np.arange(n_texts + 1))


@dataclass
class Model:
    settings: Settings
    idf: np.ndarray
    space: np.ndarray  # terms x rank
    vectors: np.ndarray  # examples x rank, unit length
    good: np.ndarray  # label of each example
    class_weight: tuple[float, float]
    base: float  # share of label 1 among all labelled rows

    def project(self, values: pa.Array) -> np.ndarray:
        """Unit vectors of texts; zero for one without terms."""
        text, term, n = term_counts(values, self.settings)
        return self.projected(text, term, n, len(values))

    def projected(
        self, text: np.ndarray, term: np.ndarray, n: np.ndarray, n_texts: int
    ) -> np.ndarray:
        out = np.zeros((n_texts, self.space.shape[1]), np.float32)
        if not len(text) or not out.shape[1]:
            return out
        weight = weighted(text, term, n, self.idf, self.settings).astype(np.float32)
        at = _rows_of(text, n_texts)
        for i in range(n_texts):
            part = slice(at[i], at[i + 1])
            out[i] = weight[part] @ self.space[term[part]]
        length = np.sqrt((out.astype(float) ** 2).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 1e-9, casting="same_kind")

    def vote(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each vector, and the cosine of its nearest example."""
        score, nearest = np.full(len(vectors), self.base), np.zeros(len(vectors))
        k = min(self.settings.neighbours, len(self.vectors))
        if not k:
            return score, nearest
        m = self.settings.prior
        for start in range(0, len(vectors), self.settings.block):
            block = vectors[start : start + self.settings.block]
            cosine = block @ self.vectors.T
            at = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            near = np.maximum(np.take_along_axis(cosine, at, axis=1).astype(float), 0.0)
            good = self.good[at]
            weight = near**self.settings.power
            weight *= np.where(good, self.class_weight[1], self.class_weight[0])
            share = ((weight * good).sum(axis=1) + m * self.base) / (weight.sum(axis=1) + m)
            part = slice(start, start + len(block))
            score[part], nearest[part] = share, near.max(axis=1)
        return score, nearest


def _space(
    text: np.ndarray, term: np.ndarray, weight: np.ndarray, n_texts: int, settings: Settings
) -> np.ndarray:
    """Main right singular vectors of the examples' weights, by subspace iteration from a
    fixed start; the matrix is unfolded some rows at a time."""
    rank = min(settings.rank, n_texts)
    wide = min(n_texts, rank + 16)
    basis = np.random.default_rng(5).standard_normal((settings.terms, wide))
    at = _rows_of(text, n_texts)
    for _ in range(8):
        basis = np.linalg.qr(basis)[0]
        after = np.zeros_like(basis)
        gram = np.zeros((wide, wide))
        for start in range(0, n_texts, 512):
            stop = min(start + 512, n_texts)
            part = slice(at[start], at[stop])
            dense = np.zeros((stop - start, settings.terms))
            dense[text[part] - start, term[part]] = weight[part]
            seen = dense @ basis
            gram += seen.T @ seen
            after += dense.T @ seen
        turned = np.linalg.eigh(gram)[1][:, ::-1]
        best, basis = basis @ turned[:, :rank], after
    return best.astype(np.float32)


def _sample(
    docs: DataFrame, labels: DataFrame, held_out: Column, settings: Settings,
    doc_id: str, text: str, label: str,
) -> tuple[DataFrame, int, int]:
    """Labelled texts of the sample, and the labelled rows of each class."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out)
        .groupBy(F.col(doc_id).cast("bigint").alias("doc_id"))
        .agg(F.min(label).cast("int").alias("good"))
    )
    known = stored(known, "quality-labels")
    counts = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [
        known.where(F.col("good") == value).orderBy(*order).limit(settings.max_examples)
        for value in (0, 1)
    ]
    chosen = stored(parts[0].unionByName(parts[1]), "quality-sample")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    same = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    examples = (
        rows.join(F.broadcast(chosen), "doc_id")  # 2 * max_examples ids at most
        .groupBy("doc_id", "good")
        .agg(F.min_by("text", same).alias("text"))
    )
    return examples, counts.get(0, 0), counts.get(1, 0)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    settings: Settings = Settings(),
) -> Model:
    """Learn from labelled rows that are not `held_out` (by default those whose crc32(id) mod
    5 is 0).

    Per class the `max_examples` rows that come first in a hashed order are the sample; class
    shares come from all labelled rows. Rows without a label or an id teach nothing, an id
    with both labels counts as 0, and of an id with several texts the one of least md5 is
    used. The driver gets one sparse row of at most `Settings.terms` counts per example.
    Without any example every text scores the share of label 1 (0 without labels).
    """
    out = held_out if held_out is not None else crc32_of_id(doc_id) % 5 == 0
    examples, n0, n1 = _sample(docs, labels, out, settings, doc_id, text, label)

    def extract(batch: pa.RecordBatch) -> list:
        values = column(batch, "text")
        text, term, n = term_counts(values, settings)
        at = _rows_of(text, len(values))
        cuts = [slice(at[i], at[i + 1]) for i in range(len(values))]
        return [[pack(term[c]) for c in cuts], [pack(n[c]) for c in cuts]]

    found = map_rows(examples, "term binary, n binary", extract, ["doc_id", "good"])
    rows = stored(found, "quality-terms").orderBy("doc_id").collect()
    base = n1 / (n0 + n1) if n0 + n1 else 0.0
    good = np.array([r.good == 1 for r in rows], bool)
    terms = [unpack(r.term).astype(np.int64) for r in rows]
    term = np.concatenate([np.empty(0, np.int64), *terms])
    n = np.concatenate([np.empty(0, np.int64), *[unpack(r.n).astype(np.int64) for r in rows]])
    at = np.repeat(np.arange(len(rows)), [len(t) for t in terms])
    idf = np.log((1 + len(rows)) / (1 + np.bincount(term, minlength=settings.terms))) + 1
    s0, s1 = int((~good).sum()), int(good.sum())
    share = (n1 / s1) / (n0 / s0) if s0 and s1 else 1.0
    empty = np.empty((0, 0), np.float32)
    model = Model(settings, idf, np.empty((settings.terms, 0), np.float32), empty, good, (1.0, share), base)
    if not len(term):
        return model
    model.space = _space(at, term, weighted(at, term, n, idf, settings), len(rows), settings)
    vectors = model.projected(at, term, n, len(rows))
    told = np.abs(vectors).sum(axis=1) > 0
    model.vectors, model.good = vectors[told], good[told]
    return model


RESULT = "score double, predicted int, similarity double"


def score_quality(
    docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add score, predicted and the cosine of the nearest example.

    Only the text is read for it, whole; texts beyond `piece` bytes are looked at piece by
    piece. Null, empty and blank texts score the share of label 1. Repeated rows score
    alike; an input column named as a result column is replaced; an empty table gives an
    empty table. One narrow pass: the examples, of bounded size, go to every executor once.
    """
    shared = shipped(docs.sparkSession, model)

    def judge(batch: pa.RecordBatch) -> list:
        known = shared()
        score, nearest = known.vote(known.project(column(batch, text)))
        return [score, (score >= known.settings.threshold).astype(np.int32), nearest]

    return map_rows(docs, RESULT, judge, keep)
