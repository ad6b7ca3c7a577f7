"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled rows. Terms are words and word beginnings; those
that tell the classes apart become the vocabulary, and every example a unit vector of TF-IDF
weights. The index holds, per term, postings in blocks of examples with the largest weight
of each block. A query adds up block bounds and scores blocks in order of their bounds until
no other can reach its k-th best, so its neighbours are exact. They vote by squared
similarity, weighted so that the sample stands for all labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsift.llm.common import column, crc32_of_id, hash64, map_rows, shipped, stored, texts

_WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """`max_examples`: labelled rows used per class. `max_terms`: size of the vocabulary.
    `least_chi2`: how surely a term must tell the classes apart; of fewer than four times as
    many examples a quarter of their number, as chi2 is at most that. `starts`: lengths of word
    beginnings that are terms too. `neighbours`: how many vote. `prior`: the weight of the
    share of toxic rows in the vote."""

    max_examples: int = 3000
    max_terms: int = 4096
    least_examples: int = 3
    least_chi2: float = 25.0
    starts: tuple[int, ...] = (4, 5)
    neighbours: int = 25
    prior: float = 0.05
    threshold: float = 0.3
    block: int = 64


def word_counts(text: str) -> Counter[str]:
    return Counter(_WORDS.findall(text.lower()))


def term_counts(words: Counter[str], starts: tuple[int, ...]) -> dict[str, int]:
    """Words, and beginnings of longer words, written with a star."""
    found: dict[str, int] = dict(words)
    for word, n in words.items():
        for k in starts:
            if len(word) > k:
                start = word[:k] + "*"
                found[start] = found.get(start, 0) + n
    return found


# Blocks scored before the others are held against the k-th best similarity.
_FIRST = 4


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges of `count` from `begin`, and the range each is of."""
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(len(of)) + (begin - np.cumsum(count) + count)[of], of


@dataclass
class Index:
    """Block-max inverted index over unit vectors of examples."""

    terms: dict[str, int]
    idf: np.ndarray
    starts: tuple[int, ...]
    block: int
    toxic: np.ndarray  # label of each example
    ids: np.ndarray  # its doc_id
    post_begin: np.ndarray  # postings of term t and block entry e: begin[e]..begin[e + 1]
    post_example: np.ndarray
    post_weight: np.ndarray
    entry_begin: np.ndarray  # block entries of term t
    entry_block: np.ndarray
    entry_max: np.ndarray

    def __post_init__(self) -> None:
        # Word beginnings that are terms, by their length.
        self.stars = {
            k: {t[:-1]: i for t, i in self.terms.items() if t.endswith("*") and len(t) == k + 1}
            for k in self.starts
        }

    @staticmethod
    def build(
        terms: list[str],
        df: list[int],
        toxic: np.ndarray,
        ids: np.ndarray,
        example: np.ndarray,
        term: np.ndarray,
        count: np.ndarray,
        settings: Settings,
    ) -> Index:
        n = len(toxic)
        idf = np.log((1 + n) / (1 + np.array(df, float))) + 1
        weight = (1 + np.log(count)) * idf[term] if len(term) else np.empty(0)
        norm = np.sqrt(np.bincount(example, weight**2, minlength=n)) if len(term) else np.ones(n)
        weight = weight / norm[example] if len(term) else weight
        at = np.lexsort((example, term))
        term, example, weight = term[at], example[at], weight[at]
        group = term * (n // settings.block + 1) + example // settings.block
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(term) else term
        return Index(
            {t: i for i, t in enumerate(terms)},
            idf,
            settings.starts,
            settings.block,
            toxic,
            ids,
            np.r_[first, len(term)].astype(np.int64),
            example,
            weight,
            np.searchsorted(term[first], np.arange(len(terms) + 1)),
            example[first] // settings.block,
            np.maximum.reduceat(weight, first) if len(term) else weight,
        )

    def query(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the vocabulary in the text, and their unit weights."""
        words = word_counts(text)
        found: dict[int, int] = {}
        known = self.terms
        for word in words.keys() & known.keys():
            found[known[word]] = words[word]
        for k in self.starts:
            stars = self.stars[k]
            for word, n in words.items():
                t = stars.get(word[:k])
                if t is not None and len(word) > k:
                    found[t] = found.get(t, 0) + n
        if not found:
            return np.empty(0, int), np.empty(0)
        order = sorted(found)
        weight = np.array([1 + math.log(found[t]) for t in order]) * self.idf[order]
        return np.array(order), weight / math.sqrt(float(weight @ weight))

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine over 0, ties to the earlier example."""
        # The block entries of all terms, one after another.
        begin = self.entry_begin[term]
        entry, of = _spread(begin, self.entry_begin[term + 1] - begin)
        by = weight[of]
        block = self.entry_block[entry]
        n_blocks = len(self.toxic) // self.block + 1
        bound = np.bincount(block, by * self.entry_max[entry], n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]

        def scores(blocks: np.ndarray) -> np.ndarray:
            chosen = np.zeros(n_blocks, bool)
            chosen[blocks] = True
            at = np.flatnonzero(chosen[block])
            first = self.post_begin[entry[at]]
            post, of = _spread(first, self.post_begin[entry[at] + 1] - first)
            part = by[at][of] * self.post_weight[post]
            return np.bincount(self.post_example[post], part, len(self.toxic))

        def best_of(at: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            top = np.lexsort((at, -score))[:k]
            return at[top], score[top]

        # The most promising blocks give a k-th best similarity; of the others only those
        # whose bound reaches it can hold a neighbour.
        score = scores(order[:_FIRST])
        best_at, best = best_of(np.flatnonzero(score > 0), score[score > 0])
        rest = order[_FIRST:]
        if len(best) == k:
            rest = rest[bound[rest] >= best[-1] - 1e-12]
        if len(rest):
            score = scores(rest)
            at = np.flatnonzero(score > 0)
            best_at, best = best_of(np.r_[best_at, at], np.r_[best, score[at]])
        return best_at, best


@dataclass
class Model:
    index: Index
    settings: Settings
    class_weight: tuple[float, float]
    base: float  # share of toxic rows among all labelled ones
    without: float  # the same among rows without a term of the vocabulary

    def score(self, text: str) -> tuple[float, float, list[int]]:
        """Score, similarity of the nearest example, doc_ids of the three nearest."""
        term, weight = self.index.query(text)
        if not len(term):
            return self.without, 0.0, []
        at, similarity = self.index.nearest(term, weight, self.settings.neighbours)
        if not len(at):
            return self.without, 0.0, []
        toxic = self.index.toxic[at]
        vote = similarity**2 * np.where(toxic, self.class_weight[1], self.class_weight[0])
        m = self.settings.prior
        score = (float(vote[toxic].sum()) + m * self.base) / (float(vote.sum()) + m)
        return score, float(similarity[0]), self.index.ids[at[:3]].tolist()


def sketch(text: str, n: int = 5) -> int:
    """The least hash of the word n-grams: near copies mostly share it."""
    words = text.lower().encode().split()
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    return min(map(hash64, grams)) >> 1


def _terms_of(docs: DataFrame, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(texts(batch)):
                found = term_counts(word_counts(text), settings.starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(column(batch, "doc_id")[i], len(found)),
                        pa.repeat(column(batch, "toxic")[i], len(found)),
                        pa.array(list(found), pa.string()),
                        pa.array(list(found.values()), pa.int64()),
                        pa.repeat(pa.scalar(sketch(text), pa.int64()), len(found)),
                    ],
                    names=["doc_id", "toxic", "term", "n", "sketch"],
                )

    return docs.mapInArrow(
        run, "doc_id bigint, toxic int, term string, n bigint, sketch bigint"
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    settings: Settings = Settings(),
) -> Model:
    """Learn from labelled rows whose crc32(id) mod 4 is not 2.

    Per class the `max_examples` rows that come first in a hashed order are the sample;
    equal texts count once. Class shares come from all labelled rows. Rows without a label
    or an id teach nothing; an id with both labels counts as toxic, and of an id with several
    texts the one of least md5 is used. What reaches the driver is bounded by max_examples
    and max_terms. Without examples of both classes the model has no terms and gives every
    text the share of toxic rows (0 without labels).
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .where(crc32_of_id(doc_id) % 4 != 2)
        .groupBy(F.col(doc_id).cast("bigint").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("toxic"))
    )
    known = stored(known, "toxic-labels")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    base = n1 / (n0 + n1) if n0 + n1 else 0.0
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = None
    for value in (0, 1):
        part = known.where(F.col("toxic") == value).orderBy(*order).limit(settings.max_examples)
        sample = part if sample is None else sample.unionByName(part)
    chosen = stored(sample, "toxic-sample")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    examples = rows.join(F.broadcast(chosen), "doc_id")  # 2 * max_examples ids at most
    # One text per id, then one id per text, so that repeated ids keep the bound as well.
    same = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    examples = (
        examples.withColumn("same", same)
        .groupBy("doc_id", "toxic")
        .agg(F.min("same").alias("same"), F.min_by("text", "same").alias("text"))
        .groupBy("same", "toxic")
        .agg(F.any_value("text").alias("text"), F.min("doc_id").alias("doc_id"))
        .drop("same")
    )
    examples = stored(examples, "toxic-examples")
    found = stored(_terms_of(examples, settings), "toxic-terms")
    listed = examples.select("doc_id", "toxic").orderBy("toxic", "doc_id").toPandas()
    toxic = listed["toxic"].to_numpy() == 1
    s0, s1 = int((~toxic).sum()), int(toxic.sum())
    empty = np.empty(0, np.int64)
    ids = listed["doc_id"].to_numpy().astype(np.int64)
    if not s0 or not s1:
        index = Index.build([], [], toxic, ids, empty, empty, empty, settings)
        return Model(index, settings, (1.0, 1.0), base, base)

    a, b = F.col("with_1"), F.col("with_0")
    c, d = F.lit(float(s1)) - a, F.lit(float(s0)) - b
    chi2 = (
        (a * d - b * c) ** 2 * float(s0 + s1) / ((a + b) * (c + d) * float(s0) * float(s1))
    )
    # Near copies of one example are one witness for their words.
    witnesses = found.select("term", "toxic", "sketch").distinct()
    vocabulary = (
        witnesses.groupBy("term")
        .agg(
            F.sum(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0)).alias("with_1"),
            F.sum(F.when(F.col("toxic") == 0, 1.0).otherwise(0.0)).alias("with_0"),
        )
        .where((a + b >= settings.least_examples) & (c + d > 0))
        .withColumn("chi2", chi2)
        .where(F.col("chi2") >= min(settings.least_chi2, (s0 + s1) / 4))
        .orderBy(F.desc("chi2"), "term")
        .limit(settings.max_terms)
    )
    vocabulary = stored(vocabulary, "toxic-vocabulary")
    kept = vocabulary.orderBy("term").toPandas()
    terms = kept["term"].tolist()
    df = (kept["with_1"] + kept["with_0"]).astype(int).tolist()
    postings = found.join(F.broadcast(vocabulary.select("term")), "term")
    postings = postings.select("doc_id", "toxic", "term", "n").toPandas()
    of = {(i, t): k for k, (i, t) in enumerate(zip(ids.tolist(), toxic.astype(int).tolist(), strict=True))}
    number = {t: i for i, t in enumerate(terms)}
    example = np.array(
        [of[x] for x in zip(postings["doc_id"], postings["toxic"], strict=True)], np.int64
    )
    term = np.array([number[t] for t in postings["term"]], np.int64)
    index = Index.build(
        terms, df, toxic, ids, example, term, postings["n"].to_numpy().astype(float), settings
    )
    # One toxic example weighs 1, a clean one what it stands for beside it.
    share = (n0 / s0) / (n1 / s1)
    bare = np.ones(len(toxic), bool)
    bare[example] = False
    w1, w0 = float((bare & toxic).sum()), float((bare & ~toxic).sum()) * share
    return Model(index, settings, (share, 1.0), base, (w1 + base) / (w0 + w1 + 1))


RESULT = "score double, predicted int, similarity double, evidence array<bigint>"


def score_toxicity(
    docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add score, predicted, similarity of the nearest example, and the doc_ids of the three
    nearest examples as evidence.

    Only the text is read for it, whole. Null and empty texts, and texts without a term of
    the vocabulary, get the share of toxic rows among such examples. Repeated rows score
    alike; an input column with the name of a result column is replaced; an empty table gives
    an empty table. One narrow pass: the index, of bounded size, goes to every executor once.
    """
    shared = shipped(docs.sparkSession, model)

    def judge(batch: pa.RecordBatch) -> list:
        known = shared()
        rows = []
        for value in texts(batch, text):
            score, similarity, evidence = known.score(value)
            rows.append((score, int(score >= known.settings.threshold), similarity, evidence))
        return list(zip(*rows, strict=True)) if rows else [[]] * 4

    return map_rows(docs, RESULT, judge, keep)
