"""A Katz backoff model of words, learned and evaluated in partitions.

A bigram seen r times keeps the share d_r of its count: Good-Turing for r up to `low`, and
(r - 0.5) / r above, so that every history keeps some mass back. That mass goes to the words
not seen after the history, in proportion to their unigram probabilities, which are
discounted in the same way and leave their rest to unknown words. All weights are normalised
exactly. A token is scored by its bigram if that was seen, else by the backoff weight of its
history times the unigram, else as an unknown word.

Texts are cut into blocks. Every block sends its bigrams, each with the documents it is in,
to the partition of its word, where counts and scores meet; so no text is shuffled, and
counts and scores need one exchange. Words and bigrams that are frequent beyond a
partition's share are dealt over all of them, with counts taken beforehand. Words are named
by 64-bit hashes, so of n words two share a name with a probability of about n**2 / 2**65.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsift.llm.common import (
    arrow_type,
    column,
    hashed_words,
    mix64,
    pack,
    shipped,
    stored,
    unpack,
    work_folder,
)

START = np.uint64((1 << 64) - 2)
END = np.uint64((1 << 64) - 3)
_COMMON = 65_535
_HIGH = np.uint64(1 << 63)


@dataclass(frozen=True)
class Katz:
    """`low`: counts up to it are discounted by Good-Turing. `block`: tokens of a block.
    `partition`: tokens a partition of the tables stands for."""

    low: int = 5
    high_discount: float = 0.5
    block: int = 1_000_000
    partition: int = 2_000_000

    def discounts(self, spectrum: list[int]) -> np.ndarray:
        """d_1..d_low from the numbers of types seen 1..low + 1 times."""
        out = [(r - self.high_discount) / r for r in range(1, self.low + 1)]
        n = spectrum
        if all(n):
            common = (self.low + 1) * n[self.low] / n[0]
            for r in range(1, self.low + 1):
                d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if common != 1 else 0
                if 0 < d < 1:
                    out[r - 1] = d
        return np.array(out)

    def kept(self, counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
        """Discounted counts; 0 stays 0."""
        counts = counts.astype(np.float64)
        low = np.r_[0.0, discounts][np.minimum(counts, self.low).astype(int)] * counts
        return np.where(counts > self.low, counts - self.high_discount, low)


@dataclass
class Totals:
    """What every task needs to know: bounded by four entries per partition."""

    tokens: int = 0
    types: int = 0
    documents: int = 0
    partitions: int = 1
    spectrum: list[int] = field(default_factory=list)
    common: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    hot_counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    pairs: np.ndarray = field(default_factory=lambda: np.empty((0, 2), np.uint64))
    pair_counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def names(self, hashes: np.ndarray) -> np.ndarray:
        """Shorter names for the most frequent words: their places; the top bit for others."""
        if not len(self.common):
            return hashes | _HIGH
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        return np.where(self.common[at] == hashes, at.astype(np.uint64), hashes | _HIGH)


# Logarithms travel as whole numbers of this many parts of one: half the bytes of a double,
# and off by less than 1e-8 a document and partition.
_PARTS_OF_ONE = float(1 << 26)


def _packed_sums(docs: np.ndarray, counts: list[np.ndarray], logs: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Documents in ascending order, as their distances, and their counts and logarithms."""
    whole = [np.rint(x * _PARTS_OF_ONE).astype(np.int64) for x in logs]
    whole = [(x << 1) ^ (x >> 63) for x in whole]  # the sign last, so that small ones stay short
    flat = np.concatenate([*[np.rint(c).astype(np.int64) for c in counts], *whole])
    return pack(np.diff(docs, prepend=0)), pack(flat.view(np.uint64))


def _unpacked_sums(docs: bytes, values: bytes, n_logs: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents, and one row per count and logarithm."""
    who = np.cumsum(unpack(docs).astype(np.int64))
    flat = unpack(values).astype(np.uint64).reshape(-1, len(who))
    out = flat.astype(np.float64)
    z = flat[len(flat) - n_logs :].view(np.int64)
    out[len(flat) - n_logs :] = ((z >> 1) ^ -(z & 1)) / _PARTS_OF_ONE
    return who, out


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted array, -1 if it is not there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def pair_key(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(word) * np.uint64(0x9E3779B97F4A7C15) + before)


@dataclass
class Block:
    number: int
    ids: list
    held: np.ndarray
    words: np.ndarray  # hashes of the words of all documents, one after another
    counts: np.ndarray  # words per document

    def tokens(self, totals: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, word before and document of every token."""
        n = len(self.counts)
        ends = np.cumsum(self.counts + 1) - 1
        word = np.full(len(self.words) + n, END, np.uint64)
        inside = np.ones(len(word), bool)
        inside[ends] = False
        word[inside] = totals.names(self.words)
        before = np.r_[START, word[:-1]] if len(word) else word
        if n:
            before[np.r_[0, ends[:-1] + 1]] = START
        return word, before, np.repeat(np.arange(n), self.counts + 1)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Block]:
    """Documents of a partition in blocks of about `size` tokens."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids: list = []
    held: list[bool] = []
    words: list[np.ndarray] = []
    counts: list[int] = []
    total = 0

    def made() -> Block:
        flat = np.concatenate(words) if words else np.empty(0, np.uint64)
        return Block(number, ids, np.array(held, bool), flat, np.array(counts, np.int64))

    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            flat, each = hashed_words(part)
            words.append(flat)
            counts += each.tolist()
            ids += column(part, "doc_id").to_pylist()
            held += column(part, "held_out").to_pylist()
            total += len(flat) + len(each)
            if total >= size:
                yield made()
                number += 1
                ids, held, words, counts, total = [], [], [], [], 0
    if counts:
        yield made()


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


def _word_counts(docs: DataFrame, model: Katz) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, model.block):
            learned = np.repeat(~block.held, block.counts)
            word, n = np.unique(block.words[learned], return_counts=True)
            ends = int((~block.held).sum())
            word, n = np.r_[word, END], np.r_[n, ends]
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"]
            )

    found = docs.mapInArrow(run, "word bigint, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _hot_pairs(docs: DataFrame, model: Katz, totals: Callable[[], Totals], least: int) -> DataFrame:
    """Counts of bigrams of two hot words that are frequent beyond a partition's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = totals()
        # The start of a text stands before as many words as there are texts.
        history = np.sort(np.r_[known.hot, START])
        for block in _blocks(batches, model.block):
            word, before, doc = block.tokens(known)
            a, b = _find(known.hot, word), _find(history, before)
            use = (a >= 0) & (b >= 0) & ~block.held[doc]
            pairs, n = np.unique(a[use] * len(history) + b[use], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(known.hot[pairs // len(history)].view(np.int64)),
                    pa.array(history[pairs % len(history)].view(np.int64)),
                    pa.array(n.astype(np.int64)),
                ],
                names=["word", "before", "n"],
            )

    found = docs.mapInArrow(run, "word bigint, before bigint, n bigint")
    sums = found.groupBy("word", "before").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") > least)


def _totals(docs: DataFrame, model: Katz) -> tuple[Totals, DataFrame]:
    words = stored(_word_counts(docs, model), "katz-words")
    seen = [F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, model.low + 2)]
    row = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), *seen).first()
    totals = Totals(row["tokens"] or 0, row["types"])
    totals.spectrum = [row[f"n{r}"] for r in range(1, model.low + 2)]
    totals.partitions = max(1, -(-int(totals.tokens * 1.2) // model.partition))
    ends = words.where(F.col("word") == int(END.astype(np.int64))).first()
    totals.documents = ends["n"] if ends else 0
    plain = words.where(F.col("word") != int(END.astype(np.int64)))
    common = plain.orderBy(F.desc("n"), "word").limit(_COMMON).toPandas()
    totals.common = np.sort(common["word"].to_numpy(np.int64).view(np.uint64))
    least = totals.tokens // (4 * totals.partitions)
    hot = words.where(F.col("n") > least).toPandas()
    hashes = hot["word"].to_numpy(np.int64).view(np.uint64)
    names = np.where(hashes == END, END, totals.names(hashes)) if len(hot) else hashes
    order = np.argsort(names)
    totals.hot, totals.hot_counts = names[order], hot["n"].to_numpy(np.int64)[order]
    pairs = _hot_pairs(docs, model, shipped(docs.sparkSession, totals), least).toPandas()
    totals.pairs = np.c_[
        pairs["word"].to_numpy(np.int64).view(np.uint64),
        pairs["before"].to_numpy(np.int64).view(np.uint64),
    ].reshape(-1, 2)
    order = np.argsort(pair_key(totals.pairs[:, 0], totals.pairs[:, 1]))
    totals.pairs, totals.pair_counts = totals.pairs[order], pairs["n"].to_numpy(np.int64)[order]
    return totals, words


_ROUTE = "block bigint, bucket int, words binary, fans binary, befores binary, times binary, docs binary"


def _routed(docs: DataFrame, model: Katz, totals: Callable[[], Totals]) -> DataFrame:
    """Per block and partition its bigrams, sorted, with the documents they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = totals()
        pair_keys = pair_key(known.pairs[:, 0], known.pairs[:, 1])
        count = np.uint64(known.partitions)
        for block in _blocks(batches, model.block):
            word, before, doc = block.tokens(known)
            name = mix64(word)
            hot = np.flatnonzero(_find(known.hot, word) >= 0)
            keys = pair_key(word[hot], before[hot])
            name[hot] = keys
            very = hot[_find(pair_keys, keys) >= 0]
            name[very] = mix64(name[very] ^ mix64(doc[very].astype(np.uint64) ^ np.uint64(block.number)))
            bucket = (name % count).astype(np.int32)
            order = np.lexsort((doc, before, word, bucket))
            word, before, bucket = word[order], before[order], bucket[order]
            doc = doc[order] * 2 + block.held[doc[order]]
            begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in zip(begin, [*begin[1:], len(bucket)], strict=True):
                w, h = word[a:b], before[a:b]
                new_word = np.r_[True, w[1:] != w[:-1]]
                pair = np.flatnonzero(new_word | np.r_[True, h[1:] != h[:-1]])
                first = np.flatnonzero(new_word[pair])
                yield _table(
                    [
                        (
                            block.number,
                            int(bucket[a]),
                            pack(w[pair[first]]),
                            pack(np.diff(np.r_[first, len(pair)])),
                            pack(h[pair]),
                            pack(np.diff(np.r_[pair, len(w)])),
                            pack(doc[a:b]),
                        )
                    ],
                    _ROUTE_NAMES,
                    _ROUTE_KINDS,
                )

    return docs.mapInArrow(run, _ROUTE)


_ROUTE_NAMES = ["block", "bucket", "words", "fans", "befores", "times", "docs"]
_ROUTE_KINDS = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
_PART = (
    "kind string, block bigint, bucket int, words binary, befores binary, counts binary, "
    "totals binary, docs binary, values binary, spectrum array<bigint>"
)
_PART_NAMES = [x.split()[0] for x in _PART.split(", ")]
_PART_KINDS = [pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.int64())]


def _unigram(model: Katz, totals: Totals) -> tuple[np.ndarray, float]:
    """Discounts of unigrams and the probability of an unknown word."""
    discounts = model.discounts(totals.spectrum)
    if not totals.tokens:
        return discounts, 1.0
    low = sum(
        r * n * (1 - d) for r, (n, d) in enumerate(zip(totals.spectrum, discounts, strict=False), 1)
    )
    high = totals.types - sum(totals.spectrum[: model.low])
    return discounts, (low + high * model.high_discount) / totals.tokens


def _counted(routed: DataFrame, model: Katz, totals: Callable[[], Totals]) -> DataFrame:
    """Counts of a partition's bigrams, and what they say of each document."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        known = totals()
        discounts, unknown = _unigram(model, known)
        words, befores, docs, blocks, numbers = [], [], [], [], []
        for row in table.to_pylist():
            times = unpack(row["times"]).astype(np.int64)
            fans = unpack(row["fans"]).astype(np.int64)
            words.append(np.repeat(np.repeat(unpack(row["words"]).astype(np.uint64), fans), times))
            befores.append(np.repeat(unpack(row["befores"]).astype(np.uint64), times))
            docs.append(unpack(row["docs"]).astype(np.int32))
            blocks.append(np.full(len(docs[-1]), len(numbers), np.int32))
            numbers.append(row["block"])
        # Parts are let go as soon as they are joined: a partition is in memory once.
        del times, fans, row
        word, words = np.concatenate(words), None
        before, befores = np.concatenate(befores), None
        doc, docs = np.concatenate(docs), None
        block, blocks = np.concatenate(blocks), None
        held, doc = (doc & 1).astype(bool), doc >> 1

        keys, first, at = np.unique(pair_key(word, before), return_index=True, return_inverse=True)
        at = at.astype(np.int32)
        count = np.bincount(at, ~held, minlength=len(keys)).astype(np.int64)
        pair_keys = pair_key(known.pairs[:, 0], known.pairs[:, 1])
        very = _find(pair_keys, keys)
        count = np.where(very >= 0, known.pair_counts[very] if len(pair_keys) else 0, count)
        pair_word, pair_before = word[first], before[first]
        del word, keys, first, held
        names, name_at = np.unique(pair_word, return_inverse=True)
        total = np.bincount(name_at, count, minlength=len(names)).astype(np.int64)
        hot = _find(known.hot, names)
        total = np.where(hot >= 0, known.hot_counts[hot] if len(known.hot) else 0, total)

        own = (count > 0) & (very < 0)
        spectrum = np.bincount(np.minimum(count[own], model.low + 2), minlength=model.low + 3)
        out = [
            (
                "model",
                0,
                int(key[0].as_py()),
                pack(pair_word[own]),
                pack(pair_before[own]),
                pack(count[own]),
                pack(total[name_at][own]),
                None,
                None,
                spectrum[1 : model.low + 2].tolist(),
            )
        ]
        probability = model.kept(total, discounts) / max(1, known.tokens)
        rest = np.log10(np.where(total > 0, np.maximum(probability, 1e-300), unknown))
        base = np.log10((total + 0.1) / (known.tokens + 0.1 * (known.types + 1)))
        used = np.log10(np.maximum(total, 1)) * (names != END)
        seen = count[at]
        of = name_at[at]
        score = np.where(
            seen > model.low,
            np.log10(np.maximum(seen - model.high_discount, 0.5)),
            np.where(seen > 0, 0.0, rest[of]),
        )
        score -= used[of]
        open_ = seen == 0
        frequent = (_find(known.hot, before) >= 0) | (before == START)
        # One row per block: sums of its documents.
        order = np.argsort(block, kind="stable")
        begin = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]])
        for some in np.split(order, begin[1:]):
            who, local = np.unique(doc[some], return_inverse=True)
            n = len(who)
            counts = [np.bincount(local, total[of[some]] > 0, n)]
            counts += [np.bincount(local, seen[some] == r, n) for r in range(1, model.low + 1)]
            logs = [np.bincount(local, x, n) for x in (base[of[some]], score[some])]
            number = numbers[block[some[0]]]
            sums = _packed_sums(who, counts, logs)
            out.append(("sums", number, 0, None, None, None, None, *sums, None))
            # Tokens that back off after a frequent history stay with their block.
            miss = some[open_[some] & frequent[some]]
            if len(miss):
                sent = pack(before[miss]), pack(doc[miss])
                out.append(("near", number, 0, None, sent[0], None, None, sent[1], None, None))
        del order, score, of, seen
        # The others go to the partition of their history, those of all blocks in one row.
        miss = np.flatnonzero(open_ & ~frequent)
        side = (mix64(before[miss]) % np.uint64(known.partitions)).astype(np.int32)
        order = np.lexsort((block[miss], side))
        miss, side = miss[order], side[order]
        begin = np.flatnonzero(np.r_[True, side[1:] != side[:-1]]) if len(miss) else []
        for a, b in zip(begin, [*begin[1:], len(miss)], strict=True):
            some = miss[a:b]
            which, n = np.unique(block[some], return_counts=True)
            sent = pack(np.array([numbers[i] for i in which], np.int64)), pack(n)
            out.append(
                (
                    "far",
                    0,
                    int(side[a]),
                    sent[0],
                    pack(before[some]),
                    sent[1],
                    None,
                    pack(doc[some]),
                    None,
                    None,
                )
            )
        return pa.Table.from_batches([_table(out, _PART_NAMES, _PART_KINDS)])

    return routed.groupBy("bucket").applyInArrow(run, _PART)


def _history_parts(tables: DataFrame, model: Katz, totals: Callable[[], Totals]) -> DataFrame:
    """Per partition of histories: what each table says of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = totals()
        discounts, _ = _unigram(model, known)
        for batch in batches:
            for row in batch.to_pylist():
                before = unpack(row["befores"]).astype(np.uint64)
                if not len(before):
                    continue
                count = unpack(row["counts"]).astype(np.int64)
                names, at = np.unique(before, return_inverse=True)
                n = len(names)
                share = model.kept(unpack(row["totals"]), discounts) / max(1, known.tokens)
                high = count > model.low
                stats = [np.bincount(at, count == r, n) for r in range(1, model.low + 1)]
                stats += [np.bincount(at, high, n), np.bincount(at, count * high, n)]
                stats = [pack(s.astype(np.int64)) for s in stats]
                seen = np.bincount(at, share, n)
                side = (mix64(names) % np.uint64(known.partitions)).astype(np.int64)
                values = np.array([unpack(s) for s in stats], np.int64)
                for b in np.unique(side).tolist():
                    use = side == b
                    yield _table(
                        [(b, pack(names[use]), pack(values[:, use].ravel()), pack(seen[use]))],
                        ["bucket", "names", "counts", "seen"],
                        [pa.int32(), pa.binary(), pa.binary(), pa.binary()],
                    )

    wanted = tables.select("befores", "counts", "totals")
    return wanted.mapInArrow(run, "bucket int, names binary, counts binary, seen binary")


def _backoff(parts: DataFrame, model: Katz, discounts: np.ndarray) -> DataFrame:
    """Per partition of histories their counts and backoff weights."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names, counts, seen = [], [], []
        for row in table.to_pylist():
            names.append(unpack(row["names"]).astype(np.uint64))
            counts.append(unpack(row["counts"]).astype(np.int64).reshape(model.low + 2, -1))
            seen.append(unpack(row["seen"]))
        history, at = np.unique(np.concatenate(names), return_inverse=True)
        n = len(history)
        counts = np.array([np.bincount(at, c, n) for c in np.concatenate(counts, 1)])
        ranks = np.arange(1, model.low + 1)
        total = ranks @ counts[: model.low] + counts[model.low + 1]
        kept = (ranks * discounts) @ counts[: model.low]
        kept = kept + counts[model.low + 1] - model.high_discount * counts[model.low]
        weight = (1 - kept / total) / (1 - np.bincount(at, np.concatenate(seen), n))
        row = [(int(key[0].as_py()), pack(history), pack(total.astype(np.int64)), pack(weight))]
        return pa.Table.from_batches(
            [_table(row, ["bucket", "names", "counts", "weights"], [pa.int32(), *[pa.binary()] * 3])]
        )

    return parts.groupBy("bucket").applyInArrow(
        run, "bucket int, names binary, counts binary, weights binary"
    )


def _answered_near(near: DataFrame, hot: Callable[[], dict]) -> DataFrame:
    """Sums per document of tokens that back off after frequent histories, whose answers
    are known everywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = hot()
        names = np.array(sorted(answers), np.uint64)
        # A history that is not known adds nothing: the unigram stands alone.
        values = np.array([*(answers[n] for n in names.tolist()), 0.0])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                value = values[_find(names, unpack(row["befores"]).astype(np.uint64))]
                who, local = np.unique(unpack(row["docs"]).astype(np.int64), return_inverse=True)
                sums = np.bincount(local, value, len(who))
                out.append((row["block"], *_packed_sums(who, [], [sums])))
            yield _table(out, _ANSWER_NAMES, _ANSWER_KINDS)

    return near.select("block", "befores", "docs").mapInArrow(run, _ANSWER)


_ANSWER = "block bigint, docs binary, values binary"
_ANSWER_NAMES = ["block", "docs", "values"]
_ANSWER_KINDS = [pa.int64(), pa.binary(), pa.binary()]


def _answered(far: DataFrame, backoff: DataFrame) -> DataFrame:
    """Sums per document of the tokens that back off, one row per partition and block."""

    def run(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        rows = known.to_pylist()
        names, answer = np.empty(0, np.uint64), np.zeros(1)
        if rows:
            names = unpack(rows[0]["names"]).astype(np.uint64)
            counts = unpack(rows[0]["counts"]).astype(np.float64)
            # An unknown history has no bigrams: the unigram stands alone.
            answer = np.r_[np.log10(unpack(rows[0]["weights"])) + np.log10(counts), 0.0]
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for row in asked.to_pylist():
            docs = unpack(row["docs"]).astype(np.int64)
            value = answer[_find(names, unpack(row["befores"]).astype(np.uint64))]
            ends = np.cumsum(unpack(row["counts"]).astype(np.int64)).tolist()
            for block, a, b in zip(unpack(row["words"]).tolist(), [0, *ends[:-1]], ends, strict=True):
                who, local = np.unique(docs[a:b], return_inverse=True)
                found.setdefault(block, []).append((who, np.bincount(local, value[a:b])))
        out = []
        for block, parts in found.items():
            who, local = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
            sums = np.bincount(local, np.concatenate([v for _, v in parts]))
            out.append((block, *_packed_sums(who, [], [sums])))
        return pa.Table.from_batches([_table(out, _ANSWER_NAMES, _ANSWER_KINDS)])

    wanted = far.select("bucket", "words", "counts", "befores", "docs")
    cogrouped = wanted.groupBy("bucket").cogroup(backoff.groupBy("bucket"))
    return cogrouped.applyInArrow(run, _ANSWER)


def _documents(docs: DataFrame, model: Katz) -> DataFrame:
    """Documents of each block, in order."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    id_type = pa.list_(arrow_type(docs.schema["doc_id"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, model.block):
            yield _table(
                [(block.number, block.ids, block.held.tolist(), (block.counts + 1).tolist())],
                ["block", "ids", "held", "tokens"],
                [pa.int64(), id_type, pa.list_(pa.bool_()), pa.list_(pa.int64())],
            )

    return docs.mapInArrow(
        run, f"block bigint, ids array<{kind}>, held array<boolean>, tokens array<bigint>"
    )


def _summed(documents: DataFrame, sums: DataFrame, model: Katz, logs: np.ndarray, start: float) -> DataFrame:
    kind = documents.schema["ids"].dataType.elementType.simpleString()
    low = model.low

    def run(key: tuple, blocks: pa.Table, parts: pa.Table) -> pa.Table:
        block = blocks.to_pylist()[0]
        n = len(block["ids"])
        known, base, score = np.zeros(n), np.zeros(n), np.full(n, start)
        for row in parts.to_pylist():
            if row["kind"] != "sums":
                who, (more,) = _unpacked_sums(row["docs"], row["values"], 1)
                score[who] += more
                continue
            who, values = _unpacked_sums(row["docs"], row["values"], 2)
            known[who] += values[0]
            base[who] += values[low + 1]
            score[who] += values[low + 2] + logs @ values[1 : low + 1]
        arrays = [
            pa.array(block["ids"], blocks.schema.field("ids").type.value_type),
            pa.array(block["held"], pa.bool_()),
            pa.array(block["tokens"], pa.int64()),
            pa.array(np.rint(known).astype(np.int64)),
            pa.array(base),
            pa.array(score),
        ]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pa.Table.from_arrays(arrays, names=names)

    return documents.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(
        run,
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, "
        "base_score double, score double",
    )


def score_texts(
    docs: DataFrame,
    held_out,
    doc_id: str = "doc_id",
    text: str = "text",
    model: Katz = Katz(),
    folder: str | None = None,
) -> DataFrame:
    """Learn from the rows where `held_out` is false and score all rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).
    A null or empty text is its end token. Repeated rows are counted and scored each; a null
    id keeps its row. Without rows to learn from every score is 0. An empty table gives an
    empty table; other columns are not read.

    The tables stay in `folder` (by default a new one in the shared folder): `words` (word,
    n), `tables` with kind=model (bigrams and counts by partition of words) and `backoff`
    (histories, counts and weights by partition of histories).
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or work_folder(spark, "katz")
    small = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out")
    )
    found, _ = _totals(small, model)
    totals = shipped(spark, found)
    parts = _counted(
        _routed(small, model, totals).repartition(found.partitions, "bucket"), model, totals
    )
    # The tables hold packed bytes already.
    parts.write.partitionBy("kind").option("compression", "uncompressed").parquet(f"{folder}/tables")
    tables = spark.read.schema(parts.schema).parquet(f"{folder}/tables")
    spectrum = [0] * (model.low + 1)
    tables_of = {k: tables.where(F.col("kind") == k) for k in ("model", "sums", "near", "far")}
    some = tables_of["model"].select(F.posexplode("spectrum").alias("r", "n"))
    for row in some.groupBy("r").agg(F.sum("n").alias("n")).collect():
        spectrum[row["r"]] += row["n"]
    hot_total = found.pair_counts
    for r in range(1, model.low + 2):
        spectrum[r - 1] += int((hot_total == r).sum())
    discounts = model.discounts(spectrum)
    modelled = tables_of["model"].select("befores", "counts", "totals")
    if len(found.pairs):
        at = _find(found.hot, found.pairs[:, 0])
        packed = [pack(found.pairs[:, 1]), pack(found.pair_counts), pack(found.hot_counts[at])]
        extra = spark.createDataFrame(
            [tuple(map(bytearray, packed))], "befores binary, counts binary, totals binary"
        )
        modelled = modelled.unionByName(extra)
    backoff = _backoff(_history_parts(modelled, model, totals), model, discounts)
    backoff.write.option("compression", "uncompressed").parquet(f"{folder}/backoff")
    backoff = spark.read.schema(backoff.schema).parquet(f"{folder}/backoff")

    frequent = np.r_[found.hot[found.hot != END], START].tolist()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.sort(np.array(frequent, np.uint64))
        for batch in batches:
            for row in batch.to_pylist():
                names = unpack(row["names"]).astype(np.uint64)
                use = np.flatnonzero(_find(wanted, names) >= 0)
                value = np.log10(unpack(row["weights"])[use]) + np.log10(
                    unpack(row["counts"])[use].astype(float)
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[use].view(np.int64)), pa.array(value)], names=["name", "value"]
                )

    answers = backoff.mapInArrow(pick, "name bigint, value double").collect()
    known = {int(np.int64(r["name"]).astype(np.uint64)): r["value"] for r in answers}
    near = _answered_near(tables_of["near"], shipped(spark, known))
    answered = _answered(tables_of["far"], backoff).union(near).withColumn("kind", F.lit("open"))
    sums = tables_of["sums"].select("kind", "block", "docs", "values")
    start = -math.log10(found.documents) if found.documents else 0.0
    logs = np.log10(discounts * np.arange(1, model.low + 1))
    scored = _summed(
        _documents(small, model), sums.unionByName(answered), model, logs, start
    )
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(found.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
