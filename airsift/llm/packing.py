"""Mixture-controlled packing by deficit round-robin over source queues.

Documents wait in one queue per source. In every round each queue's deficit grows by its
quantum, its share of a window's tokens, and the queue is served whole grains of tokens up
to its deficit; what is left is carried to the next round, through the whole corpus. Rounds
are laid one after another and cut into sequences of equal length, so only the last sequence
can be short.

What a queue has been served after r rounds is min(total, grain * floor(r * quantum / grain)),
so a token's place follows from its place in its queue and the totals of the sources. Each
partition computes its pieces on its own, with the deficits that all partitions before it
left.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsift.llm.common import column, sliced, stored, texts
from airsift.llm.tokens import default_tokenizer, worker_encoder

MAX_SOURCES = 100_000
_IDS = "queue string, part int, before bigint, n bigint, ids binary"
_CELLS = 4_000_000


class Schedule:
    """Who is served when. `totals` and `quanta` are by queue, in queue order."""

    def __init__(self, totals: list[int], quanta: list[int], grain: int):
        self.total = np.array(totals, np.int64)
        self.quantum = np.array(quanta, np.int64)
        self.grain = grain
        self.rounds = -(-self.total // self.quantum)  # the round that empties a queue

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens served by the begin of each round, one row per round."""
        r = rounds[:, None]
        some = np.minimum(r, self.rounds) * self.quantum // self.grain * self.grain
        return np.where(r >= self.rounds, self.total, np.minimum(some, self.total))

    def intervals(self, queue: int, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(round, from, to) of the tokens start..end of a queue."""
        g, q = self.grain, int(self.quantum[queue])
        total, last = int(self.total[queue]), int(self.rounds[queue])
        while start < end:
            until = min(last, -(-(start // g + 1) * g // q))
            served = total if until >= last else min(total, until * q // g * g)
            yield until - 1, start, min(end, served)
            start = min(end, served)

    def places(self, queue: np.ndarray, rounds: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Place in the packed stream of the first token of each interval."""
        out = np.empty(len(queue), np.int64)
        step = max(1, _CELLS // len(self.total))
        for i in range(0, len(queue), step):
            part = slice(i, i + step)
            now, after = self.served(rounds[part]), self.served(rounds[part] + 1)
            turn = np.cumsum(after - now, axis=1) - (after - now)
            rows = np.arange(len(now))
            own = queue[part]
            out[part] = now.sum(1) + turn[rows, own] + start[part] - now[rows, own]
        return out


def quanta(totals: list[int], shares: list[float], window: int) -> list[int]:
    """Tokens a queue gains per round, one at least."""
    whole = sum(s for s, t in zip(shares, totals, strict=True) if t) or 1.0
    return [max(1, round(window * s / whole)) for s in shares]


def mixture(
    totals: Mapping[str | None, int], shares: Mapping[str | None, float] | None
) -> list[float]:
    """The share of every source, in order of `totals`. Sources without a share have in common
    what the others leave, by their tokens."""
    if not shares:
        return [float(n) for n in totals.values()]
    named = dict(shares)
    bad = [s for s, x in named.items() if not (math.isfinite(x) and x >= 0)]
    if bad:
        raise ValueError(f"shares of {bad} are negative or not finite")
    there = sum(named.get(s, 0.0) for s in totals)
    rest = sum(n for s, n in totals.items() if s not in named)
    if rest and there >= 1:
        raise ValueError("the shares of the named sources leave nothing for the others")
    if totals and not rest and not there:
        raise ValueError("the shares of all sources are 0")
    return [
        float(named[s]) if s in named else (1 - there) * n / rest for s, n in totals.items()
    ]


def _encoded(
    docs: DataFrame,
    doc_id: str,
    text: str,
    source: str,
    tokenizer: str,
    added_tokens: bool,
    cached_pieces: int | None,
) -> DataFrame:
    """Ids of every document with its place: the partition, and the tokens of its queue
    before it in that partition."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL(_IDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = worker_encoder(tokenizer, added_tokens, cached_pieces)
        running: dict[str, int] = {}
        for batch in sliced(batches):
            ids = encoder.encode(texts(batch, text))
            queues = ["n" if s is None else "s" + s for s in column(batch, source).to_pylist()]
            counts = [len(x) // encoder.id_bytes for x in ids]
            before = []
            for queue, n in zip(queues, counts, strict=True):
                before.append(running.get(queue, 0))
                running[queue] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, doc_id),
                    pa.array(queues, pa.string()),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(before, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=schema.fieldNames(),
            )

    small = docs.select(
        F.col(doc_id), F.col(text), F.col(source).cast("string").alias(source)
    )
    return small.mapInArrow(run, schema)


PIECE = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, source string"
)


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    tokenizer: str | None = None,
    sequence: int = 1024,
    window_sequences: int = 16,
    grain: int = 64,
    shares: Mapping[str | None, float] | None = None,
    added_tokens: bool = False,
    cached_pieces: int | None = None,
) -> DataFrame:
    """One row per piece of a document in a sequence, with its place and checksum.

    `shares` are the target proportions of tokens by source, between 0 and 1; sources without
    one share what is left by their tokens (by default all do, so that all queues end
    together). Of sources that all have one, only the relations count. A share of 0 is served
    a token a round. A queue that ends early leaves its turn to the others. Every id lies in exactly one
    piece. A null text is empty and packs as its end id; a null source is a queue of its
    own, after the others; a null id stays null; repeated rows are packed each. An empty
    table gives an empty table. Other columns are not read. `added_tokens` is that of
    `Encoder`, `cached_pieces` its `pieces`. Ids are written once to the shared folder; per source one total reaches the driver, of at most MAX_SOURCES.
    """
    encoded = stored(
        _encoded(
            docs, doc_id, text, source, tokenizer or default_tokenizer(), added_tokens, cached_pieces
        ),
        "pack-ids",
    )
    parts = stored(encoded.groupBy("queue", "part").agg(F.sum("n").alias("n")), "pack-parts")
    listed = parts.groupBy("queue").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: fold them before packing")
    # Sources in code point order, null last.
    totals = {q: n for q, n in sorted(listed, key=lambda r: (r[0] == "n", r[0]))}
    names = {q: None if q == "n" else q[1:] for q in totals}
    weights = mixture({names[q]: n for q, n in totals.items()}, shares) if totals else []
    order = {q: i for i, q in enumerate(totals)}
    gains = quanta(list(totals.values()), weights, sequence * window_sequences)
    amounts = list(totals.values())

    earlier = W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = parts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    placed = encoded.join(stored(bases, "pack-bases"), ["queue", "part"])
    id_type = encoded.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL(PIECE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(amounts, gains, grain)
        for batch in batches:
            if not batch.num_rows:
                continue
            queues = [order[q] for q in column(batch, "queue").to_pylist()]
            count = column(batch, "n").to_pylist()
            begin = (
                column(batch, "base").to_numpy() + column(batch, "before").to_numpy()
            ).tolist()
            found = [
                (row, queue, r, a - at, b - a)
                for row, (queue, at, n) in enumerate(zip(queues, begin, count, strict=True))
                for r, a, b in schedule.intervals(queue, at, at + n)
            ]
            row, queue, rounds, start, length = np.array(found, np.int64).T
            at = np.array(begin, np.int64)[row]
            place = schedule.places(queue, rounds, start + at)
            # Turns that follow each other without a gap are one interval.
            joins = (row[1:] == row[:-1]) & (place[1:] == place[:-1] + length[:-1])
            first = np.flatnonzero(np.r_[True, ~joins])
            length = np.add.reduceat(length, first)
            row, start, place = row[first], start[first], place[first]
            # Cut at the borders of sequences.
            cuts = (place + length - 1) // sequence - place // sequence + 1
            of = np.repeat(np.arange(len(row)), cuts)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            number = place[of] // sequence + nth
            left = np.maximum(place[of], number * sequence)
            right = np.minimum(place[of] + length[of], (number + 1) * sequence)
            start = start[of] + left - place[of]
            row, length = row[of], right - left
            checks = np.empty(len(row), np.int64)
            blobs = column(batch, "ids")
            last, ids = -1, b""
            for i, (k, a, n) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                if k != last:
                    raw = blobs[k].as_py()
                    ids = np.frombuffer(raw, f"<u{len(raw) // count[k]}").astype("<u4").tobytes()
                    last = k
                checks[i] = zlib.crc32(ids[4 * a : 4 * (a + n)])
            pick = pa.array(row)
            source_names = [names[q] for q in order]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id").take(pick),
                    pa.array(start),
                    pa.array(length),
                    pa.array(checks),
                    column(batch, "n").take(pick),
                    pa.array(number),
                    pa.array(left - number * sequence),
                    pa.array([source_names[queues[k]] for k in row.tolist()], pa.string()),
                ],
                names=schema.fieldNames(),
            )

    return placed.select("doc_id", "queue", "base", "before", "n", "ids").mapInArrow(run, schema)
