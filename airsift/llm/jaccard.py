"""Similarity join on word n-grams: MinHash LSH forest, then exact verification.

Every text has `trees` signatures of `depth` min-hashes, each a path in a prefix trie. A path
is one integer whose leading bits are its first levels, so that sorted paths are the trie and a
shift shortens a prefix. All tries are searched from full depth; their matched prefixes are
shortened in turn, a level at a time, until a pair just at the threshold meets in some trie
with the target recall. A join owes every link over the threshold, so texts that have found
close partners are not let off sooner. Candidates are verified on their sets of n-grams, exactly.

Equal word sequences are one class and are joined once. Prefixes of more texts than a block are
split by their deeper levels: the texts of a full path are compared with one representative, and
those half the threshold's distance from it, or nearer, form a ball. Jaccard distance obeys the
triangle inequality, so all texts of a ball are linked to each other, and their links follow
from its size. Other pairs of such a prefix are dealt by pairs of blocks to tasks; a pair is
verified only in the first trie where it meets. Tasks emit sums and spanning edges, never
pairs. A large group costs rows in proportion to its size if its texts share a ball; texts
outside any ball meet every block of their prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airsift.llm.common import column, hash64, mix64, sorted_groups, stored, texts

_HALF = np.uint64(32)
# Bits of a path for each level below the shortest prefix searched.
_LEVEL_BITS = 4


@dataclass(frozen=True)
class Forest:
    """`depth`: min-hashes of a full path. `block`: texts of one prefix per block."""

    n: int = 5
    threshold: float = 0.8
    trees: int = 24
    depth: int = 10
    recall: float = 0.9999
    block: int = 384
    seed: int = 11

    def levels(self) -> list[int]:
        """The prefix searched in every trie: shortened in turn from full depth, until a pair
        at the threshold meets with the target recall."""
        levels = [self.depth] * self.trees
        tree = 0
        while max(levels) > 1 and self.met(levels) < self.recall:
            levels[tree] -= 1
            tree = (tree + 1) % self.trees
        return levels

    def met(self, levels: list[int]) -> float:
        """The probability that a pair at the threshold shares one of these prefixes."""
        missed = 1.0
        for level in levels:
            missed *= 1 - self.threshold**level
        return 1 - missed

    def shifts(self) -> list[int]:
        """Bits that shorten a path to the prefix searched, of every trie."""
        return [_LEVEL_BITS * (self.depth - level) for level in self.levels()]

    def ball(self) -> float:
        """Texts this similar to one text are within the threshold of each other."""
        return (1 + self.threshold) / 2 + 1e-9


def grams(words: list[bytes], n: int) -> np.ndarray:
    """Distinct hashed word n-grams, sorted; fewer than n words are one n-gram."""
    if not words:
        return np.empty(0, np.uint64)
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    known = np.fromiter(map(hash64, ids), np.uint64, len(ids))
    code = known[np.fromiter(map(ids.__getitem__, words), np.int64, len(words))]
    k = min(n, len(words))
    found = np.zeros(len(code) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            found = mix64(found * np.uint64(31) + code[i : len(code) - k + 1 + i])
    return np.unique(found)


def normal_words(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return text.encode().lower().split()


def signatures(sets: list[np.ndarray], forest: Forest) -> np.ndarray:
    """Per set and tree its path; sets are not empty.

    The shortest prefix searched fills the leading bits, every deeper level the next four.
    A 64-bit hash of an n-gram serves two levels, one with each half.
    """
    floor = min(forest.levels())
    deeper = forest.depth - floor
    pairs = (forest.depth + 1) // 2
    rng = np.random.default_rng(forest.seed)
    size = forest.trees * pairs
    a = rng.integers(1, 1 << 63, size, np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, size, np.uint64)
    out = np.empty((len(sets), forest.trees), np.uint64)
    begin, step = 0, 1 << 18
    while begin < len(sets):
        end, total = begin, 0
        while end < len(sets) and (end == begin or total + len(sets[end]) <= step):
            total += len(sets[end])
            end += 1
        flat = np.concatenate(sets[begin:end])
        starts = np.cumsum([0, *map(len, sets[begin : end - 1])])
        with np.errstate(over="ignore"):
            for tree in range(forest.trees):
                least = []
                for i in range(tree * pairs, (tree + 1) * pairs):
                    hashed = flat * a[i] + b[i]
                    hashed ^= hashed >> _HALF
                    halves = hashed.view(np.uint32)
                    least += [np.minimum.reduceat(halves[half::2], starts) for half in (0, 1)]
                path = np.full(end - begin, tree, np.uint64)
                for level in range(floor):
                    path = mix64(path * np.uint64(0x9E3779B97F4A7C15) + least[level])
                path <<= np.uint64(_LEVEL_BITS * deeper)
                for level in range(floor, forest.depth):
                    part = mix64(least[level]) & np.uint64((1 << _LEVEL_BITS) - 1)
                    path |= part << np.uint64(_LEVEL_BITS * (forest.depth - 1 - level))
                out[begin:end, tree] = path
        begin = end
    return out


def _signed(docs: DataFrame, doc_id: str, text: str, forest: Forest) -> DataFrame:
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                words = [normal_words(t) for t in texts(part)]
                # Of equal texts in a batch only the first is signed.
                keys = [hashlib.md5(b" ".join(w)).digest() for w in words]
                first = {k: i for i, k in reversed(list(enumerate(keys))) if words[i]}
                sets = {k: grams(words[i], forest.n) for k, i in first.items()}
                signed = signatures(list(sets.values()), forest) if sets else []
                paths = {k: s.view(np.int64).tolist() for k, s in zip(sets, signed, strict=True)}
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, "doc_id"),
                        pa.array(keys, pa.binary()),
                        pa.array([paths.get(k) for k in keys], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "key", "paths"],
                )

    small = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = small.schema["doc_id"].dataType.simpleString()
    return small.mapInArrow(run, f"doc_id {kind}, key binary, paths array<bigint>")


def _with_grams(docs: DataFrame, forest: Forest) -> DataFrame:
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [normal_words(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.md5(b" ".join(w)).digest() for w in words], pa.binary()),
                    pa.array([grams(w, forest.n).tobytes() for w in words], pa.binary()),
                ],
                names=["key", "grams"],
            )

    return docs.mapInArrow(run, "key binary, grams binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets."""
    if len(left) == 1 or len(right) == 1:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    both = np.concatenate([*left, *right])
    _, at = np.unique(both, return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [*map(len, left), *map(len, right)])
    is_left = rows < len(left)
    in_left = np.bincount(at[is_left], minlength=at.max() + 1) > 0
    in_right = np.bincount(at[~is_left], minlength=at.max() + 1) > 0
    number = np.cumsum(in_left & in_right) - 1
    use = (in_left & in_right)[at]
    rows, at, is_left = rows[use], number[at[use]], is_left[use]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 2048
    for begin in range(0, int(number[-1]) + 1, width):
        here = (at >= begin) & (at < begin + width)
        a = np.zeros((len(left), width), np.float32)
        b = np.zeros((len(right), width), np.float32)
        a[rows[here & is_left], at[here & is_left] - begin] = 1
        b[rows[here & ~is_left] - len(left), at[here & ~is_left] - begin] = 1
        out += a @ b.T
    return out


def linked(
    left: list[np.ndarray],
    right: list[np.ndarray],
    left_paths: np.ndarray,
    right_paths: np.ndarray,
    same_ball: np.ndarray,
    tree: int,
    threshold: float,
) -> np.ndarray:
    """Which pairs of no common ball reach the threshold and meet in no trie before this one."""
    met = same_ball.copy()
    for t in range(tree):
        met |= left_paths[:, t][:, None] == right_paths[:, t][None, :]
    sizes = np.array([*map(len, left)])[:, None], np.array([*map(len, right)])[None, :]
    small, large = np.minimum(*sizes), np.maximum(*sizes)
    open_ = ~met & (small >= threshold * large)
    if not open_.any():
        return open_
    rows, cols = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    shared = np.zeros(open_.shape)
    shared[np.ix_(rows, cols)] = overlaps([left[i] for i in rows], [right[j] for j in cols])
    union = sizes[0] + sizes[1] - shared
    return open_ & (shared >= threshold * union)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_TASK = ["tree", "path", "low", "high"]


def _verified(tasks: DataFrame, forest: Forest) -> DataFrame:
    """Per text of a task: links found, the copies linked to, and a text of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _, low, high), group in sorted_groups(batches, _TASK):
            sets = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
            paths = np.array(group.column("paths").to_pylist(), np.int64)
            side = np.array(group.column("side").to_pylist())
            copies = np.array(group.column("copies").to_pylist(), np.int64)
            # Texts without a ball have numbers of their own.
            alone = {None: -1}
            ball = np.array([alone.setdefault(x, len(alone)) for x in group.column("ball").to_pylist()])
            ball = np.where(ball < 0, -1 - np.arange(len(ball)), ball)
            left = np.flatnonzero(side == low)
            right = left if low == high else np.flatnonzero(side == high)
            if not len(left) or not len(right):
                continue
            found = linked(
                [sets[i] for i in left],
                [sets[i] for i in right],
                paths[left],
                paths[right],
                ball[left][:, None] == ball[right][None, :],
                tree,
                forest.threshold,
            )
            if low == high:
                found = np.triu(found, 1)
            x, y = np.nonzero(found)
            if not len(x):
                continue
            a, b = left[x], right[y]
            n = len(sets)
            links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            others = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
            root = _roots(n, a, b)
            some = np.flatnonzero(links)
            columns = [
                group.column(name).take(pa.array(rows))
                for rows in (some, root[some])
                for name in ("key", "class_id")
            ]
            columns += [pa.array(links[some], pa.int64()), pa.array(others[some].astype(np.int64))]
            names = ["key", "class_id", "root", "root_id", "links", "copies"]
            yield from pa.table(columns, names=names).combine_chunks().to_batches()

    return tasks.mapInArrow(run, _link_schema(tasks))


def _link_schema(of: DataFrame) -> str:
    kind = of.schema["class_id"].dataType.simpleString()
    return (
        f"key binary, class_id {kind}, root binary, root_id {kind}, links bigint, copies bigint"
    )


def _near(pairs: DataFrame, least: float) -> DataFrame:
    """The rows whose sets `grams` and `other` are at least that similar, without the sets."""
    kept = [c for c in pairs.columns if c not in ("grams", "other")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(column(batch, "grams"), column(batch, "other"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                near.append(shared >= least * (len(a) + len(b) - shared))
            yield batch.select(kept).filter(pa.array(near, pa.bool_()))

    return pairs.mapInArrow(run, pairs.select(*kept).schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The least node of the component of every node of an undirected graph: (node, root).

    Alternates linking every node's larger neighbours, then its smaller ones, to the least
    neighbour, until nothing changes: each round is a few shuffles of as many rows as there
    are edges, and a chain of n nodes needs about log n rounds.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    now = stored(now, "component-edges")
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # Large star: larger neighbours of u go to the least of u and its neighbours.
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        # Small star: smaller neighbours of u, and u, go to the least of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stored(new, "component-edges")
        # A round that changes nothing has reached stars.
        changed = new.exceptAll(now).limit(1).count() or now.exceptAll(new).limit(1).count()
        now = new
        if not changed:
            break
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


RESULT = ["class_id", "n_copies", "n_links", "n_linked_docs", "group_id"]


def _sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, forest: Forest) -> DataFrame:
    """The classes `wanted` with their sets of n-grams, of one text found by its least doc_id."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ids = wanted.select(F.col("class_id").alias("_id")).distinct()
    found = source.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = _with_grams(found.select("text"), forest)
    return sets.groupBy("key").agg(F.first("grams").alias("grams")).join(wanted, "key")


def _balls(
    docs: DataFrame, doc_id: str, text: str, hot: DataFrame, classes: DataFrame, forest: Forest
) -> DataFrame:
    """Texts of crowded prefixes that are near one representative: key, class_id, copies, ball,
    ball_id (the key and class_id of the representative), size and all (copies) of the ball.

    The representative of a full path is the text of its least key, and a text asks the least
    of those of its paths, so that the paths of one group agree on one.
    """
    full = hot.groupBy("tree", "full").agg(F.min("key").alias("ball"), F.count("*").alias("texts"))
    asked = (
        hot.join(full.where("texts > 1"), ["tree", "full"])
        .groupBy("key")
        .agg(F.min("ball").alias("ball"))
    )
    asked = stored(asked, "join-asked")
    keys = asked.select("key").union(asked.select(F.col("ball").alias("key"))).distinct()
    wanted = classes.select("key", "class_id", "copies").join(keys, "key")
    sets = stored(_sets(docs, doc_id, text, wanted, forest), "join-ball-sets")
    heads = sets.select(
        F.col("key").alias("ball"), F.col("class_id").alias("ball_id"), F.col("grams").alias("other")
    )
    heads = heads.join(asked.select("ball").distinct(), "ball", "left_semi")
    pairs = asked.join(sets, "key").join(heads, "ball")
    near = stored(_near(pairs, forest.ball()), "join-near")
    sizes = (
        near.groupBy("ball")
        .agg(F.count("*").alias("size"), F.sum("copies").alias("all"))
        .where("size > 1")
    )
    return stored(near.join(sizes, "ball"), "join-balls")


def _dealt(hot: DataFrame, balls: DataFrame, forest: Forest) -> DataFrame:
    """Texts of crowded prefixes by task. A ball of many texts has blocks of its own, which do
    not meet each other."""
    node = ["tree", "path"]
    none = F.lit(b"")
    hot = hot.join(balls.select("key", "ball"), "key", "left")
    hot = hot.withColumn("own", F.coalesce("ball", none))
    counts = hot.groupBy(*node, "own").agg(F.count("*").alias("n"))
    large = (F.col("own") != none) & (F.col("n") >= forest.block // 2)
    counts = counts.withColumn("part", F.when(large, F.col("own")).otherwise(none))
    parts = counts.groupBy(*node, "part").agg(F.sum("n").alias("n"))
    parts = parts.withColumn("sides", F.ceil(F.col("n") / forest.block).cast("int"))
    before = W.partitionBy(*node).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = (
        parts.withColumn("first", F.coalesce(F.sum("sides").over(before), F.lit(0)).cast("int"))
        .withColumn("total", F.sum("sides").over(W.partitionBy(*node)).cast("int"))
        .drop("n")
    )
    where = counts.drop("n").join(parts, [*node, "part"])
    side = F.col("first") + F.pmod(F.xxhash64("key", "tree"), F.col("sides")).cast("int")
    others = F.sequence(F.lit(0), F.col("total") - 1)
    foreign = F.filter(
        others, lambda o: (o < F.col("first")) | (o >= F.col("first") + F.col("sides"))
    )
    return (
        hot.join(where, [*node, "own"])
        .withColumn("side", side)
        .withColumn("other", F.explode(F.when(F.col("part") == none, others).otherwise(foreign)))
        .withColumn("low", F.least("side", "other"))
        .withColumn("high", F.greatest("side", "other"))
        .select("key", *_TASK, "side")
    )


def _classes(
    docs: DataFrame, doc_id: str, text: str, forest: Forest
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, and of every class its key, class_id, copies, sums of links
    and the class that names its group (a struct of none, id, key), null if it is alone."""
    signed = stored(_signed(docs, doc_id, text, forest), "join-signed")
    classes = signed.groupBy("key").agg(
        F.min("doc_id").alias("class_id"),
        F.count("*").alias("copies"),
        F.any_value("paths").alias("paths"),
    )
    classes = stored(classes, "join-classes")
    shifts = F.array(*map(F.lit, forest.shifts()))
    short = F.expr("transform(paths, (p, i) -> shiftrightunsigned(p, shifts[i]))")
    prefixes = classes.where("paths IS NOT NULL").withColumn("shifts", shifts)
    prefixes = prefixes.withColumn("short", short)
    trees = prefixes.select(
        "key", "paths", F.posexplode("short").alias("tree", "path")
    ).select("key", "tree", "path", F.expr("paths[tree]").alias("full"))
    shared = (
        trees.groupBy("tree", "path")
        .agg(
            F.count("*").alias("texts"),
            F.bit_xor(F.xxhash64("key")).alias("set_1"),
            F.bit_xor(F.xxhash64("key", F.lit(1))).alias("set_2"),
        )
        .where("texts > 1")
        # The same texts meeting again in a later trie have nothing new to verify.
        .groupBy("texts", "set_1", "set_2")
        .agg(F.min(F.struct("tree", "path")).alias("first"))
        .select("first.tree", "first.path", "texts")
    )
    met = stored(trees.join(shared, ["tree", "path"]), "join-met")
    hot = met.where(F.col("texts") > forest.block)
    balls = _balls(docs, doc_id, text, hot, classes, forest)
    zero = F.lit(0)
    cold = met.where(F.col("texts") <= forest.block).select(
        "key", "tree", "path", zero.alias("low"), zero.alias("high"), zero.alias("side")
    )
    members = stored(cold.union(_dealt(hot, balls, forest)), "join-members")
    wanted = members.select("key").distinct().join(prefixes, "key")
    wanted = wanted.select("key", "class_id", F.col("short").alias("paths"), "copies")
    wanted = wanted.join(balls.select("key", "ball"), "key", "left")
    tasks = (
        members.join(_sets(docs, doc_id, text, wanted, forest), "key")
        .repartition(*_TASK)
        .sortWithinPartitions(*_TASK)
        .select(*_TASK, "key", "class_id", "side", "grams", "paths", "copies", "ball")
    )
    inside = balls.select(
        "key",
        "class_id",
        F.col("ball").alias("root"),
        F.col("ball_id").alias("root_id"),
        (F.col("size") - 1).alias("links"),
        (F.col("all") - F.col("copies")).alias("copies"),
    )
    links = stored(_verified(tasks, forest).union(inside), "join-links")
    sums = links.groupBy("key").agg(
        F.sum("links").alias("n_links"), F.sum("copies").alias("n_linked_docs")
    )

    # A node sorts by its class_id, null last, so the root of a group has its name.
    def node(class_id: str, key: str) -> Column:
        return F.struct(
            F.col(class_id).isNull().alias("none"),
            F.col(class_id).alias("id"),
            F.col(key).alias("key"),
        )

    edges = links.select(node("class_id", "key").alias("a"), node("root_id", "root").alias("b"))
    groups = components(edges).select(F.col("node.key").alias("key"), "root")
    named = classes.select("key", "class_id", "copies").join(sums, "key", "left")
    named = stored(named.join(groups, "key", "left"), "join-named")
    return signed, named


def similarity_join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", forest: Forest = Forest()
) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, n_copies, n_links, n_linked_docs, group_id.

    A class holds the texts of equal words (A-Z in lower case, white space aside); its id is
    its least doc_id. `n_copies` counts the rows of the class, `n_links` the classes of
    Jaccard similarity of at least the threshold, `n_linked_docs` their rows. A group joins
    classes by links; its id is its least class_id. Null and empty texts have no n-grams:
    they are one class without links. A null id keeps its row and a class of null ids only
    has a null id. Texts of fewer than n words are one n-gram. Repeated rows are copies of
    each other. An empty table gives an empty table; other columns are not read.
    """
    signed, named = _classes(docs, doc_id, text, forest)
    group = F.when(F.col("root").isNull(), F.col("class_id")).otherwise(F.col("root.id"))
    named = named.select(
        "key",
        "class_id",
        F.col("copies").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_linked_docs", F.lit(0)).alias("n_linked_docs"),
        group.alias("group_id"),
    )
    return signed.select("doc_id", "key").join(named, "key").select("doc_id", *RESULT)


def _text_key(text: Column) -> Column:
    """The key of a text's class: md5 of its words, A-Z in lower case, joined by blanks."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.unhex(F.md5(F.translate(F.trim(words), upper, lower).cast("binary")))


def deduplicated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", forest: Forest = Forest()
) -> DataFrame:
    """One row of each group of near copies: of its texts that of least doc_id, null ids last.

    Rows are told apart by id and text: different texts of one id are in groups of their own,
    as are texts without an id, whose group is named by its texts. Of several texts of the
    kept id the one of least class key stays, and of rows that repeat it the one of least
    hash. Empty texts are not near copies of anything and stay. Other columns stay as they
    are, whatever their names.
    """
    _, named = _classes(docs, doc_id, text, forest)
    kept = named.where("root IS NULL OR root.key = key").select(
        F.col("key").alias("_key"), F.col("class_id").alias("_kept")
    )
    # The row travels whole and once, so its columns can have any names.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"))
    said, name = F.col("_row").getField(text), F.col("_row").getField(doc_id)
    blank = F.length(F.regexp_replace(F.coalesce(said, F.lit("")), r"[\x20\x09-\x0D]", "")) == 0
    keyed = rows.where(~blank).withColumn("_key", _text_key(said))
    # Ids differ by row of a class, texts by case and white space only.
    first = W.partitionBy("_key").orderBy(F.xxhash64(said), said)
    kept = kept.withColumnRenamed("_key", "_kept_key")
    same = (F.col("_key") == F.col("_kept_key")) & name.eqNullSafe(F.col("_kept"))
    once = (
        keyed.join(kept, same, "left_semi")
        .withColumn("_nth", F.row_number().over(first))
        .where("_nth = 1")
    )
    return once.select("_row.*").unionByName(rows.where(blank).select("_row.*"))
