from __future__ import annotations

import collections
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from conftest import SF_DIR
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from airsift.llm import jaccard, katz, mixing, packing, quality, queries, shards, tokens, toxicity
from airsift.llm.common import crc32_of_id, hashed_words, pack, unpack

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

PROSE = (
    "the quick brown fox jumps over a lazy dog while seven wise owls watch from an old oak tree "
    "and nobody in the quiet valley below hears how the evening wind carries distant bells "
    "across fields where farmers gather golden wheat before autumn rain turns every narrow path "
    "to mud and keeps travellers beside warm fires telling stories of ships and far islands"
)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns of clashing names."""
    long = " ".join(f"{w}{i}" for i in range(400) for w in PROSE.split()[:30])
    rows = [
        (1, PROSE, "en", "b", 1),
        (2, PROSE, "en", None, 2),
        (2, PROSE, "en", None, 2),
        (3, None, None, "a", None),
        (4, "", "en", "a", 0),
        (None, "only one line", "en", "c", 3),
        (5, long, "en", "c", 4),
        (6, PROSE.replace("seven", "eleven"), "de", "b", 5),
        (7, "a\n\n a  b\t'll  <|endoftext|> 中文 été\n", "fr", "b", 6),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    extra = {c: "x" for c in ("_key", "_nth", "_row", "_n", "score", "size", "kept", "target", "word", "block", "path", "rule")}
    return docs.selectExpr("*", *[f"'{v}' AS {k}" for k, v in extra.items()])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def ids_of(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_packed_arrays():
    for values in ([], [0], [1, 255, 256], [1 << 63, 3], [-4, 7]):
        a = np.array(values, np.int64 if min(values, default=0) < 0 else np.uint64)
        assert unpack(pack(a)).tolist() == values
    floats = np.array([0.5, -1e300, 0.0])
    assert unpack(pack(floats)).tolist() == floats.tolist()


def test_encoder_equals_the_library():
    encoder = tokens.Encoder(tokens.default_tokenizer())
    odd = ["", " ", "a  b", "\n x", "x \n y", "don't 'll", "<|endoftext|> z", "中文 é b ", "w" * 500, "a b" * 90]
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(odd * 2)]
    assert got == [ids_of(x).tolist() for x in odd * 2]


def test_pieces_of_common_and_other_characters():
    encoder = tokens.Encoder(tokens.default_tokenizer())
    signs = "aZé_'.,“”—0½²\t\r\n\x1c\x85\xa0 жα中😀ªµ"
    rng = np.random.default_rng(1)
    said = ["".join(rng.choice([*signs, *"  'stre"], n)) for n in rng.integers(0, 30, 3000)]
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(said)]
    assert got == [ids_of(x).tolist() for x in said]


def test_a_word_is_learned_once_whatever_follows_it(monkeypatch):
    encoder = tokens.Encoder(tokens.default_tokenizer())
    words = [f"{a}{b}ing" for a in ("wor", "sta", "lea") for b in ("k", "rn", "nd")]
    said = [f"x {' '.join(w + end for w in words)}\n{words[0]}" for end in ("", ",", ".", "!!", "'s")]
    expected = [ids_of(x).tolist() for x in said]
    encoder.encode([said[0] + " x'sx , . !! ,\n."])
    asked = []
    learn = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: (asked.extend(texts), learn(texts))[1])
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(said)]
    assert got == expected and not any("work" in x for x in asked)


def test_pieces_in_use_outlive_a_generation(monkeypatch):
    monkeypatch.setattr(tokens, "_GENERATION", 20)
    encoder = tokens.Encoder(tokens.default_tokenizer())
    for i in range(9):
        said = [" ".join(f"word{k}" for k in range(i * 7, i * 7 + 12)) + " always"]
        got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(said)]
        assert got == [ids_of(x).tolist() for x in said]
        assert len(encoder.cache) + len(encoder.cache.older) < 80


def test_pipeline_sends_no_text_twice(spark, odd_docs):
    carried = corpus_pipeline._carried(odd_docs.withColumn("Extra.", F.lit(1)))
    assert carried.columns == ["doc_id", "text", "source", "_row"]
    others = [c for c in odd_docs.columns if c not in ("doc_id", "text", "source")]
    assert carried.schema["_row"].dataType.names == ["_", *others, "Extra."]


def test_pipeline_holds_small_batches_and_few_pieces(spark, odd_docs, monkeypatch, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        import pyarrow as pa

        yield from (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)

    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(key, 10_000)
            stage(spark, odd_docs, SF_DIR)
            found = spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n bigint").collect()
            assert sum(r.n for r in found) == 3000 and max(r.n for r in found) <= 256, name
        spark.conf.set(key, 100)
        corpus_pipeline.quality(spark, odd_docs, SF_DIR)
        assert spark.conf.get(key) == "100"
        spark.conf.set(key, 7000)
        monkeypatch.setattr(corpus_pipeline, "STAGES", [("quality_rules", corpus_pipeline.quality)])
        corpus_pipeline.run(spark, SF_DIR)
        assert spark.conf.get(key) == "7000"
    finally:
        spark.conf.set(key, before)
    given = {}
    monkeypatch.setattr(corpus_pipeline, "pack", lambda docs, **options: given.update(options))
    corpus_pipeline.packing(spark, odd_docs, SF_DIR)
    assert given["cached_pieces"] <= 200_000
    encoder = tokens.Encoder(tokens.default_tokenizer(), pieces=20)
    for i in range(9):
        said = [" ".join(f"word{k}" for k in range(i * 7, i * 7 + 12)) + " always"]
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(said)] == [ids_of(said[0]).tolist()]
        assert len(encoder.cache) + len(encoder.cache.older) < 80


def test_shards_round_trip_and_lookup(spark, odd_docs, no_docs, tmp_path):
    folder = str(tmp_path / "s")
    shards.write_shards(odd_docs, folder, shard_bytes=4000, segment_ids=700)
    rows = shards.read_documents(spark, folder).orderBy("start").collect()
    texts = sorted(
        ((r.doc_id is not None, r.doc_id or 0, r.text or "", r.doc_id) for r in odd_docs.collect())
    )
    start = 0
    assert len(rows) == len(texts)
    for row, (_, _, text, key) in zip(rows, texts, strict=True):
        ids = ids_of(text)
        assert (row.doc_id, row.start, row.n_tokens) == (key, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(ids.tobytes())
        start += len(ids)
    keys = spark.createDataFrame([(2,), (7,), (99,), (None,)], "doc_id bigint")
    found = {r.key: list(r.ids) for r in shards.lookup(spark, folder, keys).collect()}
    wanted = {r.doc_id: ids_of(r.text).tolist() for r in odd_docs.collect() if r.doc_id in (2, 7)}
    assert found == wanted
    shards.write_shards(no_docs, str(tmp_path / "e"))
    assert shards.read_documents(spark, str(tmp_path / "e")).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    found = shards.PerfectHash.build(keys)
    assert sorted(found.slots(keys).tolist()) == list(range(len(keys)))


def test_packing_places_every_id_once(odd_docs, no_docs):
    rows = packing.pack(odd_docs, sequence=64, window_sequences=4, grain=8).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    texts = collections.defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(ids_of(r.text))
    total = sum(len(x) for v in texts.values() for x in v)
    for key, found in by_doc.items():
        ids = texts[key][0]
        assert sum(r.length for r in found) == len(ids) * len(texts[key])
        for r in found:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            assert r.doc_tokens == len(ids)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for number, found in sequences.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == 64 or number == total // 64
    assert packing.pack(no_docs).count() == 0


def test_deficits_follow_the_round_robin():
    totals, window, grain = [5000, 900, 37], 256, 16
    gains = packing.quanta(totals, [float(t) for t in totals], window)
    schedule = packing.Schedule(totals, gains, grain)
    deficit, served, r = [0] * 3, [0] * 3, 0
    while served != totals:
        for q in range(3):
            deficit[q] += gains[q]
            turn = min(totals[q] - served[q], deficit[q] // grain * grain)
            if deficit[q] >= totals[q] - served[q]:
                turn = totals[q] - served[q]
            served[q] += turn
            deficit[q] -= turn
        r += 1
        assert schedule.served(np.array([r]))[0].tolist() == served


def test_windows_hold_the_target_mixture(spark):
    # Sources of very unequal size; a third of all rows is one source.
    rows = [(i, PROSE, {0: "a", 1: "b", 2: "b"}.get(i % 6, "c" if i % 6 < 5 else None)) for i in range(360)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    n = {s: sum(len(ids_of(PROSE)) for r in rows if r[2] == s) for s in ("a", "b", "c", None)}
    rest = n["b"] + n["c"] + n[None]
    window = 16 * 64
    for shares, want in (
        ({"a": 0.5}, {"a": 0.5, "b": 0.5 * n["b"] / rest, "c": 0.5 * n["c"] / rest, None: 0.5 * n[None] / rest}),
        ({"a": 0.1, "b": 0.6}, {"a": 0.1, "b": 0.6, "c": 0.3 * n["c"] / (n["c"] + n[None]), None: 0.3 * n[None] / (n["c"] + n[None])}),
        ({"a": 2.0, "b": 1.0, "c": 4.0, None: 1.0, "absent": 9.0}, {"a": 0.25, "b": 0.125, "c": 0.5, None: 0.125}),
        (None, {s: x / sum(n.values()) for s, x in n.items()}),
    ):
        found = packing.pack(docs, sequence=64, window_sequences=16, grain=8, shares=shares).collect()
        held = collections.defaultdict(collections.Counter)
        for r in found:
            held[r.sequence_id // 16][r.source] += r.length
        whole = min(int(n[s] / (window * x)) for s, x in want.items())  # until the first queue ends
        assert whole >= 4
        for w in range(whole - 1):
            for s, x in want.items():
                # A grain of the deficit carried in, one carried out, and rounding.
                assert abs(held[w][s] - window * x) <= 2 * 8 + whole, (shares, w, s)
        assert sum(r.length for r in found) == sum(n.values())
    for bad in ({"a": -0.1}, {"a": float("nan")}, {"a": 1.0}, dict.fromkeys(["a", "b", "c", None], 0.0)):
        with pytest.raises(ValueError):
            packing.pack(docs, shares=bad)
    assert packing.pack(docs.limit(0), shares={"a": 1.0}).count() == 0


def test_quality_measures_and_bands(odd_docs, no_docs):
    def brute(text):
        words = (text or "").encode().split()
        grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {
            i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)
        }
        seen, lines = set(), 0
        for line in (text or "").split("\n"):
            if line.encode().split():
                lines += line in seen
                seen.add(line)
        chars = sum(len(w.decode()) for w in words)
        return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), lines, len(covered)

    for row in quality.quality_rules(odd_docs).collect():
        want = brute(row.text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        data = (row.text or "").encode()
        assert row.base_failed == (want[0] < 50 or 2 * want[4] > want[0])
        if data:
            assert row.ratio == len(zstandard.ZstdCompressor(level=3).compress(data)) / len(data)
        if row.doc_id == 1:
            assert row.kept
    assert quality.measure("a b c a b c\nx\nx")[3:] == brute("a b c a b c\nx\nx")[3:]
    bands = quality.Bands()
    judge = lambda t: quality.compression(t, bands, zstandard.ZstdCompressor(level=3))[3]
    assert judge(b"again and again " * 400) == "repetitive"
    assert judge(np.random.default_rng(0).bytes(9000)) == "incompressible"
    assert judge(b"") == ""
    assert quality.quality_rules(no_docs).count() == 0


def test_mixing_reaches_targets(spark, odd_docs, no_docs):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id",
        "repeat('w ', int(id % 37) + 1) AS text",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN 'tiny' WHEN id % 7 = 2 THEN NULL "
        "ELSE concat('s', id % 4) END AS source",
    )
    rows = mixing.mix_sources(docs).collect()
    sources = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r.taken <= 3 * r.size and r.taken % r.size == 0
        entry = sources[r.source]
        entry[0] += r.size
        entry[1] += r.taken
        entry[2] = r.target
    for size, taken, target in sources.values():
        assert target <= 3 * size and abs(taken - target) <= 37
    assert math.isclose(sum(t for _, _, t in sources.values()), sum(s for s, _, _ in sources.values()))
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    odd = mixing.mix_sources(odd_docs)
    assert odd.count() == odd_docs.count() and odd.where("text IS NULL").first().size == 0
    assert mixing.mixed_rows(odd).count() == odd.agg(F.sum("copies")).first()[0]
    assert mixing.mix_sources(no_docs).count() == 0


def test_mixing_divides_repeated_rows_and_ids(spark):
    rows = [(None, f"{'word ' * 9}{i}", "nulls") for i in range(700)]
    rows += [(5, "copy " * 10, "copies")] * 500 + [(6, "copy " * 10, "copies")] * 3
    rows += [(7, f"{'w ' * 4}{i}", "one id") for i in range(300)] + [(8, "", "copies"), (9, None, None)]
    rows += [(1000 + i, "word " * 10, None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    docs = docs.selectExpr("*", "'x' AS place", "'y' AS row", "source AS turn", "1 AS edge_rows")
    mixed = mixing.mix_sources(docs.repartition(9))
    assert mixed.columns == [*docs.columns, "size", "source_size", "target", "copies", "taken"]
    found = mixed.collect()
    assert len(found) == len(rows) and {(r.place, r.row, r.edge_rows) for r in found} == {("x", "y", 1)}
    for name in ("nulls", "copies", "one id", None):
        own = [r for r in found if r.source == name]
        largest = max(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= largest / 2 + 1, name
        assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in own)
        assert max(r.copies for r in own if r.size) - min(r.copies for r in own if r.size) <= 1
    again = collections.Counter((r.doc_id, r.text, r.source, r.taken) for r in mixing.mix_sources(docs).collect())
    assert again == collections.Counter((r.doc_id, r.text, r.source, r.taken) for r in found)


def test_op8_equals_its_sql_on_repeated_rows(spark, tmp_path):
    import duckdb

    rows = [(i % 40 if i % 3 else None, f"{'w ' * (i % 11)}{i % 90}", ["a", "a", "b", None][i % 4], "en", i) for i in range(900)]
    rows += [(3, "same words here", "a", "en", 0)] * 300 + [(4, None, "b", "en", 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = connection.execute(queries.oracle_sql()["op8_source_mix"])
    names = [d[0] for d in cursor.description]
    got = queries.op8_source_mix(spark, str(tmp_path))
    assert got.columns == names
    shown = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert collections.Counter(map(shown, got.collect())) == collections.Counter(map(shown, cursor.fetchall()))


def brute_join(rows, threshold=0.8):
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.setdefault(b" ".join(w), set(zip(*[w[i:] for i in range(min(5, len(w)))], strict=False)))
    links = collections.Counter()
    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = sets[a] | sets[b]
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(both):
                links[a] += 1
                links[b] += 1
    return links


def test_join_equals_brute_force(spark, odd_docs, no_docs):
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        changed = list(words)
        for k in range(i % 4):
            changed[(7 * i + 20 * k) % 60] = f"x{i}{k}"
        rows.append((i, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    forest = jaccard.Forest(block=4)
    levels = forest.levels()
    assert forest.met(levels) >= forest.recall > forest.met([n + 1 for n in levels])
    for frame in (docs, odd_docs):
        want = brute_join(frame.collect())
        found = jaccard.similarity_join(frame, forest=forest).collect()
        assert len(found) == frame.count()
        texts = {r.doc_id: b" ".join((r.text or "").encode().lower().split()) for r in frame.collect()}
        assert {r.doc_id: r.n_links for r in found} == {k: want[t] for k, t in texts.items()}
    kept = jaccard.deduplicated(odd_docs).collect()
    assert collections.Counter(r.doc_id for r in kept) == {k: 1 for k in (1, 3, 4, 5, 7, None)}
    assert jaccard.similarity_join(no_docs).count() == jaccard.deduplicated(no_docs).count() == 0


def brute_groups(rows, threshold=0.8):
    """Per row: doc_id, copies, links, linked rows and least id of the group, by all pairs."""
    sets, copies, least = {}, collections.Counter(), {}
    for r in rows:
        words = (r.text or "").encode().lower().split()
        key = b" ".join(words)
        k = min(5, len(words))
        sets[key] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
        copies[key] += 1
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    near = {key: [] for key in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            near[a].append(b)
            near[b].append(a)
    group = {}
    for key in sorted(sets, key=least.get):
        open_ = [key] if key not in group else []
        while open_:
            now = open_.pop()
            if now not in group:
                group[now] = least[key]
                open_ += near[now]
    out = collections.Counter()
    for r in rows:
        key = b" ".join((r.text or "").encode().lower().split())
        linked = sum(copies[x] for x in near[key])
        out[r.doc_id, least[key], copies[key], len(near[key]), linked, group[key]] += 1
    return out


def near_copies(name, n, changes, words=200):
    """Texts of one group: each differs from the first in some words of its own."""
    rng = np.random.default_rng(len(name) + n)
    base = [f"{name}{i}" for i in range(words)]
    for i in range(n):
        text = list(base)
        for at in rng.choice(words, changes(i), replace=False):
            text[at] = f"{name}x{i}y{at}"
        yield " ".join(text)


@pytest.mark.parametrize("block", [8, 384])
def test_join_groups_equal_brute_force(spark, block):
    texts = [
        *near_copies("close", 60, lambda i: 1),  # all within a ball
        *near_copies("wide", 40, lambda i: 2 + i % 3),  # some pairs reach the threshold
        *near_copies("far", 20, lambda i: 30),
        *near_copies("two", 2, lambda i: i),
    ]
    texts += texts[:5] + texts[70:75] + ["", "one word", "One  WORD"]
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = jaccard.similarity_join(docs, forest=jaccard.Forest(block=block)).collect()
    got = collections.Counter(
        (r.doc_id, r.class_id, r.n_copies, r.n_links, r.n_linked_docs, r.group_id) for r in found
    )
    assert got == brute_groups(docs.collect())


def test_paths_are_sorted_tries():
    forest = jaccard.Forest()
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 63, 400, np.uint64)) for i in range(3)]
    near = [np.unique(np.r_[s[:-20], s[-20:] + np.uint64(1)]) for s in sets]
    paths = jaccard.signatures(sets + near, forest)
    assert paths.shape == (6, forest.trees) and len(np.unique(paths[:3])) == 3 * forest.trees
    # A prefix that two paths share contains all longer ones they share.
    shifts = [np.uint64(4 * k) for k in range(forest.depth - min(forest.levels()) + 1)]
    shared = [(paths[:3] >> k == paths[3:] >> k).sum() for k in shifts]
    assert shared == sorted(shared) and shared[0] < shared[-1]


def test_join_recall_at_the_threshold():
    """Pairs of similarity just over 0.8 meet in some trie, nearly always."""
    forest = jaccard.Forest()
    rng = np.random.default_rng(5)
    pairs = 2000
    left, right = [], []
    for _ in range(pairs):
        values = rng.integers(0, 1 << 63, 450, np.uint64)
        left.append(np.unique(values[:400]))
        right.append(np.unique(values[45:445]))
    a, b = (jaccard.signatures(x, forest) for x in (left, right))
    shifts = np.array(forest.shifts(), np.uint64)
    met = ((a >> shifts) == (b >> shifts)).any(1)
    assert met.mean() >= 0.999


def test_join_rows_grow_with_a_group(spark):
    """Texts of a ball meet no blocks of their own ball, so tasks get each text a few times."""
    forest = jaccard.Forest(block=16)
    sent = []
    for n in (100, 400):
        hot = [(f"{i:04}".encode(), t, 7, 11) for i in range(n) for t in range(forest.trees)]
        hot = spark.createDataFrame(hot, "key binary, tree int, path bigint, full bigint")
        ball = [(f"{i:04}".encode(), b"0000") for i in range(n - 10)]
        ball = spark.createDataFrame(ball, "key binary, ball binary")
        sent.append(jaccard._dealt(hot, ball, forest).count() / (n * forest.trees))
    assert sent[0] < 4 and sent[1] < 4


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 102), (102, 101), (7, 7)]
    found = jaccard.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in found} == {
        **{i: 0 for i in range(41)},
        **{i: 100 for i in range(100, 104)},
    }


def brute_katz(rows, model):
    words = [(r.doc_id, (r.text or "").encode().lower().split() + [0], r.held) for r in rows]
    one, two, history = collections.Counter(), collections.Counter(), collections.Counter()
    for _, w, held in words:
        if not held:
            one.update(w)
            two.update(zip([1, *w[:-1]], w, strict=True))
            history.update([1, *w[:-1]])
    total = sum(one.values())
    spectrum = lambda c: [sum(v == r for v in c.values()) for r in range(1, model.low + 2)]
    d1, d2 = model.discounts(spectrum(one)), model.discounts(spectrum(two))
    kept = lambda c, d: c - model.high_discount if c > model.low else d[c - 1] * c
    p1 = {w: kept(c, d1) / total for w, c in one.items()}
    unknown = 1 - math.fsum(p1.values())
    seen, mass = collections.Counter(), collections.Counter()
    for (h, w), c in two.items():
        seen[h] += kept(c, d2) / history[h]
        mass[h] += p1[w]

    def score(h, w):
        if two[h, w]:
            return math.log10(kept(two[h, w], d2) / history[h])
        p = p1.get(w, unknown)
        return math.log10(p * (1 - seen[h]) / (1 - mass[h]) if history[h] else p)

    out = []
    for key, w, _ in words:
        out.append((str(key), len(w), round(sum(map(score, [1, *w[:-1]], w)), 6)))
    return sorted(out)


def test_katz_equals_brute_force(spark, odd_docs, no_docs):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    model = katz.Katz(block=20_000, partition=15_000)  # hot words and pairs, many blocks
    held = crc32_of_id() % 10 == 0
    for docs in (given, odd_docs):
        rows = docs.select("doc_id", "text", held.alias("held")).collect()
        found = katz.score_texts(docs, held, model=model).collect()
        ours = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in found)
        assert len(ours) == len(rows)
        for a, b in zip(ours, brute_katz(rows, model), strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5
    assert {r.score for r in katz.score_texts(odd_docs, F.lit(True)).collect()} == {0.0}
    assert katz.score_texts(no_docs, held).count() == 0


def test_word_hashes(spark):
    import pyarrow as pa

    texts = ["The cat  THE\tcat", None, "", " été Été ", "the"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    hashes, counts = hashed_words(batch)
    assert counts.tolist() == [4, 0, 0, 2, 1]
    assert hashes[0] == hashes[2] == hashes[6] and hashes[1] == hashes[3] != hashes[0]
    assert hashes[4] != hashes[5]
    assert hashed_words(batch.slice(3, 1))[0].tolist() == hashes[4:6].tolist()


def test_toxicity_learns_and_is_exact(spark, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, 40))
        if i % 4 == 0:
            words[5:7] = rng.choice(["grubword", "snarlword", "fumeword"], 2)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, known)
    held = [r for r in toxicity.score_toxicity(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    wrong = sum(r.predicted != (r.doc_id % 4 == 0) for r in held)
    assert len(held) > 50 and wrong <= 0.05 * len(held)
    index = model.index
    for _, text in rows[:60]:
        term, weight = index.query(text)
        cosine = np.zeros(len(index.toxic))
        for t, w in zip(term, weight, strict=True):
            for e in range(index.entry_begin[t], index.entry_begin[t + 1]):
                part = slice(index.post_begin[e], index.post_begin[e + 1])
                cosine[index.post_example[part]] += w * index.post_weight[part]
        at, similarity = index.nearest(term, weight, 10)
        best = np.sort(cosine[cosine > 0])[::-1][:10]
        assert np.allclose(similarity, best)
    scored = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 for r in scored)
    # Two plain classes of a dozen examples each, and one of one.
    plain = [(i, f"{'snarl' if i % 2 else 'calm'}word {'grub' if i % 2 else 'soft'}thing word{i}") for i in range(40)]
    tiny = spark.createDataFrame(plain, docs.schema)
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(32)], known.schema)
    told = {r.doc_id: r.predicted for r in toxicity.score_toxicity(tiny, toxicity.fit(tiny, marks)).collect()}
    assert told == {i: i % 2 for i in range(40)}
    one = toxicity.fit(tiny, marks.where("doc_id < 4"))
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(tiny, one).collect())
    # An id with many texts is one example.
    many = [(8, f"snarlword {i}") for i in range(50)]
    again = toxicity.fit(docs.unionByName(spark.createDataFrame(many, docs.schema)), known)
    assert len(again.index.ids) == len(set(again.index.ids.tolist())) == len(index.ids)
    bare = toxicity.fit(docs, known.limit(0))
    assert {r.score for r in toxicity.score_toxicity(odd_docs, bare).collect()} == {0.0}
    assert toxicity.score_toxicity(no_docs, model).count() == 0


def test_pipeline_keeps_columns(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
            if name != "packing":
                assert docs.columns == names, name
        docs.collect()


def test_literals_of_added_tokens_follow_the_library(spark, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = lambda t: [*library.encode(t, add_special_tokens=False).ids, 0]
    said = ["a <|endoftext|> b", "x<|endoftext|>  y z", "<|endoftext|>", "no literal here", "<|endoftext|", ""]
    encoder = tokens.Encoder(tokens.default_tokenizer(), added_tokens=True)
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(said * 2)]
    assert got == [wanted(x) for x in said * 2] and got[0] == [64, 220, 50256, 275, 0]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(said)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sums = {i: zlib.crc32(np.array(wanted(t), "<u4").tobytes()) for i, t in enumerate(said)}
    shards_found = queries.op6_token_shards(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids_crc32 for r in shards_found} == sums
    for packed in (queries.op3_packing(spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, "")):
        assert {r.doc_id: r.ids_crc32 for r in packed.collect()} == sums


def test_quality_judges_every_byte():
    import base64

    rng = np.random.default_rng(3)
    words = sorted({*PROSE.split()})
    prose = " ".join(rng.choice([f"{a}{b}" for a in words for b in ("", "s", "ed", "ing")], 3000)).encode()
    noise = bytes(rng.integers(33, 127, 9000, np.uint8))
    coded = base64.b64encode(rng.bytes(9000))
    again = b"again " * 1500
    judge = lambda *parts: quality.compression(b"".join(parts), quality.Bands(), zstandard.ZstdCompressor(level=3))
    for size in (100, 511, 512, 700, 1500, 2047, 2048, 2049, 4095, 6000, 9000):
        ratio, chunks, odd, reason = judge(prose[:size])
        assert (odd, reason) == (0, ""), size
        assert chunks == (-(-size // 2048) if size >= 2048 else -(-size // 512) if size >= 512 else 0)
    for head, tail in ((2048, 2047), (4096, 4000), (8192, 8192), (700, 700), (400, 400)):
        for junk in (noise, coded):
            assert judge(prose[:head], junk[:tail])[3], (head, tail)
    assert judge(prose[:4096], again[:2047])[3] and judge(prose[:700], again[:700])[3]
    # A chunk that ends the text counts with the bytes it adds only.
    assert judge(prose[:8192], noise[:1])[3] == ""
    assert judge(prose[:6144], noise[:2000])[2:] == (1, "")


def test_deduplication_tells_texts_of_one_id_apart(spark):
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    near = lambda name: text(name, 59) + " changed"
    rows = [
        *[(7, text(f"hot{k}x")) for k in range(12)],  # one id, unrelated texts
        (1, text("a")),
        (2, near("a")),  # a near copy, and another text of its id
        (2, text("b")),
        (None, text("c")),
        (None, text("c").upper()),
        (None, near("c")),
        (None, text("d")),
        (None, text("a")),  # copies of texts with an id
        (9, text("hot3x")),
        (1, text("a")),
        (1, "  " + text("a")),
        (4, ""),
        (4, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = jaccard.deduplicated(docs).collect()
    first = lambda r: (r.text or "").lower().split()[:1]
    got = collections.Counter((r.doc_id, *first(r)) for r in found)
    want = {(7, f"hot{k}x0"): 1 for k in range(12)}
    want |= {(1, "a0"): 1, (2, "b0"): 1, (None, "c0"): 1, (None, "d0"): 1, (4,): 2}
    assert got == want
    names = ("_key", "_nth", "_row", "_id", "_kept", "_kept_key", "key", "root", "group", "paths")
    wide = docs.selectExpr("*", *[f"'{n}' AS {n}" for n in names])
    again = jaccard.deduplicated(wide)
    assert again.columns == wide.columns
    assert collections.Counter((r.doc_id, *first(r)) for r in again.collect()) == want
    assert {tuple(r[n] for n in names) for r in again.collect()} == {names}
    # Mixing takes the texts of an id one by one.
    flat = spark.createDataFrame(
        [(None, text(f"m{i}x", 10), "s" if i % 4 else "t") for i in range(400)],
        "doc_id bigint, text string, source string",
    )
    mixed = mixing.mix_sources(flat).collect()
    for name in "st":
        found = [r for r in mixed if r.source == name]
        assert abs(sum(r.taken for r in found) - found[0].target) <= 10
