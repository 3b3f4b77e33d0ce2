"""Joins, searches, mixing and the pipeline, against plain code over the same rows."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import decontaminate, jaccard, lines, mixing, quality, sharding
from skein.llm import shingles as hashing
from skein.llm.common import components, stage
from skein.llm.shingles import words_of


def shingles(text, n):
    w = words_of(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain_components(sets, percent):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    roots = plain_components(sets, percent)
    lead = defaultdict(list)
    for (i, _), r in zip(rows, roots, strict=True):
        lead[r].append(i)
    want = Counter((i, len(s), min((x for x in lead[r] if x is not None), default=None) if s else i) for (i, _), s, r in zip(rows, sets, roots, strict=True))
    linked = jaccard.link(jaccard.keyed(docs.select("doc_id", "text")), n, percent)
    ids = {r["component"]: r["m"] for r in linked.groupBy("component").agg(F.min("doc_id").alias("m")).collect()}
    assert Counter((r["doc_id"], r["n_shingles"], ids[r["component"]] if r["component"] is not None else r["doc_id"]) for r in linked.collect()) == want


def test_keep_one(docs, rows, empty):
    sets = [shingles(t, 5) for _, t in rows]
    roots = plain_components(sets, 80)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r for r, s in zip(roots, sets, strict=True) if s}) + sum(not s for s in sets)
    assert jaccard.keep_one(empty).count() == 0


def test_signatures_lose_no_pair():
    import random

    import numpy as np

    rng, sign = random.Random(3), jaccard.Signer(85)
    draw = lambda k: [rng.getrandbits(64) for _ in range(k)]
    for size in [*range(1, 40), 97, 150, 480]:
        for _ in range(20):
            a = draw(size)
            b = a[: size - rng.randint(0, max(1, size // 8))] + draw(rng.randint(0, size // 10))
            both = len(set(a) & set(b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                s, t = (set(sign(np.unique(np.array(x, dtype=np.uint64)))) for x in (a, b))
                assert s & t


@pytest.mark.parametrize("change", [{"BLOCK_TEXTS": 5}, {"FACTS_BYTES": 0}, {"SHORT": 2}])
def test_jaccard_in_blocks(docs, rows, monkeypatch, change):
    for k, v in change.items():
        monkeypatch.setattr(jaccard, k, v)
    sets = [shingles(t, 5) for _, t in rows]
    roots = plain_components(sets, 80)
    assert jaccard.keep_one(docs).count() == len({r for r, s in zip(roots, sets, strict=True) if s}) + sum(not s for s in sets)


def test_signatures_are_subsets_of_parts():
    import numpy as np

    for size in (1, 4, 7, 30, 200, 1000):
        s = np.unique(np.random.default_rng(size).integers(0, 1 << 64, size, dtype=np.uint64))
        levels = jaccard.bands(85, size)[1]
        made = len(jaccard.Signer(85)(s))
        assert made <= sum(n * jaccard.PARTS or 1 for _, _, n in levels) and made >= sum((n - e) * jaccard.PARTS for _, e, n in levels)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 80), (7, 7), (200, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {80: 80, 90: 80, 100: 80, 200: 80}


def test_components_are_whole_or_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(path, 2)
    assert components(path.limit(0)).count() == 0


def plain_lines(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = [], Counter()
    for k in order:
        gone = []
        for no, line in enumerate((rows[k][1] or "").split("\n")):
            w = set(words_of(line))
            if w:
                if any(100 * len(w & s) >= 80 * len(w | s) for s in seen):
                    gone.append(no)
                seen.append(w)
        out[rows[k][0], ",".join(map(str, gone))] += 1
    return out


@pytest.mark.parametrize("change", [{}, {"NEAREST": 1, "BLOCK_ROWS": 3, "CELL_BITS": 7, "BATCH_ROWS": 7, "CHARS": 50}])
def test_lines(docs, rows, empty, monkeypatch, change):
    for k, v in change.items():
        monkeypatch.setattr(lines, k, v)
    got = lines.report(docs).collect()
    assert sum(r["n_removed"] for r in got) == sum(len(x.split(",")) * n for (_, x), n in plain_lines(rows).items() if x)
    unique = {i for i, n in Counter(i for i, _ in rows).items() if n == 1 and i is not None}  # rows that repeat are in any order
    assert {(r["doc_id"], r["removed_lines"]) for r in got if r["doc_id"] in unique} == {(i, x) for i, x in plain_lines(rows) if i in unique}
    assert lines.report(empty).count() == 0


def test_word_hashes(monkeypatch):
    texts = ["", "a b  a\n\tAB ab", "x" * 1000 + " " + "y" * 70, "\n\n", "x" * 1000 + "\x0bé É ab", "ba ab"]
    words = [(w, n) for n, line in enumerate("\n".join(texts).split("\n")) for w in words_of(line)]
    seen = []
    for block in (7, 64, 1 << 17):
        monkeypatch.setattr(hashing, "_BLOCK", block)
        h, line = lines.hashes(texts)
        assert line.tolist() == [n for _, n in words] and len({*zip((w for w, _ in words), h.tolist())}) == len(set(h.tolist())) == len({w for w, _ in words})
        seen.append(h.tolist())
    assert seen[0] == seen[1] == seen[2] and len(lines.hashes([""])[0]) == 0


def test_clean_lines(spark):
    d = spark.createDataFrame([(1, "a b c d e\nx y z"), (2, "q\na b c d e\n\nw"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.clean(d).collect()} == {1: "a b c d e\nx y z", 2: "q\n\nw", 3: None}


@pytest.fixture
def benchmark(spark, rows):
    words = [t.split() for i, t in rows if t and len(t.split()) > 60]
    items = [(i, " ".join(w[5 : 5 + k])) for i, (w, k) in enumerate(zip(words, [8, 20, 40, 55, 9, 30] * 20, strict=False))]
    return spark.createDataFrame([*items, (900, None), (901, ""), (902, "two words"), (0, items[0][1])], "item_id long, text string")


@pytest.mark.parametrize("size", [decontaminate.ITEMS, 10])
@pytest.mark.parametrize("piece", [decontaminate.PIECE, 1])
def test_decontamination(docs, rows, benchmark, monkeypatch, size, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (size,))
    sets = [(i, shingles(t, 5)) for i, t in rows]
    want = Counter()
    for b in benchmark.collect():
        s = shingles(b["text"], 5)
        want.update((i, b["item_id"], len(s), len(s & d)) for i, d in sets if s and 100 * len(s & d) >= 80 * len(s))
    assert Counter(map(tuple, decontaminate.find(docs, benchmark).collect())) == want
    clean = decontaminate.keep_clean(docs, benchmark)
    dirty = {i for i, *_ in want}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} - {None} == {i for i, _ in rows} - dirty - {None}
    assert decontaminate.find(docs, benchmark.limit(0)).count() == 0 and decontaminate.keep_clean(docs, benchmark.limit(0)).count() == len(rows)


def test_mixing(docs, empty):
    weights = {"src0": 3, "src1": 1, "src2": 2}
    got = mixing.order(docs, weights, 2).collect()
    assert sorted(r["position"] for r in got) == list(range(docs.count()))
    blocks = sorted({(r["slot"], r["source"], r["block"], r["phase"], r["release"], r["deadline"]) for r in got}, key=lambda x: x[0])
    assert [b[0] for b in blocks] == list(range(len(blocks)))
    assert all(b[4] <= b[0] < b[5] for b in blocks)
    assert mixing.order(empty, weights).count() == 0
    with pytest.raises(ValueError):
        mixing.order(docs, {"src0": 0})
    assert Counter(r["doc_id"] for r in mixing.mix(docs, weights).collect()) == Counter(r["doc_id"] for r in docs.collect())


def test_many_sources(spark):
    rows = spark.range(1200).selectExpr("id AS doc_id", "concat('s', id % 300) AS source")
    got = mixing.order(rows, {"s1": 300, "s2": 100, "s7": 900}, 2).collect()
    assert sorted(r["position"] for r in got) == list(range(1200))
    pool = [r for r in got if r["source"] not in ("s1", "s2", "s7")]
    assert len({r["block"] for r in pool}) == 594 and all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    assert all(r["position"] < 16 for r in got if r["source"] == "s7" and r["block"] == 0)


@pytest.mark.parametrize("weights", [{"a": 1, "b": 2, "c": 4}, {"a": 7, "b": 11, "c": 13, "d": 1}, {"a": 1}])
def test_deviation_below_one_block(weights):
    slots, total = mixing.period(weights), sum(weights.values())
    for s, w in weights.items():
        assert len(slots[s]) == w
        for t in range(total + 1):
            assert abs(mixing.deviation(t, sum(x < t for x in slots[s]), w, total)) < 1


def test_shards_keep_the_mixed_order(spark, docs):
    import corpus_pipeline as cp

    source = F.concat(F.lit("src"), (F.col("id") / 2000).cast("int"))
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), source.alias("source"))
    position = {r["doc_id"]: r["position"] for r in mixing.order(rows, mixing.WEIGHTS).collect()}
    mixed = stage(cp.mixed_sources(spark, rows, ""), "mixed")
    got = cp.shards(spark, mixed, "").collect()
    assert {(r["doc_id"], r["shard"]) for r in got} == {(r["doc_id"], r["shard"]) for r in sharding.shard(rows).collect()}
    by_shard = {}
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        by_shard.setdefault(r["shard"], []).append(r)
    for held in by_shard.values():
        assert [r["slot"] for r in held] == list(range(len(held)))
        assert [position[r["doc_id"]] for r in held] == sorted(position[r["doc_id"]] for r in held)
    first = Counter(r["doc_id"] // 2000 for r in got if r["slot"] < 60)
    assert all(abs(first[i] / first.total() - (1 + i) / 10) < 0.04 for i in range(4))
    assert all(r["text"] == "t" and r["source"] == f"src{r['doc_id'] // 2000}" for r in got)
    assert cp.shards(spark, docs, "").count() == docs.count()
    assert {r["doc_id"]: r["slot"] for r in got} != {r["doc_id"]: r["slot"] for r in cp.shards(spark, rows, "").collect()}  # without mixing


def test_pipeline(spark, tmp_path, docs, benchmark):
    import corpus_pipeline as cp

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*names).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(cp.STAGES) in (4, 5)
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = quality.keep_good(d)
    sets = {(r["doc_id"], r["text"]): shingles(r["text"], 5) for r in good.collect()}
    keys = sorted(sets, key=lambda k: (k[0] is None, k[0] or 0))
    roots = plain_components([sets[k] for k in keys], 80)
    lead = {}
    for k, r in zip(keys, roots, strict=True):
        lead.setdefault(r, k)
    items = [shingles(b["text"], 5) for b in benchmark.collect()]
    want = {k[0] for k in lead.values() if not any(s and 100 * len(s & sets[k]) >= 80 * len(s) for s in items)}
    got = cp.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)
    n = Counter(r["shard"] for r in got)
    assert max(n.values()) - min(n[s] for s in range(sharding.SHARDS)) <= 1
