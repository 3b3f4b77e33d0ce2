"""Operators on single documents, against plain code over the same rows."""

import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skein.llm import licenses, lm, pii, quality, sharding, warc

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


def test_licenses(docs, rows, empty):
    want = []
    for i, text in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in at]
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    got = licenses.find(docs)
    same(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect(), want)
    tagged = got.where("labels like '%bsd-3-clause%'").first()
    assert tagged["labels"] == "apache,bsd-3-clause,gpl,mit" and tagged["permissive"] and 0.9 < tagged["score"] <= 1
    assert licenses.find(empty).count() == 0


@pytest.mark.parametrize(("text", "labels", "free"), [("MIT", {"mit"}, True), ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", {"gpl", "mit"}, True), ("MIT AND (LGPL-2.1 OR GPL-3.0+)", {"mit", "lgpl", "gpl"}, False), ("a OR MIT AND b", {"a", "mit", "b"}, False)])
def test_expressions(text, labels, free):
    assert licenses.evaluate(licenses.expression_after(text, 0)) == (labels, free)


@pytest.mark.parametrize("text", ["", "MIT OR", "(MIT", "MIT)", "OR MIT", "MIT Apache", "()"])
def test_broken_expressions(text):
    with pytest.raises(ValueError):
        licenses.postfix(text.replace("(", "( ").replace(")", " )").split())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append((kind, *m.span()))
    return out


def test_pii(docs, rows, empty):
    want = Counter()
    for i, text in rows:
        said = pii.written(plain_spans(text or ""))
        want[i, hashlib.sha256(said.encode()).hexdigest()] += 1
    got = pii.scan(docs).collect()
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    assert all(r["n_email"] == r["spans"].count("email:") for r in got)
    assert pii.scan(empty).count() == 0


@pytest.mark.parametrize("text", ["a@b.c@d.e.f", "x..@a.b, @a.b a@b a@b.", "1.2.3.4.5.6.7.8 256.1.1.1.1 0001.2.3.4", "4845-1681 1440 7329 1 4845168114407329", "++1 23 456 789 +12-3456789-", "é@é.com é1.2.3.4", "9" * 5000 + ".1.1.1 1." + "0" * 5000 + "7.1.1"])
def test_pii_edges(text):
    try:
        want = plain_spans(text)
    except ValueError:  # plain int() refuses very long numbers
        want = [s for s in pii.base_spans(text)]
        assert want
    assert pii.base_spans(text) == want


def test_pii_discovers_by_context(spark):
    seeds = [(i, f"write to box at u{i}@x.example.org please now") for i in range(8)]
    found = pii.scan(spark.createDataFrame([*seeds, (20, "write to box at handle-77x please now"), (21, "nothing near code-778 here")], "doc_id long, text string"))
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert spans[20] == "other:16:26" and spans[21] == ""


def test_pii_finds_planted_identifiers(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], set()
    for i in range(300):
        rows.append((i, f"{prose(8)} É reach me at {word()}{i}@mail.example.org any time {prose(8)}" if i % 2 else f"{prose(5)} call her on +1 555 {1000000 + i} today {prose(9)}"))
    for i in range(300, 360):  # identifiers of no base shape, with and without digits
        name = f"{word()}.{word()}" if i % 2 else f"{word()}-{i}"
        text = f"{prose(6)} ü reach me at {name} any time {prose(6)}"
        planted.add((i, text.index(name), text.index(name) + len(name)))
        rows.append((i, text))
    rows += [(i, f"{prose(30)} at {word()} any {prose(10)} 12{i}") for i in range(400, 700)]
    got = {(r["doc_id"], *map(int, x.split(":")[1:])) for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() for x in r["spans"].split(",") if x.startswith("other")}
    assert len(got & planted) / len(planted) == 1.0 and len(got & planted) / len(got) == 1.0  # recall, precision
    kinds = {r["other_kinds"] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 300 and doc_id < 360").collect()}
    assert kinds == {"email"}
    assert pii.scan(spark.createDataFrame([(1, "at x@y.org"), (2, "x@y.org"), (3, "")], "doc_id long, text string")).count() == 3


def plain_quality(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len({x for v in at.values() if len(v) > 1 for i in v for x in (i, i + 1, i + 2)})


def test_quality(docs, rows, empty):
    want = [(i, *plain_quality(t or "")) for i, t in rows]
    got = quality.judge(docs)
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect(), want)
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    same([(r[0],) for r in kept.select("doc_id").collect()], [(r["doc_id"],) for r in got.where("kept").collect()])
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_quality_by_words(docs, rows, monkeypatch):
    monkeypatch.setattr(quality, "MAX_PLACES", 3)
    same(quality.judge(docs).select("doc_id", "n_repeat_words").collect(), [(i, plain_quality(t or "")[4]) for i, t in rows])


def test_quality_of_a_very_long_text(spark):
    text = " ".join(f"w{i % 400_000}x{i // 700_000}" for i in range(1_100_000))
    got = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got["n_words"], got["n_repeat_words"]) == (1_100_000, plain_quality(text)[4])


def test_lm(docs, rows, empty):
    train = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            train.update([*lm.words_of(t), b""])
    n, v = sum(train.values()), len(train)
    got = Counter()
    want = Counter()
    for i, t in rows:
        w = [*lm.words_of(t), b""]
        want[i, len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 3)] += 1
    for r in lm.score(docs).collect():
        got[r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)] += 1
        assert r["score"] < 0
    assert got == want
    assert lm.score(empty).count() == 0


def test_lm_gradient_and_causality():
    rng = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in lm.start().items()}
    p["b"] = rng.normal(size=p["b"].shape)
    seq = rng.integers(1, lm.CLASSES, 50)
    x, valid, t = lm.chunks([seq, seq[:5]])
    g = lm.gradient(p, x, valid, t)[1]
    for k in p:
        at = (int(x[0, 20]), 3) if k == "E" else tuple(0 for _ in p[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        slope = (lm.gradient(up, x, valid, t)[0] - lm.gradient(down, x, valid, t)[0]) / 2e-3
        assert g[k][at] == pytest.approx(slope, abs=1e-4)
    model = lm.Model(lm.start())
    whole = model(*lm.chunks([seq]))
    assert model(*lm.chunks([seq[:16]]))[0] == pytest.approx(whole[0], rel=1e-4)  # what comes later changes nothing
    probability = sum(np.exp(model(*lm.chunks([np.array([*seq[:20], c])]))[1] - model(*lm.chunks([seq[:20]]))[1]) for c in range(lm.CLASSES))
    assert probability == pytest.approx(1, abs=1e-3)


def test_lm_tail_words_are_joined(docs, monkeypatch):
    want = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 4), r["n_known"]) for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "head_of", lambda counts, limit=0: (counts.where("c >= 64").collect(), 64))
    assert {(r["doc_id"], r["n_tokens"], round(r["base_score"], 4), r["n_known"]) for r in lm.score(docs).collect()} == want


def test_lm_learns():
    rng = np.random.default_rng(1)
    seqs = [np.resize(rng.permutation(np.arange(1, 6)), 80) for _ in range(60)]
    x, valid, t = lm.chunks(seqs)
    before = lm.gradient(lm.start(), x, valid, t)[0]
    assert lm.gradient(lm.train_on(lm.start(), seqs, 6), x, valid, t)[0] < before / 2


def test_lm_trains_on_whole_texts(spark):
    ranks = spark.sparkContext.broadcast(lm.load_ranks())
    encode = lm.Subwords(ranks.value)
    spell = lm.Spelling(np.random.default_rng(2).random(encode.end + 1), np.zeros(encode.end + 1), np.zeros(encode.end + 1), 0.0)
    cls = spell.cls
    texts = [" ".join(f"word{i}" for i in range(3000)), "x" * 5000, "a b", None]
    d = spark.createDataFrame([(i, i, i > 11, t) for i, t in enumerate([*texts * 3, "held out"])], f"{lm.KEY} long, doc_id long, held_out boolean, text string")
    want = Counter(tuple(cls[[*(encode(w)[0] for w in lm.words_of(t)), encode.end]]) for t in texts * 3)
    got = [np.frombuffer(r["classes"], dtype=np.uint8) for r in lm.sequences(lm.read(d, [("word7", 3), ("a", 3)], 10.0, ranks, spell)).collect()]
    assert Counter(tuple(s) for s in got) == want
    whole = lm.chunks(got)
    for size in (7, 64, 10**6):
        parts = list(lm.buffers(iter(got), size))
        assert all(len(x) == size for x, _, _ in parts[:-1])
        assert all((np.concatenate(a) == b).all() for a, b in zip(zip(*parts, strict=True), whole, strict=True))


@pytest.mark.parametrize("texts", [1, 39, 40, 205])
def test_lm_passes_do_not_depend_on_size(monkeypatch, texts):
    runs = []
    monkeypatch.setattr(lm, "BUFFER", 40)
    monkeypatch.setattr(lm.Adam, "__call__", lambda self, x, valid, t, epochs, rate: runs.append((len(x), epochs)))
    assert lm.pass_over(lm.start(), iter([np.arange(1, 17)] * texts), 0.01)[1] == texts
    assert runs == [(n, 1) for n in [40] * (texts // 40) + [texts % 40] * (texts % 40 > 0)]
    assert lm.ROUNDS[-1][0] == 1


def plain_attention(p, seq):
    """Natural log of a class sequence's probability, one target after another."""
    soft = lambda y: y - np.log(np.exp(y).sum())
    inputs, total = [0, *seq[:-1]], 0.0
    for i, want in enumerate(seq):
        keys = range(max(0, i // lm.STRIDE - 1) * lm.STRIDE, i + 1)
        q = p["E"][inputs[i]] @ p["Q"]
        w = np.array([q @ (p["E"][inputs[j]] @ p["K"]) / lm.DIM**0.5 + p["b"][i - j] for j in keys])
        w = np.exp(w - w.max())
        h = np.tanh(sum(a * (p["E"][inputs[j]] @ p["V"]) for a, j in zip(w / w.sum(), keys, strict=True)) + p["E"][inputs[i]] @ p["R"])
        group, member = want % lm.GROUPS, want // lm.GROUPS
        total += soft(h @ p["A"] + p["a"])[group] + soft(h @ p["B"][group] + p["c"][group])[member]
    return total


def test_lm_score_is_plain_attention(spark, monkeypatch):
    rng = np.random.default_rng(4)
    p = {k: rng.normal(0, 0.5, s) for k, s in lm.SHAPES.items()}
    held = {}
    monkeypatch.setattr(lm, "train", lambda seqs, mass: p)
    monkeypatch.setattr(lm, "spelling", lambda counts, ranks, plain=lm.spelling: held.setdefault("s", plain(counts, ranks)))
    texts = [(1, "the cat sat on the mat " * 12), (2, "unseen wörds 123"), (3, None), (4, "dog"), (10, "the cat's dog")]
    train = Counter(w for i, t in texts if zlib.crc32(str(i).encode()) % 10 for w in [*lm.words_of(t), b""])
    for limit in (lm.HEAD, 1):  # the second joins the counts of nearly all words
        monkeypatch.setattr(lm.head_of, "__defaults__", (limit,))
        got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
        encode, spell = lm.Subwords(lm.load_ranks()), held["s"]
        for i, t in texts:
            words = [(w, encode(w) if w else [encode.end]) for w in [*lm.words_of(t), b""]]
            rest = 0.0
            for w, ids in words:
                chance = 10 ** (spell.first[ids[0]] + sum(spell.inner[x] for x in ids[1:]) + spell.end)
                rest += math.log10(chance + (train[w] * spell.seen[spell.cls[ids[0]]] if train[w] else 0))
            assert got[i] == pytest.approx(plain_attention(p, spell.cls[[ids[0] for _, ids in words]]) / math.log(10) + rest, rel=1e-4)
    mass = Counter()
    for w, c in train.items():
        mass[spell.cls[(encode(w) if w else [encode.end])[0]]] += c
    assert all(spell.seen[k] * n + spell.unseen[k] == pytest.approx(1) for k, n in mass.items())
    first = np.bincount(spell.cls, weights=10 ** np.array(spell.first), minlength=lm.CLASSES)
    assert first[1:] == pytest.approx(spell.unseen[1:]) and (10 ** np.array(spell.inner)).sum() + 10**spell.end == pytest.approx(1)


def test_warc(spark):
    pages = [(3, "u3", "<p>é</p>"), (1, "u1", "<p>é</p>"), (2, None, None), (4, "u 4", ""), (5, "u5", "a\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u6", "tail\r\n"), (None, "n", "<p>é</p>"), (1, "u1", "<p>é</p>"), (7, "u7", "z" * 70_000)]
    got = warc.round_trip(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload long").repartition(2)).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((i, len((h or "").encode()), digest(h)) for i, _, h in pages)
    responses = Counter((r["page_id"], r["payload_digest"]) for r in got if r["record_type"] == "response")
    assert responses == Counter({(1, digest(pages[0][2])): 1, (2, digest("")): 1, (5, digest(pages[4][2])): 1, (6, digest(pages[5][2])): 1, (7, digest(pages[8][2])): 1})
    assert {(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"} == {(3, 1), (None, 1), (1, 1), (4, 2)}
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_files(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://u/{i}", "x" * (i % 3)) for i in range(40)], "page_id long, url string, html string").repartition(3)
    for limit in (warc.light.__defaults__[0], -1):  # broadcast, and shuffled
        monkeypatch.setattr(warc.light, "__defaults__", (limit,))
        path = tmp_path / f"w{limit}"
        warc.write(warc.keyed(pages), str(path), date="2026-01-02T03:04:05Z")
        seen = Counter()
        for f in path.glob("*.gz"):
            heads = [h for h, _ in warc.Parser().feed(gzip.decompress(f.read_bytes()))]
            assert [h[b"WARC-Type"] == b"warcinfo" for h in heads] == [i == 0 for i in range(len(heads))]
            ids = {h[b"WARC-Record-ID"] for h in heads}
            assert len(ids) == len(heads) and all(h[b"WARC-Date"] == b"2026-01-02T03:04:05Z" for h in heads)
            seen.update((h[b"WARC-Type"], h.get(b"WARC-Refers-To-Target-URI")) for h in heads[1:])
        assert seen == {(b"response", None): 3, (b"revisit", b"http://u/0"): 13, (b"revisit", b"http://u/1"): 12, (b"revisit", b"http://u/2"): 12}


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs, 7, 16).collect()
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows])
    n = Counter(r["shard"] for r in got)
    assert set(n) == set(range(7)) and max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n[s])) for s in n)
    assert sharding.shard(empty).count() == 0


def test_sharding_moves_little(spark):
    d = spark.range(20_000).selectExpr("id AS doc_id", "'' AS text")
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard(d, n).collect()} for n in (24, 25))
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.2  # 0.04 is the least that any method moves
