import pytest
from pyspark.sql import functions as F

from skein.api import Engine
from skein.errors import UnsupportedFileTypeError, ValidationError
from skein.functions import metadata as M
from skein.functions import text as T
from skein.operators import chunking, citations, confidence, fusion, images, rerank, sparse, validation, variants
from skein.sources import loaders

CORPUS = [(1, "Patient presents with chest pain and dyspnea."), (2, "Aspirin and beta-blockers are the treatment for chest pain."), (3, "Troponin levels were elevated in laboratory results today.")]


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


def test_tokens_and_terms(spark):
    d = one(spark, t="über beta-blockers abc_def x- beta- ñandú 5mg t2w Größe na—ive ½cup foo")
    r = d.select(T.bm25_tokens(F.col("t")).alias("b"), T.terms(F.col("t")).alias("w")).first()
    assert r["b"] == ["beta-blockers", "beta", "t2w", "na", "ive", "foo"]
    assert r["w"] == ["über", "beta", "blockers", "abc_def", "ñandú", "größe", "½cup"]


def test_bm25_weights(spark):
    docs = spark.createDataFrame([(1, "chest pain"), (2, "treatment chest pain aspirin"), (3, "")], "id long, text string")
    terms, stats = sparse.fit(docs, "id")
    assert stats.first()["avgdl"] == pytest.approx(2.0)
    w = {(r["id"], r["token"]): r["w"] for r in sparse.encode(sparse.token_counts(docs, "id"), terms, stats).collect()}
    assert w[2, "treatment"] / w[2, "aspirin"] == pytest.approx(1.5)
    assert sparse.update(terms, docs.withColumn("text", F.lit("novel chest"))).where("idf is null").count() == 1


def test_rrf_golden(spark):
    rows = [("q", 0, r, c) for r, c in enumerate("abc", 1)] + [("q", 1, r, c) for r, c in enumerate("bd", 1)] + [("q", 2, r, c) for r, c in enumerate("ca", 1)]
    got = fusion.fused_top(spark.createDataFrame(rows, "qid string, list_no int, rank int, chunk_id string")).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("a", 3.2522), ("b", 3.2522), ("c", 3.2266), ("d", 1.6129)]


def test_parents_take_the_lowest_child(spark):
    hits = spark.createDataFrame([("q", "a", "p", 3.0, 1), ("q", "b", "p", 2.0, 2), ("q", "c", None, 1.5, 3), ("q", "d", "p", 1.0, 4)], "qid string, chunk_id string, parent_chunk_id string, score double, rank int")
    got = fusion.expand_to_parents(hits, spark.createDataFrame([("p",)], "parent_chunk_id string")).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("p", 2.0), ("c", 1.5)]


def test_domain_score_golden(spark):
    d = one(spark, t="Results: aspirin reduces mortality in a randomized controlled clinical trial.", q="Does aspirin reduce mortality?", s="results", k="research_paper")
    assert d.select(rerank.domain_score(F.col("t"), F.col("q"), F.col("s"), F.col("k")).alias("x")).first()["x"] == pytest.approx(0.24231, abs=2e-4)


def _hits(spark, text, scores, answer):
    rows = [("q", f"c{i}", 1, "methods", text, s, i, None) for i, s in enumerate(scores, 1)]
    hits = spark.createDataFrame(rows, "qid string, chunk_id string, document_id int, section string, text string, score double, rank int, year int")
    return spark.createDataFrame([("q", "What does aspirin do?", answer)], "qid string, question string, answer string"), hits


def test_confidence_goldens(spark):
    text = "Aspirin reduces platelet aggregation via COX inhibition."
    qa, hits = _hits(spark, text, [0.85, 0.75], "Aspirin reduces platelet aggregation which is used in treatment.")
    r = confidence.confidence(qa, hits).first()
    assert (r["retrieval_confidence"], r["answer_grounding"], r["source_coverage"], r["hallucination_risk"], r["overall"]) == pytest.approx((0.71, 1.0, 0.3, 0.0, 0.7935))
    r = confidence.confidence(qa, hits.limit(0)).first()
    assert r["hallucination_risk"] == 0.9 and r["warnings"][-1] == confidence.NO_CONTEXT


@pytest.mark.parametrize(("text", "ok", "score"), [("Low dose aspirin therapy of 81 mg daily is used in adult patients.", True, 0.8333), ("Metformin lowers glucose.", False, 0.0)])
def test_claims(spark, text, ok, score):
    claim = "Aspirin therapy is given at 81 mg daily to adult patients."
    qa, hits = _hits(spark, text, [0.9], claim)
    r = validation.verify_claims(validation.extract_claims(qa), hits).first()
    assert (r["is_supported"], r["support_score"]) == (ok, score)
    assert (r["warning"] or "").startswith("" if ok else "Numeric claim not found in sources: '")


def test_calibration_goldens(spark):
    base = spark.createDataFrame([("q", 0.7935, 0.0)], "qid string, overall double, hallucination_risk double").withColumn("warnings", F.array().cast("array<string>"))
    for quality, ratio, valid, strength, want in ((0.8, 1.0, True, "strong", 0.8358), (0.1, 0.5, False, "weak", 0.3415)):
        ctx = one(spark, qid="q", quality_score=quality, is_valid=valid).withColumn("warnings", F.array().cast("array<string>"))
        ev = one(spark, qid="q", support_ratio=ratio, evidence_strength=strength, n_unsupported=0)
        assert validation.calibrate(base, ctx, ev).first()["overall"] == pytest.approx(want, abs=1e-4)


def test_markers_and_phrases(spark):
    assert citations.mark("we know Alpha beta gamma delta here", [["alpha beta gamma delta"], [r"bad \1 one two"]]) == "we know alpha beta gamma delta [1] here"
    d = one(spark, t="One two. This one has five words here! no. And this has four more?")
    assert d.select(T.key_phrases(F.col("t")).alias("k")).first()["k"] == ["This one has five words here", "And this has four more"]


def test_metadata(spark):
    d = one(spark, t="Abstract and methods\nJohn Smith, Jane Roe\nof oncology in 2019")
    r = d.select(M.describe(F.col("t"), F.lit("a.md")).alias("m")).first()["m"]
    assert (r["document_type"], r["specialty"], r["year"], r["authors"]) == ("research_paper", "oncology", 2019, "John Smith, Jane Roe")


def test_sections(spark):
    d = one(spark, t="intro text\nABSTRACT\nbody a\n## Plan\nbody b")
    got = d.select(F.explode(chunking.sections(F.col("t"))).alias("s")).select("s.name", "s.text").collect()
    assert [r["name"] for r in got][:2] == ["preamble", "abstract"] and len(got) == 3


def test_splitter_invariants():
    text = "\n\n".join(" ".join(f"w{i}x{j}." for j in range(i % 37 + 1)) for i in range(60)) + "".join(f"{i:05d}" for i in range(140))
    for size, overlap in ((512, 64), (100, 10), (2048, 128)):
        pieces = chunking.split_text(text, size, overlap)
        assert max(map(len, pieces)) <= size
        seen, at = set(), 0
        for p in pieces:  # each is a part of the text, none begins before the one ahead of it
            at = text.find(p, at)
            assert at >= 0
            seen.update(range(at, at + len(p)))
        assert all(c.isspace() or i in seen for i, c in enumerate(text))


def test_variants_and_images(spark):
    d = spark.createDataFrame([("q", "what?", "short\n a variant that is long\n\nanother variant here"), ("r", "who?", None)], "qid string, question string, raw_variants string")
    assert sorted((r["qid"], r["variant_no"]) for r in variants.expand(d).collect()) == [("q", 0), ("q", 1), ("q", 2), ("r", 0)]
    raw = one(spark, j='```json\n[{"description": "a mass", "severity": "critical"}, {"finding_type": "x"}]\n```')
    f = raw.select(images.parse_findings(F.col("j")).alias("f"))
    r = f.select(images.report(F.col("f"), F.lit("ct")).alias("r")).first()["r"]
    assert r["overall_severity"] == "critical" and r["critical_flags"] == ["a mass"] and r["overall_confidence"] == 0.5


def test_engine_end_to_end(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    docs = spark.createDataFrame([(i, f"f{i}.txt", t) for i, t in CORPUS] + [(9, "again.txt", CORPUS[0][1])], "document_id long, filename string, text string")
    assert e.ingest(docs).count() == 3
    assert e.ingest(docs.limit(2)).count() == 2 and e.store.count("catalogue") == 3
    q = spark.createDataFrame([("q", "treatment of chest pain", None, None, "Aspirin and beta-blockers are the treatment for chest pain in most people.")], "qid string, question string, raw_variants string, hyde string, answer string")
    r = e.query(q).first()
    assert "**References:**" in r["final_answer"] and 0 <= r["overall"] <= 1
    assert e.stats().first()["total_documents"] == 3 and e.health()["store"]
    with pytest.raises(ValidationError):
        e.query(q.withColumn("question", F.lit("ok")))
    with pytest.raises(UnsupportedFileTypeError):
        e.ingest(docs.withColumn("filename", F.lit("file.xyz")))
    e.store.delete_document(1)
    assert e.store.get("chunks", "document_id", 1).count() == 0


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line\nline")
    assert loaders.load_text(spark, str(tmp_path / "a.txt")).first()["text"] == "line\nline"
    pages = loaders.load_pdf(loaders.load_files(spark, str(tmp_path / "a.txt")), lambda b: ["x", "a page  of more than twenty characters"])
    assert [r["text"] for r in pages.collect()] == ["a page of more than twenty characters"]


def test_entry_imports():
    import __spark_entry__ as entry

    assert "hybrid_retrieve" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
