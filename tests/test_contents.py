import logging
import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from skein.api import Engine
from skein.functions import pixels as P
from skein.log import logger
from skein.operators import chunking, imaging, variants
from skein.sources import loaders
from skein.sources.store import Store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no tests folder

CHEST = "Chest radiograph of the patient shows increased opacity of the lung. "


def scan(w=120, h=100):
    a = np.full((h, w), 20, np.uint8)
    a[20:80, 30:90] = 220
    return a


class Reader:
    def load(self):
        def read(content):
            if content.startswith(b"broken"):
                raise ValueError("no such file")
            if content == b"nothing":
                return [{"text": "short"}]
            a = scan()
            pictures = [
                {"data": a.tobytes(), "n_bytes": 9000, "width": 120, "height": 100, "channels": 1, "box": (10, 200, 300)},
                {"data": a.tobytes(), "n_bytes": 100, "width": 120, "height": 100, "channels": 1},
                {"data": b"too few", "n_bytes": 9000, "width": 120, "height": 100, "channels": 1},
            ]
            words = [(20, 60, 310, "Radiograph"), (70, 90, 310, "of"), (95, 130, 310, "chest, upright"), (20, 60, 500, "elsewhere")]
            return [{"text": CHEST * 3, "images": pictures, "words": words, "tables": [{"header": ["drug", "dose"], "rows": [["aspirin", 5], ["none", None]]}, {"header": ["empty"], "rows": []}]}, {"text": "Second page: " + CHEST}]

        return read


class Writer:
    def load(self):
        def write(prompts):
            return ["first way to ask about chest pain\nsecond way to ask about opacity" if p.startswith("Write 3") else None if p.startswith("Write a short") else "Increased opacity of the lung is seen." for p in prompts]

        return write


class Length:
    def load(self):
        return lambda qs, ts: [min(1.0, len(x) / 1000) for x in ts]


class Failing:
    def load(self):
        def fail(*_):
            raise RuntimeError("down")

        return fail


def test_pdf_contents(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), reader=Reader(), vision=Failing(), ocr=Failing(), generator=Writer(), bge=Length(), ce=Failing())
    files = spark.createDataFrame([(1, "a.pdf", None, b"pdf"), (2, "b.pdf", None, b"broken"), (3, "c.md", None, "Troponin was elevated — twice.".encode()), (4, "d.txt", "  ", None), (5, "e.pdf", None, b"nothing"), (6, "f.txt", None, None)], "document_id long, filename string, text string, content binary")
    got = {r["document_id"]: r for r in e.ingest(files).collect()}
    assert got[1]["error"] is None and got[3]["error"] is None and "no such file" in got[2]["error"] and all("no text" in got[i]["error"] for i in (4, 5, 6))
    assert (got[1]["table_chunks"], got[1]["image_chunks"], got[1]["images_extracted"], got[1]["tables_extracted"]) == (1, 1, 3, 2)
    assert e.store.count("catalogue") == 2 and set(e.store.tables()) == {"chunks", "parents", "catalogue", "pictures"}
    chunks = e.store.read("chunks")
    table = chunks.where("chunk_type = 'table'").first()
    assert table["text"] == "[TABLE from page 1]\n| drug | dose |\n| --- | --- |\n| aspirin | 5 |\n| none |  |" and table["section"] == "table" and table["page"] == 1
    picture = chunks.where("is_image_chunk").first()
    assert picture["modality"] == "xray" and picture["caption"] == "Radiograph of chest, upright" and picture["section"] == "imaging" and "Increased opacity" in picture["text"]
    assert {r["page"] for r in chunks.where("document_id = 1 and chunk_type = 'text'").collect()} == {0, 1}
    assert bytes(e.store.read("pictures").first()["picture"]).startswith(b"\x89PNG")
    q = spark.createDataFrame([("q", "what does the chest radiograph show?")], "qid string, question string")
    r = e.query(q, compress=False).first()
    assert len(r["query_variants"]) == 3 and r["hypothesis"] is None and r["answer" if "answer" in r else "final_answer"]
    assert "Multi-Query(3)" in r["retrieval_strategy"] and "HyDE" not in r["retrieval_strategy"] and r["reranking_applied"]
    assert len(r["sources"]) == r["n_hits"] == r["text_hits"] + r["table_hits"] + r["image_hits"] and r["image_hits"] >= 1
    assert all(s["rerank_score"] is not None for s in r["sources"]) and any(s["modality"] == "xray" for s in r["sources"] if s["is_image_chunk"])
    assert e.models() == {"embedder": True, "reader": True, "ocr": True, "vision": True, "generator": True, "bge": True, "ce": True}
    e.warm_up()
    e.store.delete_document(1)
    assert e.store.count("pictures") == 0


def test_pictures_of_any_kind(spark):
    big = np.random.default_rng(5).integers(0, 256, (90, 100, 3)).astype(np.uint8)
    rows = [(1, "skin photo.png", 1, 0, big.tobytes(), 5000, 100, 90, 3, "", ""), (2, None, None, None, None, None, None, None, None, None, None), (3, "x", 1, 0, b"", 0, 0, 0, 3, "", "")]
    d = spark.createDataFrame(rows, "document_id long, filename string, page int, image_index int, data binary, n_bytes long, width int, height int, channels int, caption string, near_text string")

    class Sees:
        def load(self):
            return lambda png, kind, about: '[{"description": "a rash", "severity": "critical"}]'

    class Reads:
        def load(self):
            return lambda a: " a label of the picture "

    got = {r["document_id"]: r for r in imaging.analyse(d, ocr=Reads(), vision=Sees()).collect()}
    assert got[1]["modality"] == "clinical" and got[1]["report"]["critical_flags"] == ["a rash"] and got[1]["ocr_text"] == "a label of the picture" and got[1]["error"] is None
    assert got[1]["pixel_metadata"]["pixel_count"] == 9000 and got[1]["pixel_metadata"]["aspect_ratio"] == 1.111
    assert all(got[i]["error"] and got[i]["picture"] is None for i in (2, 3))
    assert imaging.analyse(d.limit(0)).count() == 0 and imaging.image_chunks(imaging.analyse(d)).count() == 1
    assert [r["document_id"] for r in imaging.usable(d).collect()] == [1]


def unpacked(data):
    """Width, height and rows of a PNG file whose lines are unfiltered."""
    at, idat = 8, b""
    while at < len(data):
        n, tag = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert zlib.crc32(tag + body) == int.from_bytes(data[at + 8 + n : at + 12 + n])
        if tag == b"IHDR":
            w, h, c = int.from_bytes(body[:4]), int.from_bytes(body[4:8]), {0: 1, 2: 3}[body[9]]
        idat += body if tag == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, 1 + w * c)[:, 1:].reshape((h, w) if c == 1 else (h, w, c))


@pytest.mark.parametrize("shape", [(9, 14), (9, 14, 3), (1, 1), (1, 1, 3), (130, 70)])
def test_pixels(shape):
    a = np.random.default_rng(7).integers(0, 256, shape).astype(np.uint8)
    assert (unpacked(P.png(a)) == a).all()
    for kind in (*P.L.PREPARATION, "unknown"):
        b = P.prepare(a, kind, side=64)
        assert b.dtype == np.uint8 and max(b.shape[:2]) <= 64 and all(np.isfinite(x) for x in P.statistics(b).values())
    c = P.rgb(a).astype(int)
    flat = c.reshape(-1, 3)
    assert P.grey_share(a) == pytest.approx(np.mean([abs(r - g) + abs(g - b) < 10 for r, g, b in flat]))
    assert P.saturation(a) == pytest.approx(np.mean([(max(p) - min(p)) / max(p) if max(p) else 0 for p in flat.tolist()]))
    p = np.pad(a, ((1, 1), (1, 1)) + ((0, 0),) * (a.ndim - 2), mode="edge")
    plain = np.array([[np.median(p[i : i + 3, j : j + 3], axis=(0, 1)) for j in range(a.shape[1])] for i in range(a.shape[0])])
    assert (P.median(a) == plain).all()


def test_pixel_steps():
    a = scan()
    assert P.edge_share(np.full((30, 30), 90, np.uint8)) == 0 and 0.01 < P.edge_share(a) < 0.06
    assert (P.stretch(a).min(), P.stretch(a).max()) == (0, 255) and (P.stretch(a[:5]) == a[:5]).all()
    faint = (np.arange(64 * 64).reshape(64, 64) % 64 // 4 + 100).astype(np.uint8)
    assert P.even_out(faint).std() > faint.std()
    assert (P.contrast(a).min(), P.contrast(a).max()) == (0, 254) or P.contrast(a).std() > a.std()
    assert P.fit(np.full((3000, 1500), 9, np.uint8), 1024).shape == (1024, 512) and (P.fit(np.full((300, 7), 9, np.uint8), 100) == 9).all()
    for bad in ((b"abc", 1, 1, 1), (b"", 0, 0, 3), (b"ab", 1, 1, 2)):
        with pytest.raises(ValueError):
            P.as_array(*bad)
    assert P.as_array(bytes(range(8)), 2, 1, 4).tolist() == [[[0, 1, 2], [4, 5, 6]]]


def test_image_files(spark, tmp_path):
    a = np.random.default_rng(3).integers(0, 256, (12, 10, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(P.png(a))
    (tmp_path / "g.png").write_bytes(P.png(a[:, :, 0]))
    (tmp_path / "broken.png").write_bytes(b"not a picture")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in loaders.load_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "g.png"} and bytes(got["a.png"]["data"]) == a.tobytes() and (got["g.png"]["width"], got["g.png"]["channels"]) == (10, 1)


def test_spool_keeps_the_newest(spark, tmp_path):
    for content in (b"old", b"new"):
        kept = loaders.spool(spark.createDataFrame([("a b.txt", content)], "filename string, content binary"), str(tmp_path / "spool"))
    assert [(r["filename"], bytes(r["content"])) for r in kept.collect()] == [("a_b.txt", b"new")]


def test_models_that_fail(spark):
    q = spark.createDataFrame([("a", "what is it?", "given line of text", None), ("b", "who is it?", None, "given")], "qid string, question string, raw_variants string, hyde string")
    rows = {r["qid"]: r for r in variants.ask(q, Failing()).collect()}
    assert rows["a"]["raw_variants"] == "given line of text" and rows["b"]["raw_variants"] is None and rows["b"]["hyde"] == "given" and rows["a"]["hyde"] is None


def test_store_and_log(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.info("chunks") == {"name": "chunks", "rows": 0, "status": "absent"}
    for _ in range(2):
        s.create("chunks", "chunk_id string")
    assert s.info("chunks") == {"name": "chunks", "rows": 0, "status": "ready"}
    assert logger() is logger() and sum(type(h) is logging.StreamHandler for h in logger().handlers) == 1


def test_markdown(spark):
    d = spark.createDataFrame([(["a", "b"], [["1", None]]), (["a"], [])], "h array<string>, c array<array<string>>")
    assert [r["m"] for r in d.select(chunking.markdown(F.col("h"), F.col("c")).alias("m")).collect()] == ["| a | b |\n| --- | --- |\n| 1 |  |", ""]
