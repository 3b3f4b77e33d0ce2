"""The engine: ingest, query, stats and health over one store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import providers
from .config import Params
from .errors import IngestionError, UnsupportedFileTypeError, ValidationError
from .functions import lexicons as L
from .functions import metadata as M
from .functions.text import clean_text, file_extension
from .log import logger
from .operators import catalog, chunking, citations, confidence, dense, fusion, images, imaging, rerank, sparse, validation, variants
from .sources.loaders import SUPPORTED, read_pdf
from .sources.store import Store
from .staging import stage


class Engine:
    """Documents in, ranked and audited answers out, a whole frame of either at a time."""

    def __init__(self, spark: SparkSession, root: str, params: Params | None = None, embedder=None, stopwords=L.STOPWORDS, boosted=L.BOOSTED, *, reader=None, ocr=None, vision=None, generator=None, bge=None, ce=None) -> None:
        """Providers: a DocumentReader for PDF files, an Ocr and a VisionModel for pictures, a Generator for variants,
        passages and answers that are not given, and two PairScorers. Without one its stage is left out."""
        self.spark, self.store, self.p = spark, Store(spark, root), params or Params()
        self.embedder, self.stop, self.boosted = embedder or providers.HashEmbedder(), stopwords, boosted
        self.reader, self.ocr, self.vision, self.generator, self.bge, self.ce = reader, ocr, vision, generator, bge, ce
        self.log = logger()

    def _content(self, docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(new documents with their whole text, what the reader found in PDF files)."""
        if "content" not in docs.columns:
            d = docs.withColumn("content", F.lit(None).cast("binary"))
        else:
            d = docs.withColumn("text", F.coalesce("text", F.when(file_extension(F.col("filename")) != "pdf", F.decode("content", "UTF-8"))))
        d = d.select("document_id", "filename", "text", "content", F.sha2(F.coalesce("content", F.col("text").cast("binary"), F.lit("").cast("binary")), 256).alias("checksum"))
        new = stage(catalog.new_documents(d, self.store.read("catalogue")), "new-documents")
        if self.reader is None or "content" not in docs.columns:
            return new, None
        found = read_pdf(new.where("text is null and content is not null"), self.reader).withColumnRenamed("document_id", "file")
        ids = new.select("document_id", "filename", F.col("document_id").cast("string").alias("file"))
        return new, stage(found.join(ids, "file").drop("file"), "pdf-contents")

    def ingest(self, docs: DataFrame) -> DataFrame:
        """docs (document_id, filename, text and, for files as they are, content): the new ones are chunked, embedded and
        stored; their catalogue rows return. Without text, that of a txt or md file is its content, and a PDF file's
        pages, tables and pictures come from the reader.

        Files of other types are an error; documents that the catalogue holds, or that repeat within docs, are left out.
        A document without text to index is not stored: it returns with an `error`. Where all are so, that is an error."""
        kind = F.coalesce(file_extension(F.col("filename")), F.lit(""))
        wrong = docs.select(kind.alias("kind")).where(~F.col("kind").isin(*SUPPORTED)).agg(F.min("kind")).first()[0]
        if wrong is not None:
            raise UnsupportedFileTypeError(wrong, SUPPORTED)
        new, found = self._content(docs)
        whole, body = new.drop("content"), None
        if found is not None:
            pages = found.where("kind = 'page'").select("document_id", "page", clean_text(F.col("text")).alias("text")).where(F.length("text") > 20)
            joined = pages.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), " ").alias("all_pages"))
            whole = whole.join(joined, "document_id", "left").withColumn("text", F.coalesce("text", "all_pages")).drop("all_pages")
        rows = whole.withColumn("m", M.describe(clean_text(F.col("text")), F.col("filename"))).select("document_id", "text", "checksum", "m.*")
        if found is not None:
            rows = stage(rows, "described")
            paged = rows.drop("text").join(pages, "document_id")
            body = rows.join(pages.select("document_id").distinct(), "document_id", "left_anti").withColumn("page", F.lit(0)).unionByName(paged)
        else:
            body = rows.withColumn("page", F.lit(0))
        children, parents = chunking.chunk(body, (self.p.child_size, self.p.child_overlap), (self.p.parent_size, self.p.parent_overlap))
        children = children.withColumn("is_image_chunk", F.lit(False))
        counted = {"text_chunks": F.count_if(F.col("chunk_type") == "text"), "table_chunks": F.count_if(F.col("chunk_type") == "table"), "image_chunks": F.count_if("is_image_chunk")}
        if found is not None:
            about = rows.drop("text")
            cells = found.where("kind = 'table'").select("document_id", "page", F.col("number").alias("table_index"), chunking.markdown(F.col("header"), F.col("cells")).alias("markdown"))
            tables = chunking.table_chunks(cells).join(about, "document_id").drop("markdown").withColumn("is_image_chunk", F.lit(False))
            raw = found.where("kind = 'image'").withColumn("caption", F.coalesce(images.caption_below(F.col("words"), F.col("x0"), F.col("x1"), F.col("y1")), F.lit("")))
            raw = imaging.usable(raw.withColumn("near_text", images.near_text(F.col("near_text"))).withColumnRenamed("number", "image_index"))
            raw = raw.select("document_id", "filename", "page", "image_index", "data", "n_bytes", "width", "height", "channels", "caption", "near_text")
            analysed = stage(imaging.analyse(raw, ocr=self.ocr, vision=self.vision), "pictures")
            pictures = imaging.image_chunks(analysed).join(about, "document_id")
            children = children.unionByName(tables, allowMissingColumns=True).unionByName(pictures, allowMissingColumns=True)
        children = stage(children.withColumn("dense", providers.embed(F.col("text"), self.embedder)), "chunks")
        made = rows.drop("text").withColumn("ingested_at", F.current_timestamp()).join(children.groupBy("document_id").agg(*[c.alias(n) for n, c in counted.items()]), "document_id", "left")
        if found is not None:
            made = made.join(found.groupBy("document_id").agg(F.count_if(F.col("kind") == "image").alias("images_extracted"), F.count_if(F.col("kind") == "table").alias("tables_extracted"), F.max("error").alias("read_error")), "document_id", "left")
        empty = F.coalesce(F.col("text_chunks"), F.lit(0)) == 0
        why = F.coalesce(F.col("read_error"), F.lit("no text to index")) if found is not None else F.lit("no text to index")
        made = stage(made.withColumn("error", F.when(empty, why)).drop("read_error"), "catalogue")
        good = made.where("error is null").drop("error")
        if good.isEmpty() and not made.isEmpty():
            raise IngestionError("no text to index")
        kept = good.select("document_id")
        self.store.upsert("chunks", children.join(kept, "document_id", "left_semi"), "chunk_id")
        self.store.upsert("parents", parents, "parent_chunk_id")
        if found is not None:
            self.store.upsert("pictures", imaging.stored_pictures(analysed).join(kept, "document_id", "left_semi"), "image_id")
        self.store.upsert("catalogue", good, "document_id")
        self.log.info("documents ingested into %s", self.store.root)
        have = self.store.read("catalogue").join(docs.select("document_id"), "document_id", "left_semi")
        return have.unionByName(made.where("error is not null"), allowMissingColumns=True)

    def retrieve(self, questions: DataFrame, where: F.Column | None = None, multi_query: bool = True, hyde: bool = True, expand: bool = True, compress: bool = True) -> DataFrame:
        """Hits (qid, chunk columns, score, rank) of questions (qid, question, raw_variants, hyde).

        Where there is a generator, variants and passages that are missing are asked of it, once."""
        if self.generator is not None:
            questions = stage(variants.ask(questions, self.generator, self.p.multi_query_count), "questions")
        p, chunks = self.p, self.store.read("chunks")
        chunks = chunks.where(where) if where is not None else chunks
        v = variants.expand(questions, p.multi_query_count) if multi_query else questions.select("qid", F.lit(0).alias("variant_no"), F.col("question").alias("text"))
        key = F.concat_ws("|", F.col("qid").cast("string"), "kind", F.col("variant_no").cast("string"))
        probes = v.withColumn("kind", F.lit("q"))
        if hyde:
            probes = probes.union(questions.where("hyde is not null and hyde <> ''").select("qid", F.lit(0), F.col("hyde"), F.lit("h")))
        probes = probes.withColumn("probe", key)
        vectors = probes.select("probe", providers.embed(F.col("text"), self.embedder).alias("q"))
        near = dense.search(vectors, chunks.select("chunk_id", F.col("dense").alias("v")), "probe", "chunk_id", 2 * p.top_k, p.score_threshold)
        lexical = sparse.Index(chunks, "chunk_id", probes.where("kind = 'q'"), "probe", stopwords=self.stop).search(2 * p.top_k, self.boosted, p.k1, p.b)
        order = F.when(F.col("kind") == "h", 1000).otherwise(F.col("variant_no"))
        known = probes.select("probe", "qid", "kind", order.alias("no"))
        lists = near.join(known, "probe").where(F.when(F.col("kind") == "h", F.col("rank") <= p.top_k).otherwise(True)).select("qid", F.col("no").alias("list_no"), "rank", "chunk_id")
        lists = lists.union(lexical.join(known, "probe").select("qid", (F.col("no") + 2000).alias("list_no"), "rank", "chunk_id"))
        hits = fusion.fused_top(lists, p.top_k, p.rrf_k).join(chunks.select("chunk_id", "parent_chunk_id"), "chunk_id", "left")
        meta = ["document_id", "filename", "section", "document_type", "specialty", "year", "authors", "journal", "source", "chunk_type", "text", "page", "is_image_chunk", "modality", "caption"]
        have = chunks.select("chunk_id", *[c for c in meta if c in chunks.columns])
        if expand:
            parents = self.store.read("parents")
            hits = fusion.expand_to_parents(hits.select("qid", "chunk_id", "parent_chunk_id", "score", "rank"), parents, p.parent_top_k, p.top_k)
            have = have.unionByName(parents.withColumnRenamed("parent_chunk_id", "chunk_id").select("chunk_id", *[c for c in meta if c in parents.columns]), allowMissingColumns=True)
        if compress:
            hits = fusion.compress(hits, p.compression_ratio)
        return fusion.limit(hits, p.top_k).join(have, "chunk_id").withColumn("page", F.coalesce("page", F.lit(0)))

    def query(self, questions: DataFrame, where: F.Column | None = None, reranking: bool = True, bge: F.Column | None = None, ce: F.Column | None = None, **stages) -> DataFrame:
        """An audited answer for each question (qid, question, raw_variants, hyde, answer): answers are given, or come from
        the generator where they are missing. bge and ce are scores as columns of the hits; else the models give them."""
        bad = questions.where((F.length("question") < 3) | (F.length("question") > 4000)).limit(1).collect()
        if bad:
            raise ValidationError("a question has 3 to 4000 characters")
        if self.generator is not None:
            questions = stage(variants.ask(questions, self.generator, self.p.multi_query_count), "questions")
        hits = stage(self.retrieve(questions, where, **stages).join(questions.select("qid", "question"), "qid"), "hits")
        if reranking:
            pair = lambda given, model: given if given is not None or model is None else providers.pair_score(F.col("question"), F.col("text"), model)
            bge, ce = pair(bge, self.bge), pair(ce, self.ce)
            scored = hits.withColumns({n: c for n, c in (("bge", bge), ("ce", ce)) if c is not None})
            hits = stage(rerank.rerank(scored, self.p.rerank_top_n, "bge" if bge is not None else None, "ce" if ce is not None else None), "ranked")
        if self.generator is not None:
            questions = stage(variants.answer(questions, citations.context_blocks(questions, hits), self.generator, citations.messages), "answers")
        base = confidence.confidence(questions, hits, self.p.top_k, self.p.confidence_threshold, self.p.hallucination_threshold)
        found = validation.evidence(questions, validation.verify_claims(validation.extract_claims(questions), hits))
        audited = validation.calibrate(base, validation.validate_context(questions, hits), found, self.p.confidence_threshold)
        sources = citations.citations(hits)
        cited = citations.citation_block(sources)
        out = audited.join(citations.inject_markers(questions, hits), "qid", "left").join(cited, "qid", "left").join(citations.context_blocks(questions, hits), "qid", "left")
        lines = F.array_join(F.transform(F.slice("claim_warnings", 1, 5), lambda w: F.concat(F.lit("- "), w)), "\n")
        notes = F.when(F.size("claim_warnings") > 0, F.concat(F.lit("\n\n⚠️ **Unverified Claims Detected:**\n"), lines))
        doubt = F.when(~F.col("is_reliable"), F.concat(F.lit("\n\n⚠️ **Reliability Warning**: Confidence score "), F.format_string("%.2f", F.col("overall")), F.lit(" is below threshold. Please verify this information with primary medical sources.")))
        say = [F.coalesce(c, F.lit("")) for c in (F.coalesce("marked", "answer"), F.col("block"), notes, doubt)]
        on = lambda name: stages.get(name, True)
        asked = questions.select("qid", variants.parse_variants(F.col("question"), F.col("raw_variants"), self.p.multi_query_count).alias("query_variants"), F.col("hyde").alias("hypothesis"))
        path = citations.strategy(F.size("query_variants"), F.coalesce(F.col("hypothesis") != "", F.lit(False)) & F.lit(on("hyde")), on("expand"), on("compress"), reranking, on("multi_query"))
        asked = asked.withColumn("retrieval_strategy", path).withColumn("reranking_applied", F.lit(reranking))
        out = out.withColumn("final_answer", F.concat(*say)).withColumn("messages", citations.messages(F.col("context"), F.col("question")))
        return out.join(asked, "qid", "left").join(citations.sources(sources), "qid", "left").join(citations.kinds(hits), "qid", "left")

    def stats(self) -> DataFrame:
        rows = self.store.read("catalogue")
        empty = self.spark.createDataFrame([], "document_type string")
        return catalog.stats(empty if rows is None else rows, self.store.count("chunks"))

    def health(self) -> dict:
        return {"store": self.store.healthy(), "tables": self.store.tables(), "models": self.models()}

    def models(self) -> dict[str, bool]:
        """Which providers there are."""
        return providers.available(embedder=self.embedder, reader=self.reader, ocr=self.ocr, vision=self.vision, generator=self.generator, bge=self.bge, ce=self.ce)

    def warm_up(self) -> None:
        """Load the embedder in the workers, as many as run at once, before the first question."""
        n = self.spark.sparkContext.defaultParallelism
        words = self.spark.range(0, n, 1, n).select(providers.embed(F.col("id").cast("string"), self.embedder).alias("v"))
        words.write.format("noop").mode("overwrite").save()
