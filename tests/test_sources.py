import io
import json
import zipfile

from pyspark.sql import functions as F

from ravelin.functions.plugins import EngineConfig, EchoModel, hash_encoder, ocr_parser
from ravelin.operators import knowledge_base as kb, lexical
from ravelin.plans import pipeline
from ravelin.sources import files, tables
from ravelin.streaming.ingest import file_stream, ingest_stream


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Report", "Heading1") + p(" ") + p("Text here.") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + p("Part", "Heading2")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def archive(members: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def folder(path):
    (path / "a.txt").write_text("The ceramic pump needs an inspection. " * 10)
    (path / "same.txt").write_text("The ceramic pump needs an inspection. " * 10)
    (path / "latin.txt").write_bytes("Größe".encode("cp1252"))
    (path / "empty.txt").write_bytes(b"")
    (path / "w.docx").write_bytes(docx())
    (path / "bad.pdf").write_bytes(b"%PDF-1.7 nothing")
    (path / "old.doc").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x")
    (path / "z.zip").write_bytes(archive({"in/one.txt": "one " * 60, "skip.exe": "x", "deep.zip": archive({"two.txt": "two " * 60}), "../evil.txt": "no", "after.txt": "no"}))


def test_files_become_documents(spark, tmp_path):
    folder(tmp_path)
    docs = {r.original_filename: r for r in files.parse(files.expand(files.scan(spark, [str(tmp_path)]))).collect()}
    assert set(docs) == {"a.txt", "same.txt", "latin.txt", "w.docx", "bad.pdf", "old.doc", "z.zip::in/one.txt", "z.zip::two.txt"}
    assert docs["latin.txt"].full_text == "Größe" and "charset guessed" in docs["latin.txt"].extraction_warnings
    word = docs["w.docx"]
    assert [(h.level, h.text) for h in word.headings] == [(1, "Report"), (2, "Part")] and word.title == "Report" and word.structure_tier == 1
    table = word.tables[0]
    assert word.full_text[table.char_start : table.char_end] == table.markdown == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert all(word.full_text[h.char_offset :].startswith(h.text) for h in word.headings)
    assert docs["bad.pdf"].extraction_errors and docs["old.doc"].file_type == "txt" and docs["old.doc"].extraction_errors
    assert docs["a.txt"].content_hash == docs["same.txt"].content_hash and docs["a.txt"].doc_id != docs["same.txt"].doc_id


def test_ingest_twice_then_ask(spark, tmp_path):
    source, base = tmp_path / "in", str(tmp_path / "kb")
    source.mkdir()
    folder(source)
    docs = files.parse(files.expand(files.scan(spark, [str(source)]))).cache()
    first = pipeline.ingest(spark, base, "b0", "kb_001", docs).first()
    assert first.aligned and first.n_documents == 7
    again = pipeline.ingest(spark, base, "b1", "kb_001", docs).first()
    assert again.n_records == 0
    store = kb.KnowledgeBase(spark, base)
    ids = sorted(r.global_chunk_id for r in store.read("records").select("global_chunk_id").collect())
    assert ids == list(range(len(ids))) and len(ids) == first.n_records
    ranked, contexts = pipeline.retrieve(spark, base, docs, "ceramic pump inspection")
    assert "ceramic pump" in ranked.orderBy("rerank_rank").first().chunk_text
    top = contexts.orderBy("rank").first()
    assert "ceramic pump" in top.parent_text
    assert pipeline.answer(contexts, "ceramic pump", [EchoModel()], EngineConfig())["model_used"] == "echo"


def test_stream_is_idempotent(spark, tmp_path):
    source, base = tmp_path / "in", str(tmp_path / "kb")
    source.mkdir()
    folder(source)
    for _ in range(2):
        ingest_stream(spark, file_stream(spark, str(source)), base, "kb_001", str(tmp_path / "cp")).awaitTermination()
    n = spark.read.parquet(f"{base}/manifest").count()
    (source / "new.txt").write_text("A new note on the boiler. " * 9)
    (source / "copy.txt").write_text("The ceramic pump needs an inspection. " * 10)
    ingest_stream(spark, file_stream(spark, str(source)), base, "kb_001", str(tmp_path / "cp")).awaitTermination()
    assert n == 7 and spark.read.parquet(f"{base}/manifest").count() == 8


def test_texts_without_latin_letters_are_indexed(spark, tmp_path):
    source, base = tmp_path / "in", str(tmp_path / "kb")
    source.mkdir()
    folder(source)
    (source / "zh.txt").write_text("财务部问目录在哪里。文件很长。" * 9)
    (source / "marks.txt").write_text("— … ! ? " * 30)
    ingest_stream(spark, file_stream(spark, str(source)), base, "kb_001", str(tmp_path / "cp")).awaitTermination()
    store = kb.KnowledgeBase(spark, base)
    records, sizes = store.read("records"), store.read("doc_len")
    found = records.join(sizes, "global_chunk_id").groupBy("original_filename").agg(F.sum("dl").alias("dl")).collect()
    assert {r.original_filename for r in found if r.dl == 0} == {"zh.txt", "marks.txt"} and len(found) >= 7
    assert sizes.count() == records.count() == store.read("vectors").count()
    posts = store.read("postings").groupBy("global_chunk_id").agg(F.sum("tf").alias("n"))
    assert sizes.join(posts, "global_chunk_id", "left").filter("dl <> coalesce(n, 0)").count() == 0
    assert kb.alignment(store.read("vectors"), records, store.read("manifest")).first().aligned
    assert not kb.alignment(store.read("vectors").limit(1), records, store.read("manifest")).first().aligned


def test_cache_encodes_each_text_once(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "  "), ("e", None)], "chunk_id string, embed_text string")
    cache = spark.createDataFrame([(None, None)], "embed_text_hash string, dense_vector array<float>").limit(0)
    misses = kb.cache_misses(chunks, cache)
    assert misses.count() == 2
    embedded, filled = kb.embed_chunks(chunks, cache, lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float")), 2)
    assert sorted(r.chunk_id for r in embedded.collect()) == ["a", "b", "c"]
    assert kb.cache_misses(chunks, filled).count() == 0


def test_dedup_unseen_and_manifest(spark, tmp_path):
    docs = spark.createDataFrame([("k", "h1", 2, "b"), ("k", "h1", 1, "a"), ("l", "h1", 3, "c"), ("k", None, 4, "d"), ("k", None, 5, "e")], "kb_id string, content_hash string, n int, doc_id string")
    assert sorted(r.doc_id for r in kb.first_by_hash(docs, "content_hash", ["n"], ["kb_id"]).collect()) == ["a", "c", "d", "e"]
    assert sorted(r.doc_id for r in kb.unseen(docs, docs.filter("n = 1"), ["kb_id", "content_hash"]).collect()) == ["c", "d", "e"]
    (tmp_path / "m.json").write_text(json.dumps({"kb_id": "k", "indexed_doc_ids": ["a"]}))
    (tmp_path / "n.json").write_text(json.dumps({"kb_id": "l", "total_chunks": 2, "indexed_content_hashes": {"h": {"doc_id": "a", "original_filename": "f"}}}))
    read = tables.read_manifest(spark, str(tmp_path)).orderBy("kb_id").collect()
    assert read[0].total_chunks == 0 and read[0].indexed_content_hashes == {} and read[1].total_documents == 0
    assert tables.manifest_hashes(tables.read_manifest(spark, str(tmp_path))).first().content_hash == "h"


def test_log_newest_first(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01T10:00:00", "a"), ("2024-02-01T11:30:59", "b")], "timestamp string, query string")
    tables.append_log(rows, str(tmp_path / "log"))
    assert [(r.query, r.shown) for r in tables.read_log(spark, str(tmp_path / "log")).collect()] == [("b", "2024-02-01 11:30"), ("a", "2024-01-01 10:00")]


def test_next_kb(spark):
    rows = spark.createDataFrame([("kb_009",), ("kb_x",), ("brochure",)], "kb_id string")
    assert rows.agg(tables.next_kb(F.col("kb_id")).alias("n")).first().n == "kb_010"


def test_paths_that_are_not_there(spark, tmp_path):
    assert files.scan(spark, [str(tmp_path / "none")]).count() == 0


def test_retrieval_stays_in_its_knowledge_base_and_is_logged(spark, tmp_path):
    base, log = str(tmp_path / "kb"), str(tmp_path / "log")
    rows = [(f"d{n}", "txt_parser", f"f{n}", f"h{n}", t) for n, t in enumerate(["The ceramic pump needs an inspection. " * 12, "The boiler was cleaned by the clerk. " * 12, "a | b | c | d\ne | f | g | h\ni | j | k | l\n```py\ndef f():\n    return 'fenced'\n```\nThe table stands above. " * 2])]
    docs = spark.createDataFrame(rows, "doc_id string, parser_used string, original_filename string, content_hash string, full_text string").select(
        "*", F.lit(None).cast("string").alias("title"), F.array().cast("array<struct<level:int,text:string,char_offset:int>>").alias("headings"), F.array().cast("array<struct<page:int,markdown:string,char_start:int,char_end:int>>").alias("tables")
    )
    seen = []
    encode = hash_encoder(EngineConfig().dim)
    for batch, kb_id, part in (("b0", "k1", docs.filter("doc_id <> 'd1'")), ("b1", "k2", docs.filter("doc_id <> 'd0'"))):
        assert pipeline.ingest(spark, base, batch, kb_id, part, encode=encode, progress=lambda p, s: seen.append((p, s))).first().aligned
    assert seen[0] == (10, "parsing") and seen[-1] == (100, "done")
    store = kb.KnowledgeBase(spark, base)
    texts = store.read("records").select("doc_id", "chunk_type", "chunk_text", "kb_id").collect()
    assert {r.chunk_type for r in texts if r.doc_id == "d2"} == {"table", "code", "text"}
    assert not any("fenced" in r.chunk_text for r in texts if r.chunk_type == "text")
    cached = store.read("cache").groupBy("embed_text_hash").count()
    assert cached.filter("count > 1").count() == 0 and cached.count() == store.read("records").select("embed_text_hash").distinct().count()
    ranked, _ = pipeline.retrieve(spark, base, docs, "the boiler and the ceramic pump", kb_id="k1", encode=encode)
    assert ranked.count() and "d1" not in {r.doc_id for r in ranked.collect()}
    posts = store.read("postings")
    stored = {(r.global_chunk_id, r.score) for r in lexical.bm25_stored(["ceramic pump the", "boiler"], posts, store.read("doc_len"), "global_chunk_id", 9).collect()}
    assert stored and stored == {(r.global_chunk_id, r.score) for r in lexical.bm25(["ceramic pump the", "boiler"], store.read("records"), "global_chunk_id", "chunk_text", 9).collect()}
    got = pipeline.ask(spark, base, docs, "ceramic pump inspection", "k1", [EchoModel()], log)
    assert got["model_used"] == "echo" and set(got["timings"]) == {"retrieval", "generation"} and "ceramic pump" in got["answer"]
    assert [r.kb_used for r in tables.read_log(spark, log).collect()] == ["k1"]
    again = pipeline.ingest(spark, base, "b1", "k2", docs.filter("doc_id <> 'd0'")).first()
    assert again.aligned and again.n_documents == 2 and store.read("records").count() == len(texts)


def test_ocr_is_a_parser(spark):
    class Reads:
        def read(self, picture):
            return picture.decode()

    parse = ocr_parser(lambda content: [content[:4], content[4:]], Reads())
    assert parse(b"%PDFtext") | {} == {"full_text": "%PDF\ntext", "structure_tier": 3, "title_source": "none", "page_count": 2, "ocr_used": True, "parser_used": "ocr"}
