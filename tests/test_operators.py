"""Operators on literal rows."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import codes as C
from lodestone.functions import portal
from lodestone.functions import text as T
from lodestone.catalogue import LEXICON as LEX
from lodestone.lexicon import UNKNOWN
from lodestone.operators import answer as A
from lodestone.operators import chunking, classify, evaluate, index, manifest, projection, retrieve, tables, triage, understand
from lodestone.plans import build, cascade, evaluation
from lodestone.sources import embedding, files, jsonl, schemas, web



def one(df):
    return df.first()[0]


def of(spark, column, **values):
    return one(spark.createDataFrame([tuple(values.values())], list(values)).select(column))


def test_splitter_keeps_the_ceiling():
    cut = chunking.Splitter(target=20, most=30, overlap=5)
    text = "\n\n".join(" ".join(f"word{i}{j}" for j in range(9)) for i in range(12)) + "\n\n" + "x" * 500
    pieces = cut(text)
    assert all(len(p) <= 30 * chunking.CHARS_PER_TOKEN for p in pieces) and len(pieces) > 5
    assert cut("") == [] and cut("  short ") == ["short"]
    assert "".join(pieces).count("x") >= 500
    words = re.findall(r"word\d+", text)
    assert all(any(w in p for p in pieces) for w in words)


def test_overlap_is_carried():
    cut = chunking.Splitter(target=10, most=40, overlap=3)
    pieces = cut("\n\n".join(f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}" for i in range(8)) + "\n\n" + "tail " * 20)
    assert any(p.split()[0] in q.split() for q, p in zip(pieces, pieces[1:], strict=False))


def test_chunks_have_stable_ids(spark):
    pages = spark.createDataFrame([("d", 0, "1", "c", "f", "t", "text " * 40), ("d", 1, None, "c", "", "t", "tiny")], "doc_id string, page_index int, page_label string, category string, folder string, title string, text string")
    rows = chunking.chunk_pages(pages).collect()
    assert [r.chunk_id for r in rows] == ["d:p0:c00"]
    assert rows[0].text.startswith("c > f > t > p.1\n\ntext")


def test_chunk_id_widens(spark):
    assert of(spark, T.chunk_id(F.lit("d"), F.lit(None).cast("int"), F.col("n").cast("int")), n=100) == "d:pna:c100"


def test_packed_lines_lose_spaces_alone(spark):
    lines = F.split(F.col("t"), "\n")
    assert of(spark, chunking.pack_lines(lines, 300), t="0997 zero\n1219 one\n  two 2 ") == ["0997 zero\n1219 one\ntwo 2"]
    assert of(spark, chunking.pack_lines(lines, 300), t="0\n1\n   ") == ["0\n1"]


def test_split_rows_repeats_headers():
    rows = [["code", "meaning"], *[[f"E{i}", "some words here"] for i in range(40)]]
    parts = tables.split_rows(rows, True, "Table:", 60)
    assert len(parts) > 3 and all(p.startswith("Table:\n| code | meaning |") for p in parts)
    assert tables.split_rows([], True) == []
    assert len(tables.split_rows([["a" * 900]], False, "", 50)[0]) <= 170


def test_boosts_multiply_and_keep_all(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, "diagnostic_article", "OVEN", ["BK2"], ["E04"], "OVEN", ["bk2"], ["e04"]), (1, "b", 2.0, "pdf", UNKNOWN, None, [], UNKNOWN, ["x"], [])],
        "query_id int, chunk_id string, fused_score double, content_stream string, product_family string, model_series array<string>, fault_codes array<string>, q_family string, q_series array<string>, q_codes array<string>",
    )
    rows = {r.chunk_id: r for r in retrieve.boost(df).collect()}
    assert rows["a"].boosted_score == pytest.approx(1.2 * 1.35 * 1.15 * 1.5)
    assert rows["b"].boosted_score == 2.0 and rows["b"].boosts == []


def test_dense_in_cells_is_the_join_of_all(spark, monkeypatch):
    for name, most in (("ROWS_HELD", 200), ("QUESTIONS_HELD", 20), ("SCORES_HELD", 90)):
        monkeypatch.setattr(retrieve, name, most)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 4, [None, 1.0, 1.0, 1.0], [nan, 0.0, 1.0, 1.0], [inf, 1.0, 0.0, 0.0], [1.0, 2.0], [2.0, 1.0], [3.0, None]]
    rows = [(f"k{i % 100}{i}", [float((i * p) % 7 - 2) for p in (1, 3, 5, 11)]) for i in range(150)] + [(f"c{i}", [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(f"o{i}", v) for i, v in enumerate(odd * 2)]
    index = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows) if i % 20 == 0 or i > 185], "query_id int, vector array<double>")
    pairs = index.join(asked, F.size("embedding") == F.size("vector")).select("query_id", "chunk_id", retrieve.cosine(F.col("embedding"), F.col("vector")).alias("score"))
    found = retrieve.dense(asked, index, 7)
    assert not re.search("Join|Cartesian", found._jdf.queryExecution().toString())
    as_text = lambda df: sorted(map(str, df.select("query_id", "chunk_id", "score", "rank").collect()))
    assert as_text(found) == as_text(retrieve.top_k(pairs, 7))
    assert retrieve.dense(asked.limit(0), index).count() == 0 == retrieve.dense(asked, index.limit(0)).count()


def test_bm25_sums_a_document_where_it_lies(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "..."), (4, "a c d")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "none")], "query_id long, query string")
    posts, own = index.postings(docs), index.lengths(docs)
    found = retrieve.bm25(asked, posts, lengths=own)
    assert sorted(own.collect()) == [(1, 3), (2, 2), (4, 3)]
    assert sorted(found.collect()) == sorted(retrieve.bm25(asked, posts).collect())
    assert [(r.query_id, r.chunk_id) for r in found.orderBy("query_id", "rank").collect()] == [(1, 1), (1, 2), (1, 4), (2, 2), (2, 4)]
    assert not re.search(r"hashpartitioning\(query_id#\d+L, chunk_id", found._jdf.queryExecution().executedPlan().toString())


def test_bm25_of_bags_is_that_of_postings_without_a_row_for_each_term(spark):
    words = "a b c d e f g h".split()
    rows = [(i, " ".join(words[(i * p + p) % (3 + i % 6)] for p in range(1, 2 + i % 11))) for i in range(300)] + [(500 + i, "a b a c") for i in range(60)]
    rows += [(None, "a h"), (700, "a c"), (700, "c e"), (701, None), (702, "..."), (703, "")]
    docs = spark.createDataFrame(rows, "chunk_id long, text string")
    asked = spark.createDataFrame([("x", "a b"), ("y", "c c H"), ("x", "a e"), (None, "d"), ("z", "none"), ("n", None), ("w", "a b c d e f g h")], "query_id string, query string")
    allowed = docs.where("chunk_id % 3 > 0").select("chunk_id")
    plain = lambda df: sorted((str(r.query_id), r["rank"], str(r.chunk_id), round(r.score, 9)) for r in df.collect())
    for only in (None, allowed):
        found = retrieve.bm25(asked, index.bags(docs), 7, allowed=only)
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
        assert plain(found) == plain(retrieve.bm25(asked, index.postings(docs), 7, allowed=only))
    assert retrieve.bm25(asked.limit(0), index.bags(docs)).count() == 0 == retrieve.bm25(asked, index.bags(docs.limit(0))).count()


def test_bm25_of_bags_goes_through_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)
    read = F.udf(lambda t: (seen.add(1), t)[1], "string").asNondeterministic()
    docs = spark.createDataFrame([(i, f"oven {'belt ' * (i % 3)}x{i}") for i in range(30)], "chunk_id long, text string")
    questions = spark.createDataFrame([(1, "belt"), (2, "oven x7")], "query_id long, query string")
    found = retrieve.bm25(questions, index.bags(docs.withColumn("text", read("text"))), 5)
    ranks = {(r.query_id, r.rank): r.chunk_id for r in found.collect()}
    assert len(ranks) == 10 and ranks[2, 1] == 7 and [ranks[1, i] for i in (1, 2, 3)] == [2, 5, 8]
    assert seen.value == 30  # 60 when statistics and scores each read the texts


def test_rerank_appends_what_is_left_out(spark):
    df = spark.createDataFrame([(1, c, s, "q", c) for c, s in zip("abcd", (4.0, 3.0, 2.0, 1.0), strict=True)], "query_id int, chunk_id string, boosted_score double, query string, text string")
    out = retrieve.rerank_with(df, lambda q, texts: [3, 9, 3, True]).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["c", "a", "b", "d"] and out[1].rerank_score == 0.0

    def broken(q, texts):
        raise RuntimeError

    assert [r.chunk_id for r in retrieve.rerank_with(df, broken).orderBy("rank").collect()] == list("abcd")


def test_codes_of_long_questions(spark):
    far = "x" * 200 + " E:04"
    assert of(spark, understand.codes(F.col("q"), LEX), q=far) == []
    assert of(spark, understand.codes(F.col("q"), LEX), q="E:04 on a DM7") == ["E04"]


def test_enrich_takes_only_three_things(spark):
    asked = understand.understand(spark.createDataFrame([(1, "E:04"), (2, "hello")], "query_id int, query string"), LEX)
    replies = spark.createDataFrame([(1, "parts", True, "")], "query_id int, intent string, wants_diagram boolean, rewrite string")
    rows = {r.query_id: r for r in understand.enrich(asked, replies).collect()}
    assert rows[1].intent == "parts" and rows[1].wants_diagram and rows[1].q_codes == ["E04"] and rows[1].rewritten_query == "E:04"
    assert rows[2].source == "deterministic"
    got = understand.enrich_with(asked, lambda q: {"rewrite": q + "!"} if q == "hello" else 1 / 0).collect()
    assert {r.query_id: r.rewritten_query for r in got} == {1: "E:04", 2: "hello!"}


def test_sources_match_never_by_emptiness(spark):
    assert of(spark, evaluate.source_matches(F.col("e"), F.array(F.lit(""), F.lit("other"))), e="guide.pdf") is False
    assert of(spark, evaluate.source_matches(F.col("e"), F.array(F.lit("The Guide PDF v2"))), e="guide.pdf") is True


def test_answer_heading_moves(spark):
    assert of(spark, A.answer_first(F.col("t")), t="Note\nAnswer:\nDo it") == "Answer:\nNote\nDo it"
    assert of(spark, A.answer_first(F.col("t")), t="\nAnswer:\nDo it") == "Answer:\nDo it"
    assert of(spark, A.answer_first(F.col("t")), t="plain") == "plain"


def test_plain_ascii(spark):
    assert of(spark, A.plain_ascii(F.col("t")), t="café – “x” ﬁ") == 'cafe - "x" fi'


def test_reply_parsing(spark):
    ok = of(spark, A.parse_reply(F.col("t")), t='```json\n{"answer": "a", "confidence": "low"}\n```')
    assert ok.answer == "a" and of(spark, A.parse_reply(F.col("t")), t="[1]") is None


def test_strict_and_tolerant_readers(spark, tmp_path):
    good, bad = '{"query_id": "a", "rating": "up", "comment": null}', '{"query_id": "b", "rating": "up", "comment": "", "extra": 1}'
    (tmp_path / "ok.jsonl").write_text(good + "\n\n")
    (tmp_path / "extra.jsonl").write_text(bad + "\n")
    (tmp_path / "torn.jsonl").write_text(good + '\n{"query_id": "c", "rat')
    assert jsonl.read_strict(spark, str(tmp_path / "ok.jsonl"), schemas.FEEDBACK).count() == 1
    with pytest.raises(Exception, match="unexpected fields: extra"):
        jsonl.read_strict(spark, str(tmp_path / "extra.jsonl"), schemas.FEEDBACK).collect()
    rows, torn = jsonl.read_tolerant(spark, str(tmp_path / "torn.jsonl"), schemas.FEEDBACK)
    assert rows.count() == 1 and torn.count() == 1
    assert jsonl.read_optional(spark, str(tmp_path / "none.jsonl"), schemas.QUERIES).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.bin").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "c.bin").write_bytes(b"  <!DOCTYPE html><p>")
    found = files.read_files(spark, str(tmp_path))
    rows = {r.path[-5:]: r for r in found.collect()}
    assert rows["a.bin"].suffix == ".pdf" and rows["c.bin"].is_html and rows["c.bin"].suffix == ".bin"
    assert files.unique_blobs(found).where("copies = 2").first().saved == 10
    pages = files.parse_pages(found, lambda b: [{"page_index": 0, "text": b.decode()}])
    assert pages.count() == 2


def test_fetcher_and_robots():
    calls = []

    def transport(url):
        calls.append(url)
        return (503, "") if len(calls) < 3 else (200, "ok")

    slept = []
    f = web.Fetcher(transport, web.RateLimiter(1.0, clock=lambda: 0.0, sleep=slept.append))
    assert f.get("u") == "ok" and f.get("u") == "ok" and len(calls) == 3 and f.hits == 1
    with pytest.raises(web.Blocked):
        web.Fetcher(lambda u: (429, ""), web.RateLimiter(1.0, sleep=lambda s: None)).get("u")
    gate = web.RobotsGate("bot", 200, "User-agent: *\nDisallow: /private\nCrawl-delay: 2")
    assert gate.allows("/x") and not gate.allows("/private/x") and gate.crawl_delay() == 2.0
    assert web.RobotsGate("bot", 404).allows("/x") and not web.RobotsGate("bot", 500).allows("/x")
    pages = {1: [{"id": 1}, {"id": 2}], 2: [{"id": 2}]}
    assert [x["id"] for x in web.paginate(lambda n: pages[n], "id")] == [1, 2]


def test_build_embeds_only_what_changed(spark, tmp_path):
    root, cache = str(tmp_path / "index"), spark.createDataFrame([], "content_hash string, embedding array<float>")
    rows = lambda *pairs: spark.createDataFrame([(k, t) for k, t in pairs], "chunk_id string, text string").withColumn("content_hash", F.sha2("text", 256))
    embedder = index.hash_embedder(4)
    assert build.update_index(spark, rows(("a", "x"), ("b", "y")), root, "1", cache, embedder).first()["new"] == 2
    second = build.update_index(spark, rows(("a", "x"), ("b", "z"), ("c", "w")), root, "2", cache, embedder).first()
    assert (second["new"], second["changed"], second["unchanged"], second["removed"]) == (1, 1, 1, 0)
    assert build.update_index(spark, rows(("a", "x")), root, "3", cache, embedder).first()["removed"] == 2
    assert [r.chunk_id for r in index.current(spark, root).collect()] == ["a"]
    assert index.verify(index.current(spark, root), 4).first()["wrong_width"] == 0


def test_article_build(spark):
    body = "Fault E:04 means ignition failed and the flame sensor must be cleaned before a reset. " * 4
    manifest_rows = spark.createDataFrame([("1", "BK2 guide", "u", "Baking", "Faults", "f", body, None, [], None, None)], schemas.MANIFEST)
    pages = build.article_pages(manifest_rows, LEX)
    assert pages.first().product_family == "OVEN" and pages.first().doc_type == "repairs"
    chunks, table = build.chunks_with_codes(pages, LEX)
    assert chunks.first().fault_codes == ["E04"] and table.first().code_key == "E04"


def test_predicate():
    assert cascade.predicate() is None
    with pytest.raises(ValueError):
        cascade.predicate(product_family="x' OR 1=1")


def test_evaluation_report(spark):
    q = spark.createDataFrame([("1", "What is E4?", "codes", None, None, "guide", "3", ["low"], [], None), ("2", "Who won?", "unanswerable", None, None, None, None, [], [], None)], schemas.QUESTIONS)
    log = spark.createDataFrame([("r1", "what is  e4?", ["c1"], "Low pressure", [1], "high", None, 900, None, 1), ("r2", "Who won?", ["c1"], "Not covered.", [], "low", None, 800, None, 2)], schemas.QUERIES + ", seq int")
    chunks = spark.createDataFrame([("c1", "Guide", "", "", "d1", "text", "4", None)], "chunk_id string, title string, source_url string, article_url string, doc_id string, label_source string, page_label string, page_range string")
    scored = evaluation.cases(q, log, chunks)
    rows = {r.id: r for r in scored.collect()}
    assert rows["1"].recall_hit and rows["1"].page_hit and rows["1"].citation_ok and rows["1"].answer_ok and rows["1"].refusal_ok is None
    assert rows["2"].refusal_ok and rows["2"].recall_hit is None
    report = {r.metric: r for r in evaluation.report(scored).collect()}
    assert report["p95_latency_ms"].value == 900 and report["refusal_on_unanswerables"].ok
    assert "p95_latency_ms" in evaluation.as_html(evaluation.report(scored))


def test_batches():
    assert index.batches_of([1, 1, 1], texts=2) == [[0, 1], [2]]
    assert index.batches_of([5, 9, 1], tokens=6) == [[0], [1], [2]]
    assert index.batches_of([]) == []


def test_first_by_and_owners(spark):
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "key string, seq int, v string")
    assert manifest.first_by(rows, ["key"], [F.col("seq")]).first().v == "a"
    att = spark.createDataFrame([("h", "x", 1), ("h", "y", 2), (None, "z", 3)], "sha256 string, attachment_id string, seq int")
    assert {r.attachment_id: r.is_duplicate_of for r in manifest.owners(att).collect()} == {"x": None, "y": "x", "z": None}


def test_corruption(spark):
    assert of(spark, C.looks_corrupt(F.col("t")), t="coHnignhe cptrinegss Abc") is True
    assert of(spark, C.looks_corrupt(F.col("t")), t="") is False


def test_streaming(spark, tmp_path):
    from lodestone.streaming import incremental

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"query_id": "a", "rating": "up", "comment": null}\n')
    seen = []
    stream = incremental.watch(spark, str(tmp_path / "in"), schemas.FEEDBACK)
    for _ in range(2):
        incremental.each_batch(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "ckpt")).awaitTermination(60)
    assert seen == [1]


def test_family_ties(spark):
    assert of(spark, classify.document_family(F.col("c"), F.lit(""), F.lit(""), LEX), c="Mixing and Baking") == "OVEN"
    assert of(spark, classify.query_family(F.col("c"), LEX), c="nothing") == UNKNOWN


def test_record_match_whole_texts(spark, tmp_path):
    from lodestone import catalogue

    start = "The same forty characters begin this text"
    spark.createDataFrame([(1, f"{start} of one"), (2, f"{start}  OF two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(101, f"{start} of two"), (102, f"{start} of three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.id: r.query_id for r in catalogue.record_match(spark, str(tmp_path)).collect()} == {"101": "r2", "102": None}


def test_bullets_only_where_lines_begin(spark):
    assert of(spark, T.article_markdown(F.lit("T"), F.col("b")), b="Set 220·240 V\n • one\n\n\n\n▪two") == "# T\n\nSet 220·240 V\n- one\n- two"


def test_signatures(spark):
    rows = [(b"MM\0*x", ".tif"), (b"GIF8x", ".gif"), (b"\xd0\xcf\x11\xe0", ".doc"), (b"none", None)]
    got = spark.createDataFrame(rows, "c binary, want string").select(T.detect_suffix(F.col("c")), "want").collect()
    assert all(a == b for a, b in got)
    html = [(b"  \n<!doctype html>", True), (b"<head>", False), (b" " * 300 + b"<html>", True)]
    assert all(a == b for a, b in spark.createDataFrame(html, "c binary, want boolean").select(T.looks_like_html(F.col("c")), "want").collect())


def test_best_code_is_the_first_cut(spark):
    hits = [("E04", "OVEN", f"d:p{p}:c{c}", "same words", False, 0) for p, c in ((10, "00"), (9, "100"), (9, "20"))]
    from lodestone.operators.codes import code_table

    df = spark.createDataFrame(hits, "code_key string, product_family string, chunk_id string, meaning string, in_table boolean, place int")
    assert code_table(df).first().chunk_id == "d:p9:c20"


def test_portal_pages(spark):
    listing = """<div class="cs-s"><h3 class="heading"><a href="/support/solutions/77">Baking &amp; co</a></h3><a title="Deck  ovens" href="/support/solutions/folders/5">Deck.. <span>3</span></a>
      <a href="/support/solutions/folders/6">Bread</a><a href="/support/solutions/folders/5">again</a></div><div class="cs-s x"><h3 class="accordion-heading"><a href="/support/solutions/78">Mixing</a></h3><a href="/support/solutions/folders/9">Dough</a></div>"""
    got = of(spark, portal.folders(F.col("h")), h=listing)
    assert [(x.id, x.name, x.category, x.category_id) for x in got] == [("5", "Deck ovens", "Baking & co", "77"), ("6", "Bread", "Baking & co", "77"), ("9", "Dough", "Mixing", "78")]
    page = """<div class="breadcrumb"><a href="/support/solutions/77">Baking</a><a href="/support/solutions/folders/5">Deck ovens</a></div><h2 class="heading">No <span>Print</span>heat</h2><p>Modified on: 3 May 2024 <br></p>
      <article class="article-body"><p>First do</p><p>this.</p></article><a href="/helpdesk/attachments/12" title="long name.pdf">long..</a><a href="/helpdesk/attachments/12">x</a><a href="https://s3/img.png">i</a>"""
    a = of(spark, portal.article(F.col("h")), h=page)
    assert (a.title, a.body_text, a.category, a.folder, a.folder_id, a.updated_at) == ("No heat", "First do this.", "Baking", "Deck ovens", "5", "3 May 2024")
    assert [(x.id, x.filename) for x in a.attachments] == [("12", "long name.pdf")]
    assert of(spark, portal.article(F.col("h")), h="<p>login</p>") is None
    links = '<div class="article-title"><a href="/support/solutions/articles/3-a">A b</a></div><a class="c-link" href="/support/solutions/articles/4">C</a><a href="/support/solutions/articles/8">no</a>'
    assert [(x.id, x.title) for x in of(spark, portal.article_links(F.col("h")), h=links)] == [("3", "A b"), ("4", "C")]


def test_embedding_calls(spark):
    class RateLimitError(Exception):
        pass

    class BadRequestError(Exception):
        status_code = 500

    waits, tries = [], []

    def client(texts):
        tries.append(texts)
        if len(tries) < 3:
            raise RateLimitError
        return [(1, [1.0]), (0, [0.0])]

    assert embedding.vectors(client, ["a", "b"], waits.append) == [[0.0], [1.0]] and waits == [2.0, 4.0]
    with pytest.raises(embedding.EmbeddingFailed, match="after 1 "):
        embedding.vectors(lambda t: (_ for _ in ()).throw(BadRequestError()), ["a"], waits.append)
    assert list(embedding.requests(["x"] * 300)) == [(0, 256), (256, 300)] and list(embedding.requests(["y" * 600_000] * 2)) == [(0, 1), (1, 2)]
    long = "z" * 40_000
    out = embedding.embed(spark.createDataFrame([(1, long), (2, None)], "id int, text string"), lambda texts: [(i, [float(len(t))]) for i, t in enumerate(texts)]).collect()
    assert {r.id: r.embedding[0] for r in out} == {1: float(int(8191 * T.CHARS_PER_TOKEN)), 2: 0.0} and out[0].text is not None


def test_triage_report():
    row = {"documents": 1, "failed": 0, "pages": 4, "labelled": 2, "plain_text": 1, "diagram_heavy": 1, "scanned": 2, "pct_plain_text": 0.25, "pct_diagram_heavy": 0.25, "pct_scanned": 0.5, "offsets": "0=1"}
    assert "Warning" in triage.report(row) and "50.0%" in triage.report(row)
    with pytest.raises(ValueError, match="no documents"):
        triage.report({**row, "documents": 0})


def test_content_and_lookup(spark):
    assert of(spark, projection.has_content(F.col("t"), F.array()), t=" ") is False and of(spark, projection.has_content(F.col("t"), F.array(F.lit(1))), t="") is True
    index_ = spark.createDataFrame([("a", "x", [1.0]), ("b", "y", [2.0])], "chunk_id string, text string, embedding array<double>")
    assert projection.lookup(index_, "b").collect()[0].asDict() == {"chunk_id": "b", "text": "y"}
