import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.config import Settings, load_settings, resolve
from pagewright.operators import chunking, evaluation, images, parsing, retrieval, statistics, tables, vectors
from pagewright.plans.answering import answer, embed_chunks, judge, retrieve
from pagewright.plans.ingest import missing_vectors, registry_rows, reingest, text_and_table_chunks
from pagewright.providers import HashEmbedder, Limiter, Provider, applied, asked, batches_within, cached, with_retries
from pagewright.sources import store

SENTENCE = "One two three four five six seven eight nine ten. "


def test_fold_keeps_every_word_and_its_budget():
    words = [f"w{i}" for i in range(1200)]
    sentences = [" ".join(words[i : i + 10]) + "." for i in range(0, 1200, 10)]
    texts = [" ".join(sentences), "\n\n".join(" ".join(sentences[i : i + 10]) for i in range(0, 120, 10)), " ".join(words), "\n".join(" ".join(sentences[i : i + 5]) for i in range(0, 120, 5))]
    for text in texts:
        pieces = chunking.fold_text(text)
        seen = list(dict.fromkeys(w.strip(".") for p in pieces for w in p.split()))
        assert seen == words and all(chunking.estimate(p) <= 400 + 330 for p in pieces) and len(pieces) > 3
    assert chunking.fold_text("short") == ["short"] and chunking.fold_text(" \n ") == []


def test_fold_by_literal_cases():
    numbered = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    tail = lambda text, n=38: " ".join(text.split()[-n:])
    # Lines are joined by one line end again, and a new piece begins with the last 38 words before it.
    a, b, c = (numbered(x, 150) for x in "abc")
    assert chunking.fold_text(f"{a}\n{b}\n{c}") == [a, f"{tail(a)}\n{b}", f"{tail(b)}\n{c}"]
    # Paragraphs are joined by a blank line; short ones are repeated whole.
    a, b, c = numbered("a", 250), numbered("b", 3), numbered("c", 20)
    assert chunking.fold_text(f"{a}\n\n{b}\n \n{c}") == [f"{a}\n\n{b}\n\n{c}"[: len(f"{a}\n\n{b}")], f"{b}\n\n{c}"]
    # Estimates are rounded down per unit: 110 sentences of three words count 3 each, and 330 is the budget.
    sentences = [f"s{i} is short." for i in range(150)]
    assert chunking.fold_text(" ".join(sentences)) == [" ".join(sentences[:110]), " ".join(sentences[109:])]
    # After an oversized paragraph nothing is repeated.
    assert chunking.fold_text(f"head\n\n{numbered('w', 400)}\n\nend") == ["head", numbered("w", 400)[: len(numbered("w", 253))], " ".join(f"w{i}" for i in range(215, 400)), "end"]


def test_chunks_of_elements(spark):
    rows = [("d", 1, 0, "text", SENTENCE * 60), ("d", 1, 1, "text", None), ("d", 2, 0, "text", "tail"), ("d", 1, 5, "table", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("d", 1, 6, "table", "| A | b |\n| --- | --- |\n| 1 | 2 |")]
    got = {r.chunk_id: r for r in text_and_table_chunks(spark.createDataFrame(rows, "doc_id string, page int, elem_idx int, type string, content string")).collect()}
    assert {"d_p1_t0", "d_p1_t1", "d_p1_t2", "d_p1_tbl0", "d_p2_t0"} == set(got)
    assert got["d_p1_tbl0"].prev_chunk_id == "d_p1_t2" and got["d_p1_tbl0"].next_chunk_id == "d_p2_t0" and got["d_p1_t0"].prev_chunk_id is None


def test_tables(spark):
    df = spark.createDataFrame([(1, [["a", "b"], ["1"]]), (2, [["a"]]), (3, [["a", ""], ["", ""], [None, ""]]), (4, None)], "id int, cells array<array<string>>")
    got = {r.id: (r.ok, r.md) for r in df.select("id", tables.grid_ok(F.col("cells")).alias("ok"), tables.grid_to_markdown(F.col("cells")).alias("md")).collect()}
    assert got[1] == (True, "| a | b |\n| --- | --- |\n| 1 |  |") and not got[2][0] and not got[3][0] and not got[4][0]
    html = spark.createDataFrame([("<TABLE><TR><TH>x</TH><TH><b>y</b></TH></TR><TR><TD>1</TD><TD> 2 </TD></TR></TABLE>",), ("<p>no</p>",)], "h string")
    assert [r.m for r in html.select(tables.html_to_markdown(F.col("h")).alias("m")).collect()] == ["| x | y |\n| --- | --- |\n| 1 | 2 |", None]
    big = "| name | value |\n| --- | --- |\n" + "\n".join(f"| row {i} | {i} |" for i in range(200))
    pieces = spark.createDataFrame([(big,), ("| only | head |\n" + "| x |" * 400,)], "t string").select(tables.split_table(F.col("t"), 200).alias("p")).collect()
    assert all(p.startswith("| name | value |\n| --- | --- |\n") and sum(len(x) // 4 for x in p.split("\n")[2:]) + len("| name | value |\n| --- | --- |") // 4 <= 200 for p in pieces[0].p)
    assert [x for p in pieces[0].p for x in p.split("\n")[2:]] == big.split("\n")[2:] and len(pieces[1].p) == 1
    # Rows that equal the header stay, blank lines too; the header may be the second line, and what is before it is a row.
    again = "| name | value |\n" + "\n".join(["| name | value |", "", *(f"| row {i} | {i} |" for i in range(120))] * 2)
    second = "1 | 2\nname | value\n" + "\n".join(f"{i} | {i}" for i in range(200))
    got = [r.p for r in spark.createDataFrame([(again,), (second,), ("x" * 900,), (None,)], "t string").select(tables.split_table(F.col("t"), 200).alias("p")).collect()]
    assert [x for p in got[0] for x in p.split("\n")[2:]] == again.split("\n")[2:] and got[0][0].startswith("| name | value |\n| name | value |\n\n")
    assert [x for p in got[1] for x in p.split("\n")[1:]] == [second.split("\n")[0], *second.split("\n")[2:]] and all(p.startswith("name | value\n") for p in got[1])
    assert got[2] == ["x" * 900] and got[3] is None


def test_top_k_against_numpy_and_index_changes(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    m[5] = m[9]
    index = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in r]) for i, r in enumerate(m)] + [("null", None), ("zero", [0.0] * 8)], "chunk_id string, vector array<float>")
    queries = index.where("chunk_id in ('v005', 'v100')").withColumnRenamed("chunk_id", "query_id")
    got = vectors.top_k(queries, index, 5).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in ("v005", "v100"):
        s = unit @ unit[int(q[1:])]
        want = [f"v{i:03d}" for i in sorted(range(300), key=lambda i: (-round(s[i], 6), i))[:5]]
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert vectors.top_k(queries, index.where("false"), 5).collect() == []
    new = spark.createDataFrame([("v000", [3.0, 4.0]), ("v000", [1.0, 0.0])], "chunk_id string, vector array<float>")
    both = vectors.upsert(index, new)
    assert both.where("chunk_id = 'v000'").count() == 2 and both.count() == 303
    assert vectors.delete(both, new).count() == 301


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, type string, score double, rank int")


def test_search_steps(spark):
    dense = hits(spark, [("q", f"d{i}", "text", 0.9 - i / 100, i + 1) for i in range(6)])
    lexical = hits(spark, [("q", "d3", "text", 1.0, 1), ("q", "x1", "table", 0.8, 2), ("q", "x2", "image_ocr", 0.1, 3)])
    merged = retrieval.merge_hybrid(dense, lexical)
    got = {r.chunk_id: round(r.score, 3) for r in merged.collect()}
    assert got["d3"] == round((0.87 + 1) / 2, 3) and got["x1"] == 0.4 and got["d0"] == 0.9
    candidates = spark.createDataFrame([("q", "d3", "text", 0.5), ("q", "n1", "text", 0.4), ("q", "n2", "text", 0.3), ("q", "n3", "text", 0.2)], "query_id string, chunk_id string, type string, score double")
    lifted = {r.chunk_id: round(r.score, 3) for r in retrieval.anchor_topup(merged, candidates, 5).collect()}
    assert lifted["n1"] == 0.955 and lifted["n2"] == 0.975 and "n3" not in lifted and lifted["d3"] == 0.935
    pool = lexical.select("query_id", "chunk_id", "type", F.lit(0).alias("stage"), "rank").unionByName(spark.createDataFrame([("q", "t9", "table", 1, 1), ("q", "t8", "table", 1, 2)], "query_id string, chunk_id string, type string, stage int, rank int"))
    queries = spark.createDataFrame([("q",)], "query_id string")
    topped = {r.chunk_id: round(r.score, 3) for r in retrieval.type_topup(merged, pool, queries, ["table"], 5).collect()}
    assert topped["t9"] == 0.945 and "t8" not in topped
    top = retrieval.first_k(merged, 3)
    ensured = sorted(((r.n, r.chunk_id) for r in retrieval.ensure_type(top, merged, queries, ["table"], 3).collect()))
    assert ensured[:2] == [(1, "d3"), (2, "d0")] and ensured[2] == (3, "x1")


def test_anchors(spark, make_chunks):
    q = spark.createDataFrame([("a", 'where is "short" or "a longer phrase" said?'), ("b", 'phrase includes "BEAM line" and "something much longer"'), ("c", 'no "ab"'), ("d", "plain"), ("e", 'the figure "abcd"')], "query_id string, question string")
    got = {r.query_id: r for r in retrieval.intent(q).collect()}
    assert got["a"].anchor == "a longer phrase" and got["b"].anchor == "BEAM line" and got["c"].anchor is None and got["d"].preferred == [] and got["e"].preferred == ["image_ocr", "image_caption"]
    chunks = make_chunks([("c1", "The beam line is here"), ("c2", "beam of line"), ("c3", None), ("c4", "a longer PHRASE", {"type": "table"})])
    found = {(r.query_id, r.chunk_id): round(r.score, 4) for r in retrieval.anchor_candidates(retrieval.intent(q), chunks).collect()}
    assert found == {("b", "c1"): round(9 / 21 + 0.22, 4), ("a", "c4"): 1.04}


def test_pipeline_end_to_end(spark, make_chunks):
    chunks = make_chunks([(f"c{i}", f"The lens {i} has a thermal detector number {i}. It exceeds the beam.") for i in range(8)] + [("t", "| lens | table |", {"type": "table"}), ("bad", "lens", {"status": "failed"})])
    vectors_ = embed_chunks(chunks)
    assert vectors_.count() == 9 and missing_vectors(chunks, vectors_.where("chunk_id <> 'c0'")).count() == 1
    q = spark.createDataFrame([(1, "Which table names the lens?"), (2, "zzzz")], "query_id int, question string")
    found = retrieve(q, chunks, vectors_, 3)
    rows = found.collect()
    assert {r.n for r in rows if r.query_id == 1} == {1, 2, 3} and any(r.type == "table" for r in rows if r.query_id == 1)
    predictions = answer(q, found, chunks)
    data = spark.createDataFrame([(1, "Which table names the lens?", "table", "lens"), (2, "Which table names the lens?", "image", "beam")], "entry_id int, question string, slice string, expected_answer string")
    judged = judge(predictions, data).collect()
    assert {r.slice for r in judged} == {"image", "overall"} and len(judged) == 2


def test_parse_scores(spark):
    replies = ['{"faithfulness": 0.5, "relevancy": 1, "notes": "ok", "no_answer_correct": true}', '```json\n{"faithfulness": 1}\n```', "broken", '{"faithfulness": 1.5}']
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").select("i", evaluation.parse_scores(F.col("r"), F.lit(True)).alias("s")).orderBy("i").collect()
    assert (rows[0].s.faithfulness, rows[0].s.relevancy, rows[0].s.no_answer_correct) == (0.5, 1.0, True) and rows[1].s.faithfulness == 1.0 and rows[2].s.notes.startswith("Error") and rows[3].s.faithfulness == 0.0


def test_report(spark, tmp_path):
    j = spark.createDataFrame([("q1", "table", 0.2, 1.0, 0.5, 0.5, None, ""), ("q2", "no-answer", 1.0, 1.0, 1.0, 1.0, False, ""), ("q3", "odd", 1.0, 1.0, 1.0, 1.0, None, "ERROR")], "question string, slice string, faithfulness double, relevancy double, context_precision double, context_recall double, no_answer_correct boolean, notes string")
    m = evaluation.slice_metrics(j)
    text = evaluation.markdown_report(m, evaluation.report_examples(j, "question"))
    assert "| overall | all | 2 |" in text and "1. q1" in text and "1. q2" in text
    store.write_report_csv(m, str(tmp_path / "r"))
    back = {(r.slice, r.scope): r for r in store.read_report_csv(spark, str(tmp_path / "r")).collect()}
    assert back[("no-answer", "slice")].false_positive_rate == 1.0 and back[("table", "slice")].no_answer_accuracy == 0.0


def test_image_features_and_routing(spark):
    solid, noise = np.full((64, 64), 200.0), np.random.default_rng(1).integers(0, 256, (64, 64)).astype(float)
    stripes = np.tile(np.repeat([0.0, 255.0], 4), 8)[:, None] * np.ones((1, 64))
    f = {n: images.gray_features(a) for n, a in (("solid", solid), ("noise", noise), ("stripes", stripes))}
    assert f["solid"][7] == 0 and f["solid"][9] == "f" * 16 and f["noise"][3] > 0.9 and f["stripes"][6] > 0.05
    # One side under 20 pixels is enough, also after scaling down to 512: 2000 x 60 becomes 512 x 15.
    assert images.gray_features(np.full((60, 2000), 9.0))[:3] == (2000, 60, 15) and images.gray_features(np.full((19, 400), 9.0))[2] == 19
    # Of the 62 x 62 inner pixels of a checkerboard of cells of four, those at a left or upper cell border are edges: 15 columns or 15 rows.
    board = np.kron(np.indices((16, 16)).sum(0) % 2, np.ones((4, 4))) * 255
    assert images.gray_features(board)[5] == (15 * 62 * 2 - 15 * 15) / 62**2
    ramp = np.tile(np.arange(1024.0) // 4, (600, 1))
    assert np.abs(images.resized(ramp, 300, 512) - np.tile((np.arange(1024) // 4).reshape(-1, 2).mean(1), (300, 1))).max() <= 1
    df = spark.createDataFrame([(4, 4, bytes(16)), (4, 4, b"x"), (None, 1, None)], "w int, h int, p binary")
    rows = df.select(images.raw_gray_features(F.col("w"), F.col("h"), F.col("p")).alias("f")).select("f.*", images.image_class(F.col("f")).alias("c")).collect()
    assert rows[0].c == "text_scan" and rows[1].ahash is None and rows[1].c == "chart"
    small = spark.createDataFrame([("d", i, 100, 100, "aa") for i in range(3)] + [("d", 3, 40, 40, "bb"), ("d", 4, 300, 300, "aa")], "doc_id string, image_index int, width int, height int, ahash string")
    assert {r.image_index for r in images.low_information(small).collect()} == {0, 1, 2, 3}
    imgs = spark.createDataFrame([("d", 1, 0, "photo", "txt", "cap", False, False, None), ("d", 1, 1, "text_scan", "txt", "cap", False, False, None), ("d", 1, 2, "text_scan", "txt", "cap", True, True, None), ("d", 1, 3, "chart", " ", None, True, True, "low-info"), ("d", 1, 4, "text_scan", "", None, True, True, None), ("d", 1, 5, "table_scan", "| a | b |\n" * 400, None, False, False, None)], "doc_id string, page int, image_index int, image_type string, text string, caption string, ocr_failed boolean, catastrophic boolean, skip_reason string").withColumn("ocr_reason", F.lit("chars=1<50"))
    got = {r.chunk_id: r for r in images.image_chunks(imgs).collect()}
    assert sorted(x for x in got if "_i5_" not in x) == ["d_p1_i0_cap", "d_p1_i0_ocr", "d_p1_i1_ocr", "d_p1_i2_cap", "d_p1_i2_ocr", "d_p1_i3_fail", "d_p1_i4_fail"]
    assert {"d_p1_i5_table", "d_p1_i5_table_1"} <= set(got) and got["d_p1_i5_table"].table_source == "ocr" and got["d_p1_i5_table"].type == "table"
    assert got["d_p1_i2_ocr"].processing_status == "failed" and got["d_p1_i3_fail"].type == "image_caption" and got["d_p1_i4_fail"].content == "[Image processing failed: text_scan on page 1]"


def test_ingest_as_one_plan(spark):
    from pagewright.plans.ingest import ingest
    from pagewright.schemas import IMAGES

    rng = np.random.default_rng(2)
    noise, flat = bytes(rng.integers(0, 256, 4096, dtype=np.uint8)), bytes([200]) * 4096
    good = "80\x1f" + "recognised words of a picture that says something " * 4
    pictures = [("d1", 2, 0, 64, 64, noise, good), ("d2", 1, 0, 64, 64, noise, good), ("d1", 3, 1, 64, 64, flat, ""), ("d1", 3, 2, 10, 10, bytes(100), None)]
    elements = [("d1", 1, 0, "text", "Table 1: values\n\nSome text."), ("d1", 1, 1, "table", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("d2", 1, 0, "text", "Other text.")]

    class Down(Provider):
        backoff = 0.0

        def reply(self, texts):
            raise RuntimeError("no vision")

    make = lambda captioner=None: ingest(spark.createDataFrame(elements, "doc_id string, page int, elem_idx int, type string, content string"), spark.createDataFrame(pictures, IMAGES), captioner=captioner)
    done = make()
    got = {r.chunk_id: r for r in done.chunks.collect()}
    assert set(got) == {"d1_p1_t0", "d1_p1_tbl0", "d2_p1_t0", "d1_p2_i0_cap", "d1_p2_i0_ocr", "d2_p1_i0_cap", "d2_p1_i0_ocr", "d1_p3_i1_fail", "d1_p3_i2_fail"}
    assert got["d1_p1_tbl0"].content.startswith("Table 1: values\n") and got["d1_p1_t0"].metadata.next_chunk_id == "d1_p1_tbl0"
    assert got["d1_p2_i0_ocr"].metadata.ocr_confidence == 80.0 and got["d1_p3_i1_fail"].metadata.vision_error == "blank/uniform" and got["d1_p3_i2_fail"].metadata.processing_status == "failed"
    registry = {r.doc_id: r for r in done.registry.collect()}
    assert registry["d1"].image_caption == 2 and registry["d1"].errors == 0 and registry["d2"].pages == 1
    failed = make(Down())
    assert {(r.doc_id, r.page, r.error) for r in failed.errors.collect()} == {("d1", 2, "RuntimeError: no vision"), ("d2", 1, "RuntimeError: no vision")}
    assert {r.chunk_id for r in failed.chunks.where("type = 'image_ocr'").collect()} == {"d1_p2_i0_ocr", "d2_p1_i0_ocr", "d1_p3_i2_fail"} and {r.doc_id: r.errors for r in failed.registry.collect()} == {"d1": 1, "d2": 1}


def test_store(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert [r.a for r in store.read_json_lines(spark, str(p), "a int").collect()] == [1, 2]
    assert [r.line for r in store.unreadable_lines(spark, str(p), "a int").collect()] == ["not json"]
    with pytest.raises(Exception):  # noqa: B017
        store.read_json_lines(spark, str(p), "a int", strict=True).collect()
    t = str(tmp_path / "t")
    store.replace_table(spark.range(3), t)
    store.replace_table(store.current(spark, t).where("id > 0"), t)
    assert store.current(spark, t).count() == 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.pdf").write_bytes(b"1")
    (tmp_path / "f" / "b.txt").write_bytes(b"1")
    assert store.files_by_pattern(spark, str(tmp_path / "f")).count() == 1


def test_reingest(spark):
    schema = "doc_id string, chunk_id string"
    old = spark.createDataFrame([("d", "d_p1_t0"), ("d_v2", "d_v2_p1_t0"), ("e", "e_p1_t0")], schema)
    new = spark.createDataFrame([("d", "d_p1_t0"), ("n", "n_p1_t0")], schema)
    assert sorted(map(tuple, reingest(old, new).collect())) == sorted([("d", "d_p1_t0"), ("d_v2", "d_v2_p1_t0"), ("e", "e_p1_t0"), ("d_v3", "d_v3_p1_t0"), ("n", "n_p1_t0")])
    assert reingest(old, new, "overwrite").count() == 4


def test_parsing(spark):
    pages = spark.createDataFrame([("d", 1, "One block.\n\nTwo-\nthree"), ("d", 2, "  ")], "doc_id string, page int, content string")
    assert [(r.elem_idx, r.content) for r in parsing.text_elements(pages).collect()] == [(0, "One block."), (1, "Twothree")]
    files = spark.createDataFrame([("d", "img-012-003.png"), ("d", "img-012-003-smask.png"), ("d", "other.png")], "doc_id string, path string")
    assert [(r.image_index, r.page) for r in parsing.listed_images(files).orderBy("path").collect()] == [(0, 12), (1, 1)]
    cover = statistics.page_coverage(spark.createDataFrame([("a", 1, "x" * 2000), ("b", 1, "x")], "doc_id string, page int, content string"))
    assert {r.doc_id: r.accepted for r in cover.collect()} == {"a": True, "b": False}
    text = lambda d, c: (d, 1, 0, c)
    schema = "doc_id string, page int, elem_idx int, content string"
    mixed = parsing.with_fallback(spark.createDataFrame([text("a", "p"), text("b", "p")], schema), spark.createDataFrame([text("a", "q"), text("b", "q")], schema), cover)
    assert {(r.doc_id, r.content) for r in mixed.collect()} == {("a", "p"), ("b", "q")}


def test_providers(spark, tmp_path):
    class Failing(Provider):
        reply_type, backoff = "array<float>", 0.0

        def reply(self, texts):
            raise RuntimeError("down")

    class Slow(Provider):
        per_minute, most_items = 60 * 20 * 4, 1  # a call each 50 ms in each of four tasks

        def reply(self, texts):
            return [str(time.monotonic()) for _ in texts]

    assert batches_within([5, 5, 100, 1], 10, 9) == [range(0, 2), range(2, 3), range(3, 4)] and batches_within([]) == []
    calls = []
    assert with_retries(lambda: calls.append(1) or (_ for _ in ()).throw(ValueError()) if len(calls) < 2 else [1], sleep=lambda s: None) == [1]
    waits = []
    limiter = Limiter(60, clock=lambda: 0.0, sleep=waits.append)
    [limiter.wait() for _ in range(3)]
    assert waits == [1.0, 2.0] or waits == [1.0, 1.0]
    rows = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("b", "x y"), ("c", None)], "k string, t string")
    assert {r.error for r in asked(rows, Failing(), "k", "t").collect()} == {"RuntimeError: down"}
    known, new = applied(rows, HashEmbedder(8), "k", "t", spark.createDataFrame([("a", [1.0])], "k string, reply array<float>"))
    assert {r.k for r in new.collect()} == {"b", "c"} and known.count() == 3
    at = sorted(float(r.reply) for r in asked(spark.range(6).selectExpr("id", "'x' as t").coalesce(1), Slow(), "id", "t").collect())
    assert min(b - a for a, b in zip(at, at[1:])) > 0.04
    folder = f"file://{tmp_path}/cache"
    first = {r.k: r.reply for r in cached(rows, HashEmbedder(8), "k", "t", folder).collect()}
    assert set(first) == {"a", "b", "c"} and {r.k: r.reply for r in cached(rows, Failing(), "k", "t", folder).collect()} == first


def test_settings(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("top_k: 7  # few\nhybrid_enabled: false\nmodel_chat: ${CHAT}\nunknown: 1\n")
    s = load_settings(str(p), {"CHAT": "m"})
    assert (s.top_k, s.hybrid_enabled, s.model_chat) == (7, False, "m") and resolve({"a": ["${NO}"]}, {}) == {"a": [""]}
    with pytest.raises(ValueError):
        Settings(index_backend="other")


def test_registry(spark, make_chunks):
    chunks = make_chunks([("d1_p1_t0", "x"), ("d1_p1_i0_ocr", "y", {"type": "image_ocr"})]).withColumn("metadata", F.struct("metadata.*", F.lit(True).alias("ocr_failed"), F.lit(False).alias("vision_used")))
    row = registry_rows(chunks, spark.createDataFrame([("d1",)], "doc_id string")).first()
    assert (row.text, row.image_ocr, row.ocr_failure_rate, row.errors) == (1, 1, 1.0, 1)
