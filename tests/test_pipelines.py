"""The service end to end, and the operators below it, over small files."""

import random

import pytest
from pyspark.sql import functions as F

from cuecraft.operators import entities as en
from cuecraft.operators import ner
from cuecraft.operators import retrieval as rt
from cuecraft.operators.neighbours import distinct_vectors, similar_pairs
from cuecraft.service import Service
from cuecraft.sources import files

SRT = "1\n00:00:01,000 --> 00:00:05,000\nThe kernel is a subspace. It is closed.\n\n2\n00:00:05,000 --> 00:00:09,000\nThe Gradient descent method finds the minimum.\n"


@pytest.fixture()
def service(spark, tmp_path):
    s = Service(spark, str(tmp_path / "store"), annotator=ner.gazetteer({"kernel": "CONCEPT", "gradient descent": "ALGORITHM", "kernels": "CONCEPT"}), threshold=0.83)
    s.init()
    (tmp_path / "lec.srt").write_text(SRT, encoding="utf-8")
    return s


def test_ingest_search_and_ask(service, tmp_path):
    path = str(tmp_path / "lec.srt")
    assert service.ingest(path, "c", "l", 10, 60, False, str(tmp_path / "debug.srt"))["chunks"] == 3
    point = service.catalog.table("lectures").where(F.col("text").contains("Gradient")).first()
    assert (point["course_id"], point["lecture_id"], point["start_us"], point["end_us"]) == ("c", "l", 5_000_000, 9_000_000)
    assert len(point["dense"]) == 64 and len(point["colbert"]) == len(point["sparse"]) == 6
    debug = (tmp_path / "debug.srt").read_text(encoding="utf-8")
    assert debug.startswith("1\n00:00:01,000 --> ") and debug.count("-->") == 3 and debug.endswith("\n\n")
    for kind in ("dense", "hybrid", "hybrid+colbert"):
        top = service.search("gradient minimum", kind, 1, reranking=kind == "hybrid").first()
        assert "Gradient" in top["text"] and top["video_location"]["lecture_id"] == "l" and top["video_location"]["start_time"] == "0:00:05"
    service.chat = lambda p: F.to_json(F.struct(p.alias("answer")))
    assert "1: The Gradient" in service.ask("gradient minimum", limit=1).first()["answer"]
    for bad, error in (((str(tmp_path / "none.srt"), "c", "l"), FileNotFoundError), ((path, "c", "l", 50, 10), ValueError)):
        with pytest.raises(error):
            service.ingest(*bad)
    assert service.ingest(path, "c", "l", 10, 60, False)["chunks"] == 3 and service.catalog.table("lectures").count() == 6
    assert service.about()["message"] and service.status()["collections"][0]["indexed_vectors_count"] == 6


def test_own_encoder_retriever_and_reranker(spark):
    class Constant:
        def encode(self, df, key, text, parts):
            return df.select(key, F.array(F.lit(1.0), F.length(text).cast("double")).alias("dense"), F.create_map(F.lit("t"), F.lit(1.0)).alias("sparse"))

    docs = spark.createDataFrame([(1, "aa"), (2, "aaaaaaaa")], "id bigint, text string")
    q = spark.createDataFrame([(7, "bbbbbbbb")], "query_id bigint, text string")
    assert rt.search(q, docs, "dense", 1, encoder=Constant()).first()["id"] == 2
    last = rt.search(q, docs, lambda q, c, k, pool, digits: c.select(F.lit(7).cast("bigint").alias("query_id"), "id", F.lit(1.0).alias("score"), F.col("id").cast("int").alias("rank")), 1, True,
                     encoder=Constant(), reranker=lambda p: p.withColumn("score", -F.length("d_text").cast("double")))
    assert last.first()["id"] == 1


def test_full_precision_and_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 1e-4]), (2, [1.0, 0.0]), (3, [1.0]), (4, [1.0, None])], "id bigint, dense array<double>")
    q = spark.createDataFrame([(9, [1.0, 1e-4])], "query_id bigint, dense array<double>")
    assert [r["id"] for r in rt.dense_topk(q, v, 5).orderBy("rank").collect()] == [1, 2]
    # To six digits both are 1, and 0.9999999 is not 1.
    assert rt.similar(q, v, 1.0 - 1e-12).count() == 1 and rt.similar(q, v, 1.0, 6).count() == 2


def test_late_interaction_over_a_collection(spark):
    rng = random.Random(5)
    unit = lambda: [rng.gauss(0, 1) for _ in range(4)]
    docs = [(i, [unit() for _ in range(rng.randrange(0, 4))]) for i in range(30)] + [(99, None)]
    queries = [(100 + i, [unit() for _ in range(3)]) for i in range(4)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {}
    for q, qs in queries:
        scores = sorted(((-sum(max(cos(a, b) for b in ds) for a in qs), d) for d, ds in docs if ds))[:3]
        want |= {(q, k + 1): d for k, (_, d) in enumerate(scores)}
    d = spark.createDataFrame(docs, "id bigint, colbert array<array<double>>").repartition(3)
    got = rt.maxsim_search(spark.createDataFrame(queries, "query_id bigint, colbert array<array<double>>"), d, 3).collect()
    assert {(r["query_id"], r["rank"]): r["id"] for r in got} == want


@pytest.mark.parametrize("threshold", [0.3, 0.83, 0.99])
def test_similar_pairs_are_all_pairs(spark, threshold):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(50)] + [(900, None), (901, [0.0] * 6)]
    df = spark.createDataFrame(rows, "seq bigint, dense array<double>")
    reps = distinct_vectors(df, "seq", "dense")
    assert reps.count() == 300
    unit = {r["rep"]: r["v"] for r in reps.collect()}
    want = {(a, b) for a in unit for b in unit if a < b and sum(x * y for x, y in zip(unit[a], unit[b])) >= threshold}
    got = [(r["a"], r["b"]) for r in similar_pairs(reps, threshold, pivots=6, block=40).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_repeated_vectors_join_the_nearer_entity_made_in_between(spark):
    v = [[1.0, 0.0], [0.9, 0.436], [0.75, 0.661], [0.9, 0.436], [1.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(v)), "seq bigint, dense array<double>")
    assert sorted(map(tuple, en.resolve(df, 0.85).collect())) == [(0, 0, True), (1, 0, False), (2, 2, True), (3, 2, False), (4, 0, False)]


def test_extraction_from_files(service, tmp_path):
    first = service.extract(str(tmp_path / "lec.srt"), "c", "l")
    assert (first["num_extracted_entities"], first["num_new_inserted_entities"], first["num_merged_entities"], first["failed_chunks"], first["language"]) == (2, 2, 0, 0, "en")
    (tmp_path / "notes.txt").write_text("The Kernel again. The kernels differ. KERNEL.", encoding="utf-8")
    second = service.extract(str(tmp_path / "notes.txt"), "c")
    assert (second["num_extracted_entities"], second["num_new_inserted_entities"], second["num_merged_entities"]) == (3, 1, 2)
    stored = {r["name"]: r for r in service.catalog.table("entities").collect()}
    assert set(stored) == {"kernel", "gradient descent", "kernels"} and len(stored["kernel"]["entity_instances"]) == 3
    assert [i["location"]["kind"] for i in stored["kernel"]["entity_instances"]] == ["video", "file", "file"]
    page = service.list_entities(include_aliases=True).first()
    assert page["total"] == 3 and page["label_distribution"] == {"ALGORITHM": 1, "CONCEPT": 2} and [e["name"] for e in page["entities"]] == ["gradient descent", "kernel", "kernels"]
    assert service.search_entities("gradient descent", 1).first()["entity"]["name"] == "gradient descent"
    (tmp_path / "page.pdf").write_text("<h1>Kernel</h1><p>The gradient descent.</p>", encoding="utf-8")
    assert service.extract(str(tmp_path / "page.pdf"), "c")["num_merged_entities"] == 2

    def fails(text):
        raise RuntimeError("no model")

    assert service.extract(str(tmp_path / "notes.txt"), "c", annotator=fails)["failed_chunks"] == 1
    with pytest.raises(FileNotFoundError):
        service.extract(str(tmp_path / "none.txt"), "c")
    service.delete("entities")
    with pytest.raises(LookupError):
        service.list_entities()


def test_transcription(spark, service, tmp_path):
    (tmp_path / "talk.mp3").write_bytes(b"x")
    segments = spark.createDataFrame([(2, 1.5, None, " there. "), (1, 0.0, 1.5, "Hello")], "seq bigint, start_s double, end_s double, text string")
    service.transcribe(str(tmp_path / "talk.mp3"), segments)
    assert (tmp_path / "talk.srt").read_text() == "1\n00:00:00,000 --> 00:00:01,500\nHello\n\n2\n00:00:01,500 --> 00:00:01,500\nthere.\n\n"
    assert (tmp_path / "talk.txt").read_text() == "Hello there."
    with pytest.raises(FileNotFoundError):
        service.transcribe(str(tmp_path / "none.mp3"), segments)
    with pytest.raises(ValueError):
        service.transcribe(str(tmp_path / "talk.mp3"))


def test_annotator_contract(spark):
    examples = [{"text": "A group.", "spans": [{"text": "group", "is_entity": True, "label": "CONCEPT", "reason": "named"}]}]
    asked = []
    ask = ner.chat_annotator(lambda p: asked.append(p) or "1. Ring | True | CONCEPT | x\n2. y | False | CONCEPT | x", {"CONCEPT": "an idea"}, examples)
    assert ask("A ring.") == [("ring", "CONCEPT")] and asked[0].endswith("Text: A ring.") and "CONCEPT: an idea" in asked[0]
    repeated = spark.createDataFrame([(1, "kernel"), (1, "kernel")], "chunk_id int, text string").withColumn("loc", F.lit("x"))
    assert ner.annotate(repeated, ner.gazetteer({"kernel": "CONCEPT"})).count() == 2


def test_texts_and_examples(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One. Two.", encoding="utf-8")
    assert [tuple(r) for r in files.read_txt(spark, str(tmp_path / "a.txt"), "c").collect()] == [("c", "a", "One. Two.")]
    (tmp_path / "ex.json").write_text('[{"text": "A group.", "spans": [{"text": "group", "is_entity": true, "label": "CONCEPT", "reason": "r"}]}]', encoding="utf-8")
    assert files.read_examples(spark, str(tmp_path / "ex.json")).first()["spans"][0]["label"] == "CONCEPT"
    (tmp_path / "d.json").write_text('{"CONCEPT": "an idea"}', encoding="utf-8")
    assert files.read_definitions(spark, str(tmp_path / "d.json")) == {"CONCEPT": "an idea"}


def test_empty_and_dirty_inputs(spark):
    from cuecraft.operators import chunking as ch

    kind = "lecture_id string, seq bigint, start_us bigint, end_us bigint, content string, part string, slice string, _p int"
    assert ch.chunk_cues(spark.createDataFrame([], kind)).count() == 0
    dirty = spark.createDataFrame([(None, 1, None, None, None, "a", "b", 1), ("l", None, 0, 5, "A. B", None, None, None), ("l", None, 0, 5, "A. B", None, None, None), ("", 3, 1, 2, "", "", "", 2)], kind)
    assert {r["lecture_id"] for r in ch.chunk_cues(dirty, 1, 5).collect()} == {None, "l", ""}
    mentions = spark.createDataFrame([(0, None), (1, [0.0]), (2, []), (3, None), (3, None)], "seq bigint, dense array<double>")
    assert sorted(map(tuple, en.resolve(mentions).collect())) == [(k, k, True) for k in range(4)]
    assert en.resolve(mentions.limit(0)).count() == 0
    q = spark.createDataFrame([(1, "a b"), (2, None)], "query_id bigint, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a")], "id bigint, text string")
    for kind in ("dense", "hybrid", "hybrid+colbert"):
        assert rt.search(q, docs.limit(0), kind, reranking=True).count() == 0
        assert {(r["query_id"], r["id"]) for r in rt.search(q, docs, kind).collect()} == {(1, 3)}
