"""The pipeline's stages against plain versions, and on hard inputs."""

import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from gridjobs.llm import mixing, quality, tokens
from tests.llm.test_operators import DATA, DOCS, HARD, brute_components, brute_spans


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def rows_of(df):
    return sorted(map(repr, df.select(*pipeline.COLUMNS).collect()))


def test_quality_stage(spark, docs):
    kept = pipeline.quality(spark, docs, DATA)
    weights = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = [r["doc_id"] for r in docs.collect() if quality.score(r["text"], weights.astype("float32")) >= 0.5]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(good) and kept.columns == list(pipeline.COLUMNS)


def test_near_copies_stage(spark, docs):
    kept = pipeline.near_copies(spark, docs, DATA)
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_near_copies_keep_different_texts_of_one_id(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(60)) for w in "abcd")
    near = b + " end"
    rows = [
        (None, a), (None, c), (None, c), (None, near), (None, ""), (None, "  "), (None, None),  # near is a copy of 2's text
        (2, b), (5, d), (5, near), (7, c + " x"), (8, c + " y z"), (9, None), (9, ""), (9, ""),
        (10, "one two"), (10, "three four"), (11, "p q r s t u"), (11, "P q r s t u"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    kept = [(r["doc_id"], (r["text"] or "").lower() if r["doc_id"] == 11 else r["text"]) for r in pipeline.near_copies(spark, docs, DATA).collect()]
    want = [
        (None, a), (None, ""), (None, "  "), (None, None), (2, b), (5, d), (7, c + " x"), (9, None), (9, ""),
        (10, "one two"), (10, "three four"), (11, "p q r s t u"),
    ]
    assert sorted(map(repr, kept)) == sorted(map(repr, want))


def test_near_copies_keep_a_third_without_ids(spark, docs):
    some = docs.withColumn("doc_id", F.expr("case when doc_id % 3 = 0 then null else doc_id end"))
    kept = pipeline.near_copies(spark, some, DATA).collect()
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    ids = {}
    for r in docs.collect():
        ids.setdefault(r["text"], []).append(r["doc_id"])
    groups = sorted(want[ids[r["text"]][0]][1] for r in kept)
    assert groups == sorted({c for _, c in want.values()})


def test_secrets_stage(spark):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r["doc_id"]: r for r in pipeline.secrets(spark, data, DATA).collect()}
    changed = 0
    for r in data.collect():
        spans, text, at = brute_spans(r["text"]), "", 0
        for s in filter(None, spans.split(",")):
            a, b = map(int, s.split(":")[1:])
            if a >= at:
                text += r["text"][at:a] + "[secret]"
            at = max(at, b)
        want = text + r["text"][at:]
        changed += want != r["text"]
        assert out[r["doc_id"]]["text"] == want and out[r["doc_id"]]["n_chars"] == len(want)
    assert changed > 0


def test_mixing_stage(spark, docs):
    taken = {(r["doc_id"]): r["copies"] for r in mixing.mix_sources(docs).collect()}
    out = pipeline.mixing(spark, docs, DATA).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in out} == {i: n for i, n in taken.items() if n}


def test_mixing_stage_of_equal_rows_and_null_ids(spark, docs):
    some = docs.withColumn("doc_id", F.expr("case when doc_id % 3 = 0 then null else doc_id % 5 end")).withColumn("text", F.expr("case when source = 'web' then 'one text' else text end"))
    want = mixing.mix_sources(some).groupBy("source").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("words"))
    got = pipeline.mixing(spark, some, DATA).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("words"))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))


def test_whole_run(spark):
    """run() against plain Python on its own input: no stage of the pipeline is used for what is wanted."""
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    weights = quality.fit(table, spark.read.parquet(f"{DATA}/labels.parquet")).astype("float32")
    rows = [r for r in table.collect() if quality.score(r["text"], weights) >= 0.5]
    own = brute_components([(r["doc_id"], r["text"]) for r in rows])
    kept = []
    for r in rows:
        if own[r["doc_id"]][1] == r["doc_id"]:
            text, at = "", 0
            for a, b in (map(int, s.split(":")[1:]) for s in filter(None, brute_spans(r["text"]).split(","))):
                text += r["text"][at:a] + "[secret]" if a >= at else ""
                at = max(at, b)
            kept.append((r["doc_id"], text + r["text"][at:], r["source"]))
    documents = pd.DataFrame(kept, columns=["doc_id", "text", "source"])
    con = duckdb.connect()
    con.register("documents", documents)
    copies = {i: n for i, n in con.execute(f"select doc_id, copies from ({mixing.OP3_SQL})").fetchall() if n}
    library = Tokenizer.from_file(tokens.path_of("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t, _ in kept if i in copies}
    pieces = pipeline.run(spark, DATA).toPandas()
    assert set(pieces["doc_id"]) == set(copies)
    for i, some in pieces.groupby("doc_id"):
        covered = np.zeros(len(ids[i]), int)
        for r in some.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[i][r.start : r.start + r.length]) and r.doc_tokens == len(ids[i])
            covered[r.start : r.start + r.length] += 1
        assert (covered == copies[i]).all()


@pytest.mark.parametrize(("name", "stage"), pipeline.STAGES)
def test_stages_take_hard_and_empty_tables(spark, name, stage):
    extra = {c: F.lit(1) for c in ("size", "k", "copies", "found", "score", "sig", "_k")}
    hard = spark.createDataFrame(HARD, DOCS).withColumns(extra)
    out = stage(spark, hard, DATA).collect()
    if name == "secrets":
        assert len(out) == len(HARD)
    if name == "near_copies":
        assert sorted(str(r["doc_id"]) for r in out) == ["1", "2", "3", "5", "6", "7", "8", "None"]
    assert stage(spark, hard.limit(0), DATA).count() == 0
