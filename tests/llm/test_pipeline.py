"""The pipeline's stages against plain versions of them."""

import hashlib
import itertools
import re

import corpus_pipeline
import duckdb
import pytest
import xxhash
from specweave.llm import mixing, quality, simhash
from specweave.scratch import written
from test_operators import roots


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def stages(spark, small):
    """The output of each stage but the last."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, small), "test-stage")
        out.append(docs)
    return out


def pairs(df):
    return sorted((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())


def test_quality_keeps_what_is_accepted(spark, small, stages):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    accepted = {r["doc_id"] for r in quality.judged(docs, labels).where("accepted").collect()}
    assert [k for k, _ in pairs(stages[0])] == sorted(accepted)
    assert all(x.columns == docs.columns for x in stages)


def test_exact_and_near(stages):
    first = {}
    for key, text in pairs(stages[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), key)
    rows = pairs(stages[1])
    assert sorted(first.values()) == [k for k, _ in rows]
    sets = [shingles(t) for _, t in rows]
    like = {(i, j): len(a & b) / len(a | b) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if a & b}
    strict, loose = ([p for p, x in like.items() if x >= least] for least in (0.8, 0.7))
    assert strict
    kept = {k for k, _ in pairs(stages[2])}
    must = {rows[i][0] for i, r in enumerate(roots(len(rows), strict)) if r != i}
    may = {rows[i][0] for i, r in enumerate(roots(len(rows), loose)) if r != i}
    gone = {k for k, _ in rows} - kept
    assert must <= gone <= may  # the similarity is an estimate, and takes some pairs just below 0.8


def test_near_takes_what_the_tree_links(spark):
    phrase = " ".join(f"w{i}" for i in range(11))
    texts = {1: f"{phrase} " * 50, 2: f"{phrase} " * 50 + " ".join(f"x{i}" for i in range(12)), 3: "other words stand here alone", None: f"{phrase} " * 50 + "y", 5: None}
    assert len(shingles(texts[1]) & shingles(texts[2])) / len(shingles(texts[1]) | shingles(texts[2])) < 0.6
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    op1 = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs.where("doc_id is not null")).collect()}
    assert op1 == {1: 1, 2: 1, 3: 3, 5: 5}
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 3, 5]


def test_mix_and_encoding(spark, small, stages, tmp_path):
    stages[2].write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = {k: taken // size for k, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall() if size and taken}
    got = {r["doc_id"]: r["count"] for r in stages[3].where("trim(text) <> ''").groupBy("doc_id").count().collect()}
    assert got == want
    text = dict(pairs(stages[2]))
    result = corpus_pipeline.run(spark, small).collect()
    assert sorted(r["doc_id"] for r in result) == sorted(k for k, _ in pairs(stages[3]))
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in result)
