"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from specweave.llm import bpe, embedding, exact, langid, mixing, quality, secret_scan, sharding, simhash, substring

LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, "a b c d", "en", "s1", 7, "x"), (2, "a  b\tc d", "en", "s1", 7, "x"), (2, "a  b\tc d", "en", "s1", 7, "x"), (3, None, None, None, None, None),
    (4, "", "fr", "s2", 0, "y"), (None, "a b c d", "en", "s1", 7, None), (5, LONG, "fr", "s2", len(LONG), "z"), (6, LONG, "fr", None, len(LONG), "z"),
    (7, "   ", "de", "", 3, "q"), (8, "1234 5678 !!", "de", "s3", 12, "q"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"
CLASH = ["id", "n", "fp", "shard", "spans", "component_id", "target", "score", "kept", "a", "b", "u", "v", "leaf", "y", "rep", "size_", "sha", "maybe", "row", "least", "f0", "_b_id", "_u_id"]
HELPERS = ["_x_sha", "_x_maybe", "_X_row", "_m_tie", "_m_copies", "_m_copy", "_s_gone", "_q_1", "_q_4", "a.b", "c`d"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (99, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "simhash": lambda d: simhash.near_groups(d),
    "substring": lambda d: substring.deduped(d),
    "secrets": lambda d: secret_scan.secrets(d),
    "shards": lambda d: sharding.sharded(d, 3),
    "packed": lambda d: sharding.packed(d, 600_000),
    "mix": lambda d: mixing.mixed(d),
    "language": lambda d: langid.languages(d, langid.train(d)),
    "bpe": lambda d: bpe.encoded(d, public_tokenizers.path(bpe.VOCABULARY), with_ids=True),
    "exact": lambda d: exact.exact_groups(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(name, docs, none):
    ids = sorted((r[0] is None, r[0] or 0) for r in ROWS)
    got = OPERATORS[name](docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == ids
    assert OPERATORS[name](none).count() == 0


def test_quality_rows(docs, none, labels):
    assert quality.judged(docs, labels).count() == len(ROWS)
    assert quality.judged(none, labels).count() == 0
    flat = quality.judged(docs, labels.where("false")).collect()
    assert all(r["score"] == 0.5 and r["accepted"] for r in flat)
    assert quality.keep_good(docs, labels.where("false")).columns == docs.columns


def test_pass_through_keeps_columns(docs, none):
    for stage in (exact.drop_repeats, simhash.drop_near, mixing.mix):
        assert stage(docs).columns == docs.columns
        assert stage(none).count() == 0


def test_pass_through_with_maps_and_helper_names(docs, labels):
    many = docs.withColumns({c: F.lit("own") for c in HELPERS}).withColumns({"tags": F.create_map(F.lit("k"), F.col("n_chars")), "deep": F.array(F.struct(F.create_map(F.lit(1), F.lit("x")).alias("m")))})
    for stage in (exact.drop_repeats, simhash.drop_near, simhash.drop_near_texts, mixing.mix, lambda d: quality.keep_good(d, labels)):
        got = stage(many)
        assert got.schema.names == many.schema.names
        rows = got.collect()
        assert rows and all(r["_x_sha"] == r["_q_4"] == r["c`d"] == "own" and r["deep"][0]["m"] == {1: "x"} for r in rows)


def test_near_texts_edges(docs, none):
    got = {}
    for r in simhash.near_texts(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert got == {1: {1}, 2: {1}, 3: {3}, 4: {3}, None: {1}, 5: {5}, 6: {5}, 7: {3}, 8: {8}}
    assert simhash.near_texts(none).count() == 0


def test_long_runs(spark):
    """Texts that the tokeniser or a backtracking pattern would choke on, with a bound on the time."""
    import time

    coder = bpe._coder(open(public_tokenizers.path(bpe.VOCABULARY), "rb").read(), public_tokenizers.PATTERN)[0]
    for text in (" " * 1_000_000, " " * 5_000_000 + "x", "a" + "\n" * 1_000_000 + " b", "\u3000" * 900_000):
        ids = bpe.text_ids(coder, text, public_tokenizers.PATTERN)
        assert coder.decode_bytes(ids) == text.encode()
    for text in ("-" * 10_000 + "1", "-".join(["slug"] * 200) + "-10", "aB-" * 3000 + "9", "/_" * 5000 + "x1", "token" + " " * 100_000 + "secret=" * 5000):
        began = time.perf_counter()
        secret_scan.base_spans(text)
        secret_scan.entropy_spans(text)
        assert time.perf_counter() - began < 5
    rows = [(1, " " * 1_000_000), (2, "-".join(["slug"] * 200) + "-10")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bpe.encoded(df, public_tokenizers.path(bpe.VOCABULARY)).count() == secret_scan.secrets(df).count() == 2


def test_long_space_is_cut_where_the_pattern_cuts(monkeypatch):
    import random
    import re

    coder = bpe._coder(open(public_tokenizers.path(bpe.VOCABULARY), "rb").read(), public_tokenizers.PATTERN)[0]
    monkeypatch.setattr(bpe, "LONG_SPACE", re.compile(bpe.LONG_SPACE.pattern.replace("20000", "3")))
    rng, pad = random.Random(1), "x" * 20_000 + " "
    for _ in range(500):
        text = pad + "".join(rng.choices([" ", "\n", "\u3000", "\x1c", "a", "é", "1", "'s", "\u200b", "\t", "--"], k=rng.randint(1, 40)))
        assert bpe.text_ids(coder, text, public_tokenizers.PATTERN) == coder.encode_ordinary(text)


def test_letters_of_later_planes():
    assert len(langid.trigrams("\U000323a0\U000323a1")) == 2


def test_exact(docs):
    got = exact.exact_groups(docs).collect()
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in got if r["kept"])
    assert kept == [1, 3, 5, 7, 8]  # null and empty are one group, and so are the copies with other white space
    group = [r for r in got if r["keep_id"] == 1]
    assert {r["group_size"] for r in group} == {4} and sum(r["kept"] for r in group) == 1
    assert [r["text_sha256"] for r in got if r["doc_id"] == 3] == [hashlib.sha256(b"").hexdigest()]
    assert sorted(r["doc_id"] for r in exact.drop_repeats(docs).select("doc_id").collect()) == kept


def test_simhash(docs):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_groups(docs).collect()}
    zero = {k[0]: v for k, v in got.items() if k[1] == 0}
    assert zero == {3: 3, 4: 3, 7: 3}
    assert {v for k, v in got.items() if k[0] in (1, 2, None)} == {1}


def test_mix_of_copies(docs):
    rows = mixing.mixed(docs).collect()
    want = {}
    for r in rows:
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["n_copies"]
    got = {r["doc_id"]: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert all(r["n_copies"] <= 2 for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4, 7)} == {0}


def test_shards_hold_groups(docs):
    got = sharding.sharded(docs, 2).collect()
    assert {r["size"] for r in got if r["doc_id"] == 3} == {8}
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_embedding_edges(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, 0.0], 2), (7, [1.0, 0.0], 2), (8, [0.0, 1.0], 2), (9, [1.0], 2), (10, [float("inf"), 1.0], 2), (None, [1.0, 0.01], 1)]
    rows += [(20, [1.0, 0.0, 0.0], 0), (21, [1.0, 0.0, 0.0], 0), (22, [2.0, 0.1, 0.0], 0)]  # another length
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"], r["kept"]) for r in embedding.near_links(df, shared=1).collect() if r["vec_id"])
    assert got == [(1, 4, 1, True), (2, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 4, 1, False), (7, 4, 1, False), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (20, 2, 20, True), (21, 2, 20, False), (22, 2, 20, False)]
    assert embedding.near_links(df.where("false")).count() == 0


def test_language_without_letters(docs):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.languages(docs, langid.train(docs)).collect()}
    assert got[3] == got[4] == got[7] == got[8] == ("und", 0.0)
    assert got[5][0] == "fr"
    assert {r["lang_pred"] for r in langid.languages(docs, langid.train(docs.where("false"))).collect()} == {"und"}
