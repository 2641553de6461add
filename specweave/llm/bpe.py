"""Byte-level BPE encoding and decoding by a rank file.

``encode_words`` folds the ranked merges over the bytes of distinct words with Spark's higher-order functions and a
literal rank map. It gives the right ids, but not within the limits on whole corpora (see the README for figures): most distinct
words of a corpus are rare, each costs tens of microseconds, and the ids must then be joined back to every place.
``encoded`` is therefore in a free style: Arrow batches of whole texts, each piece of the pattern merged by rank, ids
decoded again by concatenating the binary pieces. It needs no shuffle, and its memory is one batch. The library matches the
pattern by recursion and breaks down on very long white space; such runs are cut out at the places where the public pattern
cuts them anyway, and merged as the single pieces that they are.

The rank file is read on the driver from a path that is a parameter, and sent to the executors (a vocabulary is a few MB).

Defined cases: null counts as empty text, which has no ids; lone surrogates cannot occur in a Spark string; rows that
share an id are separate rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BUCKETS = 1 << 14
NO_RANK = (1 << 31) - 1
#: Unicode white space, as the pattern's \s has it, in runs that are long for the library (it fails between 700,000 and 1,000,000).
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f) if piece}


@functools.cache
def _coder(packed: bytes, pattern: str):
    """Encoder, id texts and pieces; once a worker."""
    import tiktoken

    ranks = {base64.b64decode(p): int(r) for p, r in map(bytes.split, packed.splitlines())}
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), [str(i) for i in range(len(pieces))], pieces


def text_ids(coder, text: str, pattern: str) -> list[int]:
    """Ids of a text. Of white space before a word the public pattern leaves the last character to the word, and takes the others as one piece."""
    if pattern != public_tokenizers.PATTERN or len(text) < 20_000:
        return coder.encode_ordinary(text)
    ids, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += coder.encode_ordinary(text[at : run.start()])
        ids += coder._core_bpe.encode_single_piece(text[run.start() : end].encode())
        at = end
    return ids + coder.encode_ordinary(text[at:])


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) and, if asked for, ids: one row a document."""
    with open(path, "rb") as f:
        packed = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        coder, names, pieces = _coder(packed.value, pattern)
        for batch in batches:
            ids, counts, hashes, decoded = [], [], [], []
            for x in batch.column(1):
                own = text_ids(coder, x.as_py() or "", pattern)
                counts.append(len(own))
                hashes.append(hashlib.sha256(",".join([names[i] for i in own]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([pieces[i] for i in own])).hexdigest())
                if with_ids:
                    ids.append(own)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            more = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns + more, ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decoded_text(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): the pieces of each row's ids, concatenated. Null for a null list; an unknown id is an error."""
    with open(path, "rb") as f:
        packed = ids.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        pieces = _coder(packed.value, public_tokenizers.PATTERN)[2]
        for batch in batches:
            joined = [None if x is None else b"".join([pieces[i] for i in x]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined, pa.binary())], ["id", "bytes"])

    rows = ids.select(F.col(id_col).alias("id"), F.col(ids_col))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, bytes binary").withColumnRenamed("id", id_col)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once; lambda bodies have no common subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_words(words: DataFrame, path: str, word_col: str = "word") -> DataFrame:
    """(word, ids) for distinct words, each one match of the pattern; native.

    Bytes are held as characters U+0000 to U+00FF. The literal rank map is cut into small maps by a hash, since Spark
    searches a map from its start. The fold keeps the parts and the rank of each neighbouring pair.
    """
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in read_ranks(path).items():
        key = piece.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    ranks = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,int>>")  # folded to a literal

    def rank(x: Column) -> Column:
        return F.coalesce(F.element_at(F.get(ranks, F.pmod(F.crc32(x), F.lit(BUCKETS)).cast("int")), x), F.lit(NO_RANK))

    nothing = F.array().cast("array<int>")

    def merged(p: Column, r: Column, i: Column) -> Column:
        def put(new: Column) -> Column:
            left = F.when(i > 1, F.array(rank(F.concat(F.get(p, i - 2), new)))).otherwise(nothing)
            right = F.when(i + 1 < F.size(p), F.array(rank(F.concat(new, F.get(p, i + 1))))).otherwise(nothing)
            return F.struct(
                F.concat(F.slice(p, 1, i - 1), F.array(new), F.slice(p, i + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, 1, F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, F.size(r))).alias("r"),
            )

        return _let(F.concat(F.get(p, i - 1), F.get(p, i)), put)

    def step(state: Column, _: Column) -> Column:
        low = lambda m: F.when(m < NO_RANK, _let(F.array_position(state["r"], m).cast("int"), lambda i: merged(state["p"], state["r"], i))).otherwise(state)
        return _let(F.array_min(state["r"]), low)

    b = F.col("_t_bytes")
    n = F.length(b)
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: b.substr(i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(b.substr(i, F.lit(2))))
    fold = F.aggregate(F.sequence(F.lit(2), n), F.struct(parts.alias("p"), pairs.alias("r")), step, lambda s: F.transform(s["p"], rank))
    whole = rank(b)
    ids = F.when(n == 0, nothing).when((n == 1) | (whole < NO_RANK), F.array(whole)).otherwise(fold)
    return words.select(F.col(word_col).alias("word"), F.decode(F.col(word_col).cast("binary"), "ISO-8859-1").alias("_t_bytes")).select("word", ids.alias("ids"))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
