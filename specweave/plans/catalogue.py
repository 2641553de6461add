"""Queries of the driver contract, each with SQL where SQL can express it. All run over whole tables.

Graphs: the star schema (region, nation, customer, supplier, part, with suppliers driving the parts they ship), and a
summary graph of regions, nations, market segments and priorities, which stays small at every scale and serves
path, cycle and centrality queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.functions import text as T
from specweave.operators import analysis as A
from specweave.operators import communities as C
from specweave.operators import context as X
from specweave.operators import entities as E
from specweave.operators import graph as G
from specweave.operators import knowledge_graph as K
from specweave.operators import replies as R
from specweave.operators import retrieval as V
from specweave.operators import rtl
from specweave.operators import tokenizing as K2
from specweave.plans import planning, samples
from specweave.scratch import written
from specweave.sinks import graphs as SG
from specweave.sinks import results as SR
from specweave.sources import documents as D
from specweave.sources import results as SO
from specweave.sources.settings import Settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return keep


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def six(c: str):
    return F.round(c, 6).alias(c)


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '\\s+'), lambda w: w <> '')"


def terms_sql(c: str, least: int = 2) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{{least},}}')"


def estimate_sql(c: str) -> str:
    return f"CASE WHEN length(coalesce({c}, '')) = 0 THEN 0 ELSE greatest(1, round_even(length(trim({c})) / 4.0, 0)::BIGINT, len({words_sql(c)})) END::BIGINT"


# ---- documents and chunks


@query(f"SELECT count(*) AS num_files, sum(length(text))::BIGINT AS chars, sum(len({words_sql('text')}))::BIGINT AS words, sum({estimate_sql('text')})::BIGINT AS tokens FROM documents")
def doc_stats(spark, sf):
    d = read(spark, sf, "documents")
    return d.agg(F.count("*").alias("num_files"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(T.words(F.col("text")))).cast("long").alias("words"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@query(f"SELECT doc_id, len({words_sql('text')})::BIGINT AS words, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))::BIGINT AS word_tokens FROM documents")
def doc_word_counts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("words"), F.regexp_count("text", F.lit(T.WORD)).cast("long").alias("word_tokens"))


@query(f"SELECT doc_id, {estimate_sql('text')} AS tokens FROM documents")
def token_heuristic(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


CHUNKS = f"c AS (SELECT doc_id, (i // 80)::INT AS chunk_idx, array_to_string(ws[i + 1:i + 100], ' ') AS chunk, len(ws[i + 1:i + 100])::INT AS n_words FROM (SELECT doc_id, {words_sql('text')} AS ws FROM documents), unnest(range(0, len(ws), 80)) t(i))"


@query(f"WITH {CHUNKS} SELECT * FROM c")
def chunk_words_100_20(spark, sf):
    return V.chunk_words(read(spark, sf, "documents"))


CONFIGS = "k(chunk_size, overlap) AS (VALUES " + ", ".join(f"({s}, {int(s * r)})" for s in V.SIZES for r in V.RATIOS) + ")"
MANY = f"c AS (SELECT doc_id, chunk_size, overlap, (i // (chunk_size - overlap))::INT AS chunk_idx, array_to_string(ws[i + 1:i + chunk_size], ' ') AS chunk, len(ws[i + 1:i + chunk_size])::INT AS n_words FROM (SELECT doc_id, {words_sql('text')} AS ws FROM documents), k, unnest(range(0, len(ws), chunk_size - overlap)) t(i))"


@query(f"WITH {CONFIGS}, {MANY} SELECT chunk_size, overlap, count(*) AS chunks, sum(n_words)::BIGINT AS words, sum(length(chunk))::BIGINT AS chars FROM c GROUP BY ALL")
def chunk_multi_config(spark, sf):
    c = V.chunk_many(read(spark, sf, "documents"))
    return c.groupBy("chunk_size", "overlap").agg(F.count("*").alias("chunks"), F.sum("n_words").alias("words"), F.sum(F.length("chunk")).alias("chars"))


@query()
def chunk_code_lines(spark, sf):
    return V.chunk_code(samples.table(spark, "rtl"), 30, 2)


def vocabulary() -> str:
    """A public rank file of this machine; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query()
def token_counts(spark, sf):
    return K2.token_counts(read(spark, sf, "documents"), vocabulary())


@query()
def chunk_tokens_1200_100(spark, sf):
    return K2.chunk_tokens(read(spark, sf, "documents"), vocabulary())


# ---- lexical and dense retrieval

QUESTIONS = [("q1", "the of and"), ("q2", "der die und"), ("q3", "tion ment elle"), ("q4", "zzzznothing here")]


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id string, query string")


Q_SQL = samples.values("q", QUESTIONS, "query_id, query")
TF = f"tf AS (SELECT doc_id, chunk_idx, term, count(*) AS tf FROM (SELECT doc_id, chunk_idx, unnest({terms_sql('chunk')}) AS term FROM c) GROUP BY ALL), idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM c)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term)"


@query(f"WITH {CHUNKS}, {TF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def tfidf_idf(spark, sf):
    c = V.chunk_words(read(spark, sf, "documents"))
    return V.inverse_frequencies(V.term_counts(c, ["doc_id", "chunk_idx"]), c.agg(F.count("*").alias("n"))).select("term", "df", six("idf"))


def _top_sql(keys: str, part: str) -> str:
    """Ranked similarities of chunks c by tf and idf; ``part``: extra columns that separate chunk tables."""
    p = f"{part}, " if part else ""
    same = "".join(f" AND {{0}}.{x.strip()} = {{1}}.{x.strip()}" for x in part.split(",") if x.strip())
    on = lambda a, b: same.format(a, b)
    using = f"{p}{keys}"
    return f"""qt AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({terms_sql('query')}) AS term FROM q) GROUP BY ALL),
qw AS (SELECT {p and ', '.join('idf.' + x.strip() for x in part.split(',')) + ', '}query_id, idf.term, tf * idf AS x FROM qt JOIN idf ON qt.term = idf.term),
qn AS (SELECT {p}query_id, sqrt(sum(x * x)) AS n FROM qw GROUP BY ALL),
w AS (SELECT {', '.join('tf.' + x.strip() for x in using.split(','))}, tf.term, tf * idf AS x FROM tf JOIN idf ON tf.term = idf.term{on('tf', 'idf')}),
cn AS (SELECT {using}, sqrt(sum(x * x)) AS n FROM w GROUP BY ALL),
hit AS (SELECT {', '.join('w.' + x.strip() for x in using.split(','))}, qw.query_id, sum(w.x * qw.x) AS dot FROM w JOIN qw ON w.term = qw.term{on('w', 'qw')} GROUP BY ALL),
sims AS (SELECT query_id, {', '.join('cn.' + x.strip() for x in using.split(','))}, coalesce(round(dot / (cn.n * qn.n), 12), 0) AS sim FROM hit JOIN cn USING ({using}) JOIN qn USING ({p}query_id)),
every AS (SELECT q.query_id, {', '.join('c.' + x.strip() for x in using.split(','))}, coalesce(sim, 0.0) AS sim FROM q CROSS JOIN c LEFT JOIN sims ON sims.query_id = q.query_id AND {' AND '.join(f'sims.{x.strip()} = c.{x.strip()}' for x in using.split(','))}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id{', ' + part if part else ''} ORDER BY sim DESC, {', '.join(x.strip() + ' DESC' for x in keys.split(','))})::INT AS rank FROM every)"""


TOP = _top_sql("doc_id, chunk_idx", "")


@query(f"WITH {Q_SQL}, {CHUNKS}, {TF}, {TOP} SELECT query_id, doc_id, chunk_idx, round(sim, 6) AS sim, rank FROM ranked WHERE rank <= 20")
def tfidf_topk(spark, sf):
    top = V.top_windows(read(spark, sf, "documents"), questions(spark), [(100, 20)])
    return top.select("query_id", "doc_id", "chunk_idx", six("sim"), "rank")


TF_MANY = f"tf AS (SELECT chunk_size, overlap, doc_id, chunk_idx, term, count(*) AS tf FROM (SELECT chunk_size, overlap, doc_id, chunk_idx, unnest({terms_sql('chunk')}) AS term FROM c) GROUP BY ALL), cc AS (SELECT chunk_size, overlap, count(*) AS n FROM c GROUP BY ALL), idf AS (SELECT chunk_size, overlap, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf JOIN cc USING (chunk_size, overlap) GROUP BY ALL)"


@query(f"WITH {Q_SQL}, {CONFIGS}, {MANY}, {TF_MANY}, {_top_sql('doc_id, chunk_idx', 'chunk_size, overlap')}, s AS (SELECT query_id, rank, chunk, chunk_size, overlap, (1.0::DOUBLE / rank + 1.0::DOUBLE / (abs(n_words - 100) + 1)) / 2 AS score FROM ranked JOIN c USING (chunk_size, overlap, doc_id, chunk_idx) WHERE rank <= 20) SELECT query_id, ordinal, md5(chunk) AS chunk_md5, chunk_size, overlap, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_size, overlap, rank)::INT AS ordinal FROM s) WHERE ordinal <= 10")
def rag_score_top10(spark, sf):
    got = V.rag_contexts(read(spark, sf, "documents"), questions(spark))
    return got.select("query_id", "ordinal", F.md5("text").alias("chunk_md5"), "chunk_size", "overlap", "rank", six("score"))


@query("WITH q AS (SELECT label::VARCHAR AS query_id, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY label), s AS (SELECT query_id, vec_id, round(list_dot_product(embedding::DOUBLE[], qv::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qv::DOUBLE[], qv::DOUBLE[]))), 12) AS sim FROM embeddings, q) SELECT query_id, vec_id, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id DESC)::INT AS rank FROM s) WHERE rank <= 10")
def dense_topk_cosine(spark, sf):
    e = read(spark, sf, "embeddings")
    q = e.groupBy(F.col("label").cast("string").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query_vec"))
    return V.nearest_vectors(e, q, 10).select("query_id", "vec_id", six("sim"), "rank")


@query()
def node_retrieval(spark, sf):
    nodes = star_nodes(spark, sf).withColumn("attributes", F.create_map(F.lit("name"), F.col("name"), F.lit("type"), F.col("type")))
    vecs = V.hashed_vectors(V.node_texts(nodes), "node_id")
    q = V.hashed_vectors(spark.createDataFrame([("asia",), ("region",)], "query_id string").withColumn("text", F.col("query_id")), "query_id").withColumnRenamed("embedding", "query_vec")
    return V.nearest_vectors(vecs, q, 3, "node_id").select("query_id", "node_id", six("sim"), "rank")


# ---- contexts

DOC_CONTEXTS = "x AS (SELECT source AS signal, lang AS source_type, doc_id AS ordinal, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM documents)"


def doc_contexts(spark, sf):
    return read(spark, sf, "documents").select(F.col("source").alias("signal"), F.col("lang").alias("source_type"), F.col("doc_id").alias("ordinal"), "text", ((F.col("n_chars") % 1000) / 1000.0).alias("score"), F.create_map().cast("map<string,string>").alias("metadata"))


@query(f"WITH {DOC_CONTEXTS} SELECT signal, source_type, ordinal, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY signal, source_type ORDER BY score DESC, ordinal) AS r FROM x) WHERE r <= 20")
def per_type_prefilter20(spark, sf):
    return X.best_per_type(doc_contexts(spark, sf)).select("signal", "source_type", "ordinal", six("score"))


@query(f"WITH {DOC_CONTEXTS}, y AS (SELECT *, row_number() OVER (PARTITION BY signal, source_type ORDER BY score DESC, ordinal) AS own, count(*) OVER (PARTITION BY signal) AS n FROM x), t AS (SELECT signal, count(DISTINCT source_type) AS t FROM x GROUP BY signal), z AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY CASE WHEN own <= greatest(1, 10 // t) THEN 0 ELSE 1 END, score DESC, source_type, ordinal) AS k FROM y JOIN t USING (signal)) SELECT signal, source_type, ordinal, round(score, 6) AS score FROM z WHERE n <= 10 OR k <= 10")
def balanced_subset(spark, sf):
    return X.balanced(doc_contexts(spark, sf), 10).select("signal", "source_type", "ordinal", six("score"))


@query("WITH v AS (SELECT embedding::DOUBLE[] AS e, vec_id, label::VARCHAR AS source_type, (vec_id % 100) / 100.0::DOUBLE AS score FROM embeddings), q AS (SELECT arg_min(e, vec_id) AS qv FROM v), s AS (SELECT vec_id, source_type, score, list_dot_product(e, qv) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qv, qv))) AS sim FROM v, q), k AS (SELECT *, (sim + score) / 2 AS combined, row_number() OVER (PARTITION BY source_type ORDER BY round((sim + score) / 2, 12) DESC, vec_id)::INT AS rank FROM s WHERE sim >= 0.2) SELECT source_type, vec_id AS ordinal, round(sim, 6) AS sim, round(combined, 6) AS combined, rank FROM k WHERE rank <= 2")
def similarity_prune(spark, sf):
    e = read(spark, sf, "embeddings")
    x = e.select(F.lit("s").alias("signal"), F.col("label").cast("string").alias("source_type"), F.col("vec_id").alias("ordinal"), ((F.col("vec_id") % 100) / 100.0).alias("score"), F.col("embedding").alias("vec"))
    q = e.agg(F.min_by("embedding", "vec_id").alias("query_vec")).withColumn("signal", F.lit("s"))
    return X.similar_contexts(x, q, 0.2).select("source_type", "ordinal", six("sim"), six("combined"), "rank")


@query("WITH r(source_type, response) AS (VALUES ('en', 'Selected contexts: [0, 2]'), ('de', 'Selected contexts: [1, x]'), ('fr', 'none'))" + f", {DOC_CONTEXTS}, y AS (SELECT *, row_number() OVER (PARTITION BY signal, source_type ORDER BY score DESC, ordinal) - 1 AS k, count(*) OVER (PARTITION BY signal, source_type) AS n FROM x) SELECT signal, source_type, ordinal FROM y WHERE CASE WHEN source_type = 'en' THEN k IN (0, 2) ELSE k < 2 END")
def model_selection(spark, sf):
    x = doc_contexts(spark, sf)
    r = spark.createDataFrame([("en", "Selected contexts: [0, 2]"), ("de", "Selected contexts: [1, x]"), ("fr", "none")], "source_type string, response string")
    return X.selected(x, x.select("signal").distinct().crossJoin(F.broadcast(r))).select("signal", "source_type", "ordinal")


@query(f"WITH {DOC_CONTEXTS}, n AS (SELECT signal, source_type, count(*) AS n FROM x GROUP BY ALL) SELECT signal, source_type, n, p::INT AS prompt, (n // 3 + CASE WHEN p < n % 3 THEN 1 ELSE 0 END)::BIGINT AS share FROM n, range(3) t(p)")
def prompt_distribution(spark, sf):
    return X.distribution(doc_contexts(spark, sf), 3)


@query()
def prompt_pack_disjoint(spark, sf):
    return X.packed(doc_contexts(spark, sf), 3, 8000)


@query()
def prompt_pack_prefix(spark, sf):
    return X.packed(doc_contexts(spark, sf), 3, 8000, mode="prefix")


@query("WITH p AS (SELECT source AS signal, doc_id AS plan_no, lang AS plan FROM documents), n AS (SELECT signal, count(*) AS n FROM p GROUP BY signal), j AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY plan_no) - 1 AS j FROM p JOIN n USING (signal)) SELECT signal, k::INT AS prompt, plan_no, plan FROM j, range(3) t(k) WHERE n <= 10 OR j % 3 = k")
def plan_round_robin(spark, sf):
    p = read(spark, sf, "documents").select(F.col("source").alias("signal"), F.col("doc_id").alias("plan_no"), F.col("lang").alias("plan"))
    prompts = p.select("signal").distinct().crossJoin(spark.range(3).select(F.col("id").cast("int").alias("prompt")))
    return R.dealt_plans(p, prompts)


@query("SELECT lang AS signal, doc_id AS pos FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def plan_dedup_first(spark, sf):
    d = read(spark, sf, "documents").select(F.col("lang").alias("signal"), F.col("doc_id").alias("pos"), F.col("text").alias("plan"))
    return R.unique_plans(d).select("signal", "pos")


# ---- replies

PART_LINES = "p AS (SELECT p_brand, string_agg(CASE WHEN p_size % 3 = 0 THEN 'also ' || p_name ELSE p_name || ': check ' || p_type END, chr(10) ORDER BY p_partkey) AS response FROM part GROUP BY p_brand)"


def part_replies(spark, sf):
    p = read(spark, sf, "part").withColumn("line", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("also "), "p_name")).otherwise(F.concat("p_name", F.lit(": check "), "p_type")))
    return p.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\n").alias("response"))


@query(f"WITH {PART_LINES}, l AS (SELECT p_brand, unnest(string_split(response, chr(10))) AS line, generate_subscripts(string_split(response, chr(10)), 1) AS pos FROM p), g AS (SELECT *, line LIKE '%:%' AS head, sum(CASE WHEN line LIKE '%:%' THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY pos) AS plan_no FROM l) SELECT p_brand, max(CASE WHEN head THEN trim(split_part(line, ':', 1)) END) AS signal, plan_no::BIGINT AS plan_no, string_agg(CASE WHEN head THEN trim(substr(line, instr(line, ':') + 1)) ELSE line END, ' ' ORDER BY pos) AS plan FROM g WHERE plan_no > 0 GROUP BY p_brand, plan_no")
def nl_plan_parse(spark, sf):
    return R.colon_plans(part_replies(spark, sf), "p_brand")


@query("WITH p AS (SELECT p_brand, string_agg(CASE WHEN p_size % 2 = 0 THEN '  Plan: ' || p_name ELSE p_name END, chr(10) ORDER BY p_partkey) AS response FROM part GROUP BY p_brand), l AS (SELECT p_brand, unnest(string_split(response, chr(10))) AS line, generate_subscripts(string_split(response, chr(10)), 1) - 1 AS pos FROM p) SELECT p_brand AS signal, pos::INT AS pos, trim(substr(trim(line), 6)) AS plan FROM l WHERE starts_with(trim(line), 'Plan:')")
def plan_line_extract(spark, sf):
    p = read(spark, sf, "part").withColumn("line", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("  Plan: "), "p_name")).otherwise(F.col("p_name")))
    r = p.groupBy(F.col("p_brand").alias("signal")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\n").alias("response"))
    return R.plan_lines(r)


SVA_SQL = "WITH " + samples.values("r", samples.REPLIES, "reply_id, response") + r""", s AS (SELECT reply_id, unnest(list_distinct(list_concat(regexp_extract_all(response, '(?s)@\(\s*posedge\s+\w+.*?;'), regexp_extract_all(response, '(?s)assert\s+property\s*\(\s*@\(posedge\s+\w+\)\s+.*?;\s*\)')))) AS sva FROM r
UNION SELECT reply_id, trim(regexp_extract(response, '(?s)```(.*?)```', 1), E' \n') FROM r WHERE response LIKE '%SVA for Plan%') SELECT DISTINCT reply_id, trim(regexp_replace(regexp_replace(sva, '//[^\n]*', '', 'g'), '\s+', ' ', 'g')) AS sva FROM s"""


@query(SVA_SQL)
def sva_extract(spark, sf):
    return R.assertions(samples.table(spark, "replies"), ("reply_id",))


@query()
def sva_all_strategies(spark, sf):
    text = "```systemverilog\nproperty p1; @(posedge clk) a |-> b; endproperty assert property(p1);\n// assert property (@(posedge clk) x |-> y);\n```"
    return R.assertions(spark.createDataFrame([(0, text)], "reply_id int, response string"), ("reply_id",), ("sv_properties", "commented", "bodies", "paired"))


@query("WITH u AS (SELECT p_name AS sva FROM part UNION ALL SELECT upper(p_name) || '  ' FROM part) SELECT min(sva) AS sva FROM u GROUP BY lower(trim(regexp_replace(sva, '\\s+', ' ', 'g')))")
def sva_dedup(spark, sf):
    p = read(spark, sf, "part")
    return R.unique_assertions(p.select(F.col("p_name").alias("sva")).union(p.select(F.concat(F.upper("p_name"), F.lit("  ")))))


@query(samples.values("WITH l", [(i, x) for i, x in enumerate(["Signal a:", "Plan 1: first", "more", "", "Plan 2: second", "Signal b:", "stray", "Plan 3: third  "])], "line_no, line") + ", s AS (SELECT *, last_value(nullif(regexp_extract(trim(line), '^Signal\\s+(.+?):\\s*$', 1), '') IGNORE NULLS) OVER (ORDER BY line_no) AS signal FROM l WHERE trim(line) <> ''), p AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^Plan\\s+\\d+\\s*:') THEN 1 ELSE 0 END) OVER (PARTITION BY signal ORDER BY line_no) AS plan_no FROM s WHERE NOT regexp_matches(line, '^Signal\\s+.+:\\s*$')) SELECT signal, plan_no::BIGINT AS plan_no, string_agg(trim(regexp_replace(trim(line), '^Plan\\s+\\d+\\s*:', '')), ' ' ORDER BY line_no) AS plan FROM p WHERE plan_no > 0 GROUP BY ALL")
def plan_text_parse(spark, sf):
    lines = ["Signal a:", "Plan 1: first", "more", "", "Plan 2: second", "Signal b:", "stray", "Plan 3: third  "]
    return SO.plans_from_lines(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string"))


@query("WITH d AS (SELECT r_name AS signal, n_nationkey::BIGINT AS plan_no, n_name AS plan FROM nation JOIN region ON n_regionkey = r_regionkey), n AS (SELECT *, row_number() OVER (ORDER BY signal, plan_no) AS n, row_number() OVER (PARTITION BY signal ORDER BY plan_no) AS f FROM d), l AS (SELECT n, 0 AS k, 'Signal ' || signal || ':' AS line FROM n WHERE f = 1 UNION ALL SELECT n, 1, 'Plan ' || n || ': ' || plan FROM n) SELECT row_number() OVER (ORDER BY n, k)::INT AS line_no, line FROM l")
def plan_text_write(spark, sf):
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    return SR.plan_lines(n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("signal"), F.col("n_nationkey").cast("long").alias("plan_no"), F.col("n_name").alias("plan")))


# ---- markup, identifiers, names


@query("SELECT page_id, trim(replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\\\[a-zA-Z]+(\\{[^}]*\\})?', '', 'g'), '\\n', chr(10))) AS text FROM pages")
def strip_markup(spark, sf):
    return read(spark, sf, "pages").select("page_id", D.strip_markup(F.col("html")).alias("text"))


@query("WITH " + samples.values("t", samples.TABLES, "row_id, latex") + r" SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(latex, '\\text\{([^}]*)\}', '\1', 'g'), '\\', chr(10)), '&', ' | '), '\\[a-zA-Z]+', '', 'g'), '\^(\{2\}|\{2|2\}|2)', '²', 'g'), '\s+', ' ', 'g')) AS cleaned FROM t")
def clean_table(spark, sf):
    return samples.table(spark, "tables").select("row_id", D.clean_table(F.col("latex")).alias("cleaned"))


IDENTIFIERS = "i AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b[a-zA-Z_][a-zA-Z_0-9]*\\b'))) AS ident FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g') AS text FROM documents))"


def doc_identifiers(spark, sf):
    ascii_ = F.regexp_replace("text", r"[^\x00-\x7F]", "~")
    return read(spark, sf, "documents").select("doc_id", F.explode(SR.identifiers(ascii_)).alias("ident"))


KEYWORDS_SQL = ", ".join(f"'{k}'" for k in SR.KEYWORDS)


@query(f"WITH {IDENTIFIERS} SELECT ident, count(*) AS n FROM i WHERE ident NOT IN ({KEYWORDS_SQL}) GROUP BY ident")
def identifier_extract(spark, sf):
    return doc_identifiers(spark, sf).groupBy("ident").agg(F.count("*").alias("n"))


@query(f"WITH {IDENTIFIERS}, w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM benchmark) SELECT DISTINCT ident AS signal FROM i WHERE ident NOT IN ({KEYWORDS_SQL}) AND ident NOT IN (SELECT word FROM w)")
def identifier_antijoin(spark, sf):
    w = read(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("signal")).distinct()
    return doc_identifiers(spark, sf).select(F.col("ident").alias("signal")).distinct().join(w, "signal", "left_anti")


NAMES_SQL = samples.values("l", [(n,) for n in samples.NAMES], "signal") + ", a AS (SELECT signal FROM l UNION ALL SELECT p_name FROM part), b AS (SELECT signal, CASE WHEN signal LIKE '%.%' THEN regexp_extract(signal, '([^.]*)$', 1) ELSE signal END AS base FROM a)"
DROP_SQL = "regexp_matches(base, '^_+|^n\\d+$|^tmp\\d+$|^genblk\\d+|^unnamed|^\\d+$|^D_') OR (regexp_matches(base, '[A-Z]') AND base = upper(base) AND regexp_matches(base, '^[A-Z0-9_]+$')) OR (signal LIKE '%genblk%' AND regexp_matches(signal, '\\[.*\\]')) OR signal = ''"


@query(f"WITH {NAMES_SQL} SELECT DISTINCT base AS signal FROM b WHERE NOT ({DROP_SQL})")
def signal_name_filter(spark, sf):
    return rtl.wanted_signals(samples.table(spark, "names").union(read(spark, sf, "part").select("p_name")))


CLASS_SQL = "CASE WHEN regexp_matches(lower(port), 'clk|clock') THEN 'clock_signals' WHEN regexp_matches(lower(port), 'rst|reset') THEN 'reset_signals' WHEN regexp_matches(lower(port), 'data|_d$') THEN 'data_signals' WHEN regexp_matches(lower(port), 'en|sel|ctrl|control') THEN 'control_signals' WHEN regexp_matches(lower(port), 'valid|ready|ack|req') THEN 'handshaking_signals' END"
PORTS_SQL = samples.values("l", [(p,) for p in samples.PORTS], "port") + ", a AS (SELECT port FROM l UNION ALL SELECT p_name FROM part)"


@query(f"WITH {PORTS_SQL} SELECT port, {CLASS_SQL} AS pattern_type FROM a")
def protocol_classify(spark, sf):
    ports = samples.table(spark, "ports").select("port").union(read(spark, sf, "part").select("p_name"))
    return ports.select("port", rtl.protocol_class(F.col("port")).alias("pattern_type"))


VERIFICATION_SQL = f"""WITH {samples.values('l', [(i, p) for i, p in enumerate(samples.PORTS)], 'i, port')}, c AS (SELECT i, port, {CLASS_SQL} AS k FROM l),
g AS (SELECT coalesce(list(port ORDER BY i) FILTER (k = 'clock_signals'), []) AS clk, coalesce(list(port ORDER BY i) FILTER (k = 'reset_signals'), []) AS rst, coalesce(list(port ORDER BY i) FILTER (k = 'data_signals'), []) AS d,
  coalesce(list(port ORDER BY i) FILTER (k = 'control_signals'), []) AS ctl, coalesce(list(port ORDER BY i) FILTER (k = 'handshaking_signals'), []) AS h FROM c),
s AS (SELECT *, CASE WHEN len(ctl) > 0 THEN ctl ELSE clk END AS gate, list_filter(h, lambda x: regexp_matches(lower(x), 'req|valid')) AS asks, list_filter(h, lambda x: regexp_matches(lower(x), 'ack|ready')) AS acks FROM g)
SELECT 'm' AS module, 'reset_behavior' AS type, array_to_string(rst, ',') AS signals FROM s WHERE len(rst) > 0
UNION ALL SELECT 'm', 'clock_domain_crossing', array_to_string(clk, ',') FROM s WHERE len(clk) > 1
UNION ALL SELECT 'm', 'data_stability', array_to_string(list_concat(d, gate[1:1]), ',') FROM s WHERE len(d) > 0 AND len(gate) > 0
UNION ALL SELECT 'm', 'handshaking_protocol', array_to_string(list_concat(asks, acks), ',') FROM s WHERE len(asks) > 0 AND len(acks) > 0"""


@query(VERIFICATION_SQL)
def verification_rules(spark, sf):
    p = rtl.verification_points(rtl.protocol_patterns(samples.table(spark, "ports")))
    return p.select("module", "type", F.array_join("signals", ",").alias("signals"))


@query("SELECT *, n_ports + n_assigns + 2 * n_ifs + 2 * n_cases AS complexity FROM (SELECT n_name AS module, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_ports, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_assigns, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING') AS n_ifs, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'MACHINERY') AS n_cases FROM nation)")
def module_complexity(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_name").alias("module"), "n_nationkey")
    c, s = read(spark, sf, "customer"), read(spark, sf, "supplier")
    own = lambda df, key: df.join(F.broadcast(n), F.col(key) == F.col("n_nationkey"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "if").when(F.col("c_mktsegment") == "MACHINERY", "case").otherwise("other").alias("kind")
    return rtl.module_summary(n, own(c, "c_nationkey"), own(s, "s_nationkey"), own(c, "c_nationkey").select("module", kind))


# ---- links


@query("WITH t AS (SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS text FROM part), n AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ')) AS name FROM part), w AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM t) SELECT name, p_partkey FROM n JOIN w ON lower(name) = token WHERE regexp_matches(name, '^[\\p{L}\\p{N}_]+$') UNION SELECT name, p_partkey FROM n JOIN t ON regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || regexp_escape(lower(name)) || '($|[^\\p{L}\\p{N}_])') WHERE NOT regexp_matches(name, '^[\\p{L}\\p{N}_]+$') AND name <> ''")
def name_in_text_link(spark, sf):
    p = read(spark, sf, "part")
    texts = p.select(F.col("p_partkey").alias("text_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    names = p.select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ")).alias("name")).distinct().withColumn("name_id", F.col("name"))
    return K.name_hits(names, texts).select(F.col("name_id").alias("name"), F.col("text_id").alias("p_partkey"))


@query("WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM benchmark), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM documents) SELECT token, count(*) AS docs FROM n JOIN w USING (token) GROUP BY token")
def token_in_text_link(spark, sf):
    names = read(spark, sf, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("name")).distinct().withColumn("name_id", F.col("name"))
    hits = K.name_hits(names, read(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text"))
    return hits.groupBy(F.col("name_id").alias("token")).agg(F.count("*").alias("docs"))


@query("WITH t AS (SELECT 'p:' || p_partkey AS node_id, p_name AS expression FROM part), s AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS signal FROM part) SELECT signal, node_id FROM s JOIN t ON list_contains(string_split(expression, ' '), signal)")
def signal_mapping(spark, sf):
    p = read(spark, sf, "part")
    nodes = p.select(F.concat(F.lit("p:"), "p_partkey").alias("node_id"), F.lit("assignment").alias("type"), F.lit(None).cast("string").alias("name"), F.col("p_name").alias("expression"))
    return K.signal_nodes(p.select(F.explode(F.split("p_name", " ")).alias("signal")).distinct(), nodes)


# ---- the star-schema graph

STAR = [("region", "r", "r_regionkey", "r_name"), ("nation", "n", "n_nationkey", "n_name"), ("customer", "c", "c_custkey", "c_name"), ("supplier", "s", "s_suppkey", "s_name"), ("part", "p", "p_partkey", "p_name")]
NODES = "nodes AS (" + " UNION ALL ".join(f"SELECT '{p}:' || {k} AS node_id, '{t}' AS type, {n} AS name FROM {t}" for t, p, k, n in STAR) + ")"
EDGES = "edges AS (SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, 'part_of' AS relation FROM nation UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'part_of' FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'part_of' FROM supplier UNION ALL SELECT DISTINCT 's:' || l_suppkey, 'p:' || l_partkey, 'drives' FROM lineitem)"
PAIRS = "pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), ways AS (SELECT a AS node, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs), deg AS (SELECT node_id, type, name, count(node) AS degree FROM nodes LEFT JOIN ways ON node = node_id GROUP BY ALL)"
GRAPH = f"WITH RECURSIVE {NODES}, {EDGES}, {PAIRS}"


def _ids(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def star_nodes(spark, sf):
    parts = [read(spark, sf, t).select(_ids(p, k).alias("node_id"), F.lit(t).alias("type"), F.col(n).alias("name")) for t, p, k, n in STAR]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


def star_edges(spark, sf, drives=None):
    link = lambda t, a, b, rel: read(spark, sf, t).select(_ids(*a).alias("src"), _ids(*b).alias("dst"), F.lit(rel).alias("relation"))
    if drives is None:
        drives = read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    every = link("nation", ("n", "n_nationkey"), ("r", "n_regionkey"), "part_of").union(link("customer", ("c", "c_custkey"), ("n", "c_nationkey"), "part_of")).union(link("supplier", ("s", "s_suppkey"), ("n", "s_nationkey"), "part_of"))
    return every.union(drives.select(_ids("s", "l_suppkey"), _ids("p", "l_partkey"), F.lit("drives"))).withColumn("edge_seq", F.xxhash64("src", "dst"))


def star_pairs(spark, sf):
    return G.undirected(star_edges(spark, sf), "relation")


@query(f"{GRAPH} SELECT * FROM nodes")
def kg_nodes(spark, sf):
    return star_nodes(spark, sf)


@query(f"{GRAPH} SELECT * FROM edges")
def kg_edges(spark, sf):
    return star_edges(spark, sf).drop("edge_seq")


@query(f"{GRAPH} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def kg_type_histogram(spark, sf):
    return K.type_histogram(star_nodes(spark, sf))


@query(f"{GRAPH}, r AS (SELECT src AS dst, dst AS src, 'back' AS relation FROM edges WHERE relation = 'part_of'), e AS (SELECT * FROM edges UNION ALL SELECT src, dst, relation FROM r) SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n_edges, max(CASE WHEN relation = 'back' THEN 'back' END) IS NOT NULL AS doubled FROM e GROUP BY ALL")
def kg_simple_undirected(spark, sf):
    e = star_edges(spark, sf).withColumn("edge_seq", F.lit(0))
    back = e.where("relation = 'part_of'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("back").alias("relation"), F.lit(1).alias("edge_seq"))
    return G.undirected(e.unionByName(back), "relation").select("a", "b", "n_edges", (F.col("relation") == "back").alias("doubled"))


@query(f"{GRAPH} SELECT node_id, degree FROM deg")
def kg_degree(spark, sf):
    return G.degrees(star_nodes(spark, sf), star_pairs(spark, sf))


@query(f"{GRAPH} SELECT n, m, round(2.0::DOUBLE * m / (n * (n - 1)), 6) AS density, round(2.0::DOUBLE * m / n, 6) AS avg_degree FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS m FROM pairs)")
def kg_density(spark, sf):
    return G.density(star_nodes(spark, sf), star_pairs(spark, sf)).select("n", "m", six("density"), six("avg_degree"))


TRIANGLES = "e2 AS (SELECT a, b FROM pairs UNION SELECT least('n:' || s1.s_nationkey, 'p:' || l.l_partkey), greatest('n:' || s1.s_nationkey, 'p:' || l.l_partkey) FROM supplier s1 JOIN lineitem l ON l_suppkey = s_suppkey), d2 AS (SELECT x, count(*) AS d FROM (SELECT a AS x FROM e2 UNION ALL SELECT b FROM e2) GROUP BY x), t AS (SELECT e1.a AS x, e1.b AS y, f.b AS z FROM e2 e1 JOIN e2 f ON e1.b = f.a JOIN e2 g ON g.a = e1.a AND g.b = f.b), tn AS (SELECT node, count(*) AS tri FROM (SELECT x AS node FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY node)"


@query(f"{GRAPH}, {TRIANGLES} SELECT node_id, coalesce(d, 0) AS degree, coalesce(tri, 0) AS tri, round(CASE WHEN coalesce(d, 0) > 1 THEN 2.0::DOUBLE * coalesce(tri, 0) / (d * (d - 1)) ELSE 0 END, 6) AS clustering FROM nodes LEFT JOIN d2 ON x = node_id LEFT JOIN tn ON node = node_id")
def kg_clustering(spark, sf):
    """With shortcuts from a nation to the parts of its suppliers, so that there are triangles."""
    s = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    drives = written(read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct(), "drives")  # read twice
    extra = drives.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "l_partkey").distinct()
    extra = extra.select(_ids("n", "s_nationkey").alias("src"), _ids("p", "l_partkey").alias("dst"))
    pairs = G.undirected(star_edges(spark, sf, drives).select("src", "dst", "edge_seq").unionByName(extra.withColumn("edge_seq", F.lit(0).cast("long"))))
    return G.clustering(star_nodes(spark, sf), pairs).select("node_id", "degree", "tri", six("clustering"))


@query(f"{GRAPH}, top AS (SELECT node_id, degree FROM deg ORDER BY degree DESC, node_id LIMIT 5) SELECT node_id, degree, (SELECT string_agg(other, ',' ORDER BY other) FROM (SELECT other FROM ways WHERE node = node_id ORDER BY other LIMIT 5)) AS neighbours FROM top")
def kg_hubs_top5(spark, sf):
    return G.top_hubs(star_nodes(spark, sf), star_pairs(spark, sf)).withColumn("neighbours", F.array_join("neighbours", ","))


STARTS = "starts AS (SELECT node_id AS start FROM nodes WHERE type = 'region')"


def regions(nodes):
    return nodes.where("type = 'region'").select(F.col("node_id").alias("start"))


@query(f"{GRAPH}, {STARTS}, m AS (SELECT avg(degree) AS avg FROM deg), h AS (SELECT node_id AS center, degree, degree / avg AS degree_ratio FROM deg, m WHERE degree > avg * 1.5), c AS (SELECT start, start AS center FROM starts UNION SELECT start, other FROM starts JOIN ways ON node = start WHERE other NOT IN (SELECT start FROM starts)), nd AS (SELECT ways.node AS center, avg(deg.degree) AS nd FROM ways JOIN deg ON deg.node_id = other GROUP BY ways.node) SELECT start, center, degree, round(degree_ratio, 6) AS degree_ratio, round(nd, 6) AS neighbour_avg_degree FROM c JOIN h USING (center) LEFT JOIN nd USING (center)")
def kg_hub_motif(spark, sf):
    n = star_nodes(spark, sf)
    return G.hub_motifs(n, star_pairs(spark, sf), regions(n)).select("start", "center", "degree", six("degree_ratio"), six("neighbour_avg_degree"))


@query(f"{GRAPH} SELECT src, dst FROM edges WHERE src LIKE 's:%' AND dst LIKE 'n:%'")
def kg_bridges(spark, sf):
    side = F.when(F.col("type").isin("region", "nation", "customer"), "spec").otherwise("rtl")
    return G.bridges(star_nodes(spark, sf).withColumn("source", side), star_edges(spark, sf)).select("src", "dst")


@query("SELECT 'c:' || c_custkey AS node_id, 'c:' || c_custkey AS component FROM customer UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey FROM orders")
def kg_components(spark, sf):
    o = read(spark, sf, "orders").select(_ids("o", "o_orderkey").alias("b"), _ids("c", "o_custkey").alias("a"))
    nodes = read(spark, sf, "customer").select(_ids("c", "c_custkey").alias("node_id")).union(o.select("b"))
    return G.node_components(nodes, o)


@query("SELECT 'knowledge_root' AS src, 'c:' || c_custkey AS dst, 'connects' AS relationship, 0.1::DOUBLE AS weight FROM customer")
def kg_ensure_connected(spark, sf):
    e = read(spark, sf, "orders").select(_ids("o", "o_orderkey").alias("src"), _ids("c", "o_custkey").alias("dst"), F.lit("placed").alias("relation"))
    nodes = read(spark, sf, "customer").select(_ids("c", "c_custkey").alias("node_id")).union(e.select("src"))
    full = K.spec_node(nodes)
    edges = e.select(*[F.col(c) if c in e.columns else F.lit(None).cast(K._typed(c)).alias(c) for c in K.EDGE_COLUMNS])
    return K.connected(full, edges)[1].where("relationship = 'connects'").select("src", "dst", "relationship", "weight")


BFS = "bfs AS (SELECT start, start AS node, 0 AS dist FROM starts UNION SELECT start, other, dist + 1 FROM bfs JOIN ways ON ways.node = bfs.node WHERE dist < 2), near AS (SELECT start, node, min(dist)::INT AS dist FROM bfs GROUP BY ALL)"


@query(f"{GRAPH}, {STARTS}, {BFS} SELECT start, node, dist FROM near")
def kg_bfs_2hop(spark, sf):
    n = star_nodes(spark, sf)
    return G.distances(star_pairs(spark, sf), regions(n), 2)


@query(f"{GRAPH}, {STARTS}, {BFS}, i AS (SELECT x.start, count(*) AS m FROM near x JOIN pairs ON a = x.node JOIN near y ON y.node = b AND y.start = x.start GROUP BY x.start), s AS (SELECT start, count(*) AS n, count(DISTINCT type) AS types FROM near JOIN nodes ON node_id = node GROUP BY start) SELECT start, n, coalesce(m, 0) AS m, round(2.0::DOUBLE * coalesce(m, 0) / (n * (n - 1)), 6) AS density, types, round(least(0.5, n / 100.0::DOUBLE) + least(0.2, types / 10.0::DOUBLE) + least(0.3, 2.0::DOUBLE * coalesce(m, 0) / (n * (n - 1))), 6) AS score FROM s LEFT JOIN i USING (start)")
def bfs_score(spark, sf):
    n, p = star_nodes(spark, sf), star_pairs(spark, sf)
    near = G.distances(p, regions(n), 2).select("start", "node")
    return G.group_metrics(near, p, n).withColumn("score", G.expansion_score()).select("start", "n", "m", six("density"), "types", six("score"))


@query()
def kg_local_expansion(spark, sf):
    n = star_nodes(spark, sf)
    return G.expansion(star_pairs(spark, sf), regions(n), 2, 20)


@query(f"{GRAPH} SELECT node_id, round(0.4 * degree / (SELECT max(degree) FROM deg) + 0.6 * CASE type WHEN 'part' THEN 0.9 WHEN 'supplier' THEN 0.7 WHEN 'customer' THEN 0.6 ELSE 0 END, 6) AS importance FROM deg")
def node_importance(spark, sf):
    kind = F.when(F.col("type") == "part", "port").when(F.col("type") == "supplier", "module").when(F.col("type") == "customer", "assignment").otherwise("other")
    return G.node_importance(star_nodes(spark, sf).withColumn("type", kind), star_pairs(spark, sf)).select("node_id", six("importance"))


# ---- the summary graph

S_NODES = "nodes AS (SELECT 'r:' || r_regionkey AS node_id, 'region' AS type, r_name AS name FROM region UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT DISTINCT 'm:' || c_mktsegment, 'module', c_mktsegment FROM customer UNION ALL SELECT DISTINCT 'o:' || o_orderpriority, 'port', o_orderpriority FROM orders)"
S_EDGES = "edges AS (SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, 'part_of' AS relation FROM nation UNION ALL SELECT DISTINCT 'm:' || c_mktsegment, 'n:' || c_nationkey, 'sells' FROM customer UNION ALL SELECT DISTINCT 'm:' || c_mktsegment, 'o:' || o_orderpriority, 'drives' FROM customer JOIN orders ON o_custkey = c_custkey)"
SUMMARY = f"WITH RECURSIVE {S_NODES}, {S_EDGES}, {PAIRS}"


def summary_nodes(spark, sf):
    r, n = read(spark, sf, "region"), read(spark, sf, "nation")
    m, o = read(spark, sf, "customer").select("c_mktsegment").distinct(), read(spark, sf, "orders").select("o_orderpriority").distinct()
    row = lambda df, p, k, t, name: df.select(_ids(p, k).alias("node_id"), F.lit(t).alias("type"), F.col(name).alias("name"))
    return row(r, "r", "r_regionkey", "region", "r_name").union(row(n, "n", "n_nationkey", "nation", "n_name")).union(row(m, "m", "c_mktsegment", "module", "c_mktsegment")).union(row(o, "o", "o_orderpriority", "port", "o_orderpriority"))


def summary_edges(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    o = read(spark, sf, "orders").select("o_custkey", "o_orderpriority")
    sells = c.select("c_mktsegment", "c_nationkey").distinct().select(_ids("m", "c_mktsegment").alias("src"), _ids("n", "c_nationkey").alias("dst"), F.lit("sells").alias("relation"))
    drives = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_orderpriority").distinct().select(_ids("m", "c_mktsegment"), _ids("o", "o_orderpriority"), F.lit("drives"))
    part = read(spark, sf, "nation").select(_ids("n", "n_nationkey"), _ids("r", "n_regionkey"), F.lit("part_of"))
    return sells.union(drives).union(part).withColumns({"relationship": F.lit(None).cast("string"), "edge_seq": F.xxhash64("src", "dst")})


def summary(spark, sf):
    from specweave.scratch import written

    return written(summary_nodes(spark, sf), "s-nodes"), written(G.undirected(summary_edges(spark, sf), "relation", "relationship"), "s-pairs")


PATHS = "paths AS (SELECT start, start AS node, [start] AS path FROM starts UNION ALL SELECT start, other, list_append(path, other) FROM paths JOIN ways ON ways.node = paths.node WHERE len(path) <= 3 AND NOT list_contains(path, other))"


@query(f"{SUMMARY}, {STARTS}, {PATHS} SELECT start, node, array_to_string(path, '>') AS path FROM paths WHERE len(path) > 1")
def kg_simple_paths(spark, sf):
    n, p = summary(spark, sf)
    return G.simple_paths(p, regions(n), 3).withColumn("path", F.array_join("path", ">"))


METRICS = """g AS (SELECT n, m, 2.0::DOUBLE * m / (n * (n - 1)) AS density, 2.0::DOUBLE * m / n AS avg_degree FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS m FROM pairs)),
x AS (SELECT start, node, array_to_string(path, '>') AS path, path AS p, len(path) AS length FROM paths WHERE len(path) > 1),
mem AS (SELECT path, unnest(p) AS v FROM x), md AS (SELECT path, avg(degree) AS mean_degree FROM mem JOIN deg ON node_id = v GROUP BY path),
ins AS (SELECT u.path, count(*) AS m2 FROM mem u JOIN pairs ON a = u.v JOIN mem w ON w.path = u.path AND w.v = b GROUP BY u.path),
y AS (SELECT start, node, x.path, length, 2.0::DOUBLE * m2 / (length * (length - 1)) AS edge_density, mean_degree, mean_degree / (n - 1) AS mean_centrality, density, avg_degree FROM x JOIN md USING (path) JOIN ins USING (path), g)"""


@query(f"{SUMMARY}, {STARTS}, {PATHS}, {METRICS} SELECT start, node, path, length::BIGINT AS length, round(edge_density, 6) AS edge_density, round(mean_degree, 6) AS mean_degree, round((1.0::DOUBLE / (abs(length - 3) + 1) + edge_density + 0 + mean_centrality) / 4, 6) AS importance FROM y")
def path_importance(spark, sf):
    """The summary graph has no triangles, so clustering is 0 throughout."""
    n, p = summary(spark, sf)
    m = G.path_metrics(G.simple_paths(p, regions(n), 3), n, p)
    return m.select("start", "node", F.array_join("path", ">").alias("path"), "length", six("edge_density"), six("mean_degree"), six("importance"))


@query(f"{SUMMARY}, {STARTS}, {PATHS}, {METRICS} SELECT start, path FROM y WHERE mean_degree > avg_degree OR edge_density > density")
def significant_paths(spark, sf):
    n, p = summary(spark, sf)
    return G.path_metrics(G.simple_paths(p, regions(n), 3), n, p).where("significant").select("start", F.array_join("path", ">").alias("path"))


@query()
def path_contexts(spark, sf):
    n, p = summary(spark, sf)
    paths = G.path_metrics(G.simple_paths(p, regions(n), 3, G.endpoints(n, p, regions(n))), n, p).where("significant")
    return X.described_paths(paths, n, p, "verification").select("start", "node", "text", six("importance"))


@query(f"{SUMMARY}, cyc AS (SELECT a AS start, b AS node, [a, b] AS path FROM pairs UNION ALL SELECT start, other, list_append(path, other) FROM cyc JOIN ways ON ways.node = cyc.node WHERE len(path) < 5 AND other > start AND NOT list_contains(path, other)) SELECT array_to_string(path, '>') AS cycle, len(path)::INT AS length FROM cyc JOIN ways ON ways.node = cyc.node AND other = start WHERE len(path) >= 3 AND path[2] < path[-1]")
def kg_cycles_le5(spark, sf):
    _, p = summary(spark, sf)
    return G.cycles(p, 5).withColumn("cycle", F.array_join("cycle", ">"))


@query(f"{SUMMARY}, bf AS (SELECT node_id AS s, node_id AS v, 0 AS d FROM nodes UNION SELECT s, other, d + 1 FROM bf JOIN ways ON node = v WHERE d < 8), ds AS (SELECT s, v, min(d) AS d FROM bf GROUP BY ALL) SELECT s AS node_id, round((count(*) - 1) / sum(d)::DOUBLE * (count(*) - 1) / ((SELECT count(*) FROM nodes) - 1), 6) AS closeness FROM ds GROUP BY s")
def kg_closeness(spark, sf):
    return G.closeness(*summary(spark, sf)).select("node_id", six("closeness"))


@query(f"""{SUMMARY}, bf AS (SELECT node_id AS s, node_id AS v, 0 AS d FROM nodes UNION SELECT s, other, d + 1 FROM bf JOIN ways ON node = v WHERE d < 8), ds AS (SELECT s, v, min(d) AS d FROM bf GROUP BY ALL),
sp AS (SELECT node_id AS s, node_id AS t, [node_id] AS path FROM nodes UNION ALL SELECT sp.s, other, list_append(path, other) FROM sp JOIN ways ON ways.node = sp.t JOIN ds ON ds.s = sp.s AND ds.v = other AND ds.d = len(path)),
sg AS (SELECT s, t, count(*) AS n FROM sp GROUP BY ALL), inn AS (SELECT s, t, unnest(path[2:len(path) - 1]) AS v FROM sp WHERE len(path) > 2), dep AS (SELECT v, sum(1.0::DOUBLE / n) AS b FROM inn JOIN sg USING (s, t) GROUP BY v)
SELECT node_id, round(coalesce(b, 0) / (((SELECT count(*) FROM nodes) - 1) * ((SELECT count(*) FROM nodes) - 2)), 6) AS betweenness FROM nodes LEFT JOIN dep ON v = node_id""")
def kg_betweenness(spark, sf):
    return G.betweenness(*summary(spark, sf)).select("node_id", six("betweenness"))


@query(f"{SUMMARY} SELECT node_id, round(degree / ((SELECT count(*) FROM nodes) - 1)::DOUBLE, 6) AS centrality FROM deg")
def kg_degree_centrality(spark, sf):
    return G.degree_centrality(*summary(spark, sf)).select("node_id", six("centrality"))


@query()
def kg_communities_cnm(spark, sf):
    return C.modularity_communities(*summary(spark, sf))


@query()
def kg_communities_louvain(spark, sf):
    return C.louvain(star_nodes(spark, sf), star_pairs(spark, sf))


@query()
def kg_communities_label_prop(spark, sf):
    return C.label_propagation(star_nodes(spark, sf), star_pairs(spark, sf), 5)


@query()
def community_contexts(spark, sf):
    n, p = summary(spark, sf)
    return C.community_contexts(n, p, C.modularity_communities(n, p), regions(n)).select("start", "community", "size", six("score"))


@query()
def dense_motifs(spark, sf):
    n, p = summary(spark, sf)
    return C.dense_motifs(n, p, C.modularity_communities(n, p), regions(n))


@query()
def motif_importance(spark, sf):
    n, p = summary(spark, sf)
    members = G.cycles(p, 4, regions(n)).select(F.array_join("cycle", ">").alias("motif"), F.explode("cycle").alias("node"))
    return C.motif_importance(members, n, p).select("motif", six("structural"), six("connectivity"), six("centrality"), six("importance"))


def summary_signals(nodes):
    return nodes.where("type in ('port', 'module')").select(F.col("name").alias("signal"), "node_id")


@query()
def guided_walk(spark, sf):
    n, p = summary(spark, sf)
    sig = summary_signals(n)
    targets = sorted(r["signal"] for r in sig.collect())  # a handful of segments and priorities
    walks = C.guided_walks(n, p, sig, regions(n), targets, walks=20, budget=30)
    return C.ranked_walks(C.walk_quality(walks, n, p), len(targets)).select("start", "walk_id", "rank", F.array_join("path", ">").alias("path"), F.size("discovered").alias("found"), six("quality"), six("score"))


@query(f"{SUMMARY}, {STARTS}, bf AS (SELECT start, start AS node, [start] AS path FROM starts UNION ALL SELECT start, other, list_append(path, other) FROM bf JOIN ways ON ways.node = bf.node WHERE len(path) <= 3 AND NOT list_contains(path, other)), best AS (SELECT start AS source, node AS target, min(len(path)) AS l FROM bf GROUP BY ALL), paths AS (SELECT source, target, (SELECT path FROM bf WHERE start = source AND node = target AND len(path) = l ORDER BY path DESC LIMIT 1) AS path, l FROM best WHERE target LIKE 'o:%') SELECT count(*) AS paths, sum(l)::BIGINT AS nodes FROM paths")
def gateway_paths(spark, sf):
    n, p = summary(spark, sf)
    sp = G.shortest_paths(p, regions(n)).where("node like 'o:%'")
    return sp.agg(F.count("*").alias("paths"), F.sum(F.size("path")).alias("nodes"))


@query()
def gateway_scores(spark, sf):
    n, p = summary(spark, sf)
    sp = G.shortest_paths(p, regions(n)).where("node like 'o:%'").select(F.col("start").alias("source"), F.col("node").alias("target"), "path")
    return G.gateways(sp).select("source", "target", "node", six("score"), "rank")


# ---- hierarchies and dependencies


@query("SELECT r_name || '.' || n_name || '.' || s_name AS signal, 1 AS depth FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def hierarchy_signals(spark, sf):
    n, r, s = read(spark, sf, "nation"), read(spark, sf, "region"), read(spark, sf, "supplier")
    inst = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("instance"), F.col("n_name").alias("module"))
    own = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("module"), F.col("s_name").alias("signal"))
    return rtl.hierarchical_signals(inst, own, r.select(F.col("r_name").alias("module")), 1).select("signal", "depth")


@query("WITH RECURSIVE " + samples.values("d", samples.DEPENDENCIES, "file, needs") + ", f AS (SELECT file FROM d UNION SELECT needs FROM d), lv AS (SELECT file, 0 AS level FROM f WHERE file NOT IN (SELECT file FROM d) UNION SELECT d.file, level + 1 FROM d JOIN lv ON lv.file = d.needs WHERE level < 20), bad AS (SELECT 'loop_a.v' AS file UNION SELECT d.file FROM d JOIN bad ON d.needs = bad.file) SELECT f.file, CASE WHEN f.file IN (SELECT file FROM bad) THEN NULL ELSE (SELECT max(level) FROM lv WHERE lv.file = f.file) END::INT AS level FROM f")
def file_dependency_levels(spark, sf):
    d = samples.table(spark, "dependencies")
    return rtl.dependency_levels(d.select("file").union(d.select("needs")), d)


@query("WITH RECURSIVE " + samples.values("d", samples.DEPENDENCIES, "file, needs") + ", f AS (SELECT file FROM d UNION SELECT needs FROM d), r AS (SELECT file AS start, file AS node, 0 AS dist FROM f UNION SELECT start, needs, dist + 1 FROM r JOIN d ON d.file = node WHERE dist < 12) SELECT start, node, min(dist)::INT AS dist FROM r GROUP BY ALL")
def directed_reach(spark, sf):
    d = samples.table(spark, "dependencies")
    files = d.select("file").union(d.select("needs")).distinct()
    return G.directed_distances(d.select(F.col("file").alias("src"), F.col("needs").alias("dst")), files.select(F.col("file").alias("start")))


@query()
def rtl_signal_relationships(spark, sf):
    facts = rtl.facts(samples.table(spark, "rtl"))
    return rtl.signal_relationships(facts["dataflow"], rtl.primary_signals(facts["ports"]))


# ---- results

PROOFS = "WITH " + samples.values("r", samples.REPORTS, "sva_id, content") + r""",
m AS (SELECT *, regexp_extract(content, '(?s)=+\nSUMMARY\n=+\n(.*?)\n\n', 1) AS body, regexp_matches(content, '(?s)=+\nSUMMARY\n=+\n.*?\n\n') AS has FROM r),
l AS (SELECT sva_id, trim(unnest(string_split(trim(body), chr(10)))) AS line, generate_subscripts(string_split(trim(body), chr(10)), 1) AS pos FROM m),
b AS (SELECT sva_id, min(pos) AS a FROM l WHERE starts_with(line, 'assertions') GROUP BY sva_id),
e AS (SELECT l.sva_id, min(pos) AS c FROM l JOIN b ON b.sva_id = l.sva_id WHERE starts_with(line, 'covers') AND pos > a GROUP BY l.sva_id),
s AS (SELECT l.sva_id, list(lower(trim(split_part(line, ':', 1))) ORDER BY pos) AS st FROM l JOIN b ON b.sva_id = l.sva_id LEFT JOIN e ON e.sva_id = l.sva_id
  WHERE pos > a AND pos < coalesce(c, 1000000) AND len(string_split(line, ':')) = 2 AND coalesce(try_cast(regexp_extract(line, ':\s*(\d+)', 1) AS INT), 0) > 0 GROUP BY l.sva_id),
proofs AS (SELECT m.sva_id, CASE WHEN contains(content, 'ERROR') THEN 'error' WHEN NOT has OR a IS NULL THEN 'inconclusive' WHEN list_contains(st, '- proven') THEN 'proven' WHEN list_has_any(st, ['- cex', '- ar_cex']) THEN 'cex'
  WHEN st IS NULL OR list_has_any(st, ['- undetermined', '- unknown']) THEN 'inconclusive' ELSE st[1] END AS status,
  CASE WHEN contains(content, 'ERROR') THEN trim(string_split(regexp_extract(content, '[^\n]*ERROR[^\n]*'), ':')[-1]) END AS error FROM m LEFT JOIN b ON b.sva_id = m.sva_id LEFT JOIN s ON s.sva_id = m.sva_id)"""
SCRIPTS_SQL = "WITH " + samples.values("s", samples.SCRIPTS, "path, content") + r""",
l AS (SELECT *, list_transform(string_split(content, chr(10)), lambda x: trim(x)) AS lines, array_to_string(list_filter(string_split(regexp_replace(content, '\\[ \t]*\r?\n', ' ', 'g'), chr(10)), lambda x: contains(x, 'analyze -v2k')), chr(10)) AS analyze_lines FROM s)
SELECT path, nullif(regexp_extract(content, '(?m)^[ \t]*elaborate -top\s+(\S+)', 1), '') AS top_module,
  coalesce(nullif(regexp_extract(analyze_lines, '\$\{RTL_PATH\}/(\S+\.v)', 1), ''), nullif(regexp_extract(analyze_lines, '(\S+\.v)', 1), '')) AS design_file,
  list_filter(lines, lambda x: starts_with(x, 'stopat -env'))[-1] AS stopat, list_filter(lines, lambda x: starts_with(x, 'clock'))[-1] AS clock, list_filter(lines, lambda x: starts_with(x, 'reset'))[-1] AS reset FROM l"""


@query(f"{PROOFS} SELECT sva_id, status, error FROM proofs")
def proof_status(spark, sf):
    r = samples.table(spark, "reports")
    return A.proof_table(r.select("sva_id"), r)


@query("WITH " + samples.values("r", samples.COVERAGE, "report_id, content") + ", m AS (SELECT report_id, unnest(regexp_extract_all(content, '\\w+\\|\\w+\\|\\d+\\.\\d+')) AS x, generate_subscripts(regexp_extract_all(content, '\\w+\\|\\w+\\|\\d+\\.\\d+'), 1) AS pos FROM r), v AS (SELECT report_id, split_part(x, '|', 1) || '_' || split_part(x, '|', 2) AS k, arg_max(split_part(x, '|', 3)::DOUBLE, pos) AS v FROM m GROUP BY ALL) SELECT report_id, CASE WHEN regexp_matches(content, '(?i)ERROR \\(VERI-|syntax error') THEN 0.0 ELSE 1.0 END::DOUBLE AS syntax, CASE WHEN list_contains(string_split(trim(regexp_extract(regexp_extract_all(content, '\\bproofs:[^\\n]*')[-1], ':([^:]*)$', 1)), ' '), 'proven') THEN 1.0 ELSE 0.0 END::DOUBLE AS functionality, " + ", ".join(f"coalesce((SELECT v FROM v WHERE v.report_id = r.report_id AND k = '{m}'), 0)::DOUBLE AS {m}" for m in A.MEASURES) + " FROM r")
def coverage_pivot(spark, sf):
    return A.coverage(samples.table(spark, "coverage"))


@query(f"{PROOFS}, v AS (SELECT regexp_extract_all(content, '[a-z]+[|][a-z]+[|][0-9]+[.][0-9]+') AS m FROM ({samples.values('c', samples.COVERAGE, 'report_id, content').replace('c(report_id, content) AS ', '')}) c(report_id, content) WHERE report_id = 0) SELECT count(*) AS assertions, count(*) FILTER (status <> 'error') AS syntax_correct, count(*) FILTER (status = 'proven') AS proven, round(count(*) FILTER (status <> 'error') / count(*)::DOUBLE, 6) AS syntax_rate, round(count(*) FILTER (status = 'proven') / count(*)::DOUBLE, 6) AS proven_rate, (SELECT split_part(list_filter(m, lambda x: starts_with(x, 'stimuli|statement'))[-1], '|', 3)::DOUBLE FROM v) AS stimuli_statement, (SELECT split_part(list_filter(m, lambda x: starts_with(x, 'coi|branch'))[-1], '|', 3)::DOUBLE FROM v) AS coi_branch FROM proofs")
def result_summary(spark, sf):
    from specweave.plans.results import summarise

    r = samples.table(spark, "reports")
    final = summarise(r.select("sva_id"), r, samples.table(spark, "coverage").where("report_id = 0"))["final"]
    return final.select("assertions", "syntax_correct", "proven", six("syntax_rate"), six("proven_rate"), "stimuli_statement", "coi_branch")


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max, round(median(l_quantity), 6) AS median, round(sum(l_quantity), 2) AS sum, (SELECT l_quantity FROM lineitem i WHERE i.l_returnflag = o.l_returnflag GROUP BY l_quantity ORDER BY count(*) DESC, l_quantity LIMIT 1) AS mode, " + ", ".join(f"round(quantile_cont(l_quantity, {i / 10}), 6) AS q{i}0" for i in range(1, 10)) + " FROM lineitem o GROUP BY l_returnflag")
def distribution_statistics(spark, sf):
    s = A.statistics(read(spark, sf, "lineitem"), "l_quantity", ("l_returnflag",))
    return s.select("l_returnflag", "n", six("mean"), six("std"), "min", "max", six("median"), F.round("sum", 2).alias("sum"), "mode", *[six(f"q{i}0") for i in range(1, 10)])


@query("SELECT count(*) AS n_plans, count(DISTINCT lang) AS n_signals, round(avg(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))), 6) AS words_per_plan, round(count(*) / count(DISTINCT lang)::DOUBLE, 6) AS plans_per_signal FROM documents")
def plan_statistics(spark, sf):
    p = A.plan_statistics(read(spark, sf, "documents").select(F.col("lang").alias("signal"), F.col("text").alias("plan")))
    return p.select("n_plans", "n_signals", six("words_per_plan"), six("plans_per_signal"))


@query(SCRIPTS_SQL)
def script_facts(spark, sf):
    return A.script_facts(samples.table(spark, "scripts"))


@query("SELECT o_orderkey, CASE WHEN b < 1024 THEN printf('%.2f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.2f KB', round_even(b / 1024.0::DOUBLE, 2)) ELSE printf('%.2f MB', round_even(b / 1048576.0::DOUBLE, 2)) END AS size FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT * 16 AS b FROM orders)")
def readable_sizes(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", T.file_size(F.floor("o_totalprice") * 16).alias("size"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part")
def natural_order(spark, sf):
    from pyspark.sql.window import Window as W

    p = read(spark, sf, "part").withColumn("k", T.natural_order(F.col("p_name")))
    return p.select("p_partkey", F.row_number().over(W.orderBy("k", "p_partkey")).cast("long").alias("place"))


@query(f"{GRAPH} SELECT src, dst, 'e' || (row_number() OVER (ORDER BY src, dst) - 1) AS id FROM edges")
def unique_edge_ids(spark, sf):
    e = star_edges(spark, sf).select("src", "dst").withColumn("id", F.lit("same"))
    return SG.with_edge_ids(e).select("src", "dst", "id")


@query("SELECT l_suppkey AS src, l_partkey AS dst, arg_max(l_linenumber, l_orderkey * 10 + l_linenumber) AS line FROM lineitem GROUP BY ALL")
def collapsed_edges(spark, sf):
    e = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_seq"))
    return SG.collapsed(e).select("src", "dst", "line")


# ---- entities

REC = "WITH " + samples.values("r", samples.RECORDS, "doc_id, response") + ", p AS (SELECT doc_id, unnest(string_split(response, '##')) AS x, generate_subscripts(string_split(response, '##'), 1) - 1 AS pos FROM r), f AS (SELECT doc_id, pos, list_transform(string_split(regexp_extract(x, '(?s)\\((.*)\\)', 1), '<|>'), lambda y: trim(regexp_replace(trim(y), '^\"|\"$', '', 'g'))) AS f FROM p), e AS (SELECT doc_id, pos, upper(f[2]) AS name, lower(f[3]) AS type, f[4] AS description FROM f WHERE f[1] = 'entity' AND len(f) = 4)"


@query(f"{REC} SELECT doc_id, pos::INT AS pos, name, type, description FROM e")
def entity_tuple_parse(spark, sf):
    return E.entity_rows(E.records(samples.table(spark, "records")))


@query(f"{REC} SELECT name, type, count(*) AS n, string_agg(DISTINCT description, '; ' ORDER BY description) AS descriptions FROM e GROUP BY ALL")
def entity_merge(spark, sf):
    return E.merged_entities(E.entity_rows(E.records(samples.table(spark, "records")))).withColumn("descriptions", F.array_join("descriptions", "; "))


@query(f"{REC}, g AS (SELECT upper(f[2]) AS s, upper(f[3]) AS t, try_cast(f[5] AS DOUBLE) AS w FROM f WHERE f[1] = 'relationship' AND len(f) = 5) SELECT least(s, t) AS source, greatest(s, t) AS target, count(*) AS n, sum(w) AS weight FROM g WHERE w IS NOT NULL GROUP BY ALL")
def relation_merge(spark, sf):
    return E.merged_relations(E.relation_rows(E.records(samples.table(spark, "records")))).drop("descriptions")


@query(r"""SELECT trim(regexp_replace(x, '["'']', '', 'g')) AS entity_type FROM (SELECT unnest(string_split(regexp_extract(text, '(?si)Entity Types:\s*\[([^\]]*)\]', 1), ',')) AS x FROM (VALUES ('Goal' || chr(10) || 'Entity Types: [block, ''signal'', fsm state]' || chr(10) || 'Steps')) t(text)) WHERE trim(regexp_replace(x, '["'']', '', 'g')) <> ''""")
def entity_types(spark, sf):
    return A.entity_types(spark.createDataFrame([("Goal\nEntity Types: [block, 'signal', fsm state]\nSteps",)], "text string"))


@query()
def local_search(spark, sf):
    n = star_nodes(spark, sf).withColumn("text", F.concat_ws(" ", "type", "name"))
    e = star_edges(spark, sf).withColumn("description", F.col("relation"))
    return E.local_search(spark.createDataFrame([("q", "region asia")], "query_id string, query string"), n, e, 5)


# ---- Verilog


INCLUDE_SQL = "`include\\s+\"([^\"]+)\""
MODS = "WITH " + samples.values("f", samples.RTL, "file, text") + f""",
inl AS (SELECT f.file, CASE WHEN g.file IS NULL THEN regexp_replace(f.text, '{INCLUDE_SQL}', '', 'g') ELSE regexp_replace(f.text, '{INCLUDE_SQL}', g.text, 'g') END AS text FROM f LEFT JOIN f g ON g.file = regexp_extract(f.text, '{INCLUDE_SQL}', 1)),
cl AS (SELECT file, regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', '', 'g'), '(?m)//.*?$', '', 'g') AS text FROM inl),
mods AS (SELECT file, unnest(regexp_extract_all(text, '{rtl.MODULE}', 1)) AS module, unnest(regexp_extract_all(text, '{rtl.MODULE}', 2)) AS header, unnest(regexp_extract_all(text, '{rtl.MODULE}', 3)) AS body FROM cl)"""


def design(spark):
    return rtl.modules(rtl.cleaned(rtl.inline_includes(samples.table(spark, "rtl"))))


@query()
def rtl_ports(spark, sf):
    return rtl.ports(design(spark))


@query(MODS + f""", h AS (SELECT module AS parent, unnest(regexp_extract_all(body, '{rtl.INSTANCE}', 1)) AS module, unnest(regexp_extract_all(body, '{rtl.INSTANCE}', 2)) AS instance, unnest(regexp_extract_all(body, '{rtl.INSTANCE}', 3)) AS args FROM mods),
i AS (SELECT * FROM h WHERE module IN (SELECT module FROM mods) AND module <> parent), p AS (SELECT parent, instance, module, trim(unnest(string_split(args, ','))) AS item, generate_subscripts(string_split(args, ','), 1) - 1 AS k FROM i),
c AS (SELECT parent, instance, module, CASE WHEN contains(item, '.') THEN regexp_extract(item, '^\\.(\\w+)\\s*\\(\\s*(\\w+)\\s*\\)', 1) ELSE 'port_' || k END AS port, CASE WHEN contains(item, '.') THEN regexp_extract(item, '^\\.(\\w+)\\s*\\(\\s*(\\w+)\\s*\\)', 2) ELSE regexp_extract(item, '^(\\w+)', 1) END AS signal FROM p)
SELECT * FROM c WHERE port <> '' AND signal <> ''""")
def rtl_connections(spark, sf):
    return rtl.connections(rtl.instances(design(spark)))


@query(MODS + f""", seg AS (SELECT module, unnest(regexp_split_to_array(body, 'always(?:_ff|_comb|_latch)?')[2:]) AS seg, generate_subscripts(regexp_split_to_array(body, 'always(?:_ff|_comb|_latch)?')[2:], 1) - 1 AS always_block FROM mods),
blk AS (SELECT module, always_block, regexp_extract(seg, '(?s)^\\s*@\\s*\\((.*?)\\)(.*)', 1) AS sens, regexp_extract(seg, '(?s)^\\s*@\\s*\\((.*?)\\)(.*)', 2) AS inr FROM seg),
a AS (SELECT module, 'continuous' AS type, unnest(regexp_extract_all(body, '{rtl.CONTINUOUS}', 1)) AS lhs, unnest(regexp_extract_all(body, '{rtl.CONTINUOUS}', 2)) AS rhs, NULL::BOOLEAN AS in_clocked_block, NULL::INT AS always_block, (generate_subscripts(regexp_extract_all(body, '{rtl.CONTINUOUS}', 1), 1) - 1)::INT AS idx FROM mods
UNION ALL SELECT module, CASE WHEN op = '<=' THEN 'non_blocking' ELSE 'blocking' END, lhs, rhs, regexp_matches(sens, 'posedge|negedge'), always_block::INT, idx::INT FROM (SELECT module, always_block, sens, unnest(regexp_extract_all(inr, '{rtl.PROCEDURAL}', 1)) AS lhs, unnest(regexp_extract_all(inr, '{rtl.PROCEDURAL}', 2)) AS op, unnest(regexp_extract_all(inr, '{rtl.PROCEDURAL}', 3)) AS rhs, generate_subscripts(regexp_extract_all(inr, '{rtl.PROCEDURAL}', 1), 1) - 1 AS idx FROM blk))
SELECT module, type, trim(lhs) AS lhs, trim(rhs) AS rhs, array_to_string(list_filter(regexp_extract_all(trim(rhs), '\\w+'), lambda w: NOT regexp_matches(w, '^\\d+$') AND w NOT IN ({', '.join(repr(x) for x in rtl.NOT_SIGNALS)})), ',') AS rhs_signals, in_clocked_block, always_block, idx FROM a""")
def rtl_assignments(spark, sf):
    return rtl.assignments(design(spark)).withColumn("rhs_signals", F.array_join("rhs_signals", ","))


@query(MODS + r""", k AS (SELECT module, 'if' AS kind, regexp_extract_all(body, '\bif\s*\((.*?)\)', 1) AS m FROM mods UNION ALL SELECT module, 'case', regexp_extract_all(body, '\bcase\s*\(\s*(.+?)\s*\)', 1) FROM mods
UNION ALL SELECT module, 'for', regexp_extract_all(body, '\bfor\s*\(') FROM mods UNION ALL SELECT module, 'while', regexp_extract_all(body, '\bwhile\s*\(') FROM mods),
u AS (SELECT module, kind, unnest(m) AS e, (generate_subscripts(m, 1) - 1)::INT AS idx FROM k) SELECT module, kind, idx, CASE WHEN kind IN ('if', 'case') THEN trim(e) END AS expr FROM u""")
def rtl_control_flow(spark, sf):
    return rtl.control_flow(design(spark))


@query()
def rtl_signal_attributes(spark, sf):
    m = design(spark)
    return rtl.signal_attributes(m, rtl.ports(m))


@query()
def rtl_state_machines(spark, sf):
    m = design(spark)
    return rtl.state_machines(m, rtl.always_blocks(m)).withColumn("state_encodings", F.array_join("state_encodings", ","))


@query()
def rtl_dataflow(spark, sf):
    return rtl.facts(samples.table(spark, "rtl"))["dataflow"]


@query()
def rtl_hierarchy(spark, sf):
    m = design(spark)
    inst = rtl.instances(m)
    return rtl.hierarchical_signals(inst, rtl.internal_signals(m), rtl.top_modules(m, inst))


@query()
def rtl_design_signals(spark, sf):
    return rtl.design_signals(samples.table(spark, "rtl"), internal=True)


@query()
def rtl_file_order(spark, sf):
    f = samples.table(spark, "rtl")
    return rtl.files_in_order(f, rtl.file_dependencies(f)).select("file", "place")


@query()
def rtl_knowledge_graph(spark, sf):
    n, e = planning.design_graph(samples.table(spark, "rtl"), samples.table(spark, "spec_nodes"), samples.table(spark, "spec_edges"))
    return e.select("src", "dst", F.coalesce("relationship", "relation").alias("relation"))


@query()
def checker_and_bind(spark, sf):
    svas = R.unique_assertions(R.assertions(samples.table(spark, "replies"), ("reply_id",))).select(F.xxhash64("sva").alias("sva_id"), "sva")
    m = design(spark)
    return SR.checker(svas, rtl.top_ports(m, rtl.instances(m), rtl.ports(m)).select(F.col("port").alias("signal")), "bus_top")


@query()
def test_plans(spark, sf):
    files = samples.table(spark, "rtl")
    n, e = planning.design_graph(files, samples.table(spark, "spec_nodes"), samples.table(spark, "spec_edges"))
    docs = samples.table(spark, "spec_nodes").select(F.col("node_id").alias("doc_id"), "text")
    use = Settings(chunk_sizes=(50, 100), overlap_ratios=(0.2,), max_path_depth=3)
    return planning.plan(docs, rtl.design_signals(files), n, e, use)["plans"]
