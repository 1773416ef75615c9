"""Every query of the library with its SQL: name -> (spark, sf_dir) -> DataFrame, and name -> DuckDB SQL.

Floating-point results are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.operators import batching, clean, forest, metrics, models, profile, rank, split, tfidf
from corpusloom.operators.token_ids import encode_tokens, word_ids
from corpusloom.plans import experiment
from corpusloom.sources import corpus_files as files
from corpusloom.sources.scratch import new_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _rounded(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return put


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The fixtures: labelled corpora and scores made of the given tables.


def corpus(spark, d) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    tags = F.concat(F.lit('["'), "lang", F.lit('", "'), "source", F.lit('"]'))
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("row_id"), F.col("text").alias("func"), F.col("toxic").cast("int").alias("target"), F.col("source").alias("project"), "lang", tags.alias("tags"))


CORPUS = """corpus AS (SELECT d.doc_id AS row_id, d.text AS func, l.toxic AS target, d.source AS project, d.lang,
  '["' || d.lang || '", "' || d.source || '"]' AS tags FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def conflict(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("func"), (F.col("doc_id") % 2).cast("int").alias("target"))


CONFLICT = "conflict AS (SELECT doc_id AS row_id, text AS func, (doc_id % 2)::INT AS target FROM documents)"


def holes(spark, d) -> DataFrame:
    c = corpus(spark, d)
    return c.withColumn("func", F.when(F.col("row_id") % 7 != 0, F.col("func"))).withColumn("target", F.when(F.col("row_id") % 5 != 0, F.col("target")))


HOLES = CORPUS + ", holes AS (SELECT row_id, CASE WHEN row_id % 7 <> 0 THEN func END AS func, CASE WHEN row_id % 5 <> 0 THEN target END AS target, project, lang, tags FROM corpus)"


def ties(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_linestatus").alias("exp_id"), (F.col("l_orderkey") % 5).cast("int").alias("fold"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_discount") * 10).alias("score"))


TIES = "scores AS (SELECT l_linestatus AS exp_id, (l_orderkey % 5)::INT AS fold, (l_returnflag = 'R')::INT AS label, l_discount * 10 AS score FROM lineitem)"


def fine(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem")
    top = rows.agg(F.max("l_extendedprice").alias("top"))
    return rows.crossJoin(F.broadcast(top)).select(F.col("l_linestatus").alias("exp_id"), (F.col("l_orderkey") % 5).cast("int").alias("fold"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_extendedprice") / F.col("top")).alias("score"))


FINE = "scores AS (SELECT l_linestatus AS exp_id, (l_orderkey % 5)::INT AS fold, (l_returnflag = 'R')::INT AS label, l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem) AS score FROM lineitem)"


def keyed(spark, d) -> DataFrame:
    rows = table(spark, d, "orders")
    top = rows.agg(F.max("o_totalprice").alias("top"))
    return rows.crossJoin(F.broadcast(top)).select(F.lit("run").alias("exp_id"), (F.col("o_orderkey") % 5).cast("int").alias("fold"), F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), (F.col("o_totalprice") / F.col("top")).alias("score"))


KEYED = "scores AS (SELECT 'run' AS exp_id, (o_orderkey % 5)::INT AS fold, o_orderkey AS row_id, (o_orderstatus = 'F')::INT AS label, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS score FROM orders)"


def runs(spark, d) -> DataFrame:
    """Several experiments in families, fold 0 standing for the holdout."""
    s = table(spark, d, "lineitem")
    return s.select(F.concat("l_linestatus", F.lit("_lr_c-"), (F.col("l_linenumber") % 3).cast("string")).alias("exp_id"), (F.col("l_orderkey") % 5 - 1).cast("int").alias("fold"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_discount") * 10).alias("score"))


RUNS = "scores AS (SELECT l_linestatus || '_lr_c-' || (l_linenumber % 3) AS exp_id, (l_orderkey % 5 - 1)::INT AS fold, (l_returnflag = 'R')::INT AS label, l_discount * 10 AS score FROM lineitem)"


def strata(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("target"))


STRATA = "strata AS (SELECT o_orderkey AS row_id, (o_orderstatus = 'F')::INT AS target FROM orders)"


def _split_sql(rows: str) -> str:
    """CTEs each, quota, split and folds over a relation with row_id and target."""
    return f"""each AS (SELECT target AS label, count(*) AS n_c FROM {rows} GROUP BY 1),
parts AS (SELECT label, n_c, n_c * ceil((SELECT sum(n_c) FROM each) * 0.2) / (SELECT sum(n_c) FROM each) AS part FROM each),
quota AS (SELECT label, floor(part) + (row_number() OVER (ORDER BY part - floor(part) DESC, label)
  <= ceil((SELECT sum(n_c) FROM each) * 0.2) - (SELECT sum(floor(part)) FROM parts))::INT AS q FROM parts),
split AS (SELECT r.row_id, r.target AS label, CASE WHEN row_number() OVER (PARTITION BY r.target ORDER BY md5('42:' || r.row_id), r.row_id) <= q
  THEN 'holdout' ELSE 'train' END AS split FROM {rows} r JOIN quota ON quota.label = r.target),
tr AS (SELECT row_id, label FROM split WHERE split = 'train'),
lower_ AS (SELECT a.label, coalesce((SELECT count(*) FROM tr b WHERE b.label < a.label), 0) AS off FROM (SELECT DISTINCT label FROM tr) a),
folds AS (SELECT tr.row_id, tr.label, ((off + row_number() OVER (PARTITION BY tr.label ORDER BY md5('fold:42:' || tr.row_id), tr.row_id) - 1) % 5)::INT AS fold
  FROM tr JOIN lower_ ON lower_.label = tr.label)"""


_CURVE = """steps AS (SELECT exp_id, fold, score, count(*) AS n, sum(label) AS pos FROM scores GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM steps WINDOW w AS (PARTITION BY exp_id, fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
_AP = _CURVE + """, ap AS (SELECT exp_id, fold, CASE WHEN sum(pos) = 0 THEN 0.0 ELSE sum(pos * tp / seen) / sum(pos) END AS pr_auc FROM (SELECT exp_id, fold, pos::DOUBLE AS pos, tp::DOUBLE AS tp, seen::DOUBLE AS seen FROM cum) GROUP BY ALL)"""
_CONF = """conf AS (SELECT exp_id, fold, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
  count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM scores GROUP BY ALL)"""
_PRF = _CONF + """, prf AS (SELECT exp_id, fold, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1 FROM conf)"""
_EVAL = _PRF + ", " + _AP + ", metrics AS (SELECT prf.*, ap.pr_auc FROM prf JOIN ap ON prf.exp_id = ap.exp_id AND prf.fold = ap.fold)"
_TOKENS = r"""runs_ AS (SELECT doc_id AS row_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{M}\p{N}_]+')) AS term, generate_subscripts(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{M}\p{N}_]+'), 1) AS pos FROM documents),
tokens AS (SELECT * FROM runs_ WHERE regexp_full_match(term, '[a-zA-Z_][\p{L}\p{M}\p{N}_]*|0x[0-9a-fA-F]+|[0-9]+'))"""
_COUNTS = _TOKENS + """, lists_ AS (SELECT row_id, list(term ORDER BY pos) AS t FROM tokens GROUP BY 1), grams AS (SELECT row_id, unnest(t) AS term FROM lists_
 UNION ALL SELECT row_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM lists_
 UNION ALL SELECT row_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM lists_),
counts AS (SELECT row_id, term, count(*) AS tf FROM grams GROUP BY ALL)"""
_VOCAB = """ranked AS (SELECT term, sum(tf)::BIGINT AS total_tf, count(*) AS df FROM counts WHERE row_id % 5 <> 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50000),
vocab AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::INT AS idx, total_tf, df,
  ln((1 + (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0)) / (1 + df)) + 1 AS idf FROM ranked)"""
_WEIGHTS = """raw AS (SELECT c.row_id, c.term, v.idx, c.tf, (1 + ln(c.tf)) * v.idf AS w FROM counts c JOIN vocab v ON c.term = v.term),
weights AS (SELECT row_id, term, idx, tf, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS w FROM raw)"""
_LEN = "CASE WHEN func IS NULL THEN 0 ELSE greatest(1, length(func) // 4) END"
_CATS = r"""unnest(list_filter(list_transform(string_split(regexp_replace(tags, '^[\[\]"'' ]+|[\[\]"'' ]+$', '', 'g'), ','), lambda x: regexp_replace(x, '^[\s"'']+|[\s"'']+$', '', 'g')), lambda x: x <> ''))"""


# A: sources and sinks. The files are written from the given tables first.

_SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("func", T.StringType()), T.StructField("target", T.IntegerType()), T.StructField("project", T.StringType())])
_SCANNED = f"WITH {CORPUS} SELECT row_id, target, project, length(func) AS n_chars, md5(func) AS text_md5 FROM corpus"


def _scanned(df: DataFrame) -> DataFrame:
    return df.select("row_id", "target", "project", F.length("func").cast("long").alias("n_chars"), F.md5("func").alias("text_md5"))


def _corpus_rows(spark, d) -> DataFrame:
    return corpus(spark, d).select(*_SCHEMA.names)


@query("a1_scan_csv", _SCANNED)
def a1(spark, d):
    path = new_path(spark, "csv")
    _corpus_rows(spark, d).write.csv(path, header=True, escape='"', quoteAll=True, emptyValue="")
    return _scanned(files.scan_csv(spark, path, _SCHEMA))


@query("a1_scan_csv_ranges", _SCANNED)
def a1b(spark, d):
    """As a file of any size is read: by byte ranges."""
    path = new_path(spark, "csv")
    _corpus_rows(spark, d).write.csv(path, header=True, escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return _scanned(files.scan_csv(spark, path, _SCHEMA, whole=0))


@query("a2_scan_jsonl", _SCANNED)
def a2(spark, d):
    path = new_path(spark, "jsonl")
    files.sink_jsonl(_corpus_rows(spark, d), path)
    return _scanned(files.scan_jsonl(spark, path, _SCHEMA))


def _layout(layout: str, name: str, **options):
    @query(name, _SCANNED)
    def scan(spark, d):
        path = new_path(spark, layout)
        rows = _corpus_rows(spark, d).withColumn("shard", F.floor(F.col("row_id") / 250))
        files.sink_json_files(rows, path, layout, "shard", "row_id")
        return _scanned(files.SCANS[layout](spark, path, _SCHEMA, **options))


_layout("records", "a4_scan_json_records")
_layout("wrapped", "a5_scan_json_wrapped")
_layout("columnar", "a6_scan_json_columnar")
_layout("rowkeyed", "a7_scan_json_rowkeyed")
_layout("columnar", "a6_scan_json_columnar_ranges", whole=0)
_layout("rowkeyed", "a7_scan_json_rowkeyed_ranges", whole=0)


@query("a3_discover_files", _SCANNED)
def a3(spark, d):
    path = new_path(spark, "found")
    _corpus_rows(spark, d).write.csv(path, header=True, escape='"', quoteAll=True, emptyValue="")
    return _scanned(files.discover(spark, path, _SCHEMA))


@query("a8_sink_jsonl", f"WITH {CORPUS} SELECT target, count(*) AS n, sum(length(func))::BIGINT AS n_chars FROM corpus GROUP BY 1")
def a8(spark, d):
    path = new_path(spark, "sink")
    files.sink_jsonl(_corpus_rows(spark, d), path)
    return files.scan_jsonl(spark, path, _SCHEMA).groupBy("target").agg(F.count("*").alias("n"), F.sum(F.length("func")).alias("n_chars"))


@query("a9_save_load_split", f"WITH {STRATA}, {_split_sql('strata')} SELECT row_id, label, split FROM split")
def a9(spark, d):
    path = new_path(spark, "split")
    files.save_split(split.stratified_holdout(strata(spark, d), "row_id", "target"), path)
    return files.load_split(spark, path)


@query("a10_split_meta", f"""WITH {STRATA}, {_split_sql('strata')} SELECT 0.2::DOUBLE AS test_size, 42 AS random_state, count(*) AS n_total, count(*) FILTER (split = 'train') AS n_train,
 count(*) FILTER (split = 'holdout') AS n_holdout, round(avg(label) FILTER (split = 'train'), 6) AS train_pos_rate, round(avg(label) FILTER (split = 'holdout'), 6) AS holdout_pos_rate FROM split""")
def a10(spark, d):
    return split.split_meta(split.stratified_holdout(strata(spark, d), "row_id", "target"))


@query("a11_save_metrics", f"WITH {RUNS}, {_EVAL} SELECT exp_id, count(*) AS n_folds, round(max(pr_auc), 6) AS best FROM metrics GROUP BY 1")
def a11(spark, d):
    path = new_path(spark, "metrics")
    files.save_metrics(metrics.evaluate(runs(spark, d)), path)
    return files.load_metrics(spark, path).groupBy("exp_id").agg(F.count("*").alias("n_folds"), F.max("pr_auc").alias("best"))


@query("a12_load_metrics", f"WITH {RUNS}, {_EVAL} SELECT exp_id, fold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(pr_auc, 6) AS pr_auc FROM metrics WHERE fold = -1")
def a12(spark, d):
    path = new_path(spark, "metrics")
    files.save_metrics(metrics.evaluate(runs(spark, d)), path)
    return files.load_metrics(spark, path, holdout=True).select("exp_id", "fold", "precision", "recall", "f1", "pr_auc")


# B: validation, filters


@query("b1_require_columns", f"WITH {CORPUS} SELECT row_id, target FROM corpus")
def b1(spark, d):
    return clean.require_columns(corpus(spark, d), ["func", "target"]).select("row_id", "target")


@query("b2_validate_labels", "SELECT DISTINCT l_linenumber AS label FROM lineitem WHERE l_linenumber NOT IN (0, 1)")
def b2(spark, d):
    return clean.invalid_labels(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("label")), "label")


@query("b3_drop_nulls", f"WITH {HOLES} SELECT row_id, target FROM holes WHERE func IS NOT NULL AND target IS NOT NULL")
def b3(spark, d):
    return clean.drop_nulls(holes(spark, d), "func", "target").select("row_id", "target")


@query("b4_schema_report", f"""WITH {HOLES} SELECT * FROM (
 SELECT 'row_id' AS column_name, 'bigint' AS data_type, count(*) FILTER (row_id IS NULL) AS n_nulls FROM holes
 UNION ALL SELECT 'func', 'string', count(*) FILTER (func IS NULL) FROM holes UNION ALL SELECT 'target', 'int', count(*) FILTER (target IS NULL) FROM holes
 UNION ALL SELECT 'project', 'string', count(*) FILTER (project IS NULL) FROM holes UNION ALL SELECT 'lang', 'string', count(*) FILTER (lang IS NULL) FROM holes
 UNION ALL SELECT 'tags', 'string', count(*) FILTER (tags IS NULL) FROM holes)""")
def b4(spark, d):
    return clean.schema_report(holes(spark, d))


@query("b5_coerce_label", f"WITH {CORPUS} SELECT row_id, target AS label FROM corpus")
def b5(spark, d):
    t = F.col("target").cast("string")
    variants = F.when(F.col("row_id") % 3 == 0, t).when(F.col("row_id") % 3 == 1, F.concat(F.lit('{"0": '), t, F.lit("}"))).otherwise(F.concat(F.lit('{"0": "'), t, F.lit('"}')))
    return corpus(spark, d).select("row_id", X.coerce_label(variants).alias("label"))


@query("b6_resolve_column", f"WITH {CORPUS} SELECT tags AS category, count(*) AS n FROM corpus GROUP BY 1")
def b6(spark, d):
    return clean.resolve_column(corpus(spark, d).withColumnRenamed("tags", "cwe_ids"), "category").groupBy("category").agg(F.count("*").alias("n"))


@query("b7_positives_only", f"WITH {CORPUS} SELECT row_id, project FROM corpus WHERE target = 1")
def b7(spark, d):
    return clean.positives_only(corpus(spark, d), "target").select("row_id", "project")


@query("b8_texts_and_labels", f"WITH {CORPUS}, {_split_sql('corpus')} SELECT md5(func) AS text_md5, target AS label FROM corpus JOIN split ON corpus.row_id = split.row_id WHERE split = 'train'")
def b8(spark, d):
    c = corpus(spark, d)
    return split.texts_and_labels(c, split.stratified_holdout(c, "row_id", "target"), "row_id", "func", "target").select(F.md5("text").alias("text_md5"), "label")


@query("b9_threshold_predict", f"WITH {KEYED} SELECT row_id, (score >= 0.5)::INT AS predicted FROM scores")
def b9(spark, d):
    return metrics.threshold_predict(keyed(spark, d)).select("row_id", "predicted")


def _attached(spark, d) -> DataFrame:
    s = strata(spark, d)
    sides = split.stratified_holdout(s, "row_id", "target")
    return split.attach_fold(s, sides, split.stratified_kfold(sides), "row_id")


@query("b10_cv_subset", f"WITH {STRATA}, {_split_sql('strata')} SELECT row_id, CASE WHEN fold = 2 THEN 'val' ELSE 'train' END AS side FROM folds")
def b10(spark, d):
    train, val = split.cv_subset(_attached(spark, d), 2)
    return train.select("row_id", F.lit("train").alias("side")).unionByName(val.select("row_id", F.lit("val").alias("side")))


@query("b11_primary_categories", f"WITH {CORPUS}, e AS (SELECT {_CATS} AS category FROM corpus WHERE target = 1) SELECT w.category, count(e.category) AS n FROM (VALUES ('en'), ('de'), ('src1'), ('none')) w(category) LEFT JOIN e ON e.category = w.category GROUP BY 1")
def b11(spark, d):
    return profile.primary_categories(corpus(spark, d), "target", X.parse_categories(F.col("tags")), ["en", "de", "src1", "none"])


# C: joins


@query("c1_gather_by_split", f"WITH {STRATA}, {_split_sql('strata')} SELECT row_id, label AS target FROM split WHERE split = 'holdout'")
def c1(spark, d):
    s = strata(spark, d)
    return split.gather_by_split(s, split.stratified_holdout(s, "row_id", "target"), "row_id", "holdout")


@query("c2_attach_fold", f"WITH {STRATA}, {_split_sql('strata')} SELECT split.row_id, split.label AS target, split, fold FROM split LEFT JOIN folds ON split.row_id = folds.row_id")
def c2(spark, d):
    return _attached(spark, d)


@query("c4_pair_scores", f"WITH {KEYED} SELECT row_id, label, round(score, 6) AS score FROM scores")
def c4(spark, d):
    k = keyed(spark, d)
    return metrics.pair_scores(k.select("row_id", "label"), k.select("row_id", "score"), ["row_id"])


_TOP = f"cats AS (SELECT row_id, target, {_CATS} AS category, tags FROM corpus), top AS (SELECT category, count(*) AS n FROM cats WHERE target = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)"


@query("c5_category_substring", f"WITH {CORPUS}, {_TOP} SELECT top.category, count(*) FILTER (target = 0) AS n_secure, count(*) FILTER (target = 1) AS n_vulnerable FROM corpus JOIN top ON contains(tags, top.category) GROUP BY 1")
def c5(spark, d):
    return profile.category_by_class(corpus(spark, d), "target", X.parse_categories(F.col("tags")), F.col("tags"), mode="substring")


@query("c6_attach_class_weight", f"WITH {KEYED} SELECT row_id, label, round((SELECT count(*) FROM scores) / (2.0 * count(*) OVER (PARTITION BY label)), 6) AS weight FROM scores")
def c6(spark, d):
    k = keyed(spark, d).select("row_id", "label")
    return metrics.attach_class_weight(k, metrics.class_weights(k, "label"), "label")


@query("c7_split_disjointness", f"""WITH {CONFLICT}, {_split_sql('conflict')}, s AS (SELECT md5(func) AS k, split FROM conflict JOIN split ON conflict.row_id = split.row_id)
 SELECT 0::BIGINT AS n_both, 0::BIGINT AS n_missing, count(*) AS n_shared_texts FROM (SELECT k FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)""")
def c7(spark, d):
    c = conflict(spark, d)
    return split.disjointness(c, split.stratified_holdout(c, "row_id", "target"), "row_id", "func")


@query("c7_complement", f"WITH {STRATA}, {_split_sql('strata')} SELECT row_id, label AS target FROM split WHERE split = 'train'")
def c7b(spark, d):
    s = strata(spark, d)
    return split.complement(s, split.stratified_holdout(s, "row_id", "target").where("split = 'holdout'"), "row_id")


# D: aggregations


@query("d1_class_distribution", f"""WITH {CORPUS}, u AS (SELECT DISTINCT func, target FROM corpus) SELECT target AS label, CASE target WHEN 0 THEN 'Secure (0)' WHEN 1 THEN 'Vulnerable (1)' END AS name, count(*) AS n,
 round(count(*) * 100.0 / (SELECT count(*) FROM u), 6)::DOUBLE AS percent, round((SELECT count(*) FILTER (target = 0) / greatest(count(*) FILTER (target = 1), 1) FROM u), 6) AS imbalance FROM u GROUP BY 1""")
def d1(spark, d):
    return profile.class_distribution(clean.dedup(corpus(spark, d), "func", "target", "row_id"), "target")


@query("d2_class_weights", f"WITH {STRATA} SELECT target::BIGINT AS label, round((SELECT count(*) FROM strata) / (2.0 * count(*)), 6)::DOUBLE AS weight FROM strata GROUP BY 1")
def d2(spark, d):
    return metrics.class_weights(strata(spark, d), "target")


@query("d3_positive_rate", f"""WITH {STRATA}, {_split_sql('strata')} SELECT split AS part, -1 AS fold, count(*) AS n, round(avg(label), 6) AS pos_rate FROM split GROUP BY 1
 UNION ALL SELECT 'val', fold, count(*), round(avg(label), 6) FROM folds GROUP BY 2 UNION ALL SELECT 'cv_train', f.fold, count(*), round(avg(g.label), 6) FROM (SELECT DISTINCT fold FROM folds) f JOIN folds g ON g.fold <> f.fold GROUP BY 2""")
def d3(spark, d):
    sides = split.stratified_holdout(strata(spark, d), "row_id", "target")
    return split.positive_rates(sides, split.stratified_kfold(sides))


_STATS = "round(avg(len), 6) AS mean_len, round(quantile_cont(len, 0.5), 6)::DOUBLE AS median_len, round(quantile_cont(len, 0.95), 6)::DOUBLE AS p95_len"


@query("d4_length_stats", f"""WITH {CORPUS}, l AS (SELECT target AS label, {_LEN} AS len FROM corpus) SELECT label, grouping(label)::INT AS is_all, {_STATS}, round(quantile_cont(len, 0.99), 6)::DOUBLE AS p99_len,
 max(len)::BIGINT AS max_len, floor(quantile_cont(len, 0.95))::BIGINT AS suggested_len FROM l GROUP BY GROUPING SETS ((label), ())""")
def d4(spark, d):
    return profile.length_stats(corpus(spark, d), "target", "func")


@query("d5_truncation_rate", f"WITH {CORPUS}, l AS (SELECT {_LEN} AS len FROM corpus) SELECT t AS threshold, round(avg((len > t)::INT) * 100, 6) AS pct_truncated FROM l, (VALUES (512), (1024), (2048), (4096), (8192)) v(t) GROUP BY 1")
def d5(spark, d):
    return profile.truncation_rate(corpus(spark, d), X.approx_token_len(F.col("func")))


@query("d6_clipped_length_stats", f"WITH {CORPUS}, l AS (SELECT least({_LEN}, 512) AS len, ({_LEN} > 512)::INT AS cut FROM corpus) SELECT count(*) AS n, {_STATS}, max(len)::BIGINT AS max_len, round(avg(cut) * 100, 6) AS pct_truncated FROM l")
def d6(spark, d):
    return profile.clipped_length_stats(corpus(spark, d), X.approx_token_len(F.col("func")), 512)


@query("d7_length_histogram", f"""WITH {CORPUS}, l AS (SELECT target AS label, {_LEN} AS len FROM corpus), s AS (SELECT label, min(len) AS lo, max(len) AS hi FROM l GROUP BY 1)
 SELECT l.label, CASE WHEN hi > lo THEN least(floor((len - lo) * 80.0::DOUBLE / (hi - lo)), 79)::INT ELSE 0 END AS bin, count(*) AS n FROM l JOIN s ON l.label = s.label GROUP BY 1, 2""")
def d7(spark, d):
    return profile.length_histogram(corpus(spark, d), "target", X.approx_token_len(F.col("func")))


@query("d8_category_frequency", f"WITH {CORPUS}, e AS (SELECT {_CATS} AS category FROM corpus WHERE target = 1) SELECT category, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM e), 6)::DOUBLE AS percent, (SELECT count(DISTINCT category) FROM e) AS n_categories, (SELECT count(*) FROM e) AS n_labels FROM e GROUP BY 1")
def d8(spark, d):
    return profile.category_frequency(corpus(spark, d), "target", X.parse_categories(F.col("tags")))


@query("d9_category_by_class", f"WITH {CORPUS}, {_TOP} SELECT top.category, count(*) FILTER (target = 0) AS n_secure, count(*) FILTER (target = 1) AS n_vulnerable FROM cats JOIN top ON cats.category = top.category GROUP BY 1")
def d9(spark, d):
    return profile.category_by_class(corpus(spark, d), "target", X.parse_categories(F.col("tags")))


@query("d10_confusion_counts", f"WITH {TIES}, {_CONF} SELECT * FROM conf")
def d10(spark, d):
    return metrics.confusion_counts(ties(spark, d))


@query("d11_precision_recall_f1", f"WITH {TIES}, {_PRF} SELECT exp_id, fold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf")
def d11(spark, d):
    return metrics.precision_recall_f1(ties(spark, d))


@query("d12_average_precision", f"WITH {TIES}, {_AP} SELECT exp_id, fold, round(pr_auc, 6) AS pr_auc FROM ap")
def d12(spark, d):
    return metrics.average_precision(ties(spark, d))


@query("d12_average_precision_fine", f"WITH {FINE}, {_AP} SELECT exp_id, fold, round(pr_auc, 6) AS pr_auc FROM ap")
def d12b(spark, d):
    return metrics.average_precision(fine(spark, d))


@query("d13_pr_curve", f"""WITH {TIES}, {_CURVE}, p AS (SELECT exp_id, fold, sum(pos) AS p FROM steps GROUP BY ALL)
 SELECT cum.exp_id, cum.fold, round(score, 6) AS threshold, round(tp / seen::DOUBLE, 6)::DOUBLE AS precision, CASE WHEN p = 0 THEN 1.0 ELSE round(tp / p::DOUBLE, 6) END::DOUBLE AS recall FROM cum JOIN p ON cum.exp_id = p.exp_id AND cum.fold = p.fold
 UNION ALL SELECT exp_id, fold, NULL, 1.0, 0.0 FROM p""")
def d13(spark, d):
    return metrics.pr_curve(ties(spark, d))


@query("d14_pr_baseline", f"WITH {TIES} SELECT exp_id, fold, round(avg(label), 6) AS pos_rate, count(*) AS n FROM scores GROUP BY GROUPING SETS ((exp_id, fold), (exp_id))")
def d14(spark, d):
    return metrics.pr_baseline(ties(spark, d))


@query("d15_aggregate_folds", f"""WITH {TIES}, {_EVAL} SELECT exp_id, count(*) AS n_folds, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(f1), 6) AS mean_f1, round(avg(pr_auc), 6) AS mean_pr_auc,
 round(stddev_samp(precision), 6) AS std_precision, round(stddev_samp(recall), 6) AS std_recall, round(stddev_samp(f1), 6) AS std_f1, round(stddev_samp(pr_auc), 6) AS std_pr_auc, string_agg(fold::VARCHAR, ',' ORDER BY fold) AS folds FROM metrics GROUP BY 1""")
def d15(spark, d):
    out = metrics.aggregate_folds(metrics.evaluate(ties(spark, d)))
    return out.withColumn("folds", F.concat_ws(",", F.transform("per_fold", lambda x: x["fold"].cast("string")))).drop("per_fold")


@query("d19_corpus_summary", f"""WITH {CORPUS} SELECT count(*) AS total, count(*) FILTER (target = 0) AS n_secure, count(*) FILTER (target = 1) AS n_vulnerable, round(count(*) FILTER (target = 0) * 100.0 / count(*), 6)::DOUBLE AS pct_secure,
 round(count(*) FILTER (target = 1) * 100.0 / count(*), 6)::DOUBLE AS pct_vulnerable, round(count(*) FILTER (target = 0) / greatest(count(*) FILTER (target = 1), 1), 6) AS imbalance FROM corpus""")
def d19(spark, d):
    return profile.corpus_summary(corpus(spark, d), "target")


def logits(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", (F.col("value") / 10).alias("l0"), ((F.col("user_id") % 7) / 2.0).alias("l1"), (F.col("event_id") % 2).cast("int").alias("label"), (F.col("event_id") % 3).cast("int").alias("fold"))


_LOGITS = "logits AS (SELECT event_id, value / 10 AS l0, (user_id % 7) / 2.0::DOUBLE AS l1, (event_id % 2)::INT AS label, (event_id % 3)::INT AS fold FROM events)"


@query("d20_weighted_log_loss", f"""WITH {_LOGITS}, w AS (SELECT label, (SELECT count(*) FROM logits) / (2.0::DOUBLE * count(*)) AS weight FROM logits GROUP BY 1),
 p AS (SELECT fold, weight, logits.label, greatest(1e-15::DOUBLE, least((1 - 1e-15)::DOUBLE, 1.0 / (1.0 + exp(l0 - l1)))) AS p FROM logits JOIN w ON logits.label = w.label)
 SELECT 'run' AS exp_id, fold, round(sum(weight * -ln(CASE WHEN label = 1 THEN p ELSE 1 - p END)) / sum(weight), 6) AS log_loss FROM p GROUP BY 2""")
def d20(spark, d):
    x = logits(spark, d)
    p = x.select(F.lit("run").alias("exp_id"), "fold", "label", X.positive_probability(F.col("l0"), F.col("l1")).alias("p"))
    return metrics.weighted_log_loss(p, metrics.class_weights(x, "label"))


@query("d21_minmax_scores", f"WITH {KEYED} SELECT row_id, fold, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) AS score FROM scores WINDOW w AS (PARTITION BY fold)")
def d21(spark, d):
    return metrics.minmax_scores(keyed(spark, d)).select("row_id", "fold", "score")


@query("d22_dedup", f"WITH {CONFLICT} SELECT min(row_id) AS row_id, target, md5(func) AS text_md5 FROM conflict GROUP BY 2, 3")
def d22(spark, d):
    return clean.dedup(conflict(spark, d), "func", "target", "row_id").select("row_id", "target", F.md5("func").alias("text_md5"))


@query("d23_label_conflicts", f"WITH {CONFLICT} SELECT sha256(func) AS text_key, count(*) AS n_rows FROM conflict GROUP BY 1 HAVING count(DISTINCT target) > 1")
def d23(spark, d):
    return clean.label_conflicts(conflict(spark, d), "func", "target")


@query("d24_results_table", f"WITH {RUNS}, {_EVAL} SELECT exp_id, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(pr_auc, 4) AS pr_auc FROM metrics WHERE fold = -1")
def d24(spark, d):
    return metrics.results_table(metrics.evaluate(runs(spark, d)))


@query("d25_select_best_config", f"""WITH {RUNS}, {_EVAL}, m AS (SELECT split_part(exp_id, '_', 1) || '_' || split_part(exp_id, '_', 2) AS family, exp_id, avg(pr_auc) AS v FROM metrics WHERE fold <> -1 GROUP BY ALL)
 SELECT family, arg_max(exp_id, v) AS exp_id, round(max(v), 6) AS mean_pr_auc FROM m GROUP BY 1""")
def d25(spark, d):
    means = metrics.aggregate_folds(metrics.evaluate(runs(spark, d)).where("fold <> -1"))
    return metrics.select_best_config(means.withColumn("family", X.experiment_family(F.col("exp_id"))))


@query("d26_compare_tracks", f"""WITH {RUNS}, {_EVAL}, l AS (SELECT CASE WHEN exp_id LIKE 'O%' THEN 'A' ELSE 'B' END AS track, metric, value FROM
 (SELECT exp_id, unnest(['precision', 'recall', 'f1', 'pr_auc']) AS metric, unnest([precision, recall, f1, pr_auc]) AS value FROM metrics WHERE fold = -1))
 SELECT metric, round(max(value) FILTER (track = 'A'), 6) AS track_a, round(max(value) FILTER (track = 'B'), 6) AS track_b, round(max(value) FILTER (track = 'B') - max(value) FILTER (track = 'A'), 6) AS delta FROM l GROUP BY 1""")
def d26(spark, d):
    m = stored(metrics.evaluate(runs(spark, d)), "metrics")
    tracks = m.select("exp_id", F.when(F.col("exp_id").startswith("O"), "A").otherwise("B").alias("track")).distinct()
    return metrics.compare_tracks(m, tracks)


@query("d27_null_loss", f"""WITH {HOLES}, u AS (SELECT DISTINCT func, target FROM holes) SELECT (SELECT count(*) FROM holes) AS n_rows, count(*) AS n_after_dedup, count(*) FILTER (func IS NOT NULL AND target IS NOT NULL) AS n_after_nulls,
 (SELECT count(*) FROM holes) - count(*) AS n_repeats, count(*) FILTER (func IS NULL OR target IS NULL) AS n_with_nulls FROM u""")
def d27(spark, d):
    return clean.null_loss(holes(spark, d), "func", "target")


# E: ranks and windows


@query("e1_stratified_holdout", f"WITH {STRATA}, {_split_sql('strata')} SELECT row_id, label, split FROM split")
def e1(spark, d):
    return split.stratified_holdout(split.check_size(strata(spark, d)), "row_id", "target")


@query("e2_stratified_kfold", f"WITH {CORPUS}, {_split_sql('corpus')} SELECT row_id, label, fold FROM folds")
def e2(spark, d):
    return split.stratified_kfold(split.stratified_holdout(corpus(spark, d), "row_id", "target"))


@query("e3_cumulative_counts", f"WITH {FINE}, {_CURVE} SELECT exp_id, fold, round(score, 6) AS score, n, pos::BIGINT AS pos, tp::BIGINT AS tp, seen::BIGINT AS seen FROM cum")
def e3(spark, d):
    return rank.cumulative_counts(fine(spark, d), ["exp_id", "fold"])


@query("e4_bucketed_rank", f"WITH {STRATA} SELECT row_id, target, row_number() OVER (PARTITION BY target ORDER BY md5('7:' || row_id), row_id) AS rank FROM strata")
def e4(spark, d):
    return rank.bucketed_rank(strata(spark, d), ["target"], rank.hashed(7, F.col("row_id")), "row_id", "rank")


@query("e5_epoch_shuffle", "SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY md5('42:3:' || o_orderkey), o_orderkey) AS position FROM orders")
def e5(spark, d):
    return rank.epoch_shuffle(strata(spark, d).select("row_id"), "row_id", 42, 3)


# F: sorts, top-k


@query("f1_top_categories", f"WITH {CORPUS}, {_TOP} SELECT category, n FROM top ORDER BY n DESC, category LIMIT 10")
def f1(spark, d):
    return profile.top_categories(corpus(spark, d), "target", X.parse_categories(F.col("tags")), 10)


@query("f3_sample_n", "SELECT o_orderkey AS row_id FROM orders ORDER BY md5('11:' || o_orderkey), o_orderkey LIMIT 5000")
def f3(spark, d):
    return rank.sample_n(strata(spark, d), "row_id", 5000, 11).select("row_id")


@query("f4_ordered_value_counts", "SELECT l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1")
def f4(spark, d):
    return profile.ordered_value_counts(table(spark, d, "lineitem"), "l_linenumber")


@query("f5_first_row", f"WITH {CORPUS} SELECT row_id, func, target, project, lang, tags FROM corpus ORDER BY row_id LIMIT 1")
def f5(spark, d):
    return clean.first_row(corpus(spark, d), "row_id")


# G: sets


@query("g1_label_domain", "SELECT DISTINCT quality + toxic * 2 AS label FROM labels WHERE quality + toxic * 2 NOT IN (0, 1)")
def g1(spark, d):
    return clean.invalid_labels(table(spark, d, "labels").select((F.col("quality") + F.col("toxic") * 2).alias("label")), "label")


@query("g2_pool_folds", f"WITH {TIES} SELECT exp_id, round(avg(label), 6) AS pos_rate, count(*) AS n FROM scores GROUP BY 1")
def g2(spark, d):
    return metrics.pr_baseline(ties(spark, d)).where("fold is null").drop("fold")


@query("g3_train_holdout_partition", "SELECT 0::BIGINT AS n_intersection, count(*) AS n_union FROM orders")
def g3(spark, d):
    return split.partition_invariants(split.stratified_holdout(strata(spark, d), "row_id", "target"))


# H: scalar functions


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


@query("h1_normalize_text", "SELECT doc_id, md5(strip_accents(lower(text))) AS text_md5 FROM documents")
def h1(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("text_md5"))


@query("h2_code_tokens", f"WITH {_TOKENS} SELECT d.doc_id, count(term) AS n, md5(coalesce(string_agg(term, ' ' ORDER BY pos), '')) AS tokens_md5 FROM documents d LEFT JOIN tokens ON d.doc_id = tokens.row_id GROUP BY 1")
def h2(spark, d):
    t = X.code_tokens(X.normalize_text(F.col("text")))
    return _docs(spark, d).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("h3_word_ngrams", f"""WITH {_TOKENS}, l AS (SELECT row_id, list(term ORDER BY pos) AS t FROM tokens GROUP BY 1), g AS (SELECT row_id, unnest(t) AS term FROM l
 UNION ALL SELECT row_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM l UNION ALL SELECT row_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM l)
 SELECT row_id, count(*) AS n, count(DISTINCT term) AS n_distinct, sum(length(term))::BIGINT AS n_chars FROM g GROUP BY 1""")
def h3(spark, d):
    tokens = _docs(spark, d).select(F.col("doc_id").alias("row_id"), X.code_tokens(X.normalize_text(F.col("text"))).alias("tokens"))
    grams = tokens.select("row_id", X.word_ngrams(F.col("tokens"), 1, 3).alias("g"))
    chars = F.aggregate("g", F.lit(0).cast("long"), lambda total, g: total + F.length(g))
    counted = F.struct(F.size("g").cast("long").alias("n"), F.size(F.array_distinct("g")).cast("long").alias("n_distinct"), chars.alias("n_chars"))
    # The filter stands above a generator, through which it can't move: else n-grams and tokens would be made again for it.
    return grams.select("row_id", F.inline_outer(F.array(counted))).where("n > 0")


@query("h4_char_ngrams", r"""WITH c AS (SELECT doc_id, regexp_replace(text, '[ \t\n\r\f\v]{2,}', ' ', 'g') AS t FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS g FROM c)
 SELECT g AS gram, count(*) AS n FROM g GROUP BY 1""")
def h4(spark, d):
    return _docs(spark, d).select(F.explode(X.char_ngrams(F.col("text"), 3, 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("h5_sublinear_tf", f"WITH {_COUNTS} SELECT tf, round(1 + ln(tf), 6) AS w, count(*) AS n FROM counts GROUP BY 1, 2")
def h5(spark, d):
    c = tfidf.term_counts(_docs(spark, d), "doc_id", "text")
    return c.groupBy("tf").agg(F.count("*").alias("n")).select("tf", X.sublinear_tf(F.col("tf")).alias("w"), "n")


@query("h7_approx_token_len", f"WITH {HOLES} SELECT row_id, ({_LEN})::INT AS n FROM holes")
def h7(spark, d):
    return holes(spark, d).select("row_id", X.approx_token_len(F.col("func")).alias("n"))


@query("h8_parse_categories", f"WITH {CORPUS} SELECT row_id, {_CATS} AS category FROM corpus")
def h8(spark, d):
    return corpus(spark, d).select("row_id", F.explode(X.parse_categories(F.col("tags"))).alias("category"))


@query("h9_positive_probability", f"WITH {_LOGITS} SELECT event_id, round(exp(l1) / (exp(l0) + exp(l1)), 6) AS p FROM logits")
def h9(spark, d):
    return logits(spark, d).select("event_id", X.positive_probability(F.col("l0"), F.col("l1")).alias("p"))


@query("h10_experiment_id", "SELECT event_id, event_type || '_' || strftime(ts, '%Y%m%d-%H%M%S') || '_u-' || user_id AS exp_id, event_type || '_' || strftime(ts, '%Y%m%d-%H%M%S') AS family FROM events")
def h10(spark, d):
    e = table(spark, d, "events")
    x = X.experiment_id(F.col("event_type"), F.col("ts"), F.create_map(F.lit("u"), F.col("user_id").cast("string")))
    return e.select("event_id", x.alias("exp_id")).withColumn("family", X.experiment_family(F.col("exp_id")))


@query("h11_label_name", "SELECT l_linenumber AS label, CASE l_linenumber WHEN 0 THEN 'Secure (0)' WHEN 1 THEN 'Vulnerable (1)' ELSE l_linenumber::VARCHAR END AS name, count(*) AS n FROM lineitem GROUP BY 1, 2")
def h11(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("label"))
    return rows.groupBy("label", X.label_name(F.col("label")).alias("name")).agg(F.count("*").alias("n"))


@query("h12_clip_and_flag", "SELECT doc_id, least(length(text), 1000)::INT AS clipped, length(text) > 1000 AS truncated FROM documents")
def h12(spark, d):
    clipped, cut = X.clip_and_flag(F.length("text"), 1000)
    return _docs(spark, d).select("doc_id", clipped.alias("clipped"), cut.alias("truncated"))


def token_ids(spark, d) -> DataFrame:
    """The first 4096 token ids of each document, by the words of documents whose id is no multiple of 5."""
    plain = _docs(spark, d).select(F.col("doc_id").alias("row_id"), X.normalize_text(F.col("text")).alias("plain"))
    tokens = plain.select("row_id", X.code_tokens(F.col("plain")).alias("tokens"))
    return encode_tokens(tokens, "row_id", "tokens", word_ids(tokens.where("row_id % 5 <> 0"), "tokens"), 4096)


_IDS = _TOKENS + """, frequent AS (SELECT term, count(*) AS n FROM tokens WHERE row_id % 5 <> 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50000),
 words AS (SELECT term, (row_number() OVER (ORDER BY n DESC, term) + 1)::INT AS id FROM frequent),
 ids AS (SELECT d.doc_id AS row_id, coalesce(list(coalesce(w.id, 1) ORDER BY pos) FILTER (t.term IS NOT NULL), []) AS ids FROM documents d LEFT JOIN tokens t ON d.doc_id = t.row_id LEFT JOIN words w ON t.term = w.term GROUP BY 1)"""


@query("h13_truncate_pad_mask", f"""WITH {_IDS} SELECT row_id, array_to_string(list_concat(ids[1:4096], list_transform(range(4096 - len(ids[1:4096])), lambda x: 0)), ',') AS input_ids,
 array_to_string(list_concat(list_transform(ids[1:4096], lambda x: 1), list_transform(range(4096 - len(ids[1:4096])), lambda x: 0)), ',') AS mask FROM ids""")
def h13(spark, d):
    ids, mask = X.truncate_pad_mask(F.col("ids"), 4096, F.lit(4096))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return token_ids(spark, d).select("row_id", text(ids).alias("input_ids"), text(mask).alias("mask"))


# TF-IDF: fitted on the documents whose id is no multiple of 5


def _fitted(spark, d, **more) -> tuple[tfidf.TfidfPipeline, DataFrame]:
    """The pipeline with its defaults, and row_id, idx, tf and w of all documents' known terms.

    The documents' words are stored for both; the vocabulary, 50,000 rows, too, so that what follows does not count the terms once more.
    """
    docs = _docs(spark, d).select(F.col("doc_id").alias("row_id"), F.col("text").alias("func"))
    p, train = tfidf.TfidfPipeline(**more), F.col("row_id") % 5 != 0
    texts = p.texts(docs)
    p.fit(docs.where(train), texts=texts.where(train))
    p.vocabulary = stored(p.vocabulary, "vocabulary")
    return p, p.known(docs, texts)


def _vocabulary(spark, d) -> DataFrame:
    docs = _docs(spark, d).where("doc_id % 5 <> 0").select(F.col("doc_id").alias("row_id"), F.col("text").alias("func"))
    return tfidf.TfidfPipeline().fit(docs).vocabulary


def _named(p: tfidf.TfidfPipeline, known: DataFrame) -> DataFrame:
    """With the term of each idx."""
    side = p.vocabulary.select("idx", "term")
    return known.join(F.broadcast(side) if p.max_features <= tfidf.BROADCAST_TERMS else side, "idx")


@query("d16_build_vocabulary", f"WITH {_COUNTS}, {_VOCAB} SELECT term, idx, total_tf, df FROM vocab")
def d16(spark, d):
    return _vocabulary(spark, d).select("term", "idx", "total_tf", "df")


@query("d17_idf", f"WITH {_COUNTS}, {_VOCAB} SELECT term, round(idf, 6) AS idf FROM vocab")
def d17(spark, d):
    return _vocabulary(spark, d).select("term", "idf")


@query("f2_top_tokens", f"WITH {_COUNTS}, {_VOCAB} SELECT term, round(idf, 6) AS idf FROM vocab ORDER BY vocab.idf DESC, term LIMIT 30")
def f2(spark, d):
    return tfidf.top_tokens(_vocabulary(spark, d))


@query("f6_cap_vocabulary", f"WITH {_COUNTS} SELECT term, sum(tf)::BIGINT AS total_tf FROM counts WHERE row_id % 5 <> 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50000")
def f6(spark, d):
    return _vocabulary(spark, d).select("term", "total_tf")


@query("c3_vocab_lookup", f"WITH {_COUNTS}, {_VOCAB} SELECT c.row_id, v.idx, c.tf FROM counts c JOIN vocab v ON c.term = v.term")
def c3(spark, d):
    return _fitted(spark, d)[1].select("row_id", "idx", "tf")


@query("i1_tfidf_pipeline", f"WITH {_COUNTS}, {_VOCAB}, {_WEIGHTS} SELECT row_id, term, idx, tf, round(w, 6) AS w FROM weights")
def i1(spark, d):
    p, known = _fitted(spark, d)
    return _named(p, known).select("row_id", "term", "idx", "tf", "w")


@query("h6_l2_normalize", f"WITH {_COUNTS}, {_VOCAB}, {_WEIGHTS} SELECT row_id, round(sqrt(sum(w * w)), 6) AS norm FROM weights GROUP BY 1")
def h6(spark, d):
    return _fitted(spark, d)[1].groupBy("row_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


@query("d18_max_abs_scale", f"WITH {_COUNTS}, {_VOCAB}, {_WEIGHTS}, s AS (SELECT term, max(abs(w)) AS m FROM weights WHERE row_id % 5 <> 0 GROUP BY 1) SELECT row_id, w.term, round(w / m, 6) AS w FROM weights w JOIN s ON w.term = s.term")
def d18(spark, d):
    p, known = _fitted(spark, d)
    weights = stored(known.select("row_id", "idx", "w"), "weights")  # read for the scales and for the result
    scales = _named(p, tfidf.max_abs(weights.where(F.col("row_id") % 5 != 0), "idx"))
    return tfidf.max_abs_scale(weights, scales, p.max_features, "idx").select("row_id", "term", "w")


# I: models and whole runs


def probe(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", (F.col("label") == 1).cast("int").alias("label"))
    return models.embedding_features(rows, "embedding")


PROBE = "probe AS (SELECT vec_id AS row_id, (label = 1)::INT AS target FROM embeddings)"


def _probe_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Training rows and holdout."""
    rows = stored(probe(spark, d), "probe")
    sides = split.stratified_holdout(rows, "row_id", "label")
    both = stored(rows.join(sides.select("row_id", "split"), "row_id"), "probe-sides")
    return both.where("split = 'train'"), both.where("split = 'holdout'")


def _probe_scores(spark, d, fit) -> DataFrame:
    train, held = _probe_sides(spark, d)
    return _probe_run(models.predict_proba(fit(train), held))


def _probe_run(scored: DataFrame) -> DataFrame:
    return scored.select(F.lit("EXP_2").alias("exp_id"), F.lit(-1).alias("fold"), "row_id", "label", "score")


#: A gradient per row below which a model counts as the solution; the solver stops at a relative change of 1e-9.
SOLVED = 1e-6


@query("i2_weighted_logistic", f"""WITH {PROBE}, {_split_sql('probe')} SELECT count(*) AS n, sum(label)::BIGINT AS n_pos, round(count(*) / (2.0 * sum(1 - label)), 6) AS weight_0,
 round(count(*) / (2.0 * sum(label)), 6) AS weight_1, true AS solved FROM split WHERE split = 'train'""")
def i2(spark, d):
    """The fit, and the proof that it solves the weighted objective."""
    train, _ = _probe_sides(spark, d)
    return models.certificate(models.weighted_logistic(train), train).withColumn("solved", F.col("gradient") < SOLVED).drop("gradient")


@query("i2_holdout_metrics")
def i2b(spark, d):
    return metrics.evaluate(_probe_scores(spark, d, models.weighted_logistic))


@query("i3_weighted_random_forest")
def i3(spark, d):
    return metrics.evaluate(_probe_run(forest.grown_scores(*_probe_sides(spark, d))))


@query("i4_predict_proba", f"WITH {PROBE}, {_split_sql('probe')} SELECT row_id, label, true AS proven FROM split WHERE split = 'holdout'")
def i4(spark, d):
    """The scored rows; proven where the score is the logistic function of the margin summed up from the coefficients."""
    train, held = _probe_sides(spark, d)
    model = models.weighted_logistic(train)
    scored = models.predict_proba(model, held).join(models.margins(model, held), "row_id")
    return scored.select("row_id", "label", (F.abs(F.col("score") - F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))) < 1e-9).alias("proven"))


@query("i4_scores")
def i4b(spark, d):
    return _probe_scores(spark, d, models.weighted_logistic)


@query("i8_embedding_probe", f"""WITH {PROBE}, {_split_sql('probe')} SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'holdout') AS n_holdout,
 round(avg(label) FILTER (split = 'holdout'), 6) AS baseline, (SELECT max(len(embedding)) FROM embeddings)::INT AS dimensions, true AS solved FROM split""")
def i8(spark, d):
    """A probe of the embeddings: its sizes, the holdout's baseline, and the proof of the fit."""
    train, held = _probe_sides(spark, d)
    model = models.weighted_logistic(train)
    proof = models.certificate(model, train).select(F.col("n").alias("n_train"), F.lit(model.numFeatures).alias("dimensions"), (F.col("gradient") < SOLVED).alias("solved"))
    return held.agg(F.count("*").alias("n_holdout"), F.avg("label").alias("baseline")).crossJoin(F.broadcast(proof))  # a row each


@query("i8_average_precision")
def i8b(spark, d):
    return metrics.average_precision(_probe_scores(spark, d, models.weighted_logistic))


def _cv(spark, d) -> experiment.CrossValidation:
    # Stored, as each rank counts its rows first: else repeated rows would be removed anew for every count.
    c = stored(experiment.load_corpus(corpus(spark, d), "row_id"), "corpus")
    sides = stored(split.stratified_holdout(c, "row_id", "target"), "sides")
    return experiment.CrossValidation(split.attach_fold(c, sides, stored(split.stratified_kfold(sides), "folds"), "row_id"))


def _logistic(t):
    """At the surveyed tolerance."""
    return models.weighted_logistic(t, tol=1e-4)


def _forest(t):
    """Smaller than the operator's default of 300 trees of depth 30, which i3 runs; ten such forests take an hour in local mode."""
    return models.weighted_random_forest(t, trees=20, depth=10)


@query("i5_run_cv_experiment")
def i5(spark, d):
    return _cv(spark, d).run("EXP_0", _logistic)[0]


@query("i6_run_experiments")
def i6(spark, d):
    return _cv(spark, d).run_all({"EXP_0": _logistic, "EXP_1": _forest})


@query("i7_evaluate_holdout")
def i7(spark, d):
    path = new_path(spark, "metrics")
    _cv(spark, d).holdout("EXP_0", _logistic, path)
    return files.load_metrics(spark, path, holdout=True)


@query("i9_assemble_batches", f"""WITH {_IDS}, r AS (SELECT row_id, ids[1:4096] AS ids, (row_number() OVER (ORDER BY md5('5:' || row_id), row_id) - 1) // 8 AS batch_id FROM ids), m AS (SELECT batch_id, max(len(ids)) AS t FROM r GROUP BY 1)
 SELECT r.batch_id::BIGINT AS batch_id, row_id, array_to_string(list_concat(ids, list_transform(range(t - len(ids)), lambda x: 0)), ',') AS input_ids, len(ids)::INT AS n_real FROM r JOIN m ON r.batch_id = m.batch_id""")
def i9(spark, d):
    b = batching.assemble_batches(token_ids(spark, d), "row_id", "ids", seed=5)
    text = F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")
    return b.select("batch_id", "row_id", text.alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"))


@query("i9_padding_waste", f"""WITH {_IDS}, r AS (SELECT len(ids[1:4096]) AS n, (row_number() OVER (ORDER BY md5('5:' || row_id), row_id) - 1) // 8 AS batch_id FROM ids), m AS (SELECT batch_id, n, max(n) OVER (PARTITION BY batch_id) AS t FROM r)
 SELECT count(DISTINCT batch_id) AS n_batches, count(*) AS n_rows, round(sum(t - n) / sum(t), 6) AS waste FROM m""")
def i9b(spark, d):
    return batching.padding_waste(batching.assemble_batches(token_ids(spark, d), "row_id", "ids", seed=5))


@query("i10_experiment_grid")
def i10(spark, d):
    out = _cv(spark, d).run_all(experiment.grid("lr_sweep", models.weighted_logistic, c=[0.01, 0.1, 1.0, 10.0], tol=[1e-4]))
    return metrics.select_best_config(out.withColumn("family", X.experiment_family(F.col("exp_id"))))


@query("i11_corpus_profile", f"""WITH {CORPUS}, {_TOP}, l AS (SELECT target AS label, {_LEN} AS len FROM corpus), e AS (SELECT {_CATS} AS category FROM corpus WHERE target = 1)
 SELECT 'classes' AS part, target::VARCHAR AS name, count(*)::DOUBLE AS value FROM corpus GROUP BY 2
 UNION ALL SELECT 'schema', c, 0 FROM (VALUES ('row_id'), ('func'), ('target'), ('project'), ('lang'), ('tags')) v(c)
 UNION ALL SELECT 'lengths', coalesce(label::VARCHAR, 'all'), round(avg(len), 6) FROM l GROUP BY GROUPING SETS ((label), ())
 UNION ALL SELECT 'truncation', t::VARCHAR, round(avg((len > t)::INT) * 100, 6) FROM l, (VALUES (512), (1024), (2048), (4096), (8192)) v(t) GROUP BY t
 UNION ALL SELECT 'categories', category, count(*) FROM e GROUP BY 2
 UNION ALL SELECT 'categories_by_class', top.category, count(*) FILTER (target = 1) FROM cats JOIN top ON cats.category = top.category GROUP BY 2
 UNION ALL SELECT 'summary', 'total', count(*) FROM corpus UNION ALL SELECT 'summary', 'n_secure', count(*) FILTER (target = 0) FROM corpus
 UNION ALL SELECT 'summary', 'n_vulnerable', count(*) FILTER (target = 1) FROM corpus""")
def i11(spark, d):
    """All tables of the profile in long form, one value of each row."""
    tables = experiment.corpus_profile(corpus(spark, d), "func", "target", X.parse_categories(F.col("tags")))
    long = lambda part, name, value: tables[part].select(F.lit(part).alias("part"), name.alias("name"), F.col(value).cast("double").alias("value"))
    label = F.coalesce(F.col("label").cast("string"), F.lit("all"))
    out = long("classes", label, "n").unionByName(long("schema", F.col("column_name"), "n_nulls")).unionByName(long("lengths", label, "mean_len"))
    out = out.unionByName(long("truncation", F.col("threshold").cast("string"), "pct_truncated")).unionByName(long("categories", F.col("category"), "n"))
    out = out.unionByName(long("categories_by_class", F.col("category"), "n_vulnerable"))
    return reduce(DataFrame.unionByName, [long("summary", F.lit(c), c) for c in ("total", "n_secure", "n_vulnerable")], out)


@query("i12_load_corpus", f"WITH {HOLES} SELECT min(row_id) AS row_id, target, md5(func) AS text_md5 FROM holes WHERE func IS NOT NULL AND target IS NOT NULL GROUP BY 2, 3")
def i12(spark, d):
    return experiment.load_corpus(holes(spark, d), "row_id").select("row_id", "target", F.md5("func").alias("text_md5"))
