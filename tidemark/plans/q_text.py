"""Queries for the bag-of-words detector pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import folds as FO
from tidemark.operators import naive_bayes as NB
from tidemark.operators import text_features as TF
from tidemark.plans import views as V
from tidemark.plans.catalog import query
from tidemark.plans.sqlkit import CORPUS
from tidemark.session import stored
from tidemark.sources.tables import table

TERMS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}', 0)"
SPLIT_SQL = (
    "split AS (SELECT *, (CAST(('0x' || substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000) "
    "< 100 AS is_test FROM corpus)"
)


def _tf_sql(src: str) -> str:
    return (
        f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM {src}) "
        "GROUP BY doc_id, term)"
    )


def _vectors_sql(k: int | None, vectorizer: str) -> str:
    """CTEs ``voc`` and ``vec`` (long entries) with the vocabulary and idf fitted on training rows."""
    top = "" if k is None else f"ORDER BY c DESC, term LIMIT {k}"
    base = (
        f"{CORPUS}, {SPLIT_SQL}, {_tf_sql('split')}, "
        "train_tf AS (SELECT tf.* FROM tf JOIN split USING (doc_id) WHERE NOT is_test), "
        "voc AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM "
        f"(SELECT term, sum(tf) AS c FROM train_tf GROUP BY term {top})), "
        "cnt AS (SELECT doc_id, idx, CAST(tf AS DOUBLE) AS value FROM tf JOIN voc USING (term))"
    )
    if vectorizer == "count":
        return base + ", vec AS (SELECT * FROM cnt)"
    return base + (
        ", idf AS (SELECT idx, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf FROM train_tf JOIN voc USING (term), "
        "(SELECT count(*) AS n FROM split WHERE NOT is_test) GROUP BY idx, n), "
        "rawv AS (SELECT doc_id, idx, value * idf AS raw FROM cnt JOIN idf USING (idx)), "
        "vec AS (SELECT doc_id, idx, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS value FROM rawv)"
    )


def _split(spark, sf_dir):
    return FO.train_test_split(V.corpus(spark, sf_dir), "doc_id", 0.1)


@query(
    "h06_terms",
    f"WITH {_tf_sql('documents')} SELECT doc_id, term, CAST(tf AS BIGINT) AS tf FROM tf",
)
def h06(spark, sf_dir):
    return TF.term_counts(table(spark, sf_dir, "documents"))


@query(
    "h07_vocab",
    f"WITH {CORPUS}, {_tf_sql('corpus')}, top AS (SELECT term, sum(tf) AS count, count(*) AS df FROM tf GROUP BY term "
    "ORDER BY count DESC, term LIMIT 62) SELECT term, CAST(count AS BIGINT) AS count, CAST(df AS BIGINT) AS df, "
    "CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS idx FROM top",
)
def h07(spark, sf_dir):
    return TF.vocab(TF.term_counts(V.corpus(spark, sf_dir)), max_features=62)


@query(
    "h08_count_vectorize",
    f"WITH {_vectors_sql(62, 'count')} SELECT doc_id, CAST(idx AS BIGINT) AS idx, round(value, 6) AS value FROM vec",
)
def h08(spark, sf_dir):
    docs = _split(spark, sf_dir)
    long, _ = TF.fit_transform(docs, ~F.col("is_test"), 62, "count")
    return long


@query(
    "h09_tfidf",
    f"WITH {_vectors_sql(62, 'tf')} SELECT doc_id, CAST(idx AS BIGINT) AS idx, round(value, 6) AS value FROM vec",
)
def h09(spark, sf_dir):
    docs = _split(spark, sf_dir)
    long, _ = TF.fit_transform(docs, ~F.col("is_test"), 62, "tf")
    return long


@query(
    "h10_stratified_folds",
    f"WITH {CORPUS} SELECT doc_id, CAST(label AS BIGINT) AS label, CAST((row_number() OVER (PARTITION BY label "
    "ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS BIGINT) AS fold FROM corpus",
)
def h10(spark, sf_dir):
    return FO.stratified_folds(V.corpus(spark, sf_dir).select("doc_id", "label"), "doc_id", "label", 5)


@query(
    "h11_permute_labels",
    f"WITH {CORPUS}, a AS (SELECT label, row_number() OVER (ORDER BY doc_id) AS pos FROM corpus), "
    "b AS (SELECT doc_id, label, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS pos "
    "FROM corpus) SELECT b.doc_id, CAST(b.label AS BIGINT) AS label, CAST(a.label AS BIGINT) AS perm_label "
    "FROM b JOIN a USING (pos)",
)
def h11(spark, sf_dir):
    c = V.corpus(spark, sf_dir).select("doc_id", "label")
    return FO.permute_labels(c, "doc_id", "label", out="perm_label")


@query(
    "s15_train_test_split",
    f"WITH {CORPUS}, {SPLIT_SQL} SELECT doc_id, is_test FROM split",
)
def s15(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", "is_test")


_GAUSS_SQL = (
    "feat AS (SELECT s.doc_id, s.label, s.is_test, r.idx, coalesce(t.value, 0.0) AS x FROM split s "
    "CROSS JOIN (SELECT idx FROM voc) r LEFT JOIN vec t ON t.doc_id = s.doc_id AND t.idx = r.idx), "
    "stats AS (SELECT label, idx, avg(x) AS theta, var_pop(x) AS v FROM feat WHERE NOT is_test GROUP BY label, idx), "
    "eps AS (SELECT max(v) * 1e-9 AS eps FROM (SELECT idx, var_pop(x) AS v FROM feat WHERE NOT is_test GROUP BY idx)), "
    "params AS (SELECT label, idx, theta, v + eps AS sigma FROM stats, eps), "
    "pri AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS lp FROM split WHERE NOT is_test GROUP BY label), "
    "jll AS (SELECT f.doc_id, p.label, sum(-0.5 * ln(2 * pi() * p.sigma) - 0.5 * (f.x - p.theta) * (f.x - p.theta) "
    "/ p.sigma) + any_value(pr.lp) AS j FROM feat f JOIN params p USING (idx) JOIN pri pr ON pr.label = p.label "
    "WHERE f.is_test GROUP BY f.doc_id, p.label) "
    "SELECT doc_id, round(1.0 / (1.0 + exp(max(j) FILTER (WHERE label = 0) - max(j) FILTER (WHERE label = 1))), 6) "
    "AS proba FROM jll GROUP BY doc_id"
)


@query("h13_gaussian_nb", f"WITH {_vectors_sql(34, 'tf')}, {_GAUSS_SQL}")
def h13(spark, sf_dir):
    docs = _split(spark, sf_dir)
    long, voc = TF.fit_transform(docs, ~F.col("is_test"), 34, "tf")
    size = voc.count()  # bounded by max_features
    dense = stored(TF.dense(long, docs.select("doc_id", "label", "is_test"), size))  # read by every part of the fit
    params, priors = NB.gaussian_fit(dense.filter(~F.col("is_test")))
    return NB.gaussian_predict(params, priors, dense.filter(F.col("is_test")))


_MULTI_SQL = (
    "tr AS (SELECT v.idx, s.label, v.value FROM vec v JOIN split s USING (doc_id) WHERE NOT s.is_test), "
    "cls AS (SELECT label, count(*) AS n_c FROM split WHERE NOT is_test GROUP BY label), "
    "grid AS (SELECT label, idx FROM cls, voc), "
    "fc AS (SELECT g.label, g.idx, coalesce(sum(tr.value), 0.0) AS fc FROM grid g LEFT JOIN tr "
    "ON tr.label = g.label AND tr.idx = g.idx GROUP BY g.label, g.idx), "
    "params AS (SELECT label, idx, ln((fc + 1.0) / (sum(fc) OVER (PARTITION BY label) + 1.0 * (SELECT count(*) "
    "FROM voc))) AS flp FROM fc), "
    "pri AS (SELECT label, ln(n_c / sum(n_c) OVER ()) AS lp FROM cls), "
    "ll AS (SELECT v.doc_id, p.label, sum(v.value * p.flp) AS ll FROM vec v JOIN params p USING (idx) GROUP BY ALL), "
    "jll AS (SELECT s.doc_id, pr.label, coalesce(ll.ll, 0.0) + pr.lp AS j FROM split s CROSS JOIN pri pr "
    "LEFT JOIN ll ON ll.doc_id = s.doc_id AND ll.label = pr.label WHERE s.is_test) "
    "SELECT doc_id, round(1.0 / (1.0 + exp(max(j) FILTER (WHERE label = 0) - max(j) FILTER (WHERE label = 1))), 6) "
    "AS proba FROM jll GROUP BY doc_id"
)


@query("h14_multinomial_nb", f"WITH {_vectors_sql(62, 'count')}, {_MULTI_SQL}")
def h14(spark, sf_dir):
    docs = _split(spark, sf_dir)
    long, voc = TF.fit_transform(docs, ~F.col("is_test"), 62, "count")
    size = voc.count()  # bounded by max_features
    labelled = long.join(docs.select("doc_id", "label", "is_test"), "doc_id")
    train_ids = docs.filter(~F.col("is_test")).select("doc_id", "label")
    params, priors = NB.multinomial_fit(labelled.filter(~F.col("is_test")), train_ids, size)
    test_ids = docs.filter(F.col("is_test")).select("doc_id")
    return NB.multinomial_predict(params, priors, labelled.filter(F.col("is_test")).drop("label"), test_ids)


def _whole_vocabulary(spark, sf_dir, model_type, vectorizer):
    docs = _split(spark, sf_dir)
    tf = stored(TF.term_counts(docs))
    train, test = docs.filter(~F.col("is_test")).select("doc_id", "label"), docs.filter(F.col("is_test")).select("doc_id")
    entries = stored(TF.term_vectors(tf, train, vectorizer))
    params, const = NB.sparse_fit(entries.join(train, "doc_id"), train, model_type)
    return NB.sparse_predict(params, const, entries.join(test, "doc_id", "left_semi"), test)


@query("h13b_gaussian_whole_vocabulary", f"WITH {_vectors_sql(None, 'tf')}, {_GAUSS_SQL}")
def h13b(spark, sf_dir):
    """Gaussian naive Bayes on tf-idf entries of every term of the training rows, nothing dense."""
    return _whole_vocabulary(spark, sf_dir, "gaussian", "tf")


@query("h14b_multinomial_whole_vocabulary", f"WITH {_vectors_sql(None, 'tf')}, {_MULTI_SQL}")
def h14b(spark, sf_dir):
    """Multinomial naive Bayes on tf-idf entries of every term of the training rows (the `gutenberg` profile's model)."""
    return _whole_vocabulary(spark, sf_dir, "multi", "tf")
