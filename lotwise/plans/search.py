"""Queries of text, vectors, retrieval and ranking."""

from __future__ import annotations

from datetime import datetime
from functools import cache, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators import legs, ranking, retrieval, text, vectors
from lotwise.operators.sizes import small
from lotwise.session import load
from lotwise.sources.sinks import stored

from .views import AUCTIONS_SQL, listings, query, rounded

_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
_TOKENS = "list_filter(regexp_extract_all(lower({0}), '([a-z0-9]+)'), lambda w: length(w) >= 2 AND NOT list_contains(" + _STOP + ", w))"
TOK = f"t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents)"
QTOK = f"q AS (SELECT item_id AS query_id, unnest({_TOKENS.format('text')}) AS token FROM benchmark)"
_BUCKET = "CAST(CAST(('0x' || left(sha256({0}), 16)) AS UHUGEINT) % {1} AS INTEGER)"


def doc_tokens(spark, d) -> DataFrame:
    return text.doc_tokens(load(spark, d, "documents"), "doc_id", "text")


def query_tokens(spark, d) -> DataFrame:
    return load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.tokenize(F.col("text"))).alias("token"))


def words_found(spark, d, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: the ``k`` best documents of each query by their words."""
    return text.bm25_dot(query_tokens(spark, d), load(spark, d, "documents"), "doc_id", "text", k)


@query(f"SELECT doc_id, array_to_string(list_slice({_TOKENS.format('text')}, 1, 64), ' ') AS first_64, len({_TOKENS.format('text')}) AS n, md5(array_to_string({_TOKENS.format('text')}, ' ')) AS tokens_md5 FROM documents")
def txt_tokenize(spark, d):
    own = load(spark, d, "documents").select("doc_id", text.tokenize(F.col("text"), cap=64).alias("first"), text.tokenize(F.col("text")).alias("all"))
    return own.select("doc_id", F.array_join("first", " ").alias("first_64"), F.size("all").cast("long").alias("n"), F.md5(F.array_join("all", " ")).alias("tokens_md5"))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"


@query(f"WITH h AS (SELECT page_id, string_split({_HOST}, '.') AS l FROM pages) SELECT page_id, l[-2] AS sld, l[-1] AS tld, array_to_string(regexp_extract_all(l[-2], '([a-z]+|[0-9]+)'), ' ') AS tokens FROM h")
def txt_segment(spark, d):
    s = load(spark, d, "pages").select("page_id", text.segment(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("s"))
    return s.select("page_id", "s.sld", "s.tld", F.array_join("s.tokens", " ").alias("tokens"))


_WORDS = ["red", "blue", "small", "large", "ring", "bolt", "widget", "gear"]
_WHOLE = 6  # parts at most, else the word stays whole
#: What the splitter makes of names: their words have no other dictionary word inside them or over their border.
_SPLIT_SQL = "CASE WHEN list_contains([" + ", ".join(f"'{w}'" for w in _WORDS) + "], {0}) THEN [{0}] ELSE string_split({0}, '') END"
_PARTS_SQL = f"list_concat({_SPLIT_SQL.format('split_part(p_name, chr(32), 1)')}, {_SPLIT_SQL.format('split_part(p_name, chr(32), 2)')})"
_JOINED_SQL = f"j AS (SELECT *, replace(p_name, ' ', '') AS joined, CASE WHEN len({_PARTS_SQL}) <= {_WHOLE} THEN {_PARTS_SQL} ELSE [replace(p_name, ' ', '')] END AS parts FROM part)"


def _joined(spark, d) -> DataFrame:
    return load(spark, d, "part").withColumn("joined", F.replace("p_name", F.lit(" "), F.lit("")))


@query(f"WITH {_JOINED_SQL} SELECT p_partkey, joined, array_to_string(parts, ' ') AS parts FROM j")
def txt_compound_split(spark, d):
    split = text.compound_udf({w: 2.0 for w in _WORDS})
    return _joined(spark, d).select("p_partkey", "joined", F.array_join(split("joined"), " ").alias("parts"))


@query(f"WITH {_JOINED_SQL}, k AS (SELECT *, {_SPLIT_SQL.format('lower(p_type)')} AS kind FROM j) SELECT p_partkey, array_to_string(list_concat(parts, CASE WHEN len(kind) <= {_WHOLE} THEN kind ELSE [lower(p_type)] END), ' ') AS expanded FROM k")
def txt_query_compound(spark, d):
    split = text.compound_udf({w: 2.0 for w in _WORDS})
    asked = _joined(spark, d).withColumn("query", F.concat_ws(" ", "joined", F.lower("p_type")))
    words = asked.select("p_partkey", F.posexplode(F.split("query", " ")).alias("i", "w")).select("p_partkey", "i", split("w").alias("s"))
    return words.groupBy("p_partkey").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"])), " ").alias("expanded"))


_PAIRS = [("er", "ere"), ("on", "onn"), ("edon", "oner"), ("sh", "shed"), ("tion", "tions")]
_SYN = "s AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PAIRS) + ") v(a, b)), sy AS (SELECT a, b FROM s UNION SELECT b, a FROM s)"


@query(f"""WITH {TOK}, {_SYN}, o AS (SELECT DISTINCT doc_id, token FROM t), m AS (SELECT doc_id, token, b, row_number() OVER (PARTITION BY doc_id, token ORDER BY b) AS k FROM o JOIN sy ON token = a)
    SELECT doc_id, token, 1.0::DOUBLE AS weight FROM o UNION ALL SELECT DISTINCT m.doc_id, b, 0.5::DOUBLE FROM m WHERE k <= 3 AND NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = m.doc_id AND o.token = b)""")
def txt_synonym_expand(spark, d):
    return text.synonym_expand(doc_tokens(spark, d), spark.createDataFrame(_PAIRS, "a string, b string"))


@query(f"WITH {TOK}, {_SYN} SELECT token, count(*) AS n FROM t WHERE token NOT IN (SELECT a FROM sy) GROUP BY ALL HAVING count(*) >= 20")
def txt_synonym_misses(spark, d):
    return text.synonym_misses(doc_tokens(spark, d), spark.createDataFrame(_PAIRS, "a string, b string"), 20)


_BM25 = f"""tf AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL), av AS (SELECT avg(dl) AS avgdl FROM dl),
    bd AS (SELECT doc_id, {_BUCKET.format("token", 65536)} AS bucket, sum(2.2 * tf / (1.2 * (0.25 + 0.75 * dl / avgdl) + tf)) AS weight FROM tf JOIN dl USING (doc_id), av GROUP BY ALL)"""
_BQ = f"bq AS (SELECT query_id, {_BUCKET.format('token', 65536)} AS bucket, sum(1 + ln(1 + tf)) AS weight FROM (SELECT query_id, token, count(*) AS tf FROM q GROUP BY ALL) GROUP BY ALL)"


@query(f"WITH {TOK}, {_BM25} SELECT doc_id, bucket, near(weight) AS weight FROM bd")
def vec_bm25_doc(spark, d):
    return rounded(text.bm25_docs(doc_tokens(spark, d)))


@query(f"""WITH {QTOK}, {_SYN}, tf AS (SELECT query_id, token, count(*) AS tf FROM q GROUP BY ALL), m AS (SELECT query_id, b, row_number() OVER (PARTITION BY query_id, token ORDER BY b) AS k FROM tf JOIN sy ON token = a),
    w AS (SELECT query_id, token, 1 + ln(1 + tf) AS w FROM tf UNION ALL SELECT DISTINCT m.query_id, b, 0.5 * (1 + ln(2)) FROM m WHERE k <= 3 AND NOT EXISTS (SELECT 1 FROM tf WHERE tf.query_id = m.query_id AND tf.token = b)) SELECT query_id, {_BUCKET.format('token', 65536)} AS bucket, near(sum(w)) AS weight FROM w GROUP BY ALL""")
def vec_bm25_query(spark, d):
    return rounded(text.bm25_queries(query_tokens(spark, d), synonyms=spark.createDataFrame(_PAIRS, "a string, b string")))


_DOT = f"{TOK}, {QTOK}, {_BM25}, {_BQ}, sc AS (SELECT query_id, doc_id, sum(bq.weight * bd.weight) AS score FROM bq JOIN bd USING (bucket) GROUP BY ALL), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 10)"


@query(f"WITH {_DOT} SELECT query_id, doc_id, near(score) AS score, rank FROM rk")
def join_sparse_dot(spark, d):
    return rounded(words_found(spark, d, 10))


@query(f"""WITH p AS (SELECT p_partkey AS doc_id, unnest(string_split(p_name, ' ')) AS token FROM part), m AS (SELECT doc_id, '^' || token || '$' AS m FROM p),
    g AS (SELECT doc_id, substr(m, i, n) AS gram FROM m, (VALUES (3), (4)) v(n), range(1, 30) r(i) WHERE i <= length(m) - n + 1), tf AS (SELECT doc_id, {_BUCKET.format("gram", 16384)} AS bucket, count(*) AS tf FROM g GROUP BY ALL)
    SELECT doc_id, bucket, near(1 + ln(1 + tf)) AS weight FROM tf""")
def vec_char_ngram(spark, d):
    tokens = load(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.split("p_name", " ")).alias("token"))
    return rounded(text.ngram_vectors(tokens))


_KNN = "c AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)"


@query(f"WITH {_KNN} SELECT query_id, id, near((s + 1) / 2) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM c QUALIFY rank <= 10")
def vec_pivot_knn(spark, d):
    """The same neighbours from cells about pivots."""
    e = load(spark, d, "embeddings")
    index = vectors.Pivots(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    return rounded(index.search(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), 10)[0])


def _components(df: DataFrame, key: str, v) -> DataFrame:
    """``key``, i (from 1), x: a row for each component."""
    return df.select(key, F.posexplode(v).alias("i", "x")).select(key, (F.col("i") + 1).cast("long").alias("i"), "x")


def _knn(spark, d, k: int) -> DataFrame:
    e = load(spark, d, "embeddings")
    return vectors.knn(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), k)


@query(f"WITH {_KNN} SELECT query_id, id, near((s + 1) / 2) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM c QUALIFY rank <= 10")
def vec_dense_knn(spark, d):
    return rounded(_knn(spark, d, 10))


@query(f"WITH {_KNN} SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM c QUALIFY rank <= 3")
def join_knn(spark, d):
    return _knn(spark, d, 3).drop("score")


@query(f"WITH {TOK}, c AS (SELECT doc_id, CAST(CAST(('0x' || left(sha256('s|' || token), 8)) AS BIGINT) % 256 AS INTEGER) AS bucket, count(*) AS c FROM t GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(c * c)) AS norm FROM c GROUP BY ALL) SELECT doc_id, bucket, near(c / norm) AS weight FROM c JOIN n USING (doc_id)")
def vec_hash_text(spark, d):
    return rounded(text.hashed_text(doc_tokens(spark, d)))


@query("WITH t AS (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, i, near(v[i] / sqrt(list_inner_product(v, v))) AS x FROM t, (SELECT unnest(range(1, 17)) AS i) r")
def vec_truncate(spark, d):
    t = load(spark, d, "embeddings").select("vec_id", vectors.truncate(F.col("embedding"), 16).alias("v"))
    return rounded(_components(t, "vec_id", F.col("v")))


@query(f"WITH {_KNN}, e AS (SELECT * FROM c WHERE id < query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) = 1) SELECT q.vec_id AS query_id, CASE WHEN s >= 0.2 THEN id END AS match FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) q LEFT JOIN e ON q.vec_id = e.query_id")
def vec_semantic_match(spark, d):
    e = load(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    best = vectors.knn(queries, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 1, earlier=True)
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.when(F.col("score") >= 0.6, F.col("id")).alias("match"))


def _labelled(spark, d) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.col("lang").alias("label"), text.tokenize(F.col("text")).alias("tokens"))


_GRAMS = f"dt AS (SELECT doc_id, lang AS label, {_TOKENS.format('text')} AS w FROM documents), g AS (SELECT DISTINCT doc_id, label, unnest(list_concat(w, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS gram FROM dt)"
_ODDS = f"""{_GRAMS}, gc AS (SELECT label, gram, count(*) AS n FROM g GROUP BY ALL), sz AS (SELECT label, count(*) AS size FROM dt GROUP BY ALL), tot AS (SELECT gram, sum(n) AS total FROM gc GROUP BY ALL), al AS (SELECT sum(size) AS a FROM sz),
    w AS (SELECT label, gram, ln(((n + 1) / (size - n + 1)) / ((total - n + 1) / (a - size - (total - n) + 1))) AS weight FROM gc JOIN tot USING (gram) JOIN sz USING (label), al), lo AS (SELECT * FROM w WHERE weight >= 0.5 QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(weight, 9) DESC, gram) <= 50)"""


@query(f"WITH {_ODDS} SELECT label, gram, near(weight) AS weight FROM lo")
def trn_ngram_log_odds(spark, d):
    return rounded(text.log_odds(_labelled(spark, d)))


@query(f"""WITH {_ODDS}, s AS (SELECT doc_id, lo.label, sum(weight) AS score FROM g JOIN lo ON g.gram = lo.gram GROUP BY ALL), b AS (SELECT *, lead(score) OVER p AS second, row_number() OVER p AS k FROM s WINDOW p AS (PARTITION BY doc_id ORDER BY round(score, 9) DESC, label))
    SELECT dt.doc_id, CASE WHEN score >= 1 AND score - coalesce(second, 0) >= 0.1 THEN b.label END AS label, near(coalesce(score, 0)) AS score FROM dt LEFT JOIN b ON dt.doc_id = b.doc_id AND k = 1""")
def txt_ngram_classify(spark, d):
    docs = _labelled(spark, d)
    return rounded(text.ngram_classify(docs.select("doc_id", "tokens"), text.log_odds(docs)))


_CENT = "u AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL), nn AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY ALL), ce AS (SELECT label, list(m / n ORDER BY i) AS c FROM m JOIN nn USING (label) GROUP BY ALL)"


@query(f"WITH {_CENT} SELECT label, i, near(c[i]) AS x FROM ce, (SELECT unnest(range(1, 65)) AS i) r")
def vec_centroid(spark, d):
    return rounded(_components(vectors.centroids(load(spark, d, "embeddings"), "label", "embedding"), "label", F.col("centroid")))


@query(f"WITH {_CENT}, s AS (SELECT vec_id, ce.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 9) AS s FROM embeddings, ce) SELECT vec_id, label, near(s) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1")
def vec_nearest_centroid(spark, d):
    e = load(spark, d, "embeddings")
    return rounded(vectors.nearest_centroid(e.drop("label"), vectors.centroids(e, "label", "embedding"), "label", "embedding", "vec_id", -1.0))


@query()
def vec_kmeans_spherical(spark, d):
    return vectors.kmeans(load(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 10).select("vec_id", "cluster")


@query(f"WITH {_CENT}, t AS (SELECT c FROM ce WHERE label = 0), v AS (SELECT vec_id, list_transform(list_zip(CAST(embedding AS DOUBLE[]), c), lambda p: p[1] - 0.5 * p[2]) AS v FROM embeddings, t) SELECT vec_id, i, near(v[i] / sqrt(list_inner_product(v, v))) AS x FROM v, (SELECT unnest(range(1, 65)) AS i) r")
def vec_topic_subtract(spark, d):
    e = load(spark, d, "embeddings")
    topic = vectors.centroids(e.where("label = 0"), "label", "embedding").select("centroid")
    return rounded(_components(e.join(F.broadcast(topic), F.lit(True)), "vec_id", vectors.subtract_topics(F.col("embedding"), [F.col("centroid")], 0.5)))


_FILTERS = {"price_min": 1000, "price_max": 60000, "tlds": ["brand1", "brand2", "brand3", "brand4"], "types": [16, 20], "bids_min": 3, "name_length_max": 10, "exclude_keywords": ["rod"], "ends_after": datetime(1997, 1, 1)}


@query(f"""WITH {AUCTIONS_SQL} SELECT auction_id, govalue, price FROM l WHERE price BETWEEN 1000 AND 60000 AND tld IN ('brand1', 'brand2', 'brand3', 'brand4') AND type_id IN (16, 20) AND bids >= 3 AND length(sld) <= 10
    AND NOT regexp_matches(sld, '(^|-)rod|rod(-|$)') AND ends_at >= TIMESTAMP '1997-01-01' ORDER BY govalue DESC, auction_id LIMIT 100""")
def ret_structured(spark, d):
    return retrieval.structured(listings(spark, d, latest=True), _FILTERS, "govalue", "auction_id", 100).select("auction_id", "govalue", "price")


def _lists(spark, d) -> DataFrame:
    """Two sources: the word leg, and the length of the documents that it found."""
    words = stored(words_found(spark, d, 10), "found")
    docs = load(spark, d, "documents").select("doc_id", "n_chars")
    lengths = words.select("query_id", "doc_id").join(docs, "doc_id").select("query_id", F.lit("length").alias("source"), F.col("doc_id").alias("item"), F.col("n_chars").cast("double").alias("score"))
    return words.select("query_id", F.lit("words").alias("source"), F.col("doc_id").alias("item"), F.round("score", 6).alias("score")).unionByName(lengths)


_LISTS = f"{_DOT}, li AS (SELECT query_id, 'words' AS source, doc_id AS item, round(score, 6) AS score FROM rk UNION ALL SELECT query_id, 'length', doc_id, CAST(n_chars AS DOUBLE) FROM rk JOIN documents USING (doc_id))"
_RRF = f"{_LISTS}, pl AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, item) AS r FROM li), fu AS (SELECT query_id, item, sum(CASE source WHEN 'words' THEN 2.0 ELSE 1.0 END / (60 + r)) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM pl GROUP BY ALL)"


@query(f"WITH {_RRF} SELECT query_id, item, round(score, 8) AS score, sources, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item) AS INTEGER) AS rank FROM fu")
def rnk_rrf(spark, d):
    return rounded(ranking.rrf(_lists(spark, d), {"words": 2.0}).withColumn("sources", F.array_join("sources", ",")), score=8)


@query(f"WITH {_RRF.replace('2.0 ELSE', '1.0 ELSE')} SELECT query_id, item, round(score, 8) AS score FROM fu")
def rnk_slice_rrf(spark, d):
    return rounded(ranking.rrf(_lists(spark, d)).select("query_id", "item", "score"), score=8)


@query(f"WITH {_LISTS} SELECT query_id, item, near(max(score) * CASE WHEN count(DISTINCT source) >= 2 THEN 1.1 ELSE 1 END) AS score, count(DISTINCT source) AS slices FROM li GROUP BY ALL")
def rnk_slice_max(spark, d):
    return rounded(ranking.slice_max(_lists(spark, d)))


@query(f"""WITH {_LISTS}, z AS (SELECT *, avg(score) OVER p - 3 * stddev_pop(score) OVER p AS lo, avg(score) OVER p + 3 * stddev_pop(score) OVER p AS hi FROM li WINDOW p AS (PARTITION BY query_id, source)) SELECT query_id, item, near(sum(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END)) AS score FROM z GROUP BY ALL""")
def rnk_dbsf(spark, d):
    return rounded(ranking.dbsf(_lists(spark, d)))


def _top(table: str, n: int) -> str:
    return f"(SELECT query_id, doc_id, round(score, 9) AS score FROM {table} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= {n})"


_HASHED = "SELECT {0} AS id, CAST(CAST(('0x' || left(sha256('{2}|' || token), 8)) AS BIGINT) % {3} AS INTEGER) AS bucket, count(*) AS c FROM {1} GROUP BY ALL"


def _dot_sql(name: str, left: str, right: str) -> str:
    return f"{name} AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.w * d.w) AS score FROM {left} q JOIN {right} d USING (bucket) GROUP BY ALL)"


def _unit_sql(name: str, rows: str) -> str:
    return f"{name}c AS ({rows}), {name}n AS (SELECT id, sqrt(sum(c * c)) AS n FROM {name}c GROUP BY ALL), {name} AS (SELECT id, bucket, c / n AS w FROM {name}c JOIN {name}n USING (id))"


#: Documents that pass the filter; legs on words, hashed words (the dense leg), character n-grams; a second hashing reranks.
_LEGS = f"""f AS (SELECT doc_id, text FROM documents WHERE lang = 'en' AND n_chars >= 200), {TOK.replace('FROM documents', 'FROM f')}, {QTOK}, {_BM25}, {_BQ}, ws AS (SELECT query_id, doc_id, sum(bq.weight * bd.weight) AS score FROM bq JOIN bd USING (bucket) GROUP BY ALL),
    {_unit_sql('hd', _HASHED.format('doc_id', 't', 's', 256))}, {_unit_sql('hq', _HASHED.format('query_id', 'q', 's', 256))}, {_dot_sql('ds', 'hq', 'hd')}, {_unit_sql('rd', _HASHED.format('doc_id', 't', 'r', 1024))}, {_unit_sql('rq', _HASHED.format('query_id', 'q', 'r', 1024))}, {_dot_sql('rs', 'rq', 'rd')},
    tg AS (SELECT doc_id AS id, token, count(*) AS c FROM t GROUP BY ALL), qg AS (SELECT query_id AS id, token, count(*) AS c FROM q GROUP BY ALL), wd AS (SELECT DISTINCT token FROM (SELECT token FROM tg UNION ALL SELECT token FROM qg)),
    gw AS (SELECT token, unnest(list_concat(list_transform(range(1, length(token) + 1), lambda i: substr('^' || token || '$', i, 3)), list_transform(range(1, length(token)), lambda i: substr('^' || token || '$', i, 4)))) AS gram FROM wd), gb AS (SELECT token, {_BUCKET.format("gram", 16384)} AS bucket, count(*) AS k FROM gw GROUP BY ALL),
    gd AS (SELECT id, bucket, 1 + ln(1 + sum(c * k)) AS w FROM tg JOIN gb USING (token) GROUP BY ALL), gq AS (SELECT id, bucket, 1 + ln(1 + sum(c * k)) AS w FROM qg JOIN gb USING (token) GROUP BY ALL), {_dot_sql('gs', 'gq', 'gd')},
    li AS (SELECT 'words' AS source, * FROM {_top('ws', 200)} UNION ALL SELECT 'dense', * FROM {_top('ds', 200)} UNION ALL SELECT 'grams', * FROM {_top('gs', 200)})"""
_POOL = """, pl AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS r FROM li), fu AS (SELECT query_id, doc_id, sum(1.0 / (60 + r)) AS score FROM pl GROUP BY ALL)"""


def _legs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three legs, the documents that pass the filter and the queries' tokens."""
    own, asked = load(spark, d, "documents").where("lang = 'en' AND n_chars >= 200"), query_tokens(spark, d)
    return legs.found(asked, own, "doc_id", "text", 200), own, asked


@query(f"""WITH {_LEGS}{_POOL}, hd2 AS (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 400), rr AS (SELECT h.query_id, h.doc_id, rs.score FROM hd2 h JOIN rs ON h.query_id = rs.query_id AND h.doc_id = rs.doc_id WHERE round(rs.score, 9) >= 0.05),
    kp AS (SELECT DISTINCT doc_id FROM t WHERE starts_with(token, 'th')) SELECT query_id, doc_id AS item, near(score) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM rr JOIN kp USING (doc_id) QUALIFY rank <= 20""")
def ret_hybrid(spark, d):
    found, own, asked = _legs(spark, d)
    again = text.hashed_text(asked.withColumnRenamed("query_id", "doc_id"), 1024, "r").withColumnRenamed("doc_id", "query_id")

    @cache
    def pool(items):
        """Tokens of the pool's texts, which alone are read again."""
        return text.doc_tokens(stored(own.select(F.col("doc_id").alias("item"), "text").join(small(items), "item", "left_semi"), "pool"), "item", "text")

    keep = lambda items: pool(items).where(F.col("token").startswith("th")).select(F.col("doc_id").alias("item"))
    return rounded(retrieval.hybrid(found, 20, prefetch=50, rerank=(again, lambda items: text.hashed_text(pool(items), 1024, "r")), pool=100, least=0.05, keep=keep, oversample=4))


@query(f"""WITH {_LEGS}, z AS (SELECT *, avg(score) OVER p - 3 * stddev_pop(score) OVER p AS lo, avg(score) OVER p + 3 * stddev_pop(score) OVER p AS hi FROM li WINDOW p AS (PARTITION BY query_id, source)), fu AS (SELECT query_id, doc_id, sum(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END) AS score FROM z GROUP BY ALL)
    SELECT query_id, doc_id AS item, near(score) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM fu QUALIFY rank <= 20""")
def ret_hybrid_dbsf(spark, d):
    return rounded(retrieval.hybrid(_legs(spark, d)[0], 20, prefetch=200, fusion="dbsf"))


@query("""WITH f AS (SELECT doc_id, n_chars FROM documents WHERE lang = 'en'), a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM f QUALIFY r <= 50), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS r FROM f QUALIFY r <= 50)
    SELECT doc_id AS item, round(sum(1 / (60 + r)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def ret_filter_only_rails(spark, d):
    f = load(spark, d, "documents").where("lang = 'en'").select("doc_id", "n_chars")
    a = f.orderBy(F.desc("n_chars"), "doc_id").limit(50).select(F.lit("longest").alias("source"), F.col("doc_id").alias("item"), F.col("n_chars").cast("double").alias("s"), (-F.col("doc_id")).cast("double").alias("t"))
    b = f.orderBy(F.desc("doc_id")).limit(50).select(F.lit("newest").alias("source"), F.col("doc_id").alias("item"), F.col("doc_id").cast("double").alias("s"), F.lit(0.0).alias("t"))
    lists = reduce(DataFrame.unionByName, [a, b]).withColumn("query_id", F.lit(0)).withColumn("score", F.struct("s", "t")).select("query_id", "source", "item", "score")
    return rounded(ranking.rrf(lists).select("item", "score"), score=8)


@query("""WITH q AS (SELECT item_id AS query_id, length(text) AS want FROM benchmark), s AS (SELECT query_id, doc_id, CASE WHEN abs(n_chars - want) <= 5 AND lang = 'de' THEN 0 WHEN abs(n_chars - want) <= 50 AND lang = 'de' THEN 1 WHEN abs(n_chars - want) <= 50 THEN 2 ELSE 3 END AS step FROM q JOIN documents ON abs(n_chars - want) <= 500),
    c AS (SELECT query_id, step, sum(n) OVER (PARTITION BY query_id ORDER BY step) AS n FROM (SELECT query_id, step, count(*) AS n FROM s GROUP BY ALL)) SELECT query_id, CAST(min(step) AS INTEGER) AS step_no, CAST(min(n) AS BIGINT) AS found FROM c WHERE n >= 3 GROUP BY ALL""")
def ret_relax_ladder(spark, d):
    q = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.length("text").alias("want"))
    docs = load(spark, d, "documents").select("doc_id", "n_chars", "lang")
    off = F.abs(F.col("n_chars") - F.col("want"))
    return retrieval.relax_ladder(q, docs, "want", "n_chars", 500, [(off <= 5) & (F.col("lang") == "de"), (off <= 50) & (F.col("lang") == "de"), off <= 50, F.lit(True)], least=3)


@query()
def rnk_mmr(spark, d):
    top = stored(words_found(spark, d, 10), "found")
    texts = load(spark, d, "documents").select("doc_id", "text").join(small(top.select("doc_id").distinct()), "doc_id", "left_semi")
    found = top.join(texts, "doc_id")  # texts are taken apart only where they were found
    return ranking.mmr(found.select("query_id", F.col("doc_id").alias("item"), "rank", text.tokenize(F.col("text")).alias("tokens")))


@query("""WITH p AS (SELECT p_partkey, p_retailprice / 1000 AS score, string_split(p_name, ' ') AS i, [['rde', 'boltt'], ['samll', 'gera'], ['hot']][1 + p_size % 3] AS q FROM part),
    b AS (SELECT *, list_transform(q, lambda x: list_max(list_transform(i, lambda y: CASE WHEN contains(y, x) OR contains(x, y) THEN 1.0 WHEN damerau_levenshtein(x, y) <= 2 THEN 1 - damerau_levenshtein(x, y) / greatest(length(x), length(y)) ELSE 0 END))) AS b FROM p),
    c AS (SELECT p_partkey, score, coalesce(list_max(list_filter(b, lambda z: z >= 0.6)), 0) * len(list_filter(b, lambda z: z >= 0.6)) / len(q) AS coverage, p_partkey % 7 AS query_id FROM b)
    SELECT query_id, p_partkey AS item, near(coverage) AS coverage, near(score + 0.5 * coverage) AS reranked, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score + 0.5 * coverage, 9) DESC, p_partkey) AS INTEGER) AS rank FROM c""")
def rnk_fuzzy(spark, d):
    asked = F.element_at(F.array(*[F.array(*map(F.lit, q)) for q in (["rde", "boltt"], ["samll", "gera"], ["hot"])]), (F.col("p_size") % 3 + 1).cast("int"))
    lists = load(spark, d, "part").select((F.col("p_partkey") % 7).alias("query_id"), F.col("p_partkey").alias("item"), (F.col("p_retailprice") / 1000).alias("score"), asked.alias("q"), F.split("p_name", " ").alias("t"))
    return rounded(ranking.fuzzy(lists, F.col("q"), F.col("t")).select("query_id", "item", "coverage", "reranked", "rank"))


@query("""WITH p AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN replace(p_name, ' ', '') || p_size WHEN 2 THEN split_part(p_name, ' ', 2) ELSE '' END AS s FROM part), l AS (SELECT p_partkey, lower(s) AS s, regexp_replace(lower(s), '[^a-z]', '', 'g') AS t FROM p),
    f AS (SELECT p_partkey, s, greatest(0.0, least(1.0, 1 - (length(s) - 3) / 12)) AS a, CASE WHEN t <> '' THEN greatest(0.0, 1 - abs(length(regexp_replace(t, '[^aeiou]', '', 'g')) / length(t) - 0.4) / 0.4) ELSE 0.0 END AS b,
          CASE WHEN t <> '' THEN greatest(0.0, 1 - greatest(list_max(list_transform(regexp_split_to_array(t, '[aeiou]'), lambda x: length(x))) - 3, 0) / length(t)) ELSE 0.0 END AS c FROM l)
    SELECT p_partkey, near(CASE WHEN s = '' THEN 0 ELSE greatest(0, least(1, (a + b + c) / 3 - CASE WHEN regexp_matches(s, '[0-9]') THEN 0.3 ELSE 0 END - CASE WHEN contains(s, '-') THEN 0.3 ELSE 0 END)) END) AS score FROM f""")
def rnk_brandability(spark, d):
    name, kind = F.col("p_name"), F.col("p_size") % 4
    joined = lambda mark: F.replace(name, F.lit(" "), F.lit(mark))
    label = F.when(kind == 0, joined("-")).when(kind == 1, F.concat(joined(""), F.col("p_size").cast("string"))).when(kind == 2, F.split_part(name, F.lit(" "), F.lit(2))).otherwise("")
    return rounded(load(spark, d, "part").select("p_partkey", ranking.brandability(label).alias("score")))


@query("""SELECT p_partkey, near(p_retailprice * (1 + 0.30 * (0.35 * least(1, greatest(0, p_size / 50)) + 0.15 * least(1, greatest(0, p_partkey / 100))))) AS score FROM part""")
def rnk_engagement(spark, d):
    return rounded(load(spark, d, "part").select("p_partkey", ranking.engagement(F.col("p_retailprice"), [(F.col("p_size"), 50), (F.col("p_partkey"), 100)]).alias("score")))


@query("""WITH p AS (SELECT p_partkey, p_size, string_split(p_name, ' ') AS w FROM part), h AS (SELECT *, CASE WHEN list_contains(w, 'red') THEN 1 ELSE 0 END AS a, CASE WHEN list_contains(w, 'bolt') THEN 1 ELSE 0 END AS b FROM p),
    r AS (SELECT *, (a + b) / 2 AS recall, (a + b) / len(w) AS precision FROM h), f AS (SELECT *, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END AS f1 FROM r) SELECT p_partkey, near(f1) AS f1, near(p_size + 0.2 * (0.9 * a + 0.5 * b) * (0.5 + 0.5 * f1)) AS boosted FROM f""")
def rnk_soft_keyword(spark, d):
    keywords = F.array(F.struct(F.lit("red").alias("term"), F.lit(0.9).alias("p")), F.struct(F.lit("bolt").alias("term"), F.lit(0.5).alias("p")))
    p = load(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_name")
    return rounded(ranking.soft_keywords(p, keywords, F.split("p_name", " "), "p_size").select("p_partkey", "f1", "boosted"))


@query("""WITH l AS (SELECT p_brand AS k, min(p_size) / 50 AS g, max(p_size) / 50 AS a FROM part WHERE p_brand < 'Brand#20' GROUP BY ALL), s AS (SELECT p_type AS query_id, p_partkey AS item, p_retailprice / 1000 + 0.2 * (0.6 * coalesce(g, 0) + 0.4 * coalesce(a, 0)) AS score FROM part LEFT JOIN l ON p_brand = k)
    SELECT query_id, item, near(score) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS INTEGER) AS rank FROM s""")
def rnk_complement(spark, d):
    p = load(spark, d, "part")
    leanings = p.where("p_brand < 'Brand#20'").groupBy(F.col("p_brand").alias("k")).agg((F.min("p_size") / 50).alias("g"), (F.max("p_size") / 50).alias("a"))
    lists = p.select(F.col("p_type").alias("query_id"), F.col("p_partkey").alias("item"), F.col("p_brand").alias("k"), (F.col("p_retailprice") / 1000).alias("score"))
    return rounded(ranking.complement(lists, "k", leanings).drop("k"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: trim(w) <> '' AND length(w) / 6 >= 0.6), ' ') AS kept FROM part")
def rnk_keyword_threshold(spark, d):
    terms = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("term"), (F.length(w) / 6).alias("p")))
    return load(spark, d, "part").select("p_partkey", F.array_join(F.transform(ranking.keyword_threshold(terms, 0.6), lambda k: k["term"]), " ").alias("kept"))


@query("""WITH v AS (SELECT l_orderkey AS item, l_returnflag AS label, l_quantity / 50 AS weight, 1 - l_discount AS confidence FROM lineitem), ta AS (SELECT item, label, round(sum(weight * confidence), 9) AS mass FROM v GROUP BY ALL), b AS (SELECT item, label FROM ta QUALIFY row_number() OVER (PARTITION BY item ORDER BY mass DESC, label) = 1)
    SELECT v.item, b.label, count(*) AS voters, near(avg(confidence)) AS confidence, near(avg(CASE WHEN v.label = b.label THEN 1 ELSE 0 END)) AS agreement, CASE WHEN avg(CASE WHEN v.label = b.label THEN 1 ELSE 0 END) >= 0.8 THEN 'direct' WHEN avg(CASE WHEN v.label = b.label THEN 1 ELSE 0 END) >= 0.5 THEN 'review' ELSE 'fallback' END AS band FROM v JOIN b ON v.item = b.item GROUP BY v.item, b.label""")
def vote_ensemble(spark, d):
    v = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").cast("string").alias("voter"), F.col("l_returnflag").alias("label"), (F.col("l_quantity") / 50).alias("weight"), (1 - F.col("l_discount")).alias("confidence"))
    return rounded(ranking.ensemble(v).select("item", "label", "voters", "confidence", "agreement", "band"))


@query("SELECT p_partkey, CAST(damerau_levenshtein(p_name, 'red bolt') AS INTEGER) AS distance FROM part")
def udf_damerau_levenshtein(spark, d):
    return load(spark, d, "part").select("p_partkey", text.damerau_udf()("p_name", F.lit("red bolt")).alias("distance"))


@query(f"WITH {_JOINED_SQL} SELECT p_partkey, array_to_string(parts, '|') AS parts FROM j")
def udf_compound_split(spark, d):
    split = text.compound_udf({w: 2.0 for w in _WORDS})
    return _joined(spark, d).select("p_partkey", F.array_join(split("joined"), "|").alias("parts"))


@query("""WITH w AS (SELECT doc_id, replace(lower(regexp_extract(text, '([\\p{L}]+)', 1)), 'ß', 'ss') AS w FROM documents WHERE text <> ''), x AS (SELECT * FROM w WHERE w <> '')
    SELECT doc_id, w AS sld, CASE WHEN regexp_full_match(w, '[\\x00-\\x7F]*') THEN w ELSE strip_accents(w) END AS tokens FROM x""")
def udf_idn_decode(spark, d):
    words = load(spark, d, "documents").select("doc_id", F.replace(F.lower(F.regexp_extract("text", r"(\p{L}+)", 1)), F.lit("ß"), F.lit("ss")).alias("w")).where("w <> ''")
    host = F.concat(F.reflect(F.lit("java.net.IDN"), F.lit("toASCII"), F.col("w")), F.lit(".com"))
    s = words.select("doc_id", text.segment(host).alias("s"))
    return s.select("doc_id", "s.sld", F.array_join("s.tokens", " ").alias("tokens"))


@query()
def gmap_mmr(spark, d):
    return rnk_mmr(spark, d).withColumn("moved", F.col("new_rank") - F.col("rank"))


@query("SELECT p_brand, count(*) AS n, list_sort(list(p_retailprice))[CAST(least(floor(0.9 * count(*)), count(*) - 1) + 1 AS BIGINT)] AS p90 FROM part GROUP BY ALL")
def udaf_quantile_exact(spark, d):
    from lotwise.functions import quantiles

    return quantiles.grouped(load(spark, d, "part"), ["p_brand"], "p_retailprice", {"p90": 0.9})


@query("SELECT doc_id, md5(strip_accents(text)) AS plain_md5 FROM documents")
def udf_nfkc(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(text.normalise(F.col("text"))).alias("plain_md5"))


@query("""WITH m AS (SELECT p_partkey, '^' || p_name || '$' AS m FROM part) SELECT p_partkey, CAST((length(m) - 2) + (length(m) - 3) AS INTEGER) AS grams FROM m""")
def udtf_char_ngrams(spark, d):
    return load(spark, d, "part").select("p_partkey", F.size(text.char_ngrams(F.col("p_name"))).alias("grams"))


@query("SELECT tld, near(avg(p_retailprice)) AS mean FROM (SELECT lower(p_brand) AS tld, p_retailprice FROM part WHERE p_size > 10) GROUP BY ALL")
def transform_step(spark, d):
    from lotwise.operators.enrich import Pipeline

    chain = Pipeline().then(lambda x: x.where("p_size > 10")).then(lambda x: x.withColumn("tld", F.lower("p_brand"))).then(lambda x: x.groupBy("tld").agg(F.avg("p_retailprice").alias("mean")))
    return rounded(chain(load(spark, d, "part")))
