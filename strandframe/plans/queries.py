"""Queries of the operators over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import sequences as S
from strandframe.functions.ids import full_id, sequence_ids, sorted_ids
from strandframe.operators import align, clustering, sequences, spatial, stats, structure, taxonomy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, t) -> DataFrame, where t(name) reads a table, and its SQL."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _docs(t, extra: tuple[str, ...] = ()) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("description"), F.col("text").alias("seq"), *extra)


# --- sequences ------------------------------------------------------------------------------


@query("""SELECT doc_id AS ord, length(text) BETWEEN 100 AND 2000 AS within_range, length(text) <= 500 AS shorter, length(text) >= 500 AS longer,
 length(text) - length(replace(text, 'X', '')) >= 1 AS has_x, length(text) - length(replace(text, 'e', '')) >= 50 AS has_e, length(text) - length(replace(text, 'e', '')) >= 0.1 * length(text) AS fraction_e,
 regexp_matches(text, '[st]h.n') AS motif, contains(source, '1') AS described, NOT contains(source, '1') AS inverted FROM documents""")
def seq_predicates(spark, t):
    return _docs(t).select(
        "ord", S.length_within(100, 2000).alias("within_range"), S.shorter_than(500).alias("shorter"), S.longer_than(500).alias("longer"), S.contains_x(1).alias("has_x"), S.contains_letter("e", 50).alias("has_e"),
        S.fraction_of_letter("e", 0.1).alias("fraction_e"), S.has_motif("[st]-h-x-n").alias("motif"), S.description_contains("1").alias("described"), S.logical_not(S.description_contains("1")).alias("inverted"),
    )


@query("""SELECT doc_id AS ord, source AS description, length(text)::INT AS len FROM documents WHERE length(text) >= 300 AND length(text) <= 5000 AND (contains(source, '1') OR length(text) - length(replace(text, 'X', '')) >= 1)""")
def seq_filter(spark, t):
    kept = sequences.filter_sequences(_docs(t), S.longer_than(300), S.shorter_than(5000), S.any_of(S.description_contains("1"), S.contains_x(1)))
    return kept.select("ord", "description", F.length("seq").alias("len"))


@query("""SELECT min(doc_id) AS ord, length(text)::INT AS len FROM documents GROUP BY text""")
def seq_unique(spark, t):
    return sequences.unique_sequences(_docs(t)).select("ord", F.length("seq").alias("len"))


@query("""SELECT min(doc_id) AS first_ord, count(*) AS n FROM documents GROUP BY text""")
def seq_map_identical(spark, t):
    return sequences.map_identical(_docs(t)).select("first_ord", "n")


@query("""SELECT min(doc_id) OVER (PARTITION BY text) AS first_ord, doc_id AS ord FROM documents""")
def seq_identical_members(spark, t):
    return sequences.identical_members(_docs(t))


@query("""SELECT doc_id AS ord, length(text)::INT AS len FROM documents ORDER BY len, ord""")
def seq_sort_by_length(spark, t):
    return sequences.sort_by_length(_docs(t)).select("ord", F.length("seq").alias("len"))


@query("""SELECT doc_id, length(text)::INT AS len FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def id_retrieval(spark, t):
    return sequences.retrieve(t("documents"), t("labels").where("quality = 1"), "doc_id").select("doc_id", F.length("text").alias("len"))


@query("""WITH m AS (SELECT doc_id, item_id, d.text AS s, b.text AS q, unnest(range(1, len(string_split(d.text, b.text)))) AS hit FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0)
SELECT doc_id AS ord, item_id, (length(array_to_string(list_slice(string_split(s, q), 1, hit), '')) + (hit - 1) * length(q))::INT AS start, round(100.0 * length(q) / length(s), 6) AS percent FROM m""")
def subsequence_hits(spark, t):
    hits = sequences.find_subsequences(_docs(t), t("benchmark").select("item_id", F.col("text").alias("query")))
    return hits.select("ord", "item_id", F.col("start").cast("int").alias("start"), F.round("percent", 6).alias("percent"))


@query("""SELECT page_id, length(replace(replace(url, '-', ''), '_', ''))::INT AS len_ungapped, (length(url) - length(replace(url, 'e', '')))::INT AS n_e, substr(url, 9, 1) AS ninth, substr(url, 1, 12) AS prefix FROM pages""")
def gaps_and_letters(spark, t):
    return t("pages").select("page_id", S.len_ungapped("url").alias("len_ungapped"), S.count_letter("e", "url").alias("n_e"), S.char_at(8, "url").alias("ninth"), S.description_n(12, "url").alias("prefix"))


def _brands(t) -> DataFrame:
    return t("part").select(F.lit(1).alias("msa"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("description"), F.rpad("p_brand", 8, "-").alias("seq"))


_BRANDS = "SELECT p_partkey AS ord, rpad(p_brand, 8, '-') AS seq FROM part"


@query(f"""WITH r AS ({_BRANDS}), c AS (SELECT unnest(range(8)) AS i, seq FROM r), n AS (SELECT i::INT AS pos, substr(seq, i + 1, 1) AS aa, count(*) AS n FROM c GROUP BY ALL)
SELECT pos, aa, n, round(n / sum(n) OVER (PARTITION BY pos), 6)::DOUBLE AS fraction FROM n""")
def msa_profile(spark, t):
    return sequences.profile(_brands(t), ["msa"]).select("pos", "aa", "n", F.round("fraction", 6).alias("fraction"))


@query(f"""WITH r AS ({_BRANDS}), c AS (SELECT unnest(range(8)) AS i, seq FROM r), n AS (SELECT i, substr(seq, i + 1, 1) AS aa, count(*) AS n FROM c GROUP BY ALL),
b AS (SELECT i, aa, row_number() OVER (PARTITION BY i ORDER BY n DESC, aa DESC) AS k FROM n) SELECT string_agg(aa, '' ORDER BY i) AS consensus FROM b WHERE k = 1""")
def msa_consensus(spark, t):
    return sequences.consensus(_brands(t), ["msa"]).select("consensus")


@query(f"""WITH r AS ({_BRANDS}), l AS (SELECT length(replace(seq, '-', ''))::INT AS len FROM r) SELECT count(*) AS n, 8 AS columns, min(len) AS shortest, max(len) AS longest, list_sort(list(len))[(count(*) // 2) + 1] AS median FROM l""")
def msa_info(spark, t):
    return sequences.msa_info(_brands(t), ["msa"]).select("n", "columns", "shortest", "longest", "median")


def _suppliers(t) -> DataFrame:
    return t("supplier").select(F.lit(1).alias("msa"), F.col("s_suppkey").alias("ord"), F.lit("s").alias("description"), F.col("s_name").alias("seq"))


_SAME = "list_sum(list_transform(range(1, 19), lambda k: (substr(a.s_name, k, 1) = substr(b.s_name, k, 1) AND substr(a.s_name, k, 1) NOT IN ('-', '_'))::INT))"


@query(f"""SELECT a.s_suppkey AS i, b.s_suppkey AS j, {_SAME}::INT AS identical, round(100.0 * {_SAME} / 18, 6)::DOUBLE AS percent FROM supplier a JOIN supplier b ON a.s_suppkey > b.s_suppkey""")
def pair_identity(spark, t):
    return sequences.identity_pairs(_suppliers(t), ["msa"], digits=6).select("i", "j", "identical", "percent")


@query(f"""WITH p AS (SELECT a.s_suppkey AS i, min({_SAME}) AS least FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey GROUP BY 1) SELECT i AS ord FROM p ORDER BY least DESC, i LIMIT 1""")
def msa_medoid(spark, t):
    return sequences.medoid_sequence(_suppliers(t), ["msa"]).select("ord")


@query("""SELECT p_partkey AS ord, length(p_name)::INT AS len, len(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))))::INT AS kmers FROM part""")
def kmer_sets(spark, t):
    return t("part").select(F.col("p_partkey").alias("ord"), F.length("p_name").alias("len"), F.size(S.kmers(3, "p_name")).alias("kmers"))


@query("""WITH k AS (SELECT n_nationkey AS ord, unnest(list_distinct(list_transform(range(1, length(n_name) - 1), lambda i: substr(n_name, i, 3)))) AS w FROM nation)
SELECT a.ord AS i, b.ord AS j, count(*) AS shared FROM k a JOIN k b ON a.w = b.w AND a.ord < b.ord GROUP BY ALL HAVING count(*) >= 5""")
def kmer_overlaps(spark, t):
    return sequences.kmer_overlaps(t("nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("seq")), 3, 5)


@query()
def global_pairs(spark, t):
    rows = t("nation").select(F.col("n_nationkey").alias("ord"), F.regexp_replace(F.upper("n_name"), "[^A-Z]", "").alias("seq"))
    return align.align_all_pairs(rows.unionByName(t("region").select((F.col("r_regionkey") + 100).alias("ord"), F.col("r_name").alias("seq"))))


@query()
def local_pairs(spark, t):
    return align.align_all_pairs(t("region").select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("seq")), local=True)


@query()
def greedy_identity_clusters(spark, t):
    return clustering.bucket_clustering(t("supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("seq")), 0.9, lots=4)


@query()
def description_ids(spark, t):
    return t("pages").select("page_id", full_id(sorted_ids(sequence_ids("url"))).alias("ids"))


# --- statistics -----------------------------------------------------------------------------


@query("""WITH m AS (SELECT l_returnflag, avg(l_extendedprice) AS mu FROM lineitem GROUP BY 1)
SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_extendedprice) / 1e6, 4) AS var_pop, round(var_samp(l_extendedprice) / 1e6, 4) AS var_samp,
round(avg((l_extendedprice - mu) ** 3) / var_pop(l_extendedprice) ** 1.5, 6) AS skewness, round(avg((l_extendedprice - mu) ** 4) / var_pop(l_extendedprice) ** 2, 6) AS kurtosis FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1""")
def moments(spark, t):
    m = stats.moments(t("lineitem"), "l_extendedprice", ("l_returnflag",))
    return m.select("l_returnflag", "n", "min", "max", F.round("mean", 4).alias("mean"), F.round(F.col("var_pop") / 1e6, 4).alias("var_pop"), F.round(F.col("var_samp") / 1e6, 4).alias("var_samp"), F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))


@query("""SELECT round(covar_samp(l_quantity, l_discount), 6) AS cov_qd, round(covar_samp(l_quantity, l_tax), 6) AS cov_qt, round(var_samp(l_quantity), 6) AS var_q, round(avg(l_tax), 6) AS mean_t FROM lineitem""")
def covariances(spark, t):
    c = stats.covariance(t("lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return c.select(F.round("cov_l_quantity_l_discount", 6).alias("cov_qd"), F.round("cov_l_quantity_l_tax", 6).alias("cov_qt"), F.round("var_l_quantity", 6).alias("var_q"), F.round("mean_l_tax", 6).alias("mean_t"))


@query("""WITH m AS (SELECT sum(l_quantity * l_discount) / sum(l_quantity) AS md, sum(l_quantity * l_tax) / sum(l_quantity) AS mt FROM lineitem)
SELECT sum(l_quantity) AS weight, round(any_value(md), 6) AS mean_d, round(any_value(mt), 6) AS mean_t, round(sum(l_quantity * (l_discount - md) ** 2) / sum(l_quantity), 8) AS var_d, round(sum(l_quantity * (l_discount - md) * (l_tax - mt)) / sum(l_quantity), 8) AS cov_dt FROM lineitem, m""")
def weighted_moments(spark, t):
    w = stats.weighted_moments(t("lineitem"), ["l_discount", "l_tax"], "l_quantity")
    return w.select("weight", F.round("mean_l_discount", 6).alias("mean_d"), F.round("mean_l_tax", 6).alias("mean_t"), F.round("var_l_discount", 8).alias("var_d"), F.round("cov_l_discount_l_tax", 8).alias("cov_dt"))


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.9), 4) AS quantile FROM orders GROUP BY 1""")
def quantiles(spark, t):
    return stats.quantile(t("orders"), "o_totalprice", 0.9, ("o_orderpriority",), exact=True).select("o_orderpriority", F.round("quantile", 4).alias("quantile"))


@query("""SELECT floor(l_extendedprice / 1024)::INT AS bin, floor(l_extendedprice / 1024) * 1024.0 AS bin_min, (floor(l_extendedprice / 1024) + 1) * 1024.0 AS bin_max, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL""")
def hist_1d(spark, t):
    return stats.histogram(t("lineitem"), "l_extendedprice", 1024.0)


@query("""SELECT l_returnflag, floor(l_extendedprice / 4096)::INT AS bin, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL""")
def hist_weighted(spark, t):
    return stats.histogram(t("lineitem"), "l_extendedprice", 4096.0, "l_quantity", ("l_returnflag",)).select("l_returnflag", "bin", "weight")


@query("""SELECT floor(l_extendedprice / 8192)::INT AS bin_price, floor(l_quantity / 8)::INT AS bin_quantity, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL""")
def hist_2d(spark, t):
    return stats.histogram_nd(t("lineitem"), ["l_extendedprice", "l_quantity"], [8192.0, 8.0]).withColumnsRenamed({"bin_l_extendedprice": "bin_price", "bin_l_quantity": "bin_quantity"})


@query("""WITH h AS (SELECT floor(l_quantity / 4)::INT AS bin, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1) SELECT bin * 4.0 AS bin_min, (bin + 1) * 4.0 AS bin_max, weight FROM h ORDER BY weight DESC, bin LIMIT 1""")
def hist_mode(spark, t):
    return stats.mode(stats.histogram(t("lineitem"), "l_quantity", 4.0), ["bin"], [4.0])


@query("""WITH h AS (SELECT floor(value / 16)::INT AS bin, count(*)::DOUBLE AS weight FROM events GROUP BY 1) SELECT g.bin::INT AS bin, coalesce(weight, 0) AS weight FROM (SELECT unnest(range(-4, 65)) AS bin) g LEFT JOIN h USING (bin)""")
def hist_dense(spark, t):
    return stats.dense(stats.histogram(t("events"), "value", 16.0), -64.0, 1024.0, 16.0)


@query("""WITH f AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem)
SELECT round(m, 4) AS mean, round(s, 4) AS sd, round(avg(-((l_extendedprice - m) ** 2) / (2 * s * s) - ln(s * sqrt(2 * pi()))), 6) AS mean_log FROM lineitem, f GROUP BY m, s""")
def normal_fit(spark, t):
    li = t("lineitem")
    fit = stats.normal_fit(li, "l_extendedprice")
    scored = li.crossJoin(F.broadcast(fit)).select("mean", "sd", F.log(stats.normal_pdf("l_extendedprice", F.col("mean"), F.col("sd"))).alias("l"))
    return scored.groupBy("mean", "sd").agg(F.round(F.avg("l"), 6).alias("mean_log")).select(F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "mean_log")


@query("""WITH d AS (SELECT date_trunc('day', ts) AS day, sum(value) AS v FROM events GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, v - avg(v) OVER () AS v, count(*) OVER () AS n FROM d),
s AS (SELECT lag, sum(a.v * b.v) AS s FROM r a, (SELECT unnest(range(0, 11)) AS lag) l, r b WHERE b.i = (a.i + lag) % a.n GROUP BY lag) SELECT lag::INT AS lag, round(s / (SELECT s FROM s WHERE lag = 0), 6) AS value FROM s""")
def autocorrelation(spark, t):
    days = t("events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("v"))
    return stats.autocorrelation(days, "day", ["v"], 10).select(F.col("lag").cast("int").alias("lag"), F.round("value", 6).alias("value"))


# --- points and clusters --------------------------------------------------------------------

_D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))"


@query(f"""SELECT a.vec_id AS i, b.vec_id AS j, round(sqrt({_D2}), 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE sqrt({_D2}) <= 1.2""")
def vector_pairs(spark, t):
    return spatial.vector_pairs_within(t("embeddings"), "vec_id", "embedding", 1.2).select("i", "j", F.round("distance", 6).alias("distance"))


@query(f"""WITH d AS (SELECT a.vec_id, b.vec_id AS nearest, {_D2} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nearest) AS k FROM d)
SELECT vec_id, nearest, round(sqrt(d), 6) AS distance FROM r WHERE k = 1""")
def nearest_neighbor(spark, t):
    e = t("embeddings")
    return spatial.nearest(e, e, "vec_id", "embedding", other_only=True).select("vec_id", "nearest", F.round("distance", 6).alias("distance"))


@query(f"""WITH p AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt({_D2}) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT i AS id, round(min(d), 6) AS distance FROM p GROUP BY 1 HAVING min(d) > 1.1""")
def outliers(spark, t):
    e = t("embeddings")
    near = spatial.nearest(e, e, "vec_id", "embedding", other_only=True)
    pairs = near.select(F.col("vec_id").alias("i"), F.col("nearest").alias("j"), F.col("distance").alias("d"))
    return spatial.outliers(pairs, 1.1).select("id", F.round("distance", 6).alias("distance"))


@query(f"""WITH p AS (SELECT a.label, a.vec_id AS i, max(sqrt({_D2})) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, i) AS k FROM p) SELECT label AS cluster, i AS id, round(d, 6) AS distance FROM r WHERE k = 1""")
def medoids(spark, t):
    m = spatial.point_medoids(t("embeddings"), "vec_id", "embedding", "label")
    return m.select("cluster", "id", F.round("distance", 6).alias("distance"))


@query(f"""WITH RECURSIVE e AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE sqrt({_D2}) <= 1.1), r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT e.j, r.c FROM r JOIN e ON e.i = r.id)
SELECT id, min(c) AS cluster FROM r GROUP BY 1""")
def single_link_components(spark, t):
    e = t("embeddings")
    pairs = spatial.vector_pairs_within(e, "vec_id", "embedding", 1.1).withColumnRenamed("distance", "d")
    return clustering.single_link(pairs, e.select(F.col("vec_id").alias("id")), 1.1)


@query("""WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
m AS (SELECT label, k, avg(x) AS x FROM p GROUP BY ALL), d AS (SELECT p.vec_id, m.label, sum((p.x - m.x) ** 2) AS d FROM p JOIN m USING (k) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), label) AS n FROM d)
SELECT vec_id, label::INT AS cluster, round(d, 6) AS cost FROM r WHERE n = 1""")
def kmeans_assign(spark, t):
    e = t("embeddings")
    start = e.withColumns({"cluster": F.col("label"), "cost": F.lit(0.0)})
    k = e.agg(F.max("label")).first()[0] + 1
    centers, _, _ = clustering.kmeans_update(start, k, "embedding")
    return clustering.kmeans_assign(e, centers, "embedding").select("vec_id", "cluster", F.round("cost", 6).alias("cost"))


@query()
def kmeans(spark, t):
    return clustering.kmeans(t("embeddings"), 4, "embedding", repeats=1, max_rounds=8)[0].select("vec_id", "cluster", "cost")


def _points(t) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10).alias("x"), F.col("c_nationkey").cast("double").alias("y"))


@query("""WITH p AS (SELECT c_custkey AS id, c_acctbal / 10 AS x, c_nationkey::DOUBLE AS y FROM customer) SELECT a.id AS i, b.id AS j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM p a JOIN p b ON a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 2.25""")
def contacts_within(spark, t):
    p = _points(t)
    return spatial.within(p, p, ["x", "y"], 1.5).where("a_id < b_id").select(F.col("a_id").alias("i"), F.col("b_id").alias("j"), F.round("distance", 6).alias("distance"))


@query()
def optics_order(spark, t):
    return clustering.optics(_points(t), "id", ["x", "y"], 1.5, 3)


@query()
def hierarchical_average(spark, t):
    return clustering.hierarchical_points(t("embeddings"), ["label"], "vec_id", "embedding", "average", 0.9)


# --- runs, ranges, hierarchies --------------------------------------------------------------


@query("""WITH l AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, event_type, event_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS run FROM l) SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n, min(event_id) AS first FROM r GROUP BY ALL""")
def runs(spark, t):
    r = structure.runs(t("events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return r.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("""WITH r AS (SELECT c_nationkey AS k, c_custkey AS o, floor(c_acctbal / 100)::BIGINT AS a, floor(c_acctbal / 100)::BIGINT + 3 AS b FROM customer), p AS (SELECT s_suppkey, s_nationkey AS k, floor(s_acctbal / 100)::BIGINT AS x FROM supplier),
m AS (SELECT s_suppkey, o, row_number() OVER (PARTITION BY s_suppkey ORDER BY o DESC) AS n FROM p JOIN r ON p.k = r.k AND x BETWEEN a AND b) SELECT s_suppkey, o AS kind FROM p LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (s_suppkey)""")
def range_join(spark, t):
    low = F.floor(F.col("c_acctbal") / 100)
    ranges = t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("o"), F.col("c_custkey").alias("kind"), low.alias("a"), (low + 3).alias("b"))
    points = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.floor(F.col("s_acctbal") / 100).alias("x"))
    return structure.annotate_ranges(points, ranges, ["k"], "x", "a", "b", "o", "kind").select("s_suppkey", "kind")


def _tree(t) -> DataFrame:
    root = t("region").select(F.lit("root").alias("id"), F.lit("root").alias("parent"), F.lit("root").alias("rank"), F.lit("root").alias("name")).distinct()
    region = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent"), F.lit("region").alias("rank"), F.col("r_name").alias("name"))
    nation = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit("nation").alias("rank"), F.col("n_name").alias("name"))
    customer = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.lit("customer").alias("rank"), F.col("c_name").alias("name"))
    return root.unionByName(region).unionByName(nation).unionByName(customer)


_TREE = """n AS (SELECT 'root' AS id, 'root' AS parent, 'root' AS rank, 'root' AS name UNION ALL SELECT 'r' || r_regionkey, 'root', 'region', r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation', n_name FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'customer', c_name FROM customer), p AS (SELECT id, id AS ancestor, 0 AS up FROM n UNION ALL SELECT p.id, n.parent, up + 1 FROM p JOIN n ON p.ancestor = n.id WHERE n.parent <> n.id)"""


@query(f"WITH RECURSIVE {_TREE} SELECT id, max(up) OVER (PARTITION BY id) - up AS depth, ancestor FROM p")
def lineage(spark, t):
    tree = _tree(t)
    return taxonomy.lineage(taxonomy.closure(tree), tree)


@query(f"WITH RECURSIVE {_TREE} SELECT p.id, p.ancestor FROM p JOIN n ON p.ancestor = n.id WHERE n.rank = 'region'")
def nearest_rank(spark, t):
    tree = _tree(t)
    return taxonomy.nearest_rank(taxonomy.closure(tree), tree, "region")


@query(f"WITH RECURSIVE {_TREE} SELECT p.id, max(CASE WHEN n.rank = 'region' THEN n.name END) AS region, max(CASE WHEN n.rank = 'nation' THEN n.name END) AS nation FROM p JOIN n ON p.ancestor = n.id GROUP BY 1")
def rank_table(spark, t):
    tree = _tree(t)
    return taxonomy.rank_table(taxonomy.closure(tree), tree, ["region", "nation"]).select("id", "region", "nation")


@query("""WITH m AS (SELECT p_partkey AS ord, k.name, row_number() OVER (PARTITION BY p_partkey ORDER BY k.o, -len(string_split(k.name, ' ')), k.name) AS n FROM part, (SELECT DISTINCT p_name AS name, 1 AS o FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1], 1 FROM part) k WHERE contains(' ' || p_name || ' ', ' ' || k.name || ' '))
SELECT ord, name FROM m WHERE n = 1""")
def name_match(spark, t):
    part = t("part")
    names = part.select(F.col("p_name").alias("name")).union(part.select(F.split("p_name", " ")[0])).distinct().withColumns({"tax_id": F.xxhash64("name"), "rank_order": F.lit(1)})
    return taxonomy.match_names(part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("description")), names).select("ord", "name")


from strandframe.plans import polymer_queries, structure_queries  # noqa: E402, F401  register their queries
