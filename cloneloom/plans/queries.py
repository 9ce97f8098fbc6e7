"""Queries that exercise every operator on the shared test tables, each with the SQL that gives the same rows.

Stand-ins: a sample is a return flag (or an order priority), a key is a part, a weight a summed quantity, genes are a part's
brand and type, its size a length, sequences are a hash's digits written as bases, cells are users, molecules events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..functions import sequence as S
from ..operators import abundance, align, assign, cluster, diversity, filters, overlap, preproc, qc, stats, tags, usage
from ..streaming import events as ev
from . import postanalysis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def clones(spark: SparkSession, sf: str) -> DataFrame:
    """sample, key, weight, v_gene, j_gene, len. Line items are summed before parts are joined."""
    c = abundance.aggregate(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.col("l_partkey").alias("key"), "l_quantity"), ["sample", "key"], F.col("l_quantity"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("v_gene"), F.col("p_type").alias("j_gene"), F.col("p_size").alias("len"))
    return c.join(part, "key").select("sample", "key", "weight", "v_gene", "j_gene", "len")


def by_priority(spark: SparkSession, sf: str) -> DataFrame:
    """sample (order priority), key (supplier and returned or not), weight."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("sample"))
    l = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("key"), "l_quantity")
    return l.join(o, "l_orderkey").groupBy("sample", "key").agg(F.sum("l_quantity").alias("weight"))


def bases(col):
    """A hash's 32 digits as bases."""
    return F.translate(F.md5(col.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")


CL = """WITH c AS (SELECT l_returnflag AS sample, l_partkey AS key, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2),
cl AS (SELECT sample, key, weight, p_brand AS v_gene, p_type AS j_gene, p_size AS len FROM c JOIN part ON key = p_partkey)
"""
PR = """WITH cl AS (SELECT o_orderpriority AS sample, l_partkey AS key, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
f AS (SELECT *, weight / sum(weight) OVER (PARTITION BY sample) AS fraction FROM cl)
"""
NT = "translate(md5(CAST({} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


# abundance

@query("SELECT l_returnflag AS sample, l_partkey AS key, round(sum(l_quantity), 6) AS weight, count(*) AS n, max(l_extendedprice) AS best FROM lineitem GROUP BY 1, 2")
def clone_aggregation(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.col("l_partkey").alias("key"), "l_quantity", "l_extendedprice")
    return rounded(abundance.aggregate(l, ["sample", "key"], F.col("l_quantity"), n=F.count(F.lit(1)), best=F.max("l_extendedprice")))


@query(CL + "SELECT sample, key, round(weight / sum(weight) OVER (PARTITION BY sample), 9) AS fraction, row_number() OVER (PARTITION BY sample ORDER BY weight DESC, key) AS rank FROM cl")
def fractions_and_ranks(spark, sf):
    return rounded(abundance.ranks(abundance.fractions(clones(spark, sf)), ["key"]).select("sample", "key", "fraction", "rank"), 9)


@query(CL + ", b AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY sample ORDER BY weight DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(weight) OVER (PARTITION BY sample) AS t FROM cl) SELECT sample, count(*) AS n_kept FROM b WHERE b < 0.95 * t GROUP BY 1")
def cumulative_cutoff(spark, sf):
    return abundance.cumulative_cutoff(clones(spark, sf), ["key"])


@query("SELECT l_returnflag AS sample, l_partkey AS key FROM lineitem UNION ALL SELECT l_linestatus, l_suppkey FROM lineitem")
def merge_tables(spark, sf):
    l = table(spark, sf, "lineitem")
    return abundance.merge(l.select(F.col("l_returnflag").alias("sample"), F.col("l_partkey").alias("key")), l.select(F.col("l_linestatus").alias("sample"), F.col("l_suppkey").alias("key")))


# diversity

_DIV = """WITH c AS (SELECT l_returnflag AS sample, l_partkey AS key, count(*) AS w FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY sample) AS p FROM c),
s AS (SELECT sample, count(*) AS observed, -sum(p * ln(p)) AS h, sum(p * p) AS pp, """ + ", ".join(f"count(*) FILTER (w = {k}) AS f{k}" for k in range(1, 21)) + f""" FROM p GROUP BY 1),
d AS (SELECT sample, observed, unnest(range(1, 21)) AS d FROM s),
k AS (SELECT sample, w AS k, count(*) AS f FROM c GROUP BY 1, 2),
b AS (SELECT d.sample, observed, d, k, f, factorial(d::INTEGER) / (factorial(k::INTEGER) * factorial((d - k)::INTEGER)) AS b FROM d LEFT JOIN k ON k.sample = d.sample AND k <= d),
e AS (SELECT sample, d, observed + coalesce(sum(CASE WHEN k % 2 = 1 THEN b * f ELSE -b * f END), 0) AS est, sqrt(coalesce(sum(b * b * f), 0)) AS sd FROM b GROUP BY sample, observed, d),
m AS (SELECT sample, coalesce(min(d) FILTER (est > 0 AND sd / est >= 0.05 OR est = 0 AND sd > 0), 20) AS stop FROM e GROUP BY 1),
t AS (SELECT e.sample, est AS et FROM e JOIN m ON m.sample = e.sample AND d = stop)
"""


@query(_DIV + """SELECT s.sample, observed, round(exp(h), 6) AS shannon_wiener, round(h / nullif(ln(observed), 0), 6) AS normalized_shannon,
round(1 / pp, 6) AS inverse_simpson, round(1 - pp, 6) AS gini_simpson, round(observed + f1 * (f1 - 1) / (2.0 * (f2 + 1)), 6) AS chao1, round(et, 6) AS efron_thisted
FROM s LEFT JOIN t USING (sample)""")
def diversity_indices(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.col("l_partkey").alias("key"))
    return rounded(diversity.diversity(abundance.aggregate(l, ["sample", "key"])))


@query(CL + ", r AS (SELECT sample, row_number() OVER o AS r, sum(weight) OVER (PARTITION BY sample ORDER BY weight DESC, key ROWS UNBOUNDED PRECEDING) AS u, sum(weight) OVER (PARTITION BY sample) AS t FROM cl WINDOW o AS (PARTITION BY sample ORDER BY weight DESC, key)) SELECT sample, CAST(min(r) AS INTEGER) AS d50 FROM r WHERE u >= 0.5 * t GROUP BY 1")
def d50(spark, sf):
    return diversity.d50(clones(spark, sf), ["key"])


# usage

def _usage_sql(cols: str) -> str:
    return CL + f"SELECT sample, {cols}, round(sum(weight), 6) AS weight, round(sum(weight) / sum(sum(weight)) OVER (PARTITION BY sample), 9) AS fraction FROM cl GROUP BY sample, {cols}"


@query(_usage_sql("v_gene"))
def v_usage(spark, sf):
    return rounded(usage.usage(clones(spark, sf), ["v_gene"]), 9)


@query(_usage_sql("j_gene"))
def j_usage(spark, sf):
    return rounded(usage.usage(clones(spark, sf), ["j_gene"]), 9)


@query(_usage_sql("v_gene, j_gene"))
def vj_usage(spark, sf):
    return rounded(usage.usage(clones(spark, sf), ["v_gene", "j_gene"]), 9)


@query(CL + ", g AS (SELECT sample, weight, regexp_extract(v_gene, '^([^-*#]+)', 1) AS family FROM cl) SELECT sample, family, round(sum(weight), 6) AS weight, round(sum(weight) / sum(sum(weight)) OVER (PARTITION BY sample), 9) AS fraction FROM g GROUP BY 1, 2")
def family_usage(spark, sf):
    return rounded(usage.usage(clones(spark, sf).withColumn("family", usage.family(F.col("v_gene"))), ["family"]), 9)


@query(CL + ", u AS (SELECT sample, j_gene, sum(weight) AS w FROM cl GROUP BY 1, 2), f AS (SELECT *, w / sum(w) OVER (PARTITION BY sample) AS f FROM u) SELECT sample, " + ", ".join(f"round(coalesce(sum(f) FILTER (j_gene = '{t}'), 0), 9) AS \"{t}\"" for t in ("ECONOMY", "PROMO", "STANDARD")) + " FROM f GROUP BY 1")
def usage_matrix(spark, sf):
    return rounded(usage.usage_matrix(clones(spark, sf), "j_gene", ["ECONOMY", "PROMO", "STANDARD"]), 9)


@query(CL + "SELECT sample, round(sum(weight * len), 4) AS sum, round(sum(weight * len) / sum(weight), 6) AS mean, round(sqrt(greatest(0, sum(weight * len * len) / sum(weight) - (sum(weight * len) / sum(weight)) * (sum(weight * len) / sum(weight)))), 6) AS std FROM cl GROUP BY 1")
def additive_length(spark, sf):
    a = usage.additive(clones(spark, sf), F.col("len"))
    return a.select("sample", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(CL + ", f AS (SELECT sample, len AS length, key, weight / sum(weight) OVER (PARTITION BY sample) AS f FROM cl), r AS (SELECT *, row_number() OVER (PARTITION BY sample, length ORDER BY f DESC, key) AS r FROM f) SELECT sample, length, CASE WHEN r <= 10 THEN CAST(key AS VARCHAR) ELSE 'other' END AS label, round(sum(f), 9) AS fraction FROM r GROUP BY ALL")
def spectratype(spark, sf):
    return rounded(usage.spectratype(clones(spark, sf), F.col("len"), "key"), 9)


@query(CL + "SELECT sample, v_gene, len AS length, round(sum(weight), 6) AS weight FROM cl GROUP BY ALL")
def gene_spectratype(spark, sf):
    return rounded(usage.gene_spectratype(clones(spark, sf), "v_gene", F.col("len")))


@query(CL + "SELECT sample, v_gene, round(sum(len * weight) / sum(weight), 6) AS mean_length FROM cl GROUP BY ALL")
def mean_length_by_gene(spark, sf):
    return rounded(usage.mean_length_by_gene(clones(spark, sf), "v_gene", F.col("len")))


# overlap

_PAIRS = PR + """, d AS (SELECT sample, count(*) AS d, sum(fraction) AS t, sum(fraction * fraction) AS q FROM f GROUP BY 1),
s AS (SELECT a.sample AS s1, b.sample AS s2, count(*) AS n, sum(a.fraction) AS sx, sum(b.fraction) AS sy, sum(a.fraction * a.fraction) AS xx, sum(b.fraction * b.fraction) AS yy,
  sum(a.fraction * b.fraction) AS xy, sum(sqrt(a.fraction * b.fraction)) AS f2 FROM f a JOIN f b ON a.key = b.key AND a.sample < b.sample GROUP BY 1, 2),
p AS (SELECT x.sample AS sample_1, y.sample AS sample_2, x.d AS d1, y.d AS d2, x.t AS t1, y.t AS t2, x.q AS q1, y.q AS q2, coalesce(n, 0) AS n, coalesce(sx, 0) AS sx, coalesce(sy, 0) AS sy,
  coalesce(xx, 0) AS xx, coalesce(yy, 0) AS yy, coalesce(xy, 0) AS xy, coalesce(f2, 0) AS f2 FROM d x JOIN d y ON x.sample < y.sample LEFT JOIN s ON s1 = x.sample AND s2 = y.sample),
v AS (SELECT *, x1.c AS c, x1.vx AS vx, x1.vy AS vy, x2.c AS cu, x2.vx AS ux, x2.vy AS uy FROM (SELECT *, CASE WHEN n > 0 THEN {'c': xy - sx * sy / n, 'vx': xx - sx * sx / n, 'vy': yy - sy * sy / n} END AS x1,
  {'c': xy - t1 * t2 / (d1 + d2 - n), 'vx': q1 - t1 * t1 / (d1 + d2 - n), 'vy': q2 - t2 * t2 / (d1 + d2 - n)} AS x2 FROM p))
"""


@query(_PAIRS + """SELECT sample_1, sample_2, n AS shared, d1, d2, round(n / (d1 * d2), 9) AS relative_diversity, round(sqrt(sx * sy), 9) AS f1, round(f2, 9) AS f2, round(n / (d1 + d2 - n), 9) AS jaccard,
round(coalesce(CASE WHEN vx > 1e-18 AND vy > 1e-18 THEN c / sqrt(vx * vy) ELSE 0 END, 0), 6) AS pearson, round(CASE WHEN ux > 1e-18 AND uy > 1e-18 THEN cu / sqrt(ux * uy) ELSE 0 END, 6) AS pearson_all FROM v""")
def sample_overlap(spark, sf):
    o = overlap.overlap(by_priority(spark, sf), ["key"])
    return o.select("sample_1", "sample_2", "shared", "d1", "d2", *[F.round(c, 9).alias(c) for c in ("relative_diversity", "f1", "f2", "jaccard")], *[F.round(c, 6).alias(c) for c in ("pearson", "pearson_all")])


PRIORITIES = ["1-URGENT", "5-LOW"]


@query(PR + "SELECT key, count(DISTINCT sample) AS n_samples, " + ", ".join(f"round(coalesce(sum({c}) FILTER (sample = '{p}'), 0), 9) AS \"{c}_{p}\"" for p in PRIORITIES for c in ("weight", "fraction")) + " FROM f GROUP BY key")
def overlap_export(spark, sf):
    return rounded(overlap.overlap_table(by_priority(spark, sf), ["key"], PRIORITIES), 9)


@query(PR + "SELECT a.key, round(log10(a.fraction), 6) AS x, round(log10(b.fraction), 6) AS y FROM f a JOIN f b ON a.key = b.key WHERE a.sample = '1-URGENT' AND b.sample = '5-LOW'")
def overlap_scatter(spark, sf):
    return rounded(overlap.scatter(by_priority(spark, sf), ["key"], *PRIORITIES))


@query("""WITH m AS (SELECT o_orderpriority AS sample, CASE WHEN o_orderpriority < '3' THEN 'high' ELSE 'low' END AS level FROM orders GROUP BY ALL),
c AS (SELECT level AS sample, l_partkey AS key, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN m ON m.sample = o_orderpriority GROUP BY 1, 2)
SELECT sample, count(*) AS n, round(sum(w), 4) AS weight FROM c GROUP BY 1""")
def pooled_samples(spark, sf):
    level = F.when(F.col("sample") < "3", "high").otherwise("low")
    c = by_priority(spark, sf)
    meta = c.select("sample").distinct().withColumn("level", level)
    return abundance.totals(overlap.pooled(c, meta, ["level"]).groupBy("sample", "key").agg(F.sum("weight").alias("weight"))).select("sample", "n", F.round("weight", 4).alias("weight"))


@query("""WITH a AS (SELECT l_partkey AS key, sum(l_quantity) AS w FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS key, sum(l_quantity) AS w FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, round(coalesce(a.w, 0), 6) AS w1, round(coalesce(b.w, 0), 6) AS w2, CASE WHEN a.key IS NULL THEN 'only_2' WHEN b.key IS NULL THEN 'only_1' ELSE 'both' END AS side FROM a FULL JOIN b ON a.key = b.key""")
def clones_diff(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("s"), F.col("l_partkey").alias("key"), F.col("l_quantity").alias("q"))
    a, b = (c.where(F.col("s") == s).groupBy("key").agg(F.sum("q").alias("weight")) for s in "AR")
    return rounded(overlap.clone_diff(a, b, ["key"]))


@query("""WITH a AS (SELECT c_custkey AS id, c_mktsegment AS seg, c_nationkey AS nat FROM customer), b AS (SELECT s_suppkey AS id, s_name AS seg, s_nationkey AS nat FROM supplier)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_1' WHEN a.id IS NULL THEN 'only_2' WHEN a.seg IS DISTINCT FROM b.seg OR a.nat IS DISTINCT FROM b.nat THEN 'different' ELSE 'same' END AS status,
CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.seg IS DISTINCT FROM b.seg THEN 'seg' END, CASE WHEN a.nat IS DISTINCT FROM b.nat THEN 'nat' END) END AS columns FROM a FULL JOIN b ON a.id = b.id""")
def alignments_diff(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("seg"), F.col("s_nationkey").alias("nat"))
    return overlap.record_diff(a, b, "id", ["seg", "nat"])


# preprocessors

_UNITS = CL + """, u AS (SELECT sample, key, unnest(range(1, CAST(round(weight) AS BIGINT) + 1)) AS i FROM cl),
h AS (SELECT sample, key, row_number() OVER (PARTITION BY sample ORDER BY md5(sample || ':' || key || ':' || i), key) AS r FROM u)
"""


@query(_UNITS + "SELECT sample, key, CAST(count(*) AS DOUBLE) AS weight FROM h WHERE r <= 1000 GROUP BY 1, 2")
def downsample_fixed(spark, sf):
    return preproc.downsample(clones(spark, sf), ["key"], 1000)


@query(_UNITS.replace("h AS", "z AS (SELECT sample, sum(round(weight)) AS size FROM cl GROUP BY 1), n AS (SELECT min(size) AS n FROM z WHERE size >= (SELECT quantile_cont(size, 0.2) / 2 FROM z)), h AS") + "SELECT sample, key, CAST(count(*) AS DOUBLE) AS weight FROM h WHERE r <= (SELECT n FROM n) GROUP BY 1, 2")
def downsample_auto(spark, sf):
    return preproc.parse("count-weight-auto")(clones(spark, sf), ["key"])


@query(CL + ", r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY weight DESC, key) AS r FROM cl) SELECT sample, key, round(weight, 6) AS weight FROM r WHERE r <= 50")
def top_keys(spark, sf):
    return rounded(preproc.parse("top-weight-50")(clones(spark, sf), ["key"]).select("sample", "key", "weight"))


@query(CL + ", b AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY sample ORDER BY weight DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(weight) OVER (PARTITION BY sample) AS t FROM cl) SELECT sample, key, round(weight, 6) AS weight FROM b WHERE b < 0.3 * t")
def cumulative_top(spark, sf):
    return rounded(preproc.parse("cumtop-weight-0.3")(clones(spark, sf), ["key"]).select("sample", "key", "weight"))


@query(CL + ", z AS (SELECT sample FROM cl GROUP BY 1 HAVING sum(round(weight)) >= 400000) SELECT sample, count(*) AS n FROM cl WHERE sample IN (SELECT sample FROM z) GROUP BY 1")
def outliers_dropped(spark, sf):
    return preproc.drop_outliers(clones(spark, sf), 400000).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))


@query(CL + ", r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY weight DESC, key) AS r FROM cl) SELECT sample, false AS dropped, count(*) AS n_before, round(sum(weight), 4) AS weight_before, count(*) FILTER (r <= 50) AS n_after, round(sum(weight) FILTER (r <= 50), 4) AS weight_after FROM r GROUP BY 1")
def preproc_summary(spark, sf):
    c = clones(spark, sf)
    s = preproc.summary(c, preproc.top(c, ["key"], 50))
    return s.select("sample", "dropped", "n_before", F.round("weight_before", 4).alias("weight_before"), "n_after", F.round("weight_after", 4).alias("weight_after"))


@query(_UNITS + ", d AS (SELECT sample, key, CAST(count(*) AS DOUBLE) AS weight FROM h WHERE r <= 5000 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY weight DESC, key) AS r FROM d) SELECT sample, key, weight FROM r WHERE r <= 20")
def preproc_chain(spark, sf):
    return preproc.chain(clones(spark, sf), ["key"], ["count-weight-fixed-5000", "top-weight-20"]).select("sample", "key", "weight")


# filters and slices

@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 500 AND lang IN ('en', 'de')")
def scripted_filter(spark, sf):
    return filters.scripted(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "n_chars > 500 and lang in ('en', 'de')")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS new_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def slice_by_ids(spark, sf):
    ids = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.slice_ids(table(spark, sf, "orders").select("o_orderkey"), ids, "o_orderkey", True)


@query("SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 2)")
def groups_with_more(spark, sf):
    return filters.larger_groups(table(spark, sf, "events").select("user_id", "event_id"), "user_id")


@query("SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment = 'BUILDING'")
def metadata_conditions(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    return filters.metadata_filter(c, ["c_acctbal>=1000", "c_mktsegment=BUILDING"])


_PROD = f"WITH s AS (SELECT p_partkey, {NT.format('p_partkey')}[1:30] AS nt FROM part), t AS (SELECT *, list_transform(range(10), lambda i: nt[3 * i + 1:3 * i + 3]) AS codons FROM s) "


@query(_PROD + "SELECT p_partkey, nt FROM t WHERE len(list_filter(codons, lambda c: c IN ('TAA', 'TAG', 'TGA'))) = 0")
def productive_only(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.substring(bases(F.col("p_partkey")), 1, 30).alias("nt"))
    return filters.productive(p, ["nt"])


# sequence functions and export fields

_CODON = "list_aggregate(list_transform(range(10), lambda i: [" + ", ".join(f"'{a}'" for a in S.AMINO_ACIDS) + "][16 * (strpos('TCAG', nt[3 * i + 1:3 * i + 1]) - 1) + 4 * (strpos('TCAG', nt[3 * i + 2:3 * i + 2]) - 1) + strpos('TCAG', nt[3 * i + 3:3 * i + 3])]), 'string_agg', '')"


@query(f"WITH s AS (SELECT p_partkey, {NT.format('p_partkey')}[1:30] AS nt FROM part) SELECT p_partkey, nt AS \"nFeatureCDR3\", {_CODON} AS \"aaFeatureCDR3\", 30 AS \"nLengthCDR3\", 10 AS \"aaLengthCDR3\", false AS \"isOOFCDR3\", contains({_CODON}, '*') AS \"hasStopsCDR3\", reverse(translate(nt, 'ACGT', 'TGCA')) AS rc, round(len(regexp_replace(nt, '[AT]', '', 'g')) / 30, 6) AS gc FROM s")
def sequence_fields(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.substring(bases(F.col("p_partkey")), 1, 30).alias("cdr3_nt"))
    e = fields.export(p, ["nFeature CDR3", "aaFeature CDR3", "nLength CDR3", "aaLength CDR3", "isOOF CDR3", "hasStops CDR3"])
    nt = F.col("nFeatureCDR3")
    key = p.select("p_partkey", F.col("cdr3_nt").alias("nFeatureCDR3"))
    return key.join(e.distinct(), "nFeatureCDR3").select("p_partkey", *e.columns, S.reverse_complement(nt).alias("rc"), F.round(S.gc_content(nt), 6).alias("gc"))


_HYDRO = "list_sum(list_transform(string_split(aa, ''), lambda c: CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.HYDROPATHY.items()) + " ELSE 0 END))"


@query(f"WITH s AS (SELECT p_partkey, {NT.format('p_partkey')}[1:30] AS nt FROM part), a AS (SELECT p_partkey, {_CODON}[3:7] AS aa FROM s) SELECT p_partkey, aa AS central, round(CAST({_HYDRO} AS DOUBLE), 6) AS hydrophobicity FROM a")
def residue_properties(spark, sf):
    nt = F.substring(bases(F.col("p_partkey")), 1, 30)
    p = table(spark, sf, "part").select("p_partkey", S.central(S.translate(nt)).alias("central"))
    return rounded(p.withColumn("hydrophobicity", S.residue_sum(F.col("central"), S.HYDROPATHY)))


@query(f"WITH s AS (SELECT {NT.format('p_partkey')} AS nt FROM part), k AS (SELECT unnest(list_transform(range(1, 28), lambda i: nt[i:i + 5])) AS kmer FROM s) SELECT kmer, count(*) AS n FROM k GROUP BY 1")
def kmer_counts(spark, sf):
    p = table(spark, sf, "part").select(F.explode(S.kmers(bases(F.col("p_partkey")), 6)).alias("kmer"))
    return p.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH s AS (SELECT p_partkey, {NT.format('p_partkey')}[1:12] AS seq, {NT.format('p_size')}[1:12] AS ref FROM part) SELECT p_partkey, list_aggregate(list_filter(list_transform(range(12), lambda i: CASE WHEN ref[i + 1:i + 1] <> seq[i + 1:i + 1] THEN 'S' || ref[i + 1:i + 1] || i || seq[i + 1:i + 1] END), lambda x: x IS NOT NULL), 'string_agg', ',') AS mutations, CAST(hamming(ref, seq) AS INTEGER) AS n_mutations FROM s")
def mutations(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.substring(bases(F.col("p_partkey")), 1, 12).alias("seq"), F.substring(bases(F.col("p_size")), 1, 12).alias("ref"))
    m = F.array_join(S.substitutions(F.col("ref"), F.col("seq")), ",")
    return p.select("p_partkey", F.when(m != "", m).alias("mutations"), S.hamming(F.col("ref"), F.col("seq")).alias("n_mutations"))


@query(f"WITH s AS (SELECT p_partkey, {NT.format('p_partkey')}[1:30] AS nt, p_brand, p_type FROM part) SELECT CAST(p_partkey AS VARCHAR) AS sequence_id, nt AS junction, {_CODON} AS junction_aa, p_brand AS v_call, p_type AS j_call, nt[4:27] AS cdr3, NOT contains({_CODON}, '*') AS productive FROM s")
def airr_export(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("clone_id"), F.substring(bases(F.col("p_partkey")), 1, 30).alias("cdr3_nt"), F.col("p_brand").alias("v_gene"), F.col("p_type").alias("j_gene"))
    return fields.airr(p).select("sequence_id", "junction", "junction_aa", "v_call", "j_call", "cdr3", "productive")


@query("SELECT doc_id, CASE WHEN strpos(text, '.') > 0 THEN 'Good' ELSE 'NotParsed' END AS status FROM documents")
def status_routing(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.when(F.contains("text", F.lit(".")), "Good").otherwise("NotParsed").alias("status"))


@query(f"WITH s AS (SELECT l_orderkey, l_linenumber, {NT.format('l_partkey')} AS r FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN r[9:9] IN ('A', 'G') THEN r[1:4] END AS \"CELL\", CASE WHEN r[9:9] IN ('A', 'G') THEN r[5:8] END AS \"UMI\", CASE WHEN r[9:9] IN ('A', 'G') THEN 'Good' ELSE 'NotParsed' END AS status FROM s")
def tag_pattern(spark, sf):
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", bases(F.col("l_partkey")).alias("r"))
    return tags.parse_tags(r, "r", "^(CELL:N{4})(UMI:N{4})R").drop("r")


# barcodes

_SHORT = f"WITH b AS (SELECT l_returnflag AS sample, {NT.format('l_partkey')}[1:5] AS tag, count(*) AS w FROM lineitem GROUP BY 1, 2)"


@query(_SHORT + """, m AS (SELECT sample, tag, w, tag[:i - 1] || '?' || tag[i + 1:] AS mark FROM b, range(1, 6) t(i)),
t AS (SELECT sample, mark, max({'w': w, 'tag': tag}) AS best FROM m GROUP BY 1, 2),
p AS (SELECT m.sample, m.tag, max(best) AS best FROM m JOIN t ON m.sample = t.sample AND m.mark = t.mark WHERE m.tag <> best.tag AND best.w >= 2 * m.w GROUP BY 1, 2)
SELECT b.sample, coalesce(best.tag, b.tag) AS tag, CAST(sum(w) AS DOUBLE) AS weight FROM b LEFT JOIN p ON b.sample = p.sample AND b.tag = p.tag GROUP BY 1, 2""")
def tag_correction(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.substring(bases(F.col("l_partkey")), 1, 5).alias("tag")).groupBy("sample", "tag").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    out = tags.correct_level(b, "tag", ["sample"], 2.0)
    return out.groupBy("sample", "tag").agg(F.sum("weight").alias("weight"))


@query(_SHORT + ", l AS (SELECT DISTINCT " + NT.format("s_suppkey") + "[1:5] AS ok FROM supplier), n AS (SELECT DISTINCT tag FROM b WHERE tag NOT IN (SELECT ok FROM l)), f AS (SELECT tag, min(ok) AS near FROM n JOIN l ON hamming(tag, ok) = 1 GROUP BY 1 HAVING count(*) = 1) SELECT sample, coalesce(ok, near) AS tag, sum(w) AS w FROM b LEFT JOIN l ON tag = ok LEFT JOIN f USING (tag) WHERE coalesce(ok, near) IS NOT NULL GROUP BY 1, 2")
def whitelist_fuzzy(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.substring(bases(F.col("l_partkey")), 1, 5).alias("tag"))
    allowed = table(spark, sf, "supplier").select(F.substring(bases(F.col("s_suppkey")), 1, 5).alias("tag"))
    return tags.whitelist(b, "tag", allowed, 1).groupBy("sample", "tag").agg(F.count(F.lit(1)).alias("w"))


_EV = "WITH g AS (SELECT user_id, sum(value) AS m FROM events GROUP BY 1)"


@query(_EV + ", r AS (SELECT *, row_number() OVER (ORDER BY m DESC, user_id) AS r FROM g) SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM r WHERE r <= 10)")
def group_filter_top(spark, sf):
    return tags.filter_groups(table(spark, sf, "events"), ["user_id"], "top", 10, weight="value").select("event_id", "user_id")


@query(_EV + ", b AS (SELECT *, coalesce(sum(m) OVER (ORDER BY m DESC, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(m) OVER () AS t FROM g) SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM b WHERE b < 0.5 * t)")
def group_filter_cumtop(spark, sf):
    return tags.filter_groups(table(spark, sf, "events"), ["user_id"], "cumtop", 0.5, weight="value").select("event_id", "user_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) BETWEEN 2 AND 2)")
def group_filter_nunique(spark, sf):
    return tags.filter_groups(table(spark, sf, "lineitem"), ["l_orderkey"], "range", (2, 2), "nunique", "l_returnflag").select("l_orderkey", "l_linenumber")


@query()
def group_filter_otsu(spark, sf):
    return tags.filter_groups(table(spark, sf, "events"), ["user_id"], "otsu", weight="value").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey AS clone_id, l_returnflag AS cell, l_linestatus AS umi, CAST(sum(l_quantity) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2, 3")
def divide_clones_by_tags(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("clone_id"), F.col("l_returnflag").alias("cell"), F.col("l_linestatus").alias("umi"), F.col("l_quantity").alias("weight"))
    return tags.divide_by_tags(t, ["cell", "umi"])


# clustering, cells, lineages

@query(_SHORT + """, m AS (SELECT sample, tag, w, tag[:i - 1] || '?' || tag[i + 1:] AS mark FROM b, range(1, 6) t(i)),
t AS (SELECT sample, mark, max({'w': w, 'tag': tag}) AS best FROM m GROUP BY 1, 2),
p AS (SELECT m.sample, m.tag, max(best) AS best FROM m JOIN t ON m.sample = t.sample AND m.mark = t.mark WHERE m.tag <> best.tag AND best.w >= 2 * m.w GROUP BY 1, 2)
SELECT b.sample, coalesce(best.tag, b.tag) AS cdr3_nt, CAST(sum(w) AS DOUBLE) AS count FROM b LEFT JOIN p ON b.sample = p.sample AND b.tag = p.tag GROUP BY 1, 2""")
def error_clustering(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.substring(bases(F.col("l_partkey")), 1, 5).alias("cdr3_nt")).groupBy("sample", "cdr3_nt").agg(F.count(F.lit(1)).cast("double").alias("count"))
    return cluster.cluster_errors(b, ratio=2.0, depth=1)


@query("""WITH c AS (SELECT l_returnflag AS sample, p_type AS seq, p_brand AS gene, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
t AS (SELECT *, first_value(n) OVER o AS top, first_value(gene) OVER o AS g FROM c WINDOW o AS (PARTITION BY sample, seq ORDER BY n DESC, gene))
SELECT sample, seq, CASE WHEN top >= 1.2 * n THEN g ELSE gene END AS gene, sum(n) AS count FROM t GROUP BY 1, 2, 3""")
def pre_clustering(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.col("l_partkey").alias("p_partkey"))
    c = l.join(table(spark, sf, "part"), "p_partkey").groupBy("sample", F.col("p_type").alias("seq"), F.col("p_brand").alias("gene")).agg(F.count(F.lit(1)).alias("count"))
    return cluster.pre_cluster(c, "seq", "gene", ratio=1.2)


@query(f"""WITH r AS (SELECT l_suppkey AS umi, {NT.format("l_returnflag || l_linestatus")}[1:16] AS seq FROM lineitem), b AS (SELECT umi, i, seq[i:i] AS base, count(*) * 40 AS q FROM r, range(1, 17) t(i) GROUP BY 1, 2, 3),
m AS (SELECT umi, i, max({{'q': q, 'base': base}}) AS b, sum(q) AS t FROM b GROUP BY 1, 2), n AS (SELECT umi, count(*) AS reads FROM r GROUP BY 1)
SELECT umi, string_agg(CASE WHEN b.q >= 0.5 * t THEN b.base ELSE 'N' END, '' ORDER BY i) AS seq, any_value(reads) AS reads FROM m JOIN n USING (umi) GROUP BY 1""")
def consensus_of_reads(spark, sf):
    r = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("umi"), F.substring(bases(F.concat("l_returnflag", "l_linestatus")), 1, 16).alias("seq"), F.lit("I" * 16).alias("qual"))
    return cluster.consensus(r, ["umi"]).select("umi", "seq", "reads")


@query()
def contig_assembly(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.pmod("l_partkey", F.lit(200)).cast("int").alias("start"), F.substring(bases(F.lit("reference")), 1, 32).alias("seq"))
    return cluster.contigs(a, ["sample"])


@query()
def cell_grouping(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("clone_id"), F.col("user_id").alias("cell"))
    return cluster.group_cells(e)


@query("""WITH c AS (SELECT user_id AS cell_group, event_type AS chain, event_id AS clone_id, value AS count FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY cell_group, chain ORDER BY count DESC, clone_id) AS r FROM c)
SELECT cell_group, chain, max(clone_id) FILTER (r = 1) AS first, round(max(count) FILTER (r = 1), 6) AS first_weight, max(clone_id) FILTER (r = 2) AS second, count(*) AS n_clones, round(sum(count), 4) AS total FROM r GROUP BY 1, 2""")
def cell_group_export(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("cell_group"), F.col("event_type").alias("chain"), F.col("event_id").alias("clone_id"), F.col("value").alias("count"))
    g = cluster.group_chains(e)
    return g.select("cell_group", "chain", "first", F.round("first_weight", 6).alias("first_weight"), "second", "n_clones", F.round("total", 4).alias("total"))


def _lineage(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("clone_id"), F.col("p_brand").alias("v_gene"), F.col("p_type").alias("j_gene"), F.substring(bases(F.col("p_partkey")), 1, 8).alias("cdr3_nt"))
    return p, cluster.lineages(p, identity=0.74)


@query(f"""WITH RECURSIVE c AS (SELECT p_partkey AS id, p_brand AS v, p_type AS j, {NT.format('p_partkey')}[1:8] AS s FROM part),
e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.v = b.v AND a.j = b.j AND a.id <> b.id AND hamming(a.s, b.s) <= 2),
r AS (SELECT id AS x, id AS y FROM c UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a) SELECT x AS clone_id, min(y) AS tree_id FROM r GROUP BY 1""")
def lineage_grouping(spark, sf):
    return _lineage(spark, sf)[1]


@query()
def lineage_trees(spark, sf):
    p, groups = _lineage(spark, sf)
    groups = filters.larger_groups(groups, "tree_id")
    m = p.join(groups, "clone_id").select("tree_id", "clone_id", F.col("cdr3_nt").alias("seq"), F.lit("ACGTACGT").alias("germline"))
    return cluster.tree_filter(cluster.lineage_trees(m), min_nodes=3)


@query()
def lineage_newick(spark, sf):
    return cluster.newick(lineage_trees(spark, sf))


@query("""WITH m AS (SELECT p_brand AS v_gene, p_type AS mutations, p_size AS context FROM part), t AS (SELECT v_gene, count(*) AS t FROM m GROUP BY 1), s AS (SELECT v_gene, mutations, count(*) AS n_clones, count(DISTINCT context) AS diversity FROM m GROUP BY 1, 2)
SELECT v_gene, mutations, n_clones, diversity, round(n_clones / t, 6) AS share FROM s JOIN t USING (v_gene) WHERE n_clones >= 5 AND n_clones / t >= 0.35 AND diversity >= 3""")
def allele_candidates(spark, sf):
    m = table(spark, sf, "part").select(F.col("p_brand").alias("v_gene"), F.array("p_type").alias("mutations"), F.col("p_size").alias("context"))
    return rounded(cluster.allele_candidates(m))


# statistics

_PV = "WITH p AS (SELECT p_partkey, p_brand AS family, (p_partkey * 7919 % 1009 + 1) / 1010.0::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS i, count(*) OVER (PARTITION BY family) AS n FROM p)"


def _pvalues(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("family"), ((F.col("p_partkey") * 7919 % 1009 + 1) / F.lit(1010.0)).alias("p"))


def _adjusted(method: str):
    def run(spark, sf):
        a = stats.adjust(_pvalues(spark, sf), method, ["family"])
        # equal p-values get equal adjusted ones in every method but by the row, so rows are compared by value
        return a.groupBy("family", F.round("p", 9).alias("p")).agg(F.round(F.max("p_adjusted"), 9).alias("p_adjusted"))

    return run


for _m, _e in {
    "bonferroni": "least(1, p * n)",
    "holm": "least(1, max(p * (n - i + 1)) OVER (PARTITION BY family ORDER BY p, i ROWS UNBOUNDED PRECEDING))",
    "hochberg": "least(1, min(p * (n - i + 1)) OVER (PARTITION BY family ORDER BY p, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
    "bh": "least(1, min(p * n / i) OVER (PARTITION BY family ORDER BY p, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
    "by": "least(1, min(p * n / i * list_sum(list_transform(range(1, n + 1), lambda k: 1.0::DOUBLE / k))) OVER (PARTITION BY family ORDER BY p, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
}.items():
    QUERIES[f"p_adjust_{_m}"] = _adjusted(_m)
    SQL[f"p_adjust_{_m}"] = _PV + f", a AS (SELECT family, p, {_e} AS q FROM r) SELECT family, round(p, 9) AS p, round(max(q), 9) AS p_adjusted FROM a GROUP BY 1, 2"


@query()
def p_adjust_hommel(spark, sf):
    return _adjusted("hommel")(spark, sf)


@query()
def pairwise_tests(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("value"))
    return rounded(stats.adjust(stats.pairwise(c, "value", "c_mktsegment"), "holm"))


@query()
def overall_test(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("value"))
    return rounded(stats.across(c, "value", "c_mktsegment", "kruskal"))


@query()
def sample_dendrogram(spark, sf):
    return rounded(stats.cluster_samples(usage.usage_matrix(clones(spark, sf), "j_gene", ["ECONOMY", "PROMO", "STANDARD"])))


# reads

@query()
def read_alignment(spark, sf):
    reads = table(spark, sf, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat(bases(F.pmod("o_custkey", F.lit(20))), bases(F.lit(100) + F.pmod("o_custkey", F.lit(7)))).alias("seq"))
    v = spark.range(20).select(F.concat(F.lit("V"), F.col("id").cast("string")).alias("gene"), F.lit("V").alias("gene_type"), bases(F.col("id")).alias("ref"))
    j = spark.range(7).select(F.concat(F.lit("J"), F.col("id").cast("string")).alias("gene"), F.lit("J").alias("gene_type"), bases(F.lit(100) + F.col("id").cast("int")).alias("ref"))
    h = align.align_reads(reads, v.unionByName(j))
    return h.select("read_id", "gene_type", F.element_at("hits", 1)["gene"].alias("gene"), F.element_at("hits", 1)["score"].alias("score"))


SQL["read_alignment"] = "SELECT o_orderkey AS read_id, 'V' AS gene_type, 'V' || (o_custkey % 20) AS gene, 160.0::DOUBLE AS score FROM orders UNION ALL SELECT o_orderkey, 'J', 'J' || (o_custkey % 7), 160.0::DOUBLE FROM orders"


@query("SELECT p_partkey, 10 AS trimmed FROM part")
def quality_trimming(spark, sf):
    q = F.lit("I" * 14 + "#" * 6)
    return table(spark, sf, "part").select("p_partkey", S.trimmed_length(q, 30).alias("trimmed"))


# quality control

@query("""WITH c AS (SELECT l_returnflag AS sample, count(*) AS total, count(*) FILTER (l_discount < 0.08) AS aligned, count(*) FILTER (l_tax > 0.07) AS off_target FROM lineitem GROUP BY 1),
v AS (SELECT sample, 'SuccessfullyAlignedReads' AS check, aligned / total AS value FROM c UNION ALL SELECT sample, 'OffTargetReads', off_target / total FROM c)
SELECT sample, "check", round(value, 6) AS value, CASE WHEN "check" = 'OffTargetReads' THEN CASE WHEN value <= 0.12 THEN 'OK' WHEN value <= 0.14 THEN 'WARN' ELSE 'ALERT' END ELSE CASE WHEN value >= 0.8 THEN 'OK' WHEN value >= 0.6 THEN 'WARN' ELSE 'ALERT' END END AS status FROM v""".replace("AS check", 'AS "check"'))
def qc_checks(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("sample")).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("l_discount") < 0.08, 1)).alias("aligned"), F.count(F.when(F.col("l_tax") > 0.07, 1)).alias("off_target"))
    return rounded(qc.run_checks(c, qc.checks(SuccessfullyAlignedReads=(0.6, 0.8), OffTargetReads=(0.14, 0.12))))


@query("WITH e AS (SELECT p_brand AS sample, p_size AS pos, 1 AS d FROM part UNION ALL SELECT p_brand, p_size + 10, -1 FROM part), s AS (SELECT sample, pos, sum(d) AS d FROM e GROUP BY 1, 2) SELECT sample, pos, CAST(sum(d) OVER (PARTITION BY sample ORDER BY pos) AS BIGINT) AS coverage FROM s")
def coverage(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("sample"), F.col("p_size").alias("start"), (F.col("p_size") + 10).alias("end"))
    return qc.coverage(p)


# postanalysis, assignment and reports

@query("""WITH o AS (SELECT l_orderkey, l_linestatus, l_returnflag, l_partkey, l_quantity FROM lineitem),
c AS (SELECT l_linestatus AS chain, l_returnflag AS sample, l_partkey AS key, sum(l_quantity) AS w FROM o GROUP BY 1, 2, 3), x AS (SELECT c.*, p_type, p_size FROM c JOIN part ON key = p_partkey),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY chain, sample) AS p FROM x)
SELECT chain, 'g' || sample AS "group", sample, 'observed' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1, 3
UNION ALL SELECT chain, 'g' || sample, sample, 'inverse_simpson', '', round(1 / sum(p * p), 6) FROM p GROUP BY 1, 3
UNION ALL SELECT chain, 'g' || sample, sample, 'mean_length', '', round(sum(w * p_size) / sum(w), 6) FROM p GROUP BY 1, 3
UNION ALL SELECT chain, 'g' || sample, sample, 'j_usage', p_type, round(sum(p), 6) FROM p GROUP BY 1, 3, 5""")
def postanalysis_individual(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("sample"), F.col("l_partkey").alias("key"), "l_quantity")
    c = l.groupBy("status", "sample", "key").agg(F.sum("l_quantity").alias("weight"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("j_gene"), F.col("p_size").alias("len"))
    meta = spark.createDataFrame([(s, f"g{s}") for s in "ANR"], "sample string, cohort string")
    return rounded(postanalysis.individual(c.join(part, "key"), ["observed", "inverse_simpson", "mean_length", "j_usage"], ["key"], meta, ["cohort"], "status"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p_size > 25 THEN p_partkey ELSE -1 END AS clone_id FROM lineitem JOIN part ON l_partkey = p_partkey")
def clone_assignment(spark, sf):
    c = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("clone_id"))
    return assign.assign(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), c, ["l_partkey"]).select("l_orderkey", "l_linenumber", "clone_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS clone_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 AND p_brand = 'Brand#1'")
def reads_for_clones(spark, sf):
    c = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("clone_id"))
    a = assign.assign(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), c, ["l_partkey"])
    ids = table(spark, sf, "part").where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("clone_id"))
    return assign.records_for_clones(a, ids).select("l_orderkey", "l_linenumber", "clone_id")


@query("SELECT l_returnflag AS sample, CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) AS \"align.F\", CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) AS \"align.O\" FROM lineitem GROUP BY 1")
def reports_table(spark, sf):
    n = lambda s: F.count(F.when(F.col("l_linestatus") == s, 1)).cast("double")
    r = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("sample")).agg(F.create_map(F.lit("F"), n("F"), F.lit("O"), n("O")).alias("counters")).withColumn("step", F.lit("align"))
    return assign.reports_table(r, ["align.F", "align.O"])


# extension: events as windows

@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    w = ev.windowed_usage(table(spark, sf, "events"))
    return w.select("start", "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))
