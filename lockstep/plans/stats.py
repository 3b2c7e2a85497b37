"""Queries on score tables: aggregation, statistics, resampling, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import dense, models, nulls, resampling, sequences
from ..operators import summaries as agg
from ..sources.tables import finite, table, upsert
from .registry import SCORES, events, query, rounded, scores


@query(f"""WITH {SCORES} SELECT family, time, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS sd, count(score) AS n FROM scores WHERE valid GROUP BY family, time""")
def partition_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(agg.mean_over_valid(scores(spark, folder), ["family", "time"], "score", F.col("valid")), "mean", "sd")


@query(f"""WITH {SCORES} SELECT subject, family, round(median(score), 6) AS median, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, round(quantile_cont(score, 0.95), 6) AS p95 FROM scores GROUP BY subject, family""")
def null_floor(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(agg.null_floor(scores(spark, folder), ["subject", "family"], "score"), "median", "mean", "sd", "p95")


@query(f"""WITH {SCORES}, n AS (SELECT subject, family, median(score) AS med, avg(score) AS mean, stddev_samp(score) AS sd FROM scores WHERE NOT valid GROUP BY ALL),
o AS (SELECT subject, family, avg(score) AS obs FROM scores WHERE valid GROUP BY ALL)
SELECT subject, family, round(obs - med, 6) AS over_median, round(CASE WHEN sd > 0 THEN (obs - mean) / sd END, 6) AS z FROM o LEFT JOIN n USING (subject, family)""")
def score_over_null(spark: SparkSession, folder: str) -> DataFrame:
    s = scores(spark, folder)
    floor = agg.null_floor(s.where("not valid"), ["subject", "family"], "score")
    observed = s.where("valid").groupBy("subject", "family").agg(F.avg("score").alias("obs"))
    found = observed.join(floor, ["subject", "family"], "left")
    return rounded(found.select("subject", "family", (F.col("obs") - F.col("median")).alias("over_median"), F.when(F.col("sd") > 0, (F.col("obs") - F.col("mean")) / F.col("sd")).alias("z")), "over_median", "z")


@query("""WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY event_type)
SELECT event_type, round(m, 6) AS median, round(median(abs(value - m)), 6) AS mad, round(CASE WHEN median(abs(value - m)) > 0 THEN m + 5 * median(abs(value - m)) END, 6) AS threshold FROM events JOIN m USING (event_type) GROUP BY event_type, m""")
def mad_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(agg.mad_threshold(table(spark, folder, "events"), ["event_type"], "value"), "median", "mad", "threshold")


@query(f"""WITH {SCORES}, t AS (SELECT family, time, avg(score) AS m FROM scores GROUP BY ALL) SELECT family, round(max(abs(m)) FILTER (WHERE time BETWEEN 3 AND 8), 6) AS peak, round(min(m) FILTER (WHERE time < 3), 6) AS control FROM t GROUP BY family""")
def window_peak(spark: SparkSession, folder: str) -> DataFrame:
    """Largest mean in the months 3 to 8, and the least one before."""
    t = scores(spark, folder).groupBy("family", "time").agg(F.avg("score").alias("m"))
    return rounded(t.groupBy("family").agg(F.max(F.when(F.col("time").between(3, 8), F.abs("m"))).alias("peak"), F.min(F.when(F.col("time") < 3, F.col("m"))).alias("control")), "peak", "control")


@query(f"""WITH {SCORES}, s AS (SELECT subject, family, time, avg(score) AS m FROM scores GROUP BY ALL) SELECT family, time, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM s GROUP BY family, time""")
def cohort_mean_sem(spark: SparkSession, folder: str) -> DataFrame:
    s = scores(spark, folder).groupBy("subject", "family", "time").agg(F.avg("score").alias("m"))
    return rounded(s.groupBy("family", "time").agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n")), "mean", "sem")


@query("""SELECT l_shipdate IS NOT NULL AS dated, o_orderpriority, c_mktsegment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def trial_item_subject_join(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with two dimensions; Spark chooses broadcast or sort-merge by size."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_discount")
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = li.join(o, "l_orderkey", "left").join(c, "o_custkey", "left")
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.groupBy(F.col("l_shipdate").isNotNull().alias("dated"), "o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"), revenue.alias("revenue"))


@query("""SELECT count(*) AS all_, count(*) FILTER (WHERE c_acctbal > 0) AS solvent, count(*) FILTER (WHERE c_acctbal > 0 AND c_mktsegment <> 'MACHINERY') AS cohort,
(SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND c_mktsegment <> 'MACHINERY') AS active FROM customer""")
def cohort_flow(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    inside = (F.col("c_acctbal") > 0) & (F.col("c_mktsegment") != "MACHINERY")
    active = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")).join(c.where(inside), "c_custkey").agg(F.count_distinct("c_custkey").alias("active"))
    return c.agg(F.count("*").alias("all_"), F.count_if(F.col("c_acctbal") > 0).alias("solvent"), F.count_if(inside).alias("cohort")).join(active)


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')""")
def missing_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without an urgent order."""
    urgent = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT l_orderkey, l_linenumber, arg_max(l_partkey, row(l_shipdate, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY ALL""")
def last_of_key(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each key, ties by part and supplier."""
    return table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max_by("l_partkey", F.struct("l_shipdate", "l_partkey", "l_suppkey")).alias("l_partkey"))


@query(f"""WITH {SCORES} SELECT subject, round(avg(score) FILTER (WHERE family = 'A'), 6) AS a, round(avg(score) FILTER (WHERE family = 'N'), 6) AS n, round(avg(score) FILTER (WHERE family = 'R'), 6) AS r FROM scores GROUP BY subject""")
def pivot_mean(spark: SparkSession, folder: str) -> DataFrame:
    wide = scores(spark, folder).groupBy("subject").pivot("family", ["A", "N", "R"]).agg(F.avg("score"))
    return rounded(wide.withColumnsRenamed({"A": "a", "N": "n", "R": "r"}), "a", "n", "r")


@query(f"""WITH {SCORES}, s AS (SELECT subject, avg(score) FILTER (WHERE valid) AS r, avg(score) FILTER (WHERE NOT valid) AS l FROM scores GROUP BY subject)
SELECT subject, round(CASE WHEN abs(r + l) > 1e-12 THEN (r - l) / (r + l) END, 6) AS laterality FROM s""")
def laterality(spark: SparkSession, folder: str) -> DataFrame:
    s = scores(spark, folder).groupBy("subject").agg(F.avg(F.when(F.col("valid"), F.col("score"))).alias("r"), F.avg(F.when(~F.col("valid"), F.col("score"))).alias("l"))
    return rounded(s.select("subject", sc.ratio(F.col("r") - F.col("l"), F.col("r") + F.col("l")).alias("laterality")), "laterality")


@query("""SELECT quality AS true_class, toxic AS guess, count(*) AS n FROM labels GROUP BY ALL""")
def label_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").groupBy(F.col("quality").alias("true_class"), F.col("toxic").alias("guess")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderstatus AS s, left(o_orderpriority, 1) AS g, count(*) AS k FROM orders GROUP BY ALL)
SELECT s, CAST(sum(k) AS BIGINT) AS n, round(sum(CASE WHEN s = g THEN k ELSE 0 END) / sum(k), 6) AS hit_rate, arg_min(g, row(-k, g)) AS modal FROM c GROUP BY s""")
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("s"), F.left("o_orderpriority", F.lit(1)).alias("g"))
    return rounded(agg.confusion(o, "s", "g"), "hit_rate")


RULER = """WITH g AS (SELECT event_type, value AS x FROM events)
SELECT event_type, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90, round(avg((x < 50)::INT), 6) AS inside FROM g GROUP BY event_type"""


@query(RULER)
def percentile_ruler(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    q = agg.quantiles(e, ["event_type"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    inside = e.groupBy("event_type").agg(F.avg((F.col("value") < 50).cast("int")).alias("inside"))
    return rounded(q.join(inside, "event_type"), "p10", "p50", "p90", "inside")


@query("""SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag""")
def regression_by_group(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


@query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rv,
rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS ru FROM events)
SELECT event_type, round(corr(rv, ru), 6) AS rho FROM r GROUP BY event_type""")
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_type", "value", "user_id")
    ranked = agg.average_ranks(agg.average_ranks(e, ["event_type"], "value", "rv"), ["event_type"], "user_id", "ru")
    return rounded(ranked.groupBy("event_type").agg(F.corr("rv", "ru").alias("rho")), "rho")


@query("""WITH s AS (SELECT o_orderstatus AS s, avg(o_totalprice) FILTER (WHERE u) AS ma, avg(o_totalprice) FILTER (WHERE NOT u) AS mb, var_samp(o_totalprice) FILTER (WHERE u) AS va, var_samp(o_totalprice) FILTER (WHERE NOT u) AS vb, count(*) FILTER (WHERE u) AS na, count(*) FILTER (WHERE NOT u) AS nb
FROM (SELECT *, o_orderpriority = '1-URGENT' AS u FROM orders) GROUP BY 1)
SELECT s AS o_orderstatus, round(ma, 6) AS mean_a, na AS n_a, round(mb, 6) AS mean_b, nb AS n_b, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS welch_t,
round((1 - 3.0 / (4 * (na + nb) - 9)) * (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS g FROM s""")
def group_contrast(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return rounded(agg.hedges_g(o, ["o_orderstatus"], F.col("o_orderpriority") == "1-URGENT", "o_totalprice"), "mean_a", "mean_b", "welch_t", "g")


@query(f"""WITH {SCORES}, h AS (SELECT family, subject, avg(score) FILTER (WHERE split % 2 = 1) AS a, avg(score) FILTER (WHERE split % 2 = 0) AS b FROM scores GROUP BY ALL),
g AS (SELECT *, (avg(a) OVER w + avg(b) OVER w) / 2 AS gm, avg(a) OVER w AS am, avg(b) OVER w AS bm FROM h WHERE a IS NOT NULL AND b IS NOT NULL WINDOW w AS (PARTITION BY family)),
s AS (SELECT family, count(*) AS n, sum(2 * pow((a + b) / 2 - gm, 2)) AS ssr, count(*) * (pow(max(am) - max(gm), 2) + pow(max(bm) - max(gm), 2)) AS ssc, sum(pow(a - gm, 2) + pow(b - gm, 2)) AS sst FROM g GROUP BY family),
m AS (SELECT family, n, ssr / (n - 1) AS msr, ssc AS msc, (sst - ssr - ssc) / (n - 1) AS mse FROM s WHERE n > 2),
i AS (SELECT family, n, (msr - mse) / (msr + mse + 2 * (msc - mse) / n) AS icc FROM m)
SELECT family, n, round(icc, 6) AS icc, round(2 * icc / (1 + icc), 6) AS spearman_brown, CASE WHEN 2 * icc / (1 + icc) >= 0.5 THEN 'good' WHEN 2 * icc / (1 + icc) >= 0.3 THEN 'fair' ELSE 'poor' END AS gate FROM i""")
def split_half_reliability(spark: SparkSession, folder: str) -> DataFrame:
    half = lambda k: F.avg(F.when(F.pmod("split", F.lit(2)) == k, F.col("score")))
    h = scores(spark, folder).groupBy("family", "subject").agg(half(1).alias("a"), half(0).alias("b")).where("a is not null and b is not null")
    found = agg.icc21(h, ["family"], "a", "b").withColumn("gate", sc.gate(F.col("spearman_brown")))
    return rounded(found, "icc", "spearman_brown")


@query("""WITH p AS (SELECT event_type, avg(value) / 200 AS p FROM events GROUP BY event_type), r AS (SELECT *, row_number() OVER (ORDER BY p, event_type) AS k, count(*) OVER () AS m FROM p)
SELECT event_type, round(p, 6) AS p, round(least(1, max((m - k + 1) * p) OVER (ORDER BY k)), 6) AS p_holm FROM r""")
def holm(spark: SparkSession, folder: str) -> DataFrame:
    tests = table(spark, folder, "events").groupBy("event_type").agg((F.avg("value") / 200).alias("p"))
    return rounded(agg.holm(tests, "p", ["event_type"]), "p", "p_holm")


@query("""WITH q AS (SELECT quantile_cont(p_retailprice, 1/3) AS q1, quantile_cont(p_retailprice, 2/3) AS q2 FROM part),
t AS (SELECT p_partkey, CASE WHEN p_retailprice <= q1 THEN 'low' WHEN p_retailprice <= q2 THEN 'mid' ELSE 'high' END AS tertile FROM part, q)
SELECT tertile, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem JOIN t ON l_partkey = p_partkey GROUP BY tertile""")
def item_tertiles(spark: SparkSession, folder: str) -> DataFrame:
    """Tertiles on distinct items, applied to all their trials."""
    part = table(spark, folder, "part")
    edges = agg.tertile_edges(part, "p_retailprice")
    price = F.col("p_retailprice")
    tertile = F.when(price <= F.col("q1"), "low").when(price <= F.col("q2"), "mid").otherwise("high")
    items = part.join(edges).select(F.col("p_partkey").alias("l_partkey"), tertile.alias("tertile"))
    return rounded(table(spark, folder, "lineitem").join(items, "l_partkey").groupBy("tertile").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean")), "mean")


@query("""WITH c AS (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) >= 80) SELECT CASE WHEN p_brand IN (SELECT p_brand FROM c) THEN p_brand ELSE 'other' END AS p_brand, count(*) AS n FROM part GROUP BY 1""")
def merge_rare_levels(spark: SparkSession, folder: str) -> DataFrame:
    return agg.merge_rare(table(spark, folder, "part").select("p_brand"), "p_brand", 80).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("""WITH z AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part)
SELECT l_returnflag, round(avg((p_retailprice - m) / s), 6) AS mean_z, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey, z GROUP BY l_returnflag""")
def predictor_scaling(spark: SparkSession, folder: str) -> DataFrame:
    """Items are scaled by their own mean and deviation, and every trial takes its item's value."""
    part = table(spark, folder, "part")
    scaler = part.agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s"))
    z = part.join(scaler).select(F.col("p_partkey").alias("l_partkey"), ((F.col("p_retailprice") - F.col("m")) / F.col("s")).alias("z"))
    return rounded(table(spark, folder, "lineitem").join(z, "l_partkey").groupBy("l_returnflag").agg(F.avg("z").alias("mean_z"), F.count("*").alias("n")), "mean_z")


@query("""SELECT CAST(least(10, floor(l_discount / 0.01) + 1) AS INTEGER) AS bin, count(*) AS n, round(avg(l_tax), 6) AS mean_tax FROM lineitem GROUP BY 1""")
def calibration_bins(spark: SparkSession, folder: str) -> DataFrame:
    bin_ = F.least(F.lit(10), F.floor(F.col("l_discount") / 0.01) + 1).cast("int").alias("bin")
    return rounded(table(spark, folder, "lineitem").groupBy(bin_).agg(F.count("*").alias("n"), F.avg("l_tax").alias("mean_tax")), "mean_tax")


@query("""SELECT c_custkey, c_name, 'old' AS frame FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, c_name, 'new' FROM customer WHERE c_mktsegment = 'BUILDING'""")
def upsert_by_key(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    new = c.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", F.lit("new").alias("frame"))
    return upsert(c.select("c_custkey", "c_name", F.lit("old").alias("frame")), new, "c_custkey")


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE value IS NULL OR isnan(value) OR isinf(value)) AS not_finite, count(*) - count(DISTINCT event_id) AS repeated FROM events""")
def table_contract(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.agg(F.count("*").alias("n"), F.count_if(~finite(F.col("value"))).alias("not_finite"), (F.count("*") - F.count_distinct("event_id")).alias("repeated"))


@query("""SELECT conv_id, turn, len(regexp_extract_all(text, '[.!?]')) AS ends, len(text) AS chars, upper(left(role, 1)) AS initial, printf('s%d_w%04d', conv_id, turn) AS item FROM conversations""")
def text_features(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    return c.select("conv_id", "turn", F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("ends"), F.char_length("text").cast("long").alias("chars"), F.upper(F.left("role", F.lit(1))).alias("initial"), F.format_string("s%d_w%04d", "conv_id", "turn").alias("item"))


UNIT = "('0x' || substr(md5(concat_ws('|', {})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"

SIGN_SQL = f"""WITH d AS (SELECT l_suppkey AS subject, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) - avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS d FROM lineitem GROUP BY 1),
s AS (SELECT rep, avg(CASE WHEN rep > 0 AND {UNIT.format("'sign', rep, subject")} < 0.5 THEN -d ELSE d END) AS stat FROM d, range(0, 201) r(rep) GROUP BY rep),
o AS (SELECT stat AS o FROM s WHERE rep = 0)
SELECT round(o, 6) AS observed, round((1 + (SELECT count(*) FROM s WHERE rep > 0 AND abs(stat) >= abs(o) - 1e-9)) / 201.0, 6) AS p FROM o"""


@query(SIGN_SQL)
def sign_flip_test(spark: SparkSession, folder: str) -> DataFrame:
    """Two-sided sign-flip test of the subjects' mean difference, 200 repetitions."""
    flag = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    d = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("subject")).agg((flag("R") - flag("N")).alias("d"))
    stats = resampling.sign_flips(d, "subject", 200).groupBy("rep").agg(F.avg(F.col("sign") * F.col("d")).alias("stat"))
    return rounded(resampling.empirical_p(stats, [], "stat"), "observed", "p")


PERM_SQL = f"""WITH u AS (SELECT s_suppkey AS subject, s_nationkey < 12 AS label, s_acctbal AS x FROM supplier),
a AS (SELECT rep, subject, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep > 0 THEN {UNIT.format("'label', rep, subject")} ELSE 0 END, subject) AS k FROM u, range(0, 201) r(rep)),
l AS (SELECT row_number() OVER (ORDER BY subject) AS k, label FROM u),
s AS (SELECT rep, avg(x) FILTER (WHERE l.label) - avg(x) FILTER (WHERE NOT l.label) AS stat FROM a JOIN l USING (k) JOIN u USING (subject) GROUP BY rep),
o AS (SELECT stat AS o FROM s WHERE rep = 0)
SELECT round(o, 6) AS observed, round((1 + (SELECT count(*) FROM s WHERE rep > 0 AND abs(stat) >= abs(o) - 1e-9)) / 201.0, 6) AS p FROM o"""


@query(PERM_SQL)
def label_permutation_test(spark: SparkSession, folder: str) -> DataFrame:
    """Mean difference of two groups of suppliers against 200 relabellings."""
    u = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("subject"), (F.col("s_nationkey") < 12).alias("label"), F.col("s_acctbal").alias("x"))
    dealt = resampling.shuffled_labels(u, "subject", "label", 200).join(u.select("subject", "x"), "subject")
    mean = lambda c: F.avg(F.when(c, F.col("x")))
    stats = dealt.groupBy("rep").agg((mean(F.col("label")) - mean(~F.col("label"))).alias("stat"))
    return rounded(resampling.empirical_p(stats, [], "stat"), "observed", "p")


BOOT_SQL = f"""WITH u AS (SELECT s_suppkey AS subject, s_nationkey < 12 AS g, s_acctbal AS x FROM supplier),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY subject) - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM u),
d AS (SELECT g, rep, CAST(floor({UNIT.format("'boot', rep, subject")} * n) AS BIGINT) AS k FROM k, range(1, 201) r(rep)),
m AS (SELECT rep, avg(x) FILTER (WHERE g) - avg(x) FILTER (WHERE NOT g) AS diff FROM d JOIN k USING (g, k) GROUP BY rep)
SELECT round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high FROM m"""


@query(BOOT_SQL)
def bootstrap_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Percentile interval of the mean difference of two groups, 200 draws."""
    u = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("subject"), (F.col("s_nationkey") < 12).alias("g"), F.col("s_acctbal").alias("x"))
    drawn = resampling.bootstrap_rows(u, ["g"], "subject", 200)
    diff = drawn.groupBy("rep").agg((F.avg(F.when(F.col("g"), F.col("x"))) - F.avg(F.when(~F.col("g"), F.col("x")))).alias("diff"))
    q = diff.agg(F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return rounded(q.select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high")), "low", "high")


@query("""WITH g AS (SELECT label, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_
FROM (SELECT label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS y FROM embeddings) GROUP BY label)
SELECT label, round(((bb + 1) * ay - ab * by_) / ((aa + 1) * (bb + 1) - ab * ab), 6) AS w1, round(((aa + 1) * by_ - ab * ay) / ((aa + 1) * (bb + 1) - ab * ab), 6) AS w2 FROM g""")
def ridge_two_features(spark: SparkSession, folder: str) -> DataFrame:
    """Ridge regression by group from sums of products, solved in closed form."""
    e = table(spark, folder, "embeddings").select("label", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("aby")])
    g = e.groupBy("label").agg(*[F.sum(F.col(p[0]) * F.col(p[1])).alias(p) for p in ("aa", "ab", "bb", "ay", "by")])
    det = (F.col("aa") + 1) * (F.col("bb") + 1) - F.col("ab") * F.col("ab")
    w1 = ((F.col("bb") + 1) * F.col("ay") - F.col("ab") * F.col("by")) / det
    w2 = ((F.col("aa") + 1) * F.col("by") - F.col("ab") * F.col("ay")) / det
    return rounded(g.select("label", w1.alias("w1"), w2.alias("w2")), "w1", "w2")


def _halved_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings as trials of their label in 8 blocks, dealt by hash: 4 places as features, the next 60 in 6 parts of 10 as the channels of 6 times,
    with the features mixed in. Places that a shorter vector doesn't have are 0; null and empty vectors and labels are no trials."""
    e = table(spark, folder, "embeddings").where("label is not null and size(embedding) > 0")
    place = lambda k: F.coalesce(F.get("embedding", k.cast("int")), F.lit(0.0))
    trials = e.select(
        F.col("label").cast("long").alias("participant"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("time"), F.col("vec_id").alias("trial"),
        F.pmod(F.xxhash64("vec_id"), F.lit(8)).cast("int").alias("block"), F.transform(F.sequence(F.lit(0), F.lit(3)), place).alias("x"), "embedding",
    )
    mixed = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: place(F.col("time") * 10 + 4 + k) + F.get("x", F.pmod(k, F.lit(4)).cast("int")))
    return trials.withColumn("y", mixed).drop("embedding")


FAMILIES = {"first": 2, "second": 2}


@query()
def back_to_back_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Back-to-back regression on the embeddings, two families of features, over splits of their blocks."""
    found = dense.b2b_scores(_halved_embeddings(spark, folder), FAMILIES, sc.log_grid(-4, 4, 1), splits=4)
    valid = found.where("valid").groupBy("participant", "time", "family")
    return rounded(valid.agg(F.avg("trace").alias("mean_trace"), F.avg("score").alias("mean_score"), F.count("*").alias("n")), "mean_trace", "mean_score")


@query()
def back_to_back_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Median and spread of the back-to-back scores over 20 circular shifts of the features, with the observed penalties."""
    trials = _halved_embeddings(spark, folder)
    observed = dense.b2b_alphas(trials, sc.log_grid(-4, 4, 1), splits=4)
    reps = nulls.b2b_nulls(trials, observed, FAMILIES, 20, 4).groupBy("participant", "family", "rep").agg(F.avg("score").alias("score"))
    return rounded(reps.groupBy("participant", "family").agg(F.median("score").alias("floor"), F.stddev_samp("score").alias("sd"), F.count("*").alias("n")), "floor", "sd")


OOF_SQL = """WITH r AS (SELECT CAST(floor(CAST('0x' || substr(md5('fold|' || l_orderkey), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * 5) AS INTEGER) AS fold,
    l_quantity AS a, l_discount AS b, l_extendedprice / 10000 AS y FROM lineitem),
t AS (SELECT f.fold, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, count(*) * corr(a, b) AS ab,
    count(*) * covar_pop(a, y) / stddev_pop(a) AS ay, count(*) * covar_pop(b, y) / stddev_pop(b) AS by_ FROM (SELECT DISTINCT fold FROM r) f JOIN r ON r.fold <> f.fold GROUP BY f.fold),
w AS (SELECT *, ((n + 1) * ay - ab * by_) / ((n + 1) * (n + 1) - ab * ab) AS wa, ((n + 1) * by_ - ab * ay) / ((n + 1) * (n + 1) - ab * ab) AS wb FROM t),
p AS (SELECT r.fold, y, my + wa * (a - ma) / sa + wb * (b - mb) / sb AS guess FROM r JOIN w USING (fold))
SELECT fold, count(*) AS n, round(avg((y - guess) * (y - guess)), 6) AS error, round(corr(y, guess), 6) AS r FROM p GROUP BY fold"""


@query(OOF_SQL)
def grouped_prediction(spark: SparkSession, folder: str) -> DataFrame:
    """Prices predicted by ridge regression from the folds that hold no row of the same order: error and correlation by fold."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_discount", (F.col("l_extendedprice") / 10000).alias("y"))
    found = models.grouped_ridge(rows, "l_orderkey", ["l_quantity", "l_discount"], "y")
    gap = F.col("y") - F.col("predicted")
    return rounded(found.groupBy("fold").agg(F.count("*").alias("n"), F.avg(gap * gap).alias("error"), F.corr("y", "predicted").alias("r")), "error", "r")


@query()
def lagged_residual(spark: SparkSession, folder: str) -> DataFrame:
    """Values less what the gaps and hours of the last 4 events of the user explain: alpha and the part of the variance explained, by user."""
    ev = sequences.gap_before(events(spark, folder), ["user_id"], ["pos"], "us")
    ev = ev.select("user_id", "pos", "value", F.log1p(F.col("gap") / 1e6).alias("gap"), F.pmod(F.floor(F.col("us") / 3.6e9), F.lit(24)).alias("hour"))
    found = models.lagged_residual(ev, ["user_id"], ["pos"], ["gap", "hour"], "value", 4, sc.log_grid(-2, 4, 1))
    part = F.when(F.var_pop("value") > 0, 1 - F.var_pop("residual") / F.var_pop("value")).alias("explained")
    return rounded(found.groupBy("user_id").agg(F.count("*").alias("n"), F.first("alpha").alias("alpha"), part), "explained")


@query("""SELECT CAST(epoch(time_bucket(INTERVAL 6 HOURS, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The batch form of the tumbling stream."""
    from ..streaming.windows import tumbling

    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', window.start)").cast("long")
    return rounded(tumbling(table(spark, folder, "events"), "6 hours").select(start.alias("start"), "event_type", "n", "total"), "total")


@query("""WITH s AS (SELECT event_type, (value * 10)::BIGINT AS v FROM events), o AS (SELECT user_id, event_id, value FROM events)
SELECT user_id, event_id, value FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3""")
def top_values(spark: SparkSession, folder: str) -> DataFrame:
    """The three largest values of each user."""
    w = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    e = table(spark, folder, "events").select("user_id", "event_id", "value")
    return e.withColumn("_k", F.row_number().over(w)).where("_k <= 3").drop("_k")


@query("""SELECT c_custkey AS key FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000""")
def common_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Solvent customers with a large order."""
    large = table(spark, folder, "orders").where("o_totalprice > 300000").select("o_custkey")
    return table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")).intersect(large)


