"""Queries on tests by relabelling, shifting and halving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import permutation as perm
from ..operators import sequences
from ..operators import summaries as agg
from ..sources.tables import table
from .registry import EV, SCORES, events, query, rounded, scores
from .stats import UNIT

REPS = 200
MEANS = f"{SCORES}, m AS (SELECT subject, family, time, avg(score) AS v FROM scores GROUP BY ALL)"
ISLANDS = """r AS (SELECT *, row_number() OVER (PARTITION BY rep, family ORDER BY time) - row_number() OVER (PARTITION BY rep, family, coalesce(abs(t) > {0}, false) ORDER BY time) AS isl FROM t),
c AS (SELECT rep, family, min(time) AS first, max(time) AS last, count(*) AS size, sum(abs(t)) AS mass FROM r WHERE abs(t) > {0} GROUP BY rep, family, isl),
x AS (SELECT rep, max(mass) AS m FROM c WHERE rep > 0 GROUP BY rep)
SELECT family, first, last, size, round(mass, 6) AS mass, round((1 + (SELECT count(*) FROM x WHERE m >= mass - 1e-9)) / 201.0, 6) AS p FROM c WHERE rep = 0"""


def _means(spark: SparkSession, folder: str) -> DataFrame:
    return scores(spark, folder).groupBy("subject", "family", "time").agg(F.avg("score").alias("v"))


@query(f"""WITH {MEANS}, u AS (SELECT s_suppkey AS subject, s_nationkey < 12 AS label FROM supplier),
a AS (SELECT rep, subject, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep > 0 THEN {UNIT.format("'label', rep, subject")} ELSE 0 END, subject) AS k FROM u, range(0, 201) q(rep)),
l AS (SELECT row_number() OVER (ORDER BY subject) AS k, label FROM u),
t AS (SELECT rep, family, time, (avg(v) FILTER (WHERE label) - avg(v) FILTER (WHERE NOT label)) / sqrt(var_samp(v) FILTER (WHERE label) / count(v) FILTER (WHERE label) + var_samp(v) FILTER (WHERE NOT label) / count(v) FILTER (WHERE NOT label)) AS t
FROM a JOIN l USING (k) JOIN m USING (subject) GROUP BY rep, family, time), {ISLANDS.format("1.0")}""")
def label_cluster_test(spark: SparkSession, folder: str) -> DataFrame:
    """Two groups of subjects: clusters of months with |t| over 1, largest mass over families and months against 200 relabellings."""
    units = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("subject"), (F.col("s_nationkey") < 12).alias("label"))
    found = perm.label_clusters(_means(spark, folder), units, "subject", "label", ["family"], "time", "v", 1.0, REPS)
    return rounded(found, "mass", "p")


@query(f"""WITH {MEANS}, d AS (SELECT subject, family, time, v - avg(v) OVER (PARTITION BY subject, family) AS v FROM m),
s AS (SELECT rep, family, subject, CAST((time - 1 + CASE WHEN rep > 0 THEN 1 + floor({UNIT.format("'shift', rep, subject")} * 11) ELSE 0 END) % 12 + 1 AS INTEGER) AS time, v FROM d, range(0, 201) q(rep)),
t AS (SELECT rep, family, time, CASE WHEN stddev_samp(v) > 0 THEN avg(v) / (stddev_samp(v) / sqrt(count(v))) END AS t FROM s GROUP BY rep, family, time), {ISLANDS.format("1.0")}""")
def existence_cluster_test(spark: SparkSession, folder: str) -> DataFrame:
    """Months in which scores leave their subject's mean, against 200 shifts of each subject's months."""
    w = Window.partitionBy("subject", "family")
    centred = _means(spark, folder).withColumn("v", F.col("v") - F.avg("v").over(w))
    return rounded(perm.existence_clusters(centred, "subject", ["family"], "time", "v", 12, 1.0, REPS), "mass", "p")


@query(f"""WITH u AS (SELECT s_suppkey AS subject, s_nationkey % 4 AS label, s_acctbal AS x FROM supplier),
a AS (SELECT rep, subject, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep > 0 THEN {UNIT.format("'label', rep, subject")} ELSE 0 END, subject) AS k FROM u, range(0, 201) q(rep)),
l AS (SELECT row_number() OVER (ORDER BY subject) AS k, label FROM u),
g AS (SELECT rep, l.label, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM a JOIN l USING (k) JOIN u USING (subject) GROUP BY ALL),
f AS (SELECT rep, ((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))) AS f FROM g GROUP BY rep),
o AS (SELECT f AS o FROM f WHERE rep = 0)
SELECT round(o, 6) AS observed, round((1 + (SELECT count(*) FROM f WHERE rep > 0 AND abs(f) >= abs(o) - 1e-9)) / 201.0, 6) AS p FROM o""")
def omnibus_f_test(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("subject"), F.pmod("s_nationkey", F.lit(4)).alias("label"), F.col("s_acctbal").alias("x"))
    return rounded(perm.omnibus_f(u, "subject", "label", "x", REPS), "observed", "p")


ONE_SIDED = f"""{MEANS}, d AS (SELECT subject, family, time, v - avg(v) OVER (PARTITION BY subject, family) AS v FROM m),
s AS (SELECT rep, family, CAST((time - 1 + CASE WHEN rep > 0 THEN 1 + floor({UNIT.format("'shift', rep, subject")} * 11) ELSE 0 END) % 12 + 1 AS INTEGER) AS time, v FROM d, range(0, 201) q(rep)),
w AS (SELECT rep, family, avg(v) AS stat FROM s WHERE time BETWEEN 3 AND 8 GROUP BY rep, family), o AS (SELECT family, stat AS o FROM w WHERE rep = 0),
p1 AS (SELECT family, o AS observed, (1 + count(*) FILTER (WHERE rep > 0 AND stat >= o - 1e-9)) / 201.0 AS p FROM w JOIN o USING (family) GROUP BY family, o)"""


def _one_sided(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("subject", "family")
    centred = _means(spark, folder).withColumn("v", F.col("v") - F.avg("v").over(w))
    moved = perm.shifted_places(centred, "subject", "time", 12, REPS).where("time between 3 and 8")
    return perm.one_sided_p(moved.groupBy("rep", "family").agg(F.avg("v").alias("stat")), ["family"], "stat")


@query(f"WITH {ONE_SIDED} SELECT family, round(observed, 6) AS observed, round(p, 6) AS p FROM p1")
def one_sided_window_test(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the months 3 to 8 against shifts that are drawn for each subject by itself."""
    return rounded(_one_sided(spark, folder), "observed", "p")


@query(f"""WITH {ONE_SIDED}, h AS (SELECT *, row_number() OVER (ORDER BY p, family) AS k, count(*) OVER () AS n FROM p1),
j AS (SELECT family, observed, least(1, max((n - k + 1) * p) OVER (ORDER BY k)) AS p_holm FROM h),
e AS (SELECT family, count(DISTINCT subject) AS n FROM scores GROUP BY family)
SELECT family, round(p_holm, 6) AS p_holm, CASE WHEN p_holm < 0.05 AND n >= 50 AND observed > 0 THEN 'keep' WHEN p_holm < 0.05 OR n >= 50 THEN 'weak' ELSE 'drop' END AS decision FROM j JOIN e USING (family)""")
def decision_table(spark: SparkSession, folder: str) -> DataFrame:
    """Step-down p values and a gate on the number of subjects as one decision by family."""
    tests = agg.holm(_one_sided(spark, folder), "p", ["family"])
    size = scores(spark, folder).groupBy("family").agg(F.count_distinct("subject").alias("n"))
    return rounded(tests.join(size, "family").select("family", "p_holm", perm.decision(F.col("observed"), F.col("p_holm"), F.col("n") >= 50).alias("decision")), "p_holm")


@query(f"""WITH {SCORES}, g AS (SELECT subject, family, time, avg(score) AS v, count(*) AS n FROM scores GROUP BY ALL),
k AS (SELECT *, rank() OVER (PARTITION BY subject ORDER BY v) AS k FROM g), c AS (SELECT subject, corr(k, n) AS r FROM k GROUP BY subject)
SELECT round(avg(r), 6) AS mean_r, count(r) AS n FROM c WHERE NOT isnan(r)""")
def rank_metric_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Rank of a subject's cells against their number of trials, by subject and then over subjects."""
    cells = scores(spark, folder).groupBy("subject", "family", "time").agg(F.avg("score").alias("v"), F.count("*").alias("trials"))
    by = perm.rank_correlation(cells, "subject", "v", "trials").where("r is not null and not isnan(r)")
    return rounded(by.agg(F.avg("r").alias("mean_r"), F.count("r").alias("n")), "mean_r")


@query("""WITH u AS (SELECT s_suppkey AS subject, s_nationkey < 12 AS g, s_acctbal AS x FROM supplier), a AS (SELECT sum(x) FILTER (WHERE g) AS sa, count(*) FILTER (WHERE g) AS na, sum(x) FILTER (WHERE NOT g) AS sb, count(*) FILTER (WHERE NOT g) AS nb FROM u),
d AS (SELECT CASE WHEN g THEN (sa - x) / (na - 1) - sb / nb ELSE sa / na - (sb - x) / (nb - 1) END AS diff, sa / na - sb / nb AS whole FROM u, a)
SELECT round(min(diff), 6) AS low, round(max(diff), 6) AS high, round(avg((sign(diff) = sign(whole))::INT), 6) AS same_sign FROM d""")
def leave_one_out_stability(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("subject"), (F.col("s_nationkey") < 12).alias("g"), F.col("s_acctbal").alias("x"))
    whole = u.agg((F.avg(F.when(F.col("g"), F.col("x"))) - F.avg(F.when(~F.col("g"), F.col("x")))).alias("whole"))
    found = perm.leave_one_out(u, "subject", "g", "x").join(F.broadcast(whole))
    return rounded(found.agg(F.min("diff").alias("low"), F.max("diff").alias("high"), F.avg((F.signum("diff") == F.signum("whole")).cast("int")).alias("same_sign")), "low", "high", "same_sign")


HALF_SQL = """h AS (SELECT mask, list_filter(range(1, 9), lambda b: (mask >> (b - 1)::INT) & 1 = 1) AS blocks FROM range(0, 256) r(mask) WHERE bit_count(mask) = 4 AND mask & 1 = 1),
o AS (SELECT seed, blocks, row_number() OVER (PARTITION BY seed ORDER BY md5('half|events|' || seed || '|' || array_to_string(blocks, ',')), blocks) AS split FROM h, range(0, 400) s(seed)),
f AS (SELECT seed, split, CASE WHEN split % 2 = 1 THEN blocks ELSE list_filter(range(1, 9), lambda b: NOT list_contains(blocks, b)) END AS first FROM o WHERE split <= 20),
u AS (SELECT seed, b, count(*) FILTER (WHERE list_contains(first, b)) AS uses FROM f, range(1, 9) q(b) GROUP BY ALL),
z AS (SELECT min(seed) AS seed FROM (SELECT seed FROM u GROUP BY seed HAVING min(uses) >= 8 AND max(uses) <= 12)),
rows_ AS (SELECT split, b AS block, CASE WHEN list_contains(first, b) THEN 1 ELSE 2 END AS half FROM f JOIN z USING (seed), range(1, 9) q(b))"""


@query(f"""WITH {EV}, {HALF_SQL}, p AS (SELECT *, (SELECT count(*) FROM range(0, 8) e(b) WHERE round_even(b * n / 8.0, 0) < pos) AS block FROM ev)
SELECT CAST(split AS INTEGER) AS split, half, count(*) AS n, round(avg(value), 6) AS mean FROM p JOIN rows_ USING (block) GROUP BY ALL""")
def balanced_half_means(spark: SparkSession, folder: str) -> DataFrame:
    """20 balanced half-assignments of 8 blocks, applied to each user's events."""
    ev = events(spark, folder).withColumn("block", sequences.block_id(F.col("pos"), F.col("n"), 8))
    halves = perm.assignment_rows(spark, ["events"]).drop("section")
    return rounded(ev.join(F.broadcast(halves), "block").groupBy("split", "half").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


@query("""WITH m AS (SELECT l_suppkey AS split, l_linenumber AS block, avg(l_quantity) > 25 AS first FROM lineitem GROUP BY ALL),
k AS (SELECT split, coalesce(list_sort(list(block) FILTER (WHERE first)), []) AS a FROM m GROUP BY split), b AS (SELECT *, list_filter(range(1, 8), lambda x: NOT list_contains(a, x)) AS b FROM k)
SELECT split, least(array_to_string(a, ','), array_to_string(b, ',')) AS key FROM b""")
def split_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as splits of seven line numbers, those with a mean quantity over 25 as one half: a name for each, the same for its complement."""
    m = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("split"), F.col("l_linenumber").alias("block")).agg((F.avg("l_quantity") > 25).alias("first"))
    halves = m.groupBy("split").agg(F.array_sort(F.collect_list(F.when(F.col("first"), F.col("block").cast("int")))).alias("a"))
    return halves.select("split", perm.split_key(F.col("a"), F.sequence(F.lit(1), F.lit(7))).alias("key"))


@query(f"""WITH {EV}, u AS (SELECT user_id, max(n) AS n FROM ev GROUP BY user_id) SELECT user_id, CAST(greatest(0, n - 2 * 20 + 1) AS BIGINT) AS shifts, CASE WHEN n >= 40 THEN 20 END AS first, CASE WHEN n >= 40 THEN CAST(n - 20 AS INTEGER) END AS last FROM u""")
def allowed_shift_range(spark: SparkSession, folder: str) -> DataFrame:
    """Circular shifts of a user's events that stay 20 places from 0 either way."""
    u = events(spark, folder).groupBy("user_id").agg(F.max("n").alias("n"))
    allowed = u.withColumn("s", perm.allowed_shifts(F.col("n"), 20))
    return allowed.select("user_id", F.size("s").cast("long").alias("shifts"), F.array_min("s").alias("first"), F.array_max("s").alias("last"))
