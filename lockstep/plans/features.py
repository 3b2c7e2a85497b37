"""Queries on the columns of designs, on screens, and on waves by tertile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decoding as dec
from ..operators import features as fe
from ..operators import joins
from ..operators import summaries as agg
from ..sources import tables
from ..sources.tables import table
from .decoding import CHANCES, ROLES, _chances
from .registry import SCORES, query, rounded, scores

LONG = "l AS (SELECT vec_id, label, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _long(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double"))


@query(f"""WITH {LONG} SELECT CASE WHEN k < 8 THEN 'a' WHEN k < 24 THEN 'b' ELSE 'nuisance' END AS family, CAST(CASE WHEN k < 8 THEN k WHEN k < 24 THEN k - 8 ELSE k - 24 END AS INTEGER) AS place, count(*) AS n, round(avg(x), 6) AS mean FROM l GROUP BY 1, 2""")
def column_families(spark: SparkSession, folder: str) -> DataFrame:
    """Places of the embeddings as columns of two families and what comes behind them."""
    family, place = fe.family_of(F.col("k"), {"a": 8, "b": 16})
    return rounded(_long(spark, folder).groupBy(family.alias("family"), place.alias("place")).agg(F.count("*").alias("n"), F.avg("x").alias("mean")), "mean")


@query(f"""WITH {LONG}, s AS (SELECT * FROM (VALUES ('level', 0), ('level', 1), ('level', 2), ('dynamic', 2), ('dynamic', 5), ('all', 0), ('all', 1), ('all', 2), ('all', 5)) q(subset, k))
SELECT vec_id, subset, round(sum(x), 6) AS total, count(x) AS n FROM l JOIN s USING (k) GROUP BY vec_id, subset""")
def column_subset_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Sums over sets of places that share some, for every vector."""
    sets = {"level": [0, 1, 2], "dynamic": [2, 5], "all": [0, 1, 2, 5]}
    subsets = spark.createDataFrame([(s, k) for s, ks in sets.items() for k in ks], "subset string, column int")
    return rounded(fe.subset_sums(_long(spark, folder), ["vec_id"], "k", "x", subsets), "total")


@query("""WITH m AS (SELECT year(l_shipdate) AS rep, month(l_shipdate) AS time, l_linenumber AS k, l_returnflag AS family, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), w AS (SELECT * FROM m WHERE time BETWEEN 4 AND 9)
SELECT rep, family, CAST(k AS INTEGER) AS "column", round(avg(v), 6) AS mean FROM w GROUP BY ALL UNION ALL SELECT rep, family, 0, round(avg(t), 6) FROM (SELECT rep, family, time, sum(v) AS t FROM w GROUP BY ALL) GROUP BY ALL""")
def confirm_window_means(spark: SparkSession, folder: str) -> DataFrame:
    """Years as repetitions, line numbers as columns of a return flag: means over the months 4 to 9 of each column, and of the flag's trace."""
    li = table(spark, folder, "lineitem")
    m = li.groupBy(F.year("l_shipdate").alias("rep"), F.month("l_shipdate").alias("time"), F.col("l_linenumber").alias("k"), "l_returnflag").agg(F.avg("l_quantity").alias("v"))
    return rounded(fe.window_means(m, ["rep"], "time", "k", "l_returnflag", "v", 4, 9), "mean")


@query(f"""WITH {LONG} SELECT k, count(x) AS n, round(coalesce(stddev_samp(v), 0), 6) AS sd, bool_and(abs(v * (v - 1)) < 1e-8) AS binary, k <> 3 AND coalesce(stddev_samp(v), 0) >= 1e-8 AND (NOT bool_and(abs(v * (v - 1)) < 1e-8) OR count(*) FILTER (WHERE v > 0.5) >= 10) AS kept
FROM (SELECT *, CASE k % 3 WHEN 0 THEN x WHEN 1 THEN (x > 0.25)::INT ELSE (x > 2)::INT END::DOUBLE AS v FROM l) GROUP BY k""")
def kept_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Which places of the embeddings a design keeps, a third as they are, a third as a rare flag, a third as one that never holds; place 3 is ruled out."""
    x = F.when(F.col("k") % 3 == 0, F.col("x")).when(F.col("k") % 3 == 1, (F.col("x") > 0.25).cast("double")).otherwise((F.col("x") > 2).cast("double"))
    return rounded(fe.kept_columns(_long(spark, folder).withColumn("x", x), "k", "x", [3]), "sd")


@query("""WITH c AS (SELECT p_brand AS b FROM part GROUP BY p_brand HAVING count(*) >= (SELECT count(*) / 25 FROM part)), m AS (SELECT CASE WHEN p_brand IN (SELECT b FROM c) THEN p_brand ELSE 'other' END AS p_brand, p_retailprice FROM part),
t AS (SELECT p_brand AS top FROM m GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1)
SELECT CASE WHEN p_brand <> top THEN p_brand END AS coded, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM m, t GROUP BY 1""")
def reference_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Brands as levels of a full-rank design: the rare ones merged, the most frequent one left out."""
    part = table(spark, folder, "part").select("p_brand", "p_retailprice")
    found = fe.reference_levels(part, "p_brand", -(-part.count() // 25))
    return rounded(found.groupBy("coded").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("mean")), "mean")


@query(f"""WITH {CHANCES} SELECT id, round((p0 - p1) / sqrt(2), 6) AS e1, round((p0 + p1 - 2 * p2) / sqrt(6), 6) AS e2,
round(((y = 0)::INT - p0 - (y = 1)::INT + p1) / sqrt(2), 6) AS r1, round(((y = 0)::INT - p0 + (y = 1)::INT - p1 - 2 * ((y = 2)::INT - p2)) / sqrt(6), 6) AS r2 FROM ps WHERE y IS NOT NULL""")
def class_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The roles' chances, and what they miss, on contrasts of the roles."""
    found = fe.evidence(_chances(spark, folder), "role", ROLES, "probability").where("evidence is not null")
    return rounded(found.select("id", *[F.col(c)[k].alias(f"{c[0]}{k + 1}") for c in ("evidence", "residual") for k in (0, 1)]), "e1", "e2", "r1", "r2")


@query(f"""WITH {CHANCES}, s AS (SELECT p.*, t.step FROM ps p JOIN t USING (id) WHERE y IS NOT NULL), top AS (SELECT step FROM s GROUP BY step ORDER BY count(*) DESC, step LIMIT 1),
k AS (SELECT y, CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p FROM s WHERE step NOT IN (SELECT step FROM top)), g AS (SELECT y, count(*) / (SELECT count(*) FROM k)::DOUBLE AS q FROM k GROUP BY y)
SELECT count(*) AS n, round(avg(-ln(p)), 6) AS log_loss, (SELECT round(sum(-q * ln(q)), 6) FROM g) AS log_loss_prior FROM k""")
def scores_without_largest(spark: SparkSession, folder: str) -> DataFrame:
    """The log loss of the roles' chances without the length step that most turns have."""
    rows = fe.without_largest(_chances(spark, folder), "step")
    return rounded(dec.class_scores(rows, [], "role", ROLES, "probability").select("n", "log_loss", "log_loss_prior"), "log_loss", "log_loss_prior")


SYLLABLES = ["zhang1", "nü3", "a4", "shi", "lu:e4", "zh2", "ER2", "xiong2"]


@query(f"""WITH p AS (SELECT p_partkey, {SYLLABLES}[1 + p_partkey % {len(SYLLABLES)}] AS syllable FROM part), t AS (SELECT *, replace(replace(lower(syllable), 'u:', 'v'), 'ü', 'v') AS t FROM p),
b AS (SELECT *, regexp_replace(t, '[1-5]$', '') AS body FROM t), i AS (SELECT *, regexp_extract(body, '^(zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw]).', 1) AS one, regexp_extract(body, '^([zcs])h$', 1) AS two FROM b)
SELECT p_partkey, CASE WHEN two <> '' THEN two ELSE one END AS initial, substr(body, 1 + length(CASE WHEN two <> '' THEN two ELSE one END)) AS final, TRY_CAST(nullif(regexp_extract(t, '([1-5])$', 1), '') AS INTEGER) AS tone FROM i""")
def syllable_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Initials, finals and tones of syllables, one for every part."""
    syllable = F.get(F.array(*[F.lit(s) for s in SYLLABLES]), F.pmod("p_partkey", F.lit(len(SYLLABLES))).cast("int"))
    initial, final, tone = fe.syllable_parts(syllable)
    return table(spark, folder, "part").select("p_partkey", initial.alias("initial"), final.alias("final"), tone.alias("tone"))


@query("""WITH b AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE value * 50 END AS a, CASE WHEN event_id % 2 = 0 THEN value + 0.5 ELSE (value + 0.5) * 50 END AS z FROM events WHERE event_id % 11 = 0),
n AS (SELECT user_id, event_id, CASE WHEN greatest(abs(a), abs(z)) > 400 THEN 50.0 ELSE 1.0 END AS r, a, z FROM b), s AS (SELECT user_id, least(a, z) / r AS lo, greatest(a, z) / r AS hi FROM n)
SELECT e.user_id, e.event_id, EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND e.value < hi AND e.value + 1 > lo) AS bad FROM events e""")
def flags_of_mixed_units(spark: SparkSession, folder: str) -> DataFrame:
    """Values as starts of intervals of 1 s, against bad ones that are given in seconds or in samples at 50 Hz of a recording of 10,000."""
    e = table(spark, folder, "events").select("user_id", "event_id", F.col("value").alias("start"), (F.col("value") + 1).alias("end"))
    raw = e.where("event_id % 11 = 0")
    unit = F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(50.0)
    low, high = fe.in_seconds(F.col("start") * unit, (F.col("start") + 0.5) * unit, 50.0, F.lit(10000))
    bad = raw.select("user_id", low.alias("bad_start"), high.alias("bad_end"))
    return joins.overlaps_any(e, bad, ["user_id"], "event_id", 5.0).select("user_id", "event_id", "bad")


@query(f"""WITH {SCORES}, m AS (SELECT subject, family, avg(score) - (SELECT avg(score) FROM scores) AS gap FROM scores GROUP BY ALL)
SELECT subject, family, round(gap, 6) AS gap, row_number() OVER (ORDER BY abs(gap) DESC, subject, family) AS rank FROM m QUALIFY rank <= 12""")
def largest_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve cells of subject and family farthest from the mean of all scores, either way."""
    s = scores(spark, folder)
    whole = s.agg(F.avg("score").alias("_m"))
    m = s.groupBy("subject", "family").agg(F.avg("score").alias("v")).join(F.broadcast(whole)).select("subject", "family", (F.col("v") - F.col("_m")).alias("gap"))
    return rounded(fe.most_extreme(m, "gap", 12, "subject", "family"), "gap")


@query("""WITH k AS (SELECT l_suppkey AS subject, avg((l_linestatus = 'F')::INT) AS share FROM lineitem GROUP BY 1)
SELECT s_nationkey < 12 AS label, round(avg(share), 6) AS mean, round(median(share), 6) AS median, count(*) AS n FROM k JOIN supplier ON s_suppkey = subject GROUP BY 1""")
def kept_share_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """The share of valid rows of each subject: mean, median and number by group."""
    share = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("subject")).agg(F.avg((F.col("l_linestatus") == "F").cast("int")).alias("share"))
    units = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("subject"), (F.col("s_nationkey") < 12).alias("label"))
    return rounded(share.join(units, "subject").groupBy("label").agg(F.avg("share").alias("mean"), F.median("share").alias("median"), F.count("*").alias("n")), "mean", "median")


@query(f"""WITH {LONG}, c AS (SELECT vec_id, k // 8 AS channel, x, (x - avg(x) OVER (PARTITION BY k // 8)) / stddev_samp(x) OVER (PARTITION BY k // 8) AS z FROM l),
g AS (SELECT vec_id, channel, max(x) - min(x) AS pp, max(abs(z)) AS z, var_samp(x) AS v FROM c GROUP BY ALL)
SELECT vec_id, round(max(pp), 6) AS peak_to_peak, round(max(z), 6) AS largest_z, round(avg(v), 6) AS mean_variance FROM g GROUP BY vec_id""")
def epoch_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as epochs of channels of eight samples: the largest peak to peak and the largest z over channels, the channels' mean variance."""
    long = _long(spark, folder).withColumn("channel", F.floor(F.col("k") / 8))
    return rounded(agg.epoch_quality(long, ["vec_id"], "channel", "x"), "peak_to_peak", "largest_z", "mean_variance")


@query("""WITH q AS (SELECT quantile_cont(p_retailprice, 1/3) AS q1, quantile_cont(p_retailprice, 2/3) AS q2 FROM part),
t AS (SELECT p_partkey, CASE WHEN p_retailprice <= q1 THEN 'low' WHEN p_retailprice <= q2 THEN 'mid' ELSE 'high' END AS tertile FROM part, q),
w AS (SELECT l_suppkey, tertile, month(l_shipdate) AS time, avg(l_quantity) AS v FROM lineitem JOIN t ON l_partkey = p_partkey GROUP BY ALL)
SELECT tertile, time, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, count(v) AS n FROM w GROUP BY tertile, time""")
def tertile_waves(spark: SparkSession, folder: str) -> DataFrame:
    """Each subject's monthly mean by tertile of the item's price, then the subjects' mean and its error."""
    part = table(spark, folder, "part")
    price = F.col("p_retailprice")
    tertile = F.when(price <= F.col("q1"), "low").when(price <= F.col("q2"), "mid").otherwise("high")
    items = part.join(agg.tertile_edges(part, "p_retailprice")).select(F.col("p_partkey").alias("l_partkey"), tertile.alias("tertile"))
    rows = table(spark, folder, "lineitem").join(items, "l_partkey").withColumn("time", F.month("l_shipdate"))
    return rounded(agg.subject_waves(rows, "l_suppkey", ["tertile", "time"], "l_quantity"), "mean", "sem")


@query("""SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey NOT IN (3, 5, 7) GROUP BY 1""")
def excluded_nations(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers by nation without the nations of a list that names one twice."""
    kept = tables.excluding(table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey", "3, 5;7 3")
    return table(spark, folder, "supplier").join(kept, "s_nationkey", "left_semi").groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand, p_size AS size FROM part WHERE p_partkey % 5 <> 0)
SELECT p.p_partkey, coalesce(e.brand, p.p_brand) AS brand, coalesce(e.size, p.p_size) AS size FROM part p LEFT JOIN e USING (p_partkey)""")
def backfilled_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries that lack some parts and some brands, with what the parts themselves say."""
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    entries = part.where("p_partkey % 5 <> 0").withColumn("brand", F.when(F.col("p_partkey") % 3 != 0, F.col("brand")))
    return tables.backfilled(entries, part, ["p_partkey"])
