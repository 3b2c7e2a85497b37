"""Queries on participants' tables and gates, contracts, tones and templates, envelopes and rates, bases, and the stability of tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.distributions import t_quantile
from ..operators import assembly, basis, models, sequences, signals, weights
from ..operators import permutation as perm
from ..sources import tables
from ..sources.tables import table
from .registry import EV, SCORES, events, query, rounded, scores
from .stats import OOF_SQL, UNIT

# Rates and envelopes

BAND, QUARTER = signals.bandpass_taps(1.0, 0.05, 0.2, 24), signals.quadrature_taps(1.0, 0.05, 0.2, 24)
TAPS_SQL = ", ".join(f"({j}, {float(a)!r}, {float(b)!r})" for j, (a, b) in enumerate(zip(BAND, QUARTER, strict=True), -24))


@query(f"""WITH {EV}, taps AS (SELECT * FROM (VALUES {TAPS_SQL}) q(j, a, b)), p AS (SELECT user_id, pos - 1 AS at_, n, value FROM ev),
c AS (SELECT user_id, at_ AS to_, value FROM p UNION ALL SELECT user_id, -1 - at_, value FROM p UNION ALL SELECT user_id, 2 * n - 1 - at_, value FROM p)
SELECT p.user_id, p.at_ + 1 AS pos, round(ln(1 + sqrt(power(sum(coalesce(c.value, 0) * a), 2) + power(sum(coalesce(c.value, 0) * b), 2))), 6) AS envelope
FROM p JOIN taps ON true JOIN c ON c.user_id = p.user_id AND c.to_ = p.at_ - j GROUP BY p.user_id, p.at_""")
def envelope_events(spark: SparkSession, folder: str) -> DataFrame:
    """How large the slow waves of each user's values are, over the order of the events, compressed."""
    return rounded(signals.envelope(events(spark, folder), ["user_id"], "pos", "value", BAND, QUARTER, compress=True), "envelope")


RATE = signals.resample_taps(2, 3, 4)
RATE_SQL = ", ".join(f"({j}, {float(h)!r})" for j, h in enumerate(RATE, -(len(RATE) // 2)))


@query(f"""WITH {EV}, taps AS (SELECT * FROM (VALUES {RATE_SQL}) q(j, h)), p AS (SELECT user_id, pos - 1 AS at_, n, value FROM ev),
k AS (SELECT user_id, unnest(range(0, CAST(ceil(max(n) * 2 / 3.0) AS BIGINT))) AS place FROM p GROUP BY user_id)
SELECT k.user_id, place, round(sum(coalesce(value * h, 0)), 6) AS resampled FROM k JOIN p ON p.user_id = k.user_id AND abs(place * 3 - at_ * 2) <= {len(RATE) // 2} JOIN taps ON j = place * 3 - at_ * 2 GROUP BY ALL""")
def resampled_events(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's values at two thirds of their rate."""
    return rounded(signals.resampled(events(spark, folder), ["user_id"], "pos", "value", 2, 3, RATE), "resampled")


# Tones and templates


@query("""WITH p AS (SELECT p_partkey, ['a', 'aj', 'o', 'tʰ', 'sil', 'ə'][1 + p_partkey % 6] || ['˥', '˧˥', '˨˩˦', '˥˩', '1', '', '˧', '˩'][1 + p_size % 8] AS label FROM part),
t AS (SELECT p_partkey, label, CASE WHEN lower(label) = 'sil' THEN NULL WHEN regexp_matches(label, '[1-5]$') THEN label[-1:] WHEN label LIKE '%˨˩˦' THEN '3' WHEN label LIKE '%˧˥' THEN '2'
    WHEN label LIKE '%˥˩' THEN '4' WHEN label LIKE '%˥' THEN '1' WHEN label LIKE '%˧' THEN '5' WHEN label LIKE '%˩' THEN '3' END AS tone FROM p)
SELECT p_partkey, label, CASE WHEN lower(label) = 'sil' THEN 'sil' ELSE regexp_replace(label, '([1-5]|˨˩˦|˧˥|˥˩|˥|˧|˩)$', '') END AS phone, CAST(tone AS INTEGER) AS tone FROM t""")
def phone_tones(spark: SparkSession, folder: str) -> DataFrame:
    """Phones and tones from labels that end in a digit or a contour, for every part."""
    pick = lambda items, k: F.get(F.array(*[F.lit(i) for i in items]), k)
    label = F.concat(pick(["a", "aj", "o", "tʰ", "sil", "ə"], F.pmod("p_partkey", F.lit(6)).cast("int")), pick(["˥", "˧˥", "˨˩˦", "˥˩", "1", "", "˧", "˩"], F.pmod("p_size", F.lit(8)).cast("int")))
    parts = table(spark, folder, "part").select("p_partkey", label.alias("label"))
    phone, tone = sc.phone_and_tone(F.col("label"))
    return parts.select("p_partkey", "label", phone.alias("phone"), tone.alias("tone"))


@query("""WITH e AS (SELECT vec_id, label, embedding[:8] AS v FROM embeddings WHERE len(embedding) >= 8),
m AS (SELECT label, list(a ORDER BY k) AS t FROM (SELECT label, k, avg(v[k]::DOUBLE) AS a FROM e, range(1, 9) q(k) WHERE label IS NOT NULL GROUP BY label, k) GROUP BY label),
d AS (SELECT vec_id, m.label, sqrt(list_sum(list_transform(range(1, 9), lambda k: (v[k]::DOUBLE - t[k]) * (v[k]::DOUBLE - t[k]))) / 8) AS d FROM e, m)
SELECT vec_id, arg_min(label, d) AS nearest, round(min(d), 6) AS distance FROM d GROUP BY vec_id""")
def nearest_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The label whose mean shape over the first eight places is nearest, for every vector."""
    e = table(spark, folder, "embeddings").where("size(embedding) >= 8").select("vec_id", "label", F.slice("embedding", 1, 8).cast("array<double>").alias("v"))
    shapes = e.where("label is not null").groupBy("label").agg(F.array(*[F.avg(F.col("v")[k]) for k in range(8)]).alias("t"))
    return rounded(signals.nearest_template(e, "v", shapes, "label", "t").select("vec_id", "nearest", "distance"), "distance")


@query("""WITH p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k, l_quantity AS d, ['j', 'a', 'n', 'ow', 't', 's'][1 + l_partkey % 6] AS phone FROM lineitem),
t AS (SELECT *, sum(d) OVER w - d AS on_, sum(d) OVER (PARTITION BY l_orderkey) AS offset_ FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY k)),
f AS (SELECT l_orderkey, arg_min(on_, k) AS start, arg_min(phone, k) AS nucleus, max(offset_) AS end_ FROM t WHERE phone IN ('a', 'ow') GROUP BY l_orderkey)
SELECT o.l_orderkey, round(start, 6) AS start, CASE WHEN start IS NOT NULL THEN round(end_, 6) END AS "end", nucleus FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN f USING (l_orderkey)""")
def rime_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as syllables whose phones last as long as their lines' quantities: from the first vowel to the end."""
    names = F.array(*[F.lit(p) for p in ("j", "a", "n", "ow", "t", "s")])
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("d"), F.get(names, F.pmod("l_partkey", F.lit(6)).cast("int")).alias("phone"))
    by = sequences.ordered(["l_orderkey"], ["l_linenumber", "l_partkey", "d"])
    timed = li.withColumn("k", F.row_number().over(by)).withColumn("off", F.sum("d").over(sequences.ordered(["l_orderkey"], ["k"]))).withColumn("on", F.col("off") - F.col("d"))
    syllables = timed.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", "on", "off", "phone"))).alias("p"), F.max("off").alias("end"))
    found = syllables.select("l_orderkey", signals.rime_window(F.col("p"), F.lit(0.0), F.col("end"), ["a", "ow"]).alias("w"))
    return rounded(found.select("l_orderkey", "w.start", "w.end", "w.nucleus"), "start", "end")


@query("""WITH e AS (SELECT vec_id, label, embedding AS v, row_number() OVER w AS k FROM embeddings WHERE label IS NOT NULL WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS j FROM e WHERE vec_id % 3 <> 0),
b AS (SELECT e.vec_id, e.label, e.v, (SELECT count(*) FROM c WHERE c.label = e.label AND c.k < e.k) AS before FROM e)
SELECT b.vec_id, round(avg(list_cosine_similarity(list_transform(b.v, lambda x: x::DOUBLE), list_transform(c.v, lambda x: x::DOUBLE))), 6) AS cosine FROM b LEFT JOIN c ON c.label = b.label AND c.j > b.before - 3 AND c.j <= b.before GROUP BY b.vec_id""")
def earlier_cosines(spark: SparkSession, folder: str) -> DataFrame:
    """The mean cosine of each vector to up to three earlier ones of its label, passing over ids divisible by 3."""
    e = table(spark, folder, "embeddings").where("label is not null").select("vec_id", "label", "embedding")
    return rounded(sequences.earlier_cosine(e, ["label"], ["vec_id"], "embedding", F.col("vec_id") % 3 != 0).select("vec_id", "cosine"), "cosine")


# Contracts, tables and gates


@query("""WITH e AS (SELECT embedding AS v FROM embeddings) SELECT 'embedding' AS "column", count(*) AS n, count(*) FILTER (WHERE v IS NULL OR len(v) <> 64) AS wrong_width,
count(*) FILTER (WHERE len(v) > 0 AND len(list_filter(v, lambda x: x <> 0)) = 0) AS only_zeros, count(*) FILTER (WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS not_finite FROM e""")
def width_contract(spark: SparkSession, folder: str) -> DataFrame:
    """How many vectors aren't 64 wide, hold zeros alone, or a value that is null or not finite."""
    return tables.width_report(table(spark, folder, "embeddings"), {"embedding": 64})


@query("""WITH o AS (SELECT o_custkey, count(*) AS n_orders, round(avg(o_totalprice), 6) AS mean_price FROM orders GROUP BY 1),
p AS (SELECT o_custkey, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 6) AS price_urgent, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 6) AS price_low FROM orders GROUP BY 1)
SELECT c_custkey AS participant, c_mktsegment AS "group", c_acctbal AS balance, n_orders, mean_price, price_urgent, price_low, n_orders IS NULL AS no_orders FROM customer
LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN p ON p.o_custkey = c_custkey""")
def subject_table(spark: SparkSession, folder: str) -> DataFrame:
    """One wide row for each customer: what it is, its orders, and its prices by priority as columns."""
    base = table(spark, folder, "customer").select(F.col("c_custkey").alias("participant"), F.col("c_mktsegment").alias("group"), F.col("c_acctbal").alias("balance"))
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "participant")
    mean = orders.groupBy("participant").agg(F.count("*").alias("n_orders"), F.round(F.avg("o_totalprice"), 6).alias("mean_price"))
    long = orders.select("participant", F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "5-LOW", "low").alias("name"), F.col("o_totalprice").alias("x"))
    wide = rounded(assembly.spread(long, "participant", "name", "x", ["urgent", "low"], "price_"), "price_urgent", "price_low")
    return assembly.participant_table(base, "participant", [mean, wide]).withColumn("no_orders", F.col("n_orders").isNull())


METRIC_SQL = f"""WITH {SCORES}, u AS (SELECT s_suppkey AS subject, s_nationkey < 12 AS label FROM supplier),
m AS (SELECT subject, family, unnest(['mean', 'top']) AS metric, unnest([avg(score), max(score)]) AS x FROM scores GROUP BY subject, family),
a AS (SELECT rep, subject, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep > 0 THEN {UNIT.format("'label', rep, subject")} ELSE 0 END, subject) AS k FROM u, range(0, 201) r(rep)),
l AS (SELECT row_number() OVER (ORDER BY subject) AS k, label FROM u),
s AS (SELECT rep, family, metric, avg(x) FILTER (WHERE label) AS mean_a, avg(x) FILTER (WHERE NOT label) AS mean_b, count(x) FILTER (WHERE label) AS n_a, count(x) FILTER (WHERE NOT label) AS n_b,
    var_samp(x) FILTER (WHERE label) AS va, var_samp(x) FILTER (WHERE NOT label) AS vb FROM a JOIN l USING (k) JOIN m USING (subject) GROUP BY ALL),
o AS (SELECT * FROM s WHERE rep = 0), p AS (SELECT o.family, o.metric, count(*) FILTER (WHERE s.rep > 0 AND abs(s.mean_a - s.mean_b) >= abs(o.mean_a - o.mean_b) - 1e-9) AS hits FROM s JOIN o USING (family, metric) GROUP BY ALL)
SELECT family, metric, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
    CASE WHEN (n_a - 1) * va + (n_b - 1) * vb > 0 THEN round((1 - 3.0 / (4 * (n_a + n_b) - 9)) * (mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) END AS g, round((hits + 1) / 201.0, 6) AS p FROM o JOIN p USING (family, metric)"""


@query(METRIC_SQL)
def metric_contrasts(spark: SparkSession, folder: str) -> DataFrame:
    """Two groups of subjects compared on two measures of each family: means, effect size, and p over 200 relabellings."""
    m = scores(spark, folder).groupBy("subject", "family").agg(F.avg("score").alias("mean"), F.max("score").cast("double").alias("top")).unpivot(["subject", "family"], ["mean", "top"], "metric", "x")
    units = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("subject"), (F.col("s_nationkey") < 12).alias("label"))
    return rounded(assembly.metric_contrasts(m, units, "subject", "label", ["family", "metric"], "x", 200), "mean_a", "mean_b", "g", "p")


@query(f"""WITH {SCORES}, m AS (SELECT subject, time, avg(score) AS v, count(*) AS n FROM scores GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY time) - row_number() OVER (PARTITION BY subject, v > 25 ORDER BY time) AS isl FROM m),
r AS (SELECT subject, max(k) AS longest FROM (SELECT subject, isl, count(*) AS k FROM i WHERE v > 25 GROUP BY subject, isl) GROUP BY subject),
g AS (SELECT subject, count(*) AS times, min(n) AS least FROM m GROUP BY subject)
SELECT subject, coalesce(longest, 0) AS longest, times = 12 AS complete, least >= 2 AS enough, CASE WHEN times = 12 AND least >= 2 AND coalesce(longest, 0) >= 5 THEN 'PASS' ELSE 'STOP' END AS verdict FROM g LEFT JOIN r USING (subject)""")
def pilot_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects that go on: every month there, two scores in each, and five months in a row with a mean over 25."""
    m = scores(spark, folder).groupBy("subject", "time").agg(F.avg("score").alias("v"), F.count("*").alias("n"))
    gates = {"complete": F.count("*") == 12, "enough": F.min("n") >= 2}
    return assembly.gated(m, ["subject"], ["time"], F.col("v") > 25, 5, gates)


GAIN_SQL = OOF_SQL[: OOF_SQL.index("p AS (SELECT r.fold")].rstrip().rstrip(",")


@query(f"""{GAIN_SQL}, b AS (SELECT *, (ay / (n + 1)) AS w1 FROM t),
p AS (SELECT r.fold, y, w.my + wa * (a - w.ma) / w.sa + wb * (b - w.mb) / w.sb AS whole, w.my + w1 * (a - w.ma) / w.sa AS part FROM r JOIN w USING (fold) JOIN b USING (fold))
SELECT fold, count(*) AS n, round(avg((y - whole) * (y - whole)), 6) AS error, round(avg((y - part) * (y - part)), 6) AS error_part, round(1 - sum((y - whole) * (y - whole)) / sum((y - part) * (y - part)), 6) AS gain FROM p GROUP BY fold""")
def model_gain(spark: SparkSession, folder: str) -> DataFrame:
    """Prices predicted out of fold from quantity and discount, and from quantity alone: errors by fold, and what discount gains."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_discount", (F.col("l_extendedprice") / 10000).alias("y"))
    found = models.compared_ridges(rows, "l_orderkey", ["l_quantity", "l_discount"], ["l_quantity"], "y")
    a, b = F.pow(F.col("y") - F.col("predicted"), F.lit(2)), F.pow(F.col("y") - F.col("predicted_part"), F.lit(2))
    return rounded(found.groupBy("fold").agg(F.count("*").alias("n"), F.avg(a).alias("error"), F.avg(b).alias("error_part"), (1 - F.sum(a) / F.sum(b)).alias("gain")), "error", "error_part", "gain")


# Bases


def _words(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as words of a section for each label, their ids as onsets, in three families of eight places."""
    e = table(spark, folder, "embeddings").where("label is not null and size(embedding) >= 24")
    return e.select("vec_id", F.col("label").alias("section"), F.col("vec_id").cast("double").alias("onset"), *[F.slice("embedding", 8 * k + 1, 8).cast("array<double>").alias(n) for k, n in enumerate("abc")])


@query("""WITH e AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) >= 24)
SELECT vec_id, CAST(k AS INTEGER) AS place, round(v[k]::DOUBLE - avg(v[k]::DOUBLE) OVER (PARTITION BY label, k), 6) AS residual FROM e, range(1, 25) q(k)""")
def section_residuals(spark: SparkSession, folder: str) -> DataFrame:
    """Three families less what a drift of one constant explains within the section: their sections' means."""
    found = basis.drift_residuals(_words(spark, folder), "section", "onset", {n: n for n in "abc"}, 1)
    return found.select("vec_id", F.posexplode("residual").alias("place", "residual")).select("vec_id", (F.col("place") + 1).alias("place"), F.round("residual", 6).alias("residual"))


@query()
def ordered_basis(spark: SparkSession, folder: str) -> DataFrame:
    """Components of three families, each freed of those before it, behind a drift of 40 bumps: their eigenvalues, and the words' mean squares on them."""
    words, families = _words(spark, folder), {n: n for n in "abc"}
    model = basis.fit_basis(words, "section", "onset", families, 3)
    z = basis.put_through(basis.drift_residuals(words, "section", "onset", families), "residual", model)
    square = z.select(F.posexplode("z").alias("at", "v")).groupBy("at").agg(F.avg(F.col("v") * F.col("v")).alias("mean_square"))
    return rounded(model.select("family", "component", "eigenvalue", (F.col("family_no") * 3 + F.col("component")).alias("at")).join(square, "at").drop("at"), "eigenvalue", "mean_square")


@query("""WITH c AS (SELECT corr(a, y) AS ra, corr(b, y) AS rb, corr(a, b) AS ab FROM (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE + embedding[1]::DOUBLE AS y FROM embeddings WHERE len(embedding) >= 3))
SELECT 0 AS place, round(sqrt((ra * ra + rb * rb - 2 * ra * rb * ab) / (1 - ab * ab)), 6) AS r FROM c""")
def canonical_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical correlation of two places of the embeddings with a mixture of places."""
    e = table(spark, folder, "embeddings").where("size(embedding) >= 3").select(F.slice("embedding", 1, 2).cast("array<double>").alias("a"), F.array((F.col("embedding")[2].cast("double") + F.col("embedding")[0].cast("double"))).alias("b"))
    found = basis.canonical_correlations(e, "a", "b")
    return spark.createDataFrame([(k, round(float(r), 6)) for k, r in enumerate(found)], "place int, r double")


@query("""WITH c AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab FROM (SELECT l_quantity AS a, l_extendedprice / 1000 AS b FROM lineitem)),
l AS (SELECT unnest([(aa + bb + sqrt(power(aa - bb, 2) + 4 * ab * ab)) / 2, (aa + bb - sqrt(power(aa - bb, 2) + 4 * ab * ab)) / 2]) AS power, unnest([0, 1]) AS component FROM c) SELECT component, round(power, 5) AS power FROM l""")
def sketched_components(spark: SparkSession, folder: str) -> DataFrame:
    """Variances of quantity and price on their components, found by a sketch."""
    li = table(spark, folder, "lineitem").select(F.array("l_quantity", F.col("l_extendedprice") / 1000).alias("x"))
    _, _, power = basis.sketched_components(li, "x", 2)
    return spark.createDataFrame([(k, round(float(p), 5)) for k, p in enumerate(np.asarray(power))], "component int, power double")


# Stability of tests


def _nations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nations as units in two groups, and their mean scores by family and month."""
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("subject"), F.col("s_nationkey").alias("nation"))
    means = scores(spark, folder).join(suppliers, "subject").groupBy("nation", "family", "time").agg(F.avg("score").alias("v"))
    return means, table(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") < 12).alias("label"))


@query()
def cluster_stability(spark: SparkSession, folder: str) -> DataFrame:
    """The cluster test of two groups of nations over 40 draws of nations with replacement, 100 relabellings in each: how p and mass spread."""
    means, units = _nations(spark, folder)
    threshold = t_quantile(0.975, units.count() - 2)
    found = weights.nested_cluster_p(means, "nation", ["family"], "time", "v", weights.bootstrap_counts(units, "nation", "label", 40, 100), 40, 100, threshold)
    q = found.where("draw > 0").agg(F.expr("percentile(p, array(0.025, 0.5, 0.975))").alias("p"), F.avg((F.col("p") < 0.05).cast("int")).alias("share_05"), F.median("mass").alias("median_mass"))
    whole = found.where("draw = 0").select(F.col("p").alias("p_whole"), F.col("mass").alias("mass_whole"))
    return rounded(q.select(F.col("p")[0].alias("p_low"), F.col("p")[1].alias("p_median"), F.col("p")[2].alias("p_high"), "share_05", "median_mass").join(F.broadcast(whole)), "p_low", "p_median", "p_high", "share_05", "median_mass", "p_whole", "mass_whole")


@query()
def cluster_leave_one_out(spark: SparkSession, folder: str) -> DataFrame:
    """The same test without each nation: mass and p, and how far p moves."""
    means, units = _nations(spark, folder)
    counts, out = weights.left_out_counts(units, "nation", "label", 100)
    n = units.count()
    found = weights.nested_cluster_p(means, "nation", ["family"], "time", "v", counts, n, 100, t_quantile(0.975, n - 2))
    whole = found.where("draw = 0").select(F.col("p").alias("_p"))
    return rounded(found.join(out, "draw").join(F.broadcast(whole)).select("nation", "mass", "p", (F.col("p") - F.col("_p")).alias("p_moves")), "mass", "p", "p_moves")
