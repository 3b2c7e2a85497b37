"""Queries of decoders over time, their filters and nulls, and of mixed models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import dense, mixed, nulls, signals
from ..operators import permutation as perm
from ..sources.tables import table
from .registry import query, rounded
from .stats import FAMILIES, _halved_embeddings

ALPHAS = sc.log_grid(-4, 4, 1)


@query()
def decoder_generalisation(spark: SparkSession, folder: str) -> DataFrame:
    """Decoders of each time tested at every other: the families' mean scores over splits and directions."""
    found = dense.b2b_generalised(_halved_embeddings(spark, folder), FAMILIES, ALPHAS, splits=4).where("valid")
    return rounded(found.groupBy("participant", "t_train", "t_test", "family").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n")), "mean_score")


HALVES = ", ".join(f"({k}, {b - 1})" for k, (_, first) in enumerate(perm.balanced_halves()[:4]) for b in first)
GENERAL_SQL = f"""WITH e AS (SELECT label % 3 AS label, vec_id, embedding AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) >= 5),
r AS (SELECT label, vec_id % 8 AS block, t, v[1]::DOUBLE AS x, v[2 + t]::DOUBLE + v[1]::DOUBLE AS y FROM e, range(0, 4) q(t)),
h AS (SELECT * FROM (VALUES {HALVES}) q(split, block)), s AS (SELECT DISTINCT split FROM h),
b AS (SELECT label, t, split, block IN (SELECT block FROM h WHERE h.split = s.split) AS first, x, y FROM r, s),
c AS (SELECT label, t, split, first, covar_pop(x, y) AS xy, var_pop(x) AS xx, var_pop(y) AS yy FROM b GROUP BY ALL)
SELECT a.label::BIGINT AS participant, a.t::INTEGER AS t_train, z.t::INTEGER AS t_test, round(avg(a.xy / (a.yy * 1.5) * z.xy / z.xx), 6) AS mean_score, count(*) AS n
FROM c a JOIN c z ON z.label = a.label AND z.split = a.split AND z.first <> a.first GROUP BY ALL"""


@query(GENERAL_SQL)
def decoder_generalisation_one(spark: SparkSession, folder: str) -> DataFrame:
    """One feature decoded from one channel at each of four times, tested at every other."""
    e = table(spark, folder, "embeddings").where("label is not null and size(embedding) >= 5")
    value = lambda k: F.get("embedding", k).cast("double")
    trials = e.select(
        F.pmod("label", F.lit(3)).cast("long").alias("participant"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("time"), F.col("vec_id").alias("trial"),
        F.pmod("vec_id", F.lit(8)).alias("block"), F.array(value(F.lit(0))).alias("x"), "embedding",
    ).withColumn("y", F.array(value(F.col("time") + 1) + F.col("x")[0])).drop("embedding")
    found = dense.b2b_generalised(trials, {"one": 1}, [0.5], splits=4).where("valid")
    return rounded(found.groupBy("participant", "t_train", "t_test").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n")), "mean_score")


@query()
def decoder_sustain(spark: SparkSession, folder: str) -> DataFrame:
    """How long a family is decoded at its own time, and how wide decoders generalise: from the families' mean scores above 0."""
    mean = dense.b2b_generalised(_halved_embeddings(spark, folder), FAMILIES, ALPHAS, splits=4).where("valid").groupBy("participant", "family", "t_train", "t_test").agg(F.avg("score").alias("score"))
    return rounded(signals.sustained(mean, ["participant", "family"], 0.0), "width")


@query()
def evoked_filter_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores behind two spatial filters that are fit on each split's first half, and what these explain."""
    trials = _halved_embeddings(spark, folder)
    filters = dense.evoked_filters(dense.block_sums(trials, ["participant", "time", "block"]), 4, 4)
    found = dense.b2b_scores(trials, FAMILIES, ALPHAS, splits=4, filters=filters).where("valid").groupBy("participant", "family").agg(F.avg("score").alias("mean_score"))
    explained = filters.groupBy("participant").agg(F.avg("explained").alias("explained"))
    return rounded(found.join(explained, "participant"), "mean_score", "explained")


@query()
def nested_null_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The second family beyond the first, against 200 repetitions in which only what the first doesn't explain of it is shifted."""
    trials = _halved_embeddings(spark, folder)
    observed = dense.b2b_scores(trials, FAMILIES, ALPHAS, splits=4)
    null = nulls.b2b_nulls(trials, observed, FAMILIES, 200, 4, nested=True)
    key = ["participant", "family", "rep"]
    mean = null.groupBy(*key).agg(F.avg("score").alias("score")).unionByName(observed.where("valid").withColumn("rep", F.lit(-1)).groupBy(*key).agg(F.avg("score").alias("score")))
    ranked = perm.one_sided_p(mean.withColumn("rep", F.col("rep") + 1), ["participant", "family"], "score")
    return rounded(ranked, "observed", "p")


@query()
def tuned_null_maximum(spark: SparkSession, folder: str) -> DataFrame:
    """Each participant's largest mean score over times and families against 20 shifts in two chunks, the penalty tuned anew in each."""
    trials = _halved_embeddings(spark, folder)
    alphas = sc.log_grid(-2, 2, 1)
    observed = dense.b2b_scores(trials, FAMILIES, alphas, splits=2).where("valid")
    stats = nulls.window_maximum(observed.withColumn("rep", F.lit(0)), 1, 4)
    for first in (0, 10):
        tuned = nulls.null_alphas(trials, FAMILIES, alphas, 10, splits=2, least=4, first_rep=first)
        chunk = nulls.b2b_nulls(trials, tuned, FAMILIES, 10, 4, first_rep=first)
        stats = stats.unionByName(nulls.window_maximum(chunk, 1, 4).withColumn("rep", F.col("rep") + 1))
    return rounded(perm.one_sided_p(stats, ["participant"], "stat"), "observed", "p")


@query("""WITH w AS (SELECT l_suppkey % 20 AS participant, l_orderkey % 3 AS chunk, l_linenumber - 1 AS rep FROM lineitem),
p AS (SELECT DISTINCT participant FROM w), n AS (SELECT participant, rep, count(DISTINCT chunk) AS n FROM w GROUP BY ALL)
SELECT participant, CAST(r AS INTEGER) AS rep, coalesce(n, 0) AS n FROM p CROSS JOIN range(0, 9) q(r) LEFT JOIN n ON n.participant = p.participant AND n.rep = r WHERE coalesce(n, 0) <> 1""".replace("SELECT participant, CAST(r", "SELECT p.participant, CAST(r"))
def chunk_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Line numbers as repetitions in chunks of orders: those that no chunk or several hold, for groups of suppliers."""
    done = table(spark, folder, "lineitem").select((F.col("l_suppkey") % 20).alias("participant"), (F.col("l_orderkey") % 3).alias("chunk"), (F.col("l_linenumber") - 1).cast("int").alias("rep"))
    return nulls.chunk_gaps(done, done, 9)


@query("""WITH e AS (SELECT label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE * (1 + label) AS b FROM embeddings WHERE label IS NOT NULL AND len(embedding) >= 2),
c AS (SELECT label, count(*) AS n, count(*) * var_pop(a) AS aa, count(*) * var_pop(b) AS bb, count(*) * covar_pop(a, b) AS ab FROM e GROUP BY label),
v AS (SELECT label, n, (aa + bb + sqrt((aa - bb) * (aa - bb) + 4 * ab * ab)) / 2 AS high, (aa + bb - sqrt((aa - bb) * (aa - bb) + 4 * ab * ab)) / 2 AS low FROM c),
p AS (SELECT *, sqrt(high / low) AS kappa, greatest(0, (high - 9 * low) / 8) AS penalty FROM v)
SELECT label, n, round(kappa, 6) AS condition, round(penalty, 6) AS penalty, round(sqrt((high + penalty) / (low + penalty)), 6) AS condition_after, kappa > 3 AS warn, n < 2 AS invalid FROM p""")
def penalty_for_condition(spark: SparkSession, folder: str) -> DataFrame:
    """The least penalty that brings two features of each label to a condition of 3, from eigenvalues of their sums of products."""
    e = table(spark, folder, "embeddings").where("label is not null and size(embedding) >= 2").select("label", F.col("embedding")[0].cast("double").alias("a"), (F.col("embedding")[1].cast("double") * (1 + F.col("label"))).alias("b"))
    n = F.count("*")
    c = e.groupBy("label").agg(n.alias("n"), (n * F.var_pop("a")).alias("aa"), (n * F.var_pop("b")).alias("bb"), (n * F.covar_pop("a", "b")).alias("ab"))
    low, high = dense.two_eigenvalues(F.col("aa"), F.col("bb"), F.col("ab"))
    found = dense.condition_gate(c.select("label", "n", low.alias("low"), high.alias("high")), "low", "high", "n", 2, 3.0)
    return rounded(found.drop("low", "high"), "condition", "penalty", "condition_after")


CROSSED_SQL = """WITH e AS (SELECT vec_id, CAST(unnest(range(1, len(embedding) + 1)) AS BIGINT) AS place, unnest(embedding)::DOUBLE AS v, label FROM embeddings),
y AS (SELECT vec_id, place, v + label / 10.0 + place / 50.0 AS y FROM e), m AS (SELECT avg(y) AS m, count(DISTINCT vec_id) AS a, count(DISTINCT place) AS b, count(*) AS n FROM y),
p AS (SELECT place, avg(y) AS pm FROM y GROUP BY place), q AS (SELECT vec_id, avg(y) AS qm FROM y GROUP BY vec_id),
s AS (SELECT sum((y - pm - qm + m) * (y - pm - qm + m)) AS se FROM y JOIN p USING (place) JOIN q USING (vec_id), m),
k AS (SELECT m, n, se / ((a - 1) * (b - 1)) AS mse, a * (SELECT sum((pm - m) * (pm - m)) FROM p) / (b - 1) AS msp, b * (SELECT sum((qm - m) * (qm - m)) FROM q) / (a - 1) AS msq, a, b FROM m, s)
SELECT round(m, 4) AS beta, round(mse, 5) AS residual, round((msp - mse) / a, 4) AS solved, round((msq - mse) / b, 4) AS absorbed, n FROM k"""


@query(CROSSED_SQL)
def crossed_intercepts(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of all embeddings with crossed intercepts for places and vectors, by restricted likelihood: with every cell filled, what mean squares give in closed form."""
    e = table(spark, folder, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("place", "v"))
    y = e.select("vec_id", "place", (F.col("v").cast("double") + F.col("label") / 10.0 + (F.col("place") + 1) / 50.0).alias("y"))
    found = mixed.effects_table(spark, mixed.crossed_intercepts(y, "place", "vec_id", "y", [], reml=True))
    return found.select(F.round("beta", 4).alias("beta"), F.round("residual", 5).alias("residual"), F.round("solved", 4).alias("solved"), F.round("absorbed", 4).alias("absorbed"), "n")


@query()
def crossed_ratio_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Prices of line items with crossed intercepts for suppliers' nations and parts: does discount count, and then quantity?"""
    items = table(spark, folder, "lineitem").join(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    rows = items.select("s_nationkey", "l_partkey", "l_discount", (F.col("l_quantity") / 10).alias("quantity"), (F.col("l_extendedprice") / 10000).alias("price"))
    fits = mixed.crossed_intercepts(rows, "s_nationkey", "l_partkey", "price", ["l_discount", "quantity"], [[], ["l_discount"], ["l_discount", "quantity"]])
    return mixed.nested_ratio_tests(spark, fits).withColumns({"chi_squared": F.round("chi_squared", 2), "p": F.round("p", 3)})
