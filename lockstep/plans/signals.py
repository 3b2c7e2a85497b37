"""Queries on signals, channels and features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequences, signals
from ..sources.tables import table
from .inference import MEANS, _means
from .registry import EV, events, query, rounded

CH = "ch AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS channel, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"""WITH {CH}, s AS (SELECT label, channel, avg(x) AS m, stddev_samp(x) AS s FROM ch GROUP BY ALL)
SELECT vec_id, CAST(channel AS INTEGER) AS channel, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS z FROM ch JOIN s USING (label, channel)""")
def zscored_channels(spark: SparkSession, folder: str) -> DataFrame:
    """All 64 places of the embeddings as channels, scaled by label."""
    long = signals.by_channel(table(spark, folder, "embeddings"), ["vec_id", "label"], "embedding")
    return rounded(signals.zscore_channels(long, ["label", "channel"], "x").select("vec_id", "channel", "z"), "z")


@query(f"""WITH {EV}, b AS (SELECT *, CASE WHEN pos <= 10 THEN value END AS v0 FROM ev), p AS (SELECT event_type, user_id, count(v0) AS k, sum(v0) AS s, sum(v0 * v0) AS q FROM b GROUP BY ALL),
n AS (SELECT event_type, sqrt(sum(CASE WHEN k > 0 THEN greatest(0, q - s * s / k) END) / sum(k)) AS rms FROM p GROUP BY event_type)
SELECT event_type, round(var_samp(value), 4) AS variance, count(value) AS n, round(max(rms), 4) AS baseline_rms FROM ev JOIN n USING (event_type) GROUP BY event_type""")
def channel_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = signals.channel_qc(events(spark, folder), ["user_id"], "event_type", "value", F.col("pos") <= 10)
    return found.withColumns({c: F.round(c, 4) for c in ("variance", "baseline_rms")})


@query("""SELECT vec_id, round(embedding[6]::DOUBLE, 6) AS fz, round(embedding[2]::DOUBLE, 6) AS cz, round((embedding[6]::DOUBLE + embedding[2]::DOUBLE) / 2, 6) AS roi FROM embeddings""")
def picked_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Two channels by name, in the order asked for, and their mean as a region."""
    names = [f"c{k}" for k in range(64)]
    pick = signals.picked(F.col("embedding"), names, ["c5", "c1"])
    found = table(spark, folder, "embeddings").select("vec_id", F.transform(pick, lambda x: x.cast("double")).alias("p"))
    return rounded(found.select("vec_id", F.col("p")[0].alias("fz"), F.col("p")[1].alias("cz"), ((F.col("p")[0] + F.col("p")[1]) / 2).alias("roi")), "fz", "cz", "roi")


@query(f"""WITH {EV}, l AS (SELECT user_id, regr_slope(value, pos) AS b, avg(pos) AS x, avg(value) AS y FROM ev GROUP BY user_id)
SELECT user_id, event_id, round(y + coalesce(b, 0) * (pos - x), 6) AS fit, round(value - y - coalesce(b, 0) * (pos - x), 6) AS residual FROM ev JOIN l USING (user_id)""")
def drift_removed(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(signals.drift_residual(events(spark, folder), ["user_id"], "pos", "value").select("user_id", "event_id", "fit", "residual"), "fit", "residual")


@query(f"""WITH {EV}, l AS (SELECT user_id, regr_slope(value, pos) AS b, avg(pos) AS x, avg(value) AS y FROM ev GROUP BY user_id),
r AS (SELECT user_id, event_id, pos, n, y + coalesce(b, 0) * (pos - x) AS fit, value - y - coalesce(b, 0) * (pos - x) AS r FROM ev JOIN l USING (user_id))
SELECT a.user_id, a.event_id, round(a.fit + z.r, 6) AS surrogate FROM r a JOIN r z ON a.user_id = z.user_id AND z.pos = ((a.pos - 1 - 7) % a.n + a.n) % a.n + 1""")
def freedman_lane_surrogate(spark: SparkSession, folder: str) -> DataFrame:
    """The drift of each user's values with the residuals moved on by 7 places."""
    found = signals.freedman_lane(events(spark, folder), ["user_id"], ["pos"], "pos", "value", 7)
    return rounded(found.select("user_id", "event_id", "surrogate"), "surrogate")


@query()
def spatial_filter_power(spark: SparkSession, folder: str) -> DataFrame:
    """Variance of the 4 leading spatial components of the embeddings, by label."""
    e = table(spark, folder, "embeddings")
    mean, weights, _ = signals.spatial_components(e, "embedding", 4)
    long = signals.by_channel(e.select("label", signals.apply_filter(F.col("embedding"), mean, weights).alias("y")), ["label"], "y")
    return rounded(long.groupBy("label", F.col("channel").alias("component")).agg(F.var_pop("x").alias("power"), F.count("*").alias("n")), "power")


@query("""SELECT vec_id, round((embedding[1]::DOUBLE - 0.5) * 2 + (embedding[2]::DOUBLE + 1) * -1, 6) AS a, round((embedding[1]::DOUBLE - 0.5) * 0.5 + (embedding[2]::DOUBLE + 1) * 3, 6) AS b FROM embeddings""")
def spatial_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A given filter of two channels to two components."""
    y = signals.apply_filter(F.slice("embedding", 1, 2), np.array([0.5, -1.0]), np.array([[2.0, 0.5], [-1.0, 3.0]]))
    return rounded(table(spark, folder, "embeddings").select("vec_id", y[0].alias("a"), y[1].alias("b")), "a", "b")


@query(f"""WITH {EV}, d AS (SELECT user_id, event_id, (value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) * 50 AS d FROM ev)
SELECT user_id, event_id, round(coalesce(greatest(d, 0), 0), 6) AS onset, round(coalesce(greatest(-d, 0), 0), 6) AS offset_ FROM d""")
def rectified_change(spark: SparkSession, folder: str) -> DataFrame:
    found = signals.rectified_steps(events(spark, folder), ["user_id"], ["pos"], "value", 50.0)
    return rounded(found.select("user_id", "event_id", "onset", F.col("offset").alias("offset_")), "onset", "offset_")


@query(f"""WITH {EV}, w AS (SELECT e.user_id, e.event_id, k, least(e.pos + k, e.n) AS s FROM ev e, range(0, 5) r(k) WHERE event_type = 'purchase')
SELECT w.user_id, w.event_id, round(avg(x.value), 6) AS mean, round(stddev_pop(x.value), 6) AS sd, round(max(x.value) - min(x.value), 6) AS range, round(max(x.value), 6) AS max,
round(regr_slope(x.value, k), 6) AS slope, round(arg_max(x.value, k) - arg_min(x.value, k), 6) AS change FROM w JOIN ev x ON x.user_id = w.user_id AND x.pos = s GROUP BY ALL""")
def segment_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Five values from each purchase on, the last one held, as mean, spread, slope and change."""
    ev = events(spark, folder)
    asked = ev.where("event_type = 'purchase'").select("user_id", "event_id", "pos", F.col("n").alias("last"))
    values = signals.sampled(asked, ev.select("user_id", F.col("pos").alias("sample"), "value"), ["user_id"], "pos", "sample", 5, "last")
    found = signals.segment_stats(values, ["user_id", "event_id"], "k", "value").drop("n")
    return rounded(found, "mean", "sd", "range", "max", "slope", "change")


@query(f"""WITH {EV}, c AS (SELECT user_id, round(floor(value / 10) * 10, 6) AS f, count(*) AS k FROM ev GROUP BY ALL), m AS (SELECT user_id, arg_max(f, row(k, -f)) AS fill FROM c GROUP BY user_id)
SELECT user_id, round(max(fill), 6) AS fill, count(*) FILTER (WHERE abs(floor(value / 10) * 10 - fill) > 1e-4) AS voiced FROM ev JOIN m USING (user_id) GROUP BY user_id""")
def voiced_mask(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent rounded value is the fill; other values are voiced."""
    ev = events(spark, folder).withColumn("f", F.floor(F.col("value") / 10) * 10.0)
    found = ev.join(signals.fill_value(ev, ["user_id"], "f"), "user_id").groupBy("user_id").agg(F.max("fill").alias("fill"), F.count_if(signals.voiced(F.col("f"), F.col("fill"))).alias("voiced"))
    return rounded(found, "fill")


@query(f"""WITH {EV}, p AS (SELECT user_id, rel / 3600000000.0::DOUBLE AS t, avg(value) AS v FROM ev GROUP BY ALL), g AS (SELECT user_id, (h * 24)::DOUBLE AS t FROM (SELECT DISTINCT user_id FROM ev), range(0, 11) r(h)),
a AS (SELECT g.user_id, g.t, max(p.t) AS t0 FROM g LEFT JOIN p ON p.user_id = g.user_id AND p.t <= g.t GROUP BY ALL), b AS (SELECT g.user_id, g.t, min(p.t) AS t1 FROM g LEFT JOIN p ON p.user_id = g.user_id AND p.t >= g.t GROUP BY ALL)
SELECT a.user_id, a.t, round(CASE WHEN t1 = t0 THEN x.v WHEN t1 - t0 <= 48 THEN x.v + (a.t - t0) / (t1 - t0) * (y.v - x.v) END, 6) AS v
FROM a JOIN b ON a.user_id = b.user_id AND a.t = b.t LEFT JOIN p x ON x.user_id = a.user_id AND x.t = t0 LEFT JOIN p y ON y.user_id = a.user_id AND y.t = t1""")
def interpolated_days(spark: SparkSession, folder: str) -> DataFrame:
    """Values at the first 11 days of each user, on the line between the events next to them if these are two days apart at most."""
    ev = events(spark, folder).select("user_id", (F.col("rel") / F.lit(3600000000.0)).alias("t"), F.col("value").alias("v"))
    grid = ev.select("user_id").distinct().select("user_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda h: (h * 24).cast("double"))).alias("t"))
    return rounded(signals.interpolated(grid, ev, ["user_id"], "t", "v", 48.0), "v")


@query(f"""WITH {EV}, o AS (SELECT DISTINCT user_id, CAST(round_even(rel / 86400000000.0, 0) AS INTEGER) AS sample FROM ev)
SELECT u.user_id, CAST(s AS INTEGER) AS sample, CAST(CASE WHEN o.sample IS NULL THEN 0 ELSE 1 END AS INTEGER) AS x FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN range(0, 40) r(s) LEFT JOIN o ON o.user_id = u.user_id AND o.sample = s""")
def event_raster(spark: SparkSession, folder: str) -> DataFrame:
    """Events as an impulse train of 40 days."""
    return signals.rasterised(events(spark, folder), ["user_id"], F.col("rel") / F.lit(86400000000.0), 40)


def _half_stats(c: str, sql: str) -> str:
    x = f"({sql})::DOUBLE"
    return f"SELECT '{c}' AS name, stddev_pop({x}) AS sd, coalesce(max(abs({x})) FILTER (WHERE l_orderkey % 2 = 0), 0) AS a, coalesce(max(abs({x})) FILTER (WHERE l_orderkey % 2 <> 0), 0) AS b FROM lineitem"


COLUMNS = {"quantity": "l_quantity", "tax": "l_tax", "one": "1", "odd_only": "l_orderkey % 2", "zero": "0", "returned": "(l_returnflag = 'R')::INT"}


@query(f"""WITH s AS ({' UNION ALL '.join(_half_stats(c, x) for c, x in COLUMNS.items())}), f AS (SELECT *, sd < 1e-12 AS constant, a = 0 OR b = 0 AS fragile FROM s)
SELECT name, round(sd, 6) AS sd, constant, fragile, NOT constant AND NOT fragile AS kept FROM f""")
def column_screen(spark: SparkSession, folder: str) -> DataFrame:
    """Columns without spread and columns that are 0 throughout one half."""
    li = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), F.lit(1).alias("one"), (F.col("l_orderkey") % 2).alias("odd_only"), F.lit(0).alias("zero"), (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return rounded(signals.constant_columns(li, list(COLUMNS), F.col("l_orderkey") % 2 == 0).withColumnRenamed("column", "name"), "sd")


@query("""WITH f AS (SELECT p_partkey, p_size::DOUBLE AS size, CASE WHEN p_size > 5 THEN ln(p_size - 5) END AS freq, p_retailprice AS price FROM part),
i AS (SELECT p_partkey, size, coalesce(freq, (SELECT min(freq) FROM f)) AS freq, price FROM f),
s AS (SELECT avg(size) AS m1, stddev_pop(size) AS s1, avg(freq) AS m2, stddev_pop(freq) AS s2, avg(price) AS m3, stddev_pop(price) AS s3 FROM i)
SELECT p_partkey, round((size - m1) / s1, 6) AS size, round((freq - m2) / s2, 6) AS freq, round((price - m3) / s3, 6) AS price FROM i, s""")
def nuisance_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Item properties as z scores; a missing log frequency takes the least one there is."""
    size = F.col("p_size").cast("double")
    part = table(spark, folder, "part").select("p_partkey", size.alias("size"), F.when(size > 5, F.log(size - 5)).alias("freq"), F.col("p_retailprice").alias("price"))
    return rounded(signals.standardised(part, ["size", "freq", "price"]), "size", "freq", "price")


TG = f"{MEANS}, tg AS (SELECT a.family, a.time AS t_train, b.time AS t_test, corr(a.v, b.v) AS score, count(*) AS n FROM m a JOIN m b USING (subject, family) GROUP BY ALL)"


@query(f"WITH {TG} SELECT family, t_train, t_test, round(score, 6) AS score, n FROM tg")
def time_correlations(spark: SparkSession, folder: str) -> DataFrame:
    """Every month against every month over subjects, by family."""
    return rounded(signals.time_correlations(_means(spark, folder), "subject", ["family"], "time", "v"), "score")


@query(f"WITH {TG} SELECT family, t_test - t_train AS lag, round(avg(score), 6) AS score FROM tg GROUP BY ALL")
def realigned_diagonals(spark: SparkSession, folder: str) -> DataFrame:
    matrix = signals.time_correlations(_means(spark, folder), "subject", ["family"], "time", "v")
    return rounded(signals.diagonal_means(matrix, ["family"]), "score")


@query(f"""WITH {TG}, r AS (SELECT family, t_train, count(*) FILTER (WHERE score > 0.05) AS width, max(score) FILTER (WHERE t_train = t_test) AS own FROM tg GROUP BY ALL)
SELECT family, round(coalesce(avg(width) FILTER (WHERE own > 0.05), avg(width)), 6) AS width, count(*) FILTER (WHERE own > 0.05) AS rows_above FROM r GROUP BY family""")
def sustained_width(spark: SparkSession, folder: str) -> DataFrame:
    matrix = signals.time_correlations(_means(spark, folder), "subject", ["family"], "time", "v")
    return rounded(signals.sustained(matrix, ["family"], 0.05), "width")


@query(f"""WITH {MEANS}, t AS (SELECT family, time, avg(v) AS y, stddev_samp(v) / sqrt(count(*)) AS se FROM m GROUP BY ALL), z AS (SELECT *, y - 25.5 > 0.5 * se AS up FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY time) - row_number() OVER (PARTITION BY family, up ORDER BY time) AS isl FROM z), i AS (SELECT family, isl, count(*) AS k FROM r WHERE up GROUP BY ALL)
SELECT family, max(k) AS longest, CAST(sum(k) AS BIGINT) AS total FROM i GROUP BY family""")
def above_error_duration(spark: SparkSession, folder: str) -> DataFrame:
    """Months in which a family's mean is over 25.5 by half a standard error: longest run and all."""
    t = _means(spark, folder).groupBy("family", "time").agg(F.avg("v").alias("y"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("se"))
    return sequences.longest_run(t, ["family"], ["time"], F.col("y") - 25.5 > 0.5 * F.col("se"))


@query(f"""WITH {MEANS}, t AS (SELECT family, time, avg(v) - 25.5 AS y FROM m GROUP BY ALL), p AS (SELECT family, max(y) AS peak FROM t GROUP BY family)
SELECT family, time, round(sum(greatest(y, 0)) OVER (PARTITION BY time ORDER BY peak DESC, family), 6) AS stacked, round(y / peak, 6) AS relative FROM t JOIN p USING (family)""")
def stacked_contours(spark: SparkSession, folder: str) -> DataFrame:
    """Positive parts summed over families in order of their peak, and each trace as a part of its maximum."""
    t = _means(spark, folder).groupBy("family", "time").agg((F.avg("v") - 25.5).alias("y"))
    t = t.join(t.groupBy("family").agg(F.max("y").alias("peak")), "family")
    run = Window.partitionBy("time").orderBy(F.desc("peak"), "family")
    return rounded(t.select("family", "time", F.sum(F.greatest("y", F.lit(0.0))).over(run).alias("stacked"), (F.col("y") / F.col("peak")).alias("relative")), "stacked", "relative")


@query(f"""WITH {EV}, l AS (SELECT *, CASE WHEN count(value) OVER w >= 3 THEN value - quantile_cont(value, 0.5) OVER w END AS r, us < lag(us) OVER (PARTITION BY user_id ORDER BY pos) AS back FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT user_id, event_id, round(r, 6) AS residual, round((pos - 1) / greatest(n - 1, 1), 6) AS story_pos, coalesce(back, false) AS back FROM l""")
def local_residual(spark: SparkSession, folder: str) -> DataFrame:
    """Values less their running median, the place in the user's story from 0 to 1, and whether time runs back."""
    ev = sequences.rolling_median(events(spark, folder), ["user_id"], ["pos"], "value", 3, 3)
    back = F.coalesce(F.col("us") < F.lag("us").over(Window.partitionBy("user_id").orderBy("pos")), F.lit(False))
    story = (F.col("pos") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    return rounded(ev.select("user_id", "event_id", (F.col("value") - F.col("median")).alias("residual"), story.alias("story_pos"), back.alias("back")), "residual", "story_pos")


LEVELS = ["click", "error", "purchase", "signup", "view"]


@query(f"""WITH {EV}, u AS (SELECT user_id, 2.0 * (pos - 1) / nullif(n - 1, 0) - 1 AS u, value AS y FROM ev),
c AS (SELECT user_id, count(u) AS n, avg(u) AS m, avg(u * u) AS q, avg(y) AS y0, covar_pop(u, u) AS a, covar_pop(u, u * u) AS b, covar_pop(u * u, u * u) AS c, covar_pop(u, y) AS d, covar_pop(u * u, y) AS e
    FROM u WHERE y IS NOT NULL AND u IS NOT NULL GROUP BY user_id),
f AS (SELECT *, (a * e - b * d) / nullif(a * c - b * b, 0) AS b2 FROM c), g AS (SELECT *, (d - b * b2) / nullif(a, 0) AS b1 FROM f)
SELECT user_id, n, CASE WHEN n >= 4 THEN round(y0 - b1 * m - b2 * (q - 1.0 / 3), 6) END AS level, CASE WHEN n >= 4 THEN round(b1, 6) END AS slope, CASE WHEN n >= 4 THEN round(2 * b2 / 3, 6) END AS bend FROM g""")
def legendre_contours(spark: SparkSession, folder: str) -> DataFrame:
    """Level, slope and bend of each user's values over the order of the events."""
    return rounded(signals.legendre_contours(events(spark, folder), ["user_id"], "pos", "value"), "level", "slope", "bend")


@query(f"""WITH h AS (SELECT user_id, value, CASE event_type {" ".join(f"WHEN '{level}' THEN {k}" for k, level in enumerate(LEVELS))} END AS k FROM events)
SELECT user_id, {", ".join(f"round(avg(value * CASE WHEN k < {j} THEN 1 WHEN k = {j} THEN -{j} ELSE 0 END / sqrt({j} * ({j} + 1.0))), 6) AS contrast_{j}" for j in range(1, len(LEVELS)))} FROM h GROUP BY user_id""")
def helmert_contrasts(spark: SparkSession, folder: str) -> DataFrame:
    """Means of each user's values times the contrasts of the event types."""
    coded = signals.helmert_codes(table(spark, folder, "events"), "event_type", LEVELS)
    names = {f"contrast_{j}": F.avg(F.col("value") * F.col(f"code_{j}")) for j in range(1, len(LEVELS))}
    return rounded(coded.groupBy("user_id").agg(*[c.alias(n) for n, c in names.items()]), *names)
