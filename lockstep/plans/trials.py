"""Queries on event sequences: epochs, quality control, neighbours, runs, blocks, joins in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import joins, sequences, speech
from ..operators import summaries as agg
from ..sources.tables import missing_keys, table
from .registry import EV, events, query, rounded

SLICE = f"""
WITH {EV}, epochs AS (
    SELECT e.user_id, e.event_id, e.event_type, e.pos, e.n, CAST(s.pos - e.pos AS INTEGER) AS t, s.value
    FROM ev e JOIN ev s ON s.user_id = e.user_id AND s.pos BETWEEN e.pos - 2 AND e.pos + 4
), trials AS (
    SELECT user_id, event_id, event_type, pos, n, avg(value) FILTER (WHERE t < 0) AS baseline,
        avg(value) FILTER (WHERE t BETWEEN 1 AND 3) AS level, max(value) - min(value) AS range_, count(*) AS n_samples
    FROM epochs GROUP BY ALL
)"""


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each event: baseline, level and range of value around it."""
    ev = events(spark, folder)
    cut = joins.slice_around(ev.drop("value", "us", "rel").withColumnRenamed("pos", "at"), ev.select("user_id", F.col("pos"), "value"), ["user_id"], "at", "pos", 2, 4)
    inside = lambda a, b: F.when(F.col("t").between(a, b), F.col("value"))
    return cut.groupBy("user_id", "event_id", "event_type", F.col("at").alias("pos"), "n").agg(
        F.avg(inside(-2, -1)).alias("baseline"), F.avg(inside(1, 3)).alias("level"), (F.max("value") - F.min("value")).alias("range_"), F.count("*").alias("n_samples")
    )


@query(SLICE + """, bound AS (
    SELECT user_id, m + 5 * median(abs(range_ - m)) AS most, median(abs(range_ - m)) AS mad
    FROM (SELECT user_id, range_, median(range_) OVER (PARTITION BY user_id) AS m FROM trials WHERE n_samples = 7) GROUP BY user_id, m
)
SELECT event_type, status, count(*) AS n, round(avg(level - baseline), 6) AS mean_level FROM (
    SELECT t.*, CASE WHEN n_samples < 7 THEN 'boundary' WHEN event_type = 'error' THEN 'masked' WHEN mad > 0 AND range_ > most THEN 'artifact' ELSE 'keep' END AS status
    FROM trials t LEFT JOIN bound USING (user_id)
) GROUP BY event_type, status""")  # fmt: skip
def epoch_window_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Event-locked level less its baseline by event type, with an ordered rejection: the first reason counts."""
    all_trials = trials(spark, folder)
    bound = agg.mad_threshold(all_trials.where("n_samples = 7"), ["user_id"], "range_").select("user_id", "threshold")
    status = F.when(F.col("n_samples") < 7, "boundary").when(F.col("event_type") == "error", "masked").when(F.col("range_") > F.col("threshold"), "artifact").otherwise("keep")
    found = all_trials.join(bound, "user_id", "left").withColumn("status", status)
    return rounded(found.groupBy("event_type", "status").agg(F.count("*").alias("n"), F.avg(F.col("level") - F.col("baseline")).alias("mean_level")), "mean_level")


@query(f"""WITH {EV} SELECT event_id, lag(value) OVER w AS value_m1, value, lead(value) OVER w AS value_p1 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos)""")
def lag_lead(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.neighbours(events(spark, folder), ["user_id"], ["pos"], ["value"]).select("event_id", "value_m1", "value", "value_p1")


@query(f"""WITH {EV} SELECT event_id, coalesce(greatest(us - lag(us) OVER (PARTITION BY user_id ORDER BY pos), 0), 0) AS gap FROM ev""")
def inter_event_gap(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.gap_before(events(spark, folder), ["user_id"], ["pos"], "us").select("event_id", "gap")


@query(f"""WITH {EV}, marked AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY pos) > 43200000000, false)::INT AS new FROM ev),
runs AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM marked)
SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, max(us) - min(us) AS length FROM runs GROUP BY user_id, run""")
def session_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a user's events, split where 12 hours pass without any."""
    runs = sequences.runs_by_gap(events(spark, folder), ["user_id"], ["pos"], "us", 43_200_000_000)
    return runs.groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("length"))


@query(f"""WITH {EV}, m AS (SELECT *, value > 60 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY pos) - row_number() OVER (PARTITION BY user_id, value > 60 ORDER BY pos) AS g FROM ev),
r AS (SELECT user_id, g, count(*) AS c FROM m WHERE hit GROUP BY user_id, g)
SELECT user_id, max(c) AS longest, CAST(sum(c) AS BIGINT) AS total FROM r GROUP BY user_id""")
def longest_true_run(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.longest_run(events(spark, folder), ["user_id"], ["pos"], F.col("value") > 60)


@query(f"""WITH {EV}, z AS (SELECT *, value - 60 AS stat FROM ev), m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) - row_number() OVER (PARTITION BY user_id, abs(stat) > 30 ORDER BY pos) AS g FROM z)
SELECT user_id, min(pos) AS first, max(pos) AS last, count(*) AS size, round(sum(abs(stat)), 6) AS mass FROM m WHERE abs(stat) > 30 GROUP BY user_id, g""")
def threshold_clusters(spark: SparkSession, folder: str) -> DataFrame:
    ev = events(spark, folder).withColumn("stat", F.col("value") - 60)
    found = sequences.clusters(ev, ["user_id"], "pos", "stat", 30)
    return rounded(found.select("user_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "size", "mass"), "mass")


@query(f"""WITH {EV} SELECT event_id, CAST(len(list_filter(range(0, 8), lambda b: round_even(b * n / 8.0, 0) < pos)) AS INTEGER) AS block,
    len(list_filter(range(1, 8), lambda b: abs(pos - round_even(b * n / 8.0, 0)) <= 2 OR abs(pos - round_even(b * n / 8.0, 0) - 1) <= 2)) > 0 AS guarded FROM ev""")
def blocks_and_guards(spark: SparkSession, folder: str) -> DataFrame:
    ev = events(spark, folder)
    return ev.select("event_id", sequences.block_id(F.col("pos"), F.col("n"), 8).alias("block"), sequences.near_edge(F.col("pos"), F.col("n"), 8, 2).alias("guarded"))


@query(f"""WITH {EV} SELECT a.event_id, b.value FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.pos = (a.pos - 1 - 5 + 5 * a.n) % a.n + 1""")
def circular_shift(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.circular_shift(events(spark, folder), ["user_id"], ["pos"], ["value"], 5).select("event_id", "value")


@query(f"""WITH {EV} SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(quantile_cont(value, 0.5) OVER w, 6) END AS median FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def rolling_median(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sequences.rolling_median(events(spark, folder), ["user_id"], ["pos"], "value", 3, 5).select("event_id", "median"), "median")


@query(f"""WITH {EV}, y AS (SELECT user_id, pos, value - 50 AS y FROM ev), c AS (SELECT *, sum(greatest(y, 0)) OVER (PARTITION BY user_id ORDER BY pos) AS area, sum(greatest(y, 0)) OVER (PARTITION BY user_id) AS whole, max(y) OVER (PARTITION BY user_id) AS top FROM y)
SELECT user_id, min(CASE WHEN y = top THEN pos END) AS peak_at, min(CASE WHEN whole > 0 AND 2 * area >= whole THEN pos END) AS half_area_at, min(CASE WHEN top > 0 AND 2 * y >= top THEN pos END) AS half_max_at FROM c GROUP BY user_id""")
def latencies(spark: SparkSession, folder: str) -> DataFrame:
    ev = events(spark, folder).select("user_id", F.col("pos").cast("long").alias("pos"), (F.col("value") - 50).alias("y"))
    return sequences.latencies(ev, ["user_id"], "pos", "y")


@query(f"""WITH {EV}, m AS (SELECT *, CASE WHEN coalesce(us - lag(us) OVER w >= 21600000000, true) THEN us END AS s, CASE WHEN coalesce(lead(us) OVER w - us >= 21600000000, true) THEN us END AS e FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT event_id, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos) AS phrase_start, first_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS phrase_end FROM m""")
def pause_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.pause_bounds(events(spark, folder), ["user_id"], ["pos"], "us", 21_600_000_000).select("event_id", "phrase_start", "phrase_end")


@query(f"""WITH {EV} SELECT user_id, CASE WHEN (rel // 86400000000) % 2 = 0 THEN 'odd' ELSE 'even' END AS half, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY 1, 2""")
def odd_even_days(spark: SparkSession, folder: str) -> DataFrame:
    half = sequences.odd_even(F.col("rel"), F.lit(0), 86_400_000_000).alias("half")
    return events(spark, folder).groupBy("user_id", half).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {EV}, e AS (SELECT user_id, event_id, us FROM ev WHERE event_type = 'error'), v AS (SELECT user_id, us, min(event_id) AS hit FROM ev WHERE event_type = 'view' GROUP BY ALL),
b AS (SELECT e.*, v.us AS bu, v.hit AS bh FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.us >= v.us),
c AS (SELECT b.*, v.us AS au, v.hit AS ah FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.us <= v.us)
SELECT event_id, CASE WHEN bu IS NOT NULL AND (au IS NULL OR us - bu <= au - us) THEN CASE WHEN us - bu <= 36000000000 THEN bh END WHEN au - us <= 36000000000 THEN ah END AS nearest_hit FROM c""")
def nearest_in_time(spark: SparkSession, folder: str) -> DataFrame:
    """Each error with the user's nearest view within 10 hours."""
    ev = events(spark, folder).select("user_id", "event_id", "us", "event_type")
    views = ev.where("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("hit"))
    return joins.nearest_in_time(ev.where("event_type = 'error'").drop("event_type"), views, ["user_id"], "us", "hit", 36_000_000_000).select("event_id", "nearest_hit")


SPANS = f"""{EV}, pieces AS (SELECT user_id, event_id AS piece_id, us AS on_, us + CAST(value * 60000000 AS BIGINT) AS off_ FROM ev WHERE event_type IN ('click', 'view')),
spans AS (SELECT user_id, event_id AS span_id, us AS start, us + 14400000000 AS end_ FROM ev WHERE event_type = 'purchase')"""


def _pieces(ev: DataFrame) -> DataFrame:
    return ev.where("event_type in ('click', 'view')").select("user_id", F.col("event_id").alias("piece_id"), F.col("us").alias("on"), (F.col("us") + F.round(F.col("value") * 60_000_000).cast("long")).alias("off"))


@query(f"""WITH {SPANS}, met AS (SELECT p.user_id, piece_id, span_id, greatest(on_, start) AS clip_on, least(off_, end_) AS clip_off FROM pieces p JOIN spans s ON p.user_id = s.user_id AND on_ < end_ AND off_ > start)
SELECT user_id, piece_id, span_id, clip_off - clip_on AS overlap, clip_on, clip_off FROM met WHERE clip_off - clip_on >= 600000000
QUALIFY row_number() OVER (PARTITION BY user_id, piece_id ORDER BY clip_off - clip_on DESC, span_id) = 1""")
def largest_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Each click or view, as long as its value in minutes, with the purchase span of 4 hours that it overlaps most."""
    ev = events(spark, folder)
    spans = ev.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), F.col("us").alias("start"), (F.col("us") + 14_400_000_000).alias("end"))
    return joins.largest_overlap(_pieces(ev), spans, ["user_id"], 600_000_000, 14_400_000_000)


@query(f"""WITH {SPANS} SELECT piece_id, EXISTS (SELECT 1 FROM spans s WHERE s.user_id = p.user_id AND on_ < end_ AND off_ > start) AS bad FROM pieces p""")
def overlap_flags(spark: SparkSession, folder: str) -> DataFrame:
    ev = events(spark, folder)
    bad = ev.where("event_type = 'purchase'").select("user_id", (F.col("us") + 14_400_000_000).alias("bad_start"), F.col("us").alias("bad_end"))
    rows = _pieces(ev).withColumnsRenamed({"on": "start", "off": "end"})
    return joins.overlaps_any(rows, bad, ["user_id"], "piece_id", 14_400_000_000).select("piece_id", "bad")


@query(f"""WITH {EV} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND 21600000000 FOLLOWING) AS n_near FROM ev""")
def band_count(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the user within 6 hours on either side, itself included."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-21_600_000_000, 21_600_000_000)
    return events(spark, folder).select("event_id", F.count("*").over(w).alias("n_near"))


@query(f"""WITH {EV}, s AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS before, event_type AS after FROM ev), c AS (SELECT before, after, count(*) AS n FROM s WHERE before IS NOT NULL GROUP BY ALL)
SELECT before, after, n, round(n / sum(n) OVER (PARTITION BY before), 6) AS share FROM c""")
def transition_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(agg.transitions(events(spark, folder), ["user_id"], ["pos"], "event_type"), "share")


@query("""WITH k AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT k, count(*) AS n, count(DISTINCT user_id) AS users FROM k GROUP BY k""")
def json_counts(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    return table(spark, folder, "events").groupBy(k).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"""WITH {EV}, d AS (SELECT DISTINCT user_id, (rel // 86400000000)::BIGINT AS day FROM ev), u AS (SELECT DISTINCT user_id FROM ev)
SELECT user_id, day FROM u CROSS JOIN range(0, 28) r(day) ANTI JOIN d USING (user_id, day)""")
def missing_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days of the expected 28 on which a user has no event."""
    ev = events(spark, folder)
    work = ev.select("user_id").distinct().withColumn("day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(27).cast("long"))))
    return missing_keys(work, ev.select("user_id", F.floor(F.col("rel") / 86_400_000_000).alias("day")), "user_id", "day")


@query(f"""WITH {EV}, g AS (SELECT user_id, CAST(pos // 4 AS BIGINT) AS bin, avg(value) AS mean, count(*) AS c FROM (SELECT user_id, pos - 1 AS pos, value FROM ev) GROUP BY ALL) SELECT user_id, bin, round(mean, 6) AS mean FROM g WHERE c = 4""")
def time_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Means of 4 events in a row, the rest left out."""
    binned = events(spark, folder).groupBy("user_id", F.floor((F.col("pos") - 1) / 4).alias("bin")).agg(F.avg("value").alias("mean"), F.count("*").alias("_n"))
    return rounded(binned.where("_n = 4").drop("_n"), "mean")


@query("""WITH e AS (SELECT vec_id, embedding, label FROM embeddings), d AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM e, range(1, 65) r(i) GROUP BY ALL)
SELECT label, CAST(i AS INTEGER) AS place, round(m, 6) AS mean FROM d""")
def class_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of each embedding place by label."""
    long = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return rounded(long.groupBy("label", (F.col("p") + 1).alias("place")).agg(F.avg(F.col("x").cast("double")).alias("mean")), "mean")


@query("""WITH v AS (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(before::DOUBLE[], embedding::DOUBLE[]), 6) AS cosine FROM v WHERE before IS NOT NULL""")
def cosine_to_previous(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    v = table(spark, folder, "embeddings").withColumn("before", F.lag("embedding").over(w)).where("before is not null")
    return rounded(v.select("vec_id", sc.cosine(F.col("before"), F.col("embedding")).alias("cosine")), "cosine")


@query("""WITH w AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, '[^ \\n]+')) AS n FROM conversations)
SELECT conv_id, turn, role, CAST(n AS INTEGER) AS n, CAST(coalesce(lag(n) OVER (PARTITION BY conv_id ORDER BY turn), n) AS INTEGER) AS n_before FROM w""")
def turns_edge_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each turn and of the one before, its own at the edge."""
    n = F.regexp_count("text", F.lit("[^ \n]+"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", n.alias("n"), F.coalesce(F.lag(n).over(w), n).alias("n_before"))


@query(f"""WITH {EV}, m AS (SELECT *, event_type = 'purchase' AS on_, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY pos) AS c,
    count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id) AS total, lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM ev)
SELECT event_id, CAST(CASE WHEN total = 0 OR c = 0 THEN 0 WHEN on_ THEN c - 1 WHEN c = total THEN total - 1 WHEN before = 'purchase' AND event_type = 'error' THEN c - 1 ELSE c END AS INTEGER) AS syllable FROM m""")
def syllables(spark: SparkSession, folder: str) -> DataFrame:
    """Events grouped as phones are: purchases as nuclei, errors as codas."""
    kind = F.col("event_type")
    return speech.syllables(events(spark, folder), ["user_id"], ["pos"], kind == "purchase", kind == "error").select("event_id", "syllable")


@query(f"""WITH {EV}, w AS (SELECT user_id, pos, event_id, CASE event_type WHEN 'error' THEN '不' WHEN 'click' THEN '一' ELSE '' END AS word, nullif(CAST(floor(value) AS INTEGER) % 5, 0) AS tone FROM ev),
a AS (SELECT *, lead(tone) OVER (PARTITION BY user_id ORDER BY pos) AS nxt FROM w),
b AS (SELECT *, CASE WHEN word = '不' AND nxt = 4 THEN 2 WHEN word = '一' AND nxt = 4 THEN 2 WHEN word = '一' AND nxt IS NOT NULL THEN 4 ELSE tone END AS one FROM a),
c AS (SELECT *, CASE WHEN one = 3 AND lead(one) OVER (PARTITION BY user_id ORDER BY pos) = 3 THEN 2 ELSE one END AS surface FROM b)
SELECT event_id, surface, CASE WHEN tone IS NULL OR tone = surface THEN 'none' WHEN word = '不' AND nxt = 4 THEN 'not' WHEN word = '一' AND nxt IS NOT NULL THEN 'one' WHEN tone = 3 AND surface = 2 THEN 'third' ELSE 'other' END AS change FROM c""")
def surface_tones(spark: SparkSession, folder: str) -> DataFrame:
    """Tones (whole part of the value modulo 5, 0 neutral) after the rules that neighbours set off."""
    kind, tone = F.col("event_type"), F.floor("value").cast("int") % 5
    rows = events(spark, folder).select("user_id", "pos", "event_id", F.when(kind == "error", speech.NOT).when(kind == "click", speech.ONE).otherwise("").alias("word"), F.when(tone != 0, tone).alias("tone"))
    return speech.surface_tones(rows, ["user_id"], ["pos"], "word", "tone").select("event_id", "surface", "change")
