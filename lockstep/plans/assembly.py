"""Queries on alignment, look-ups, summaries and tables put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..operators import alignment as al
from ..operators import summaries as agg
from ..sources.sinks import stale
from ..sources.tables import table
from .registry import EV, SCORES, events, query, rounded, scores

WORDS = """w AS (SELECT conv_id, turn, i AS word, list_extract(ws, i) AS t FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations), range(1, 100000) r(i) WHERE i <= len(ws)),
spans AS (SELECT conv_id, turn, word, t, CAST(sum(length(t) + 1) OVER (PARTITION BY conv_id, turn ORDER BY word) - 1 AS BIGINT) AS off FROM w)"""


def _words(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("word", "t"))
    return c.withColumn("word", (F.col("word") + 1).cast("long"))


@query(f"""WITH {WORDS}, s AS (SELECT conv_id, turn, word AS span_id, off - length(t) AS start, off AS end_ FROM spans WHERE length(t) > 0),
p AS (SELECT conv_id, turn, k AS piece_id, k * 3 AS on_, least(k * 3 + 3, length(text)) AS off FROM conversations, range(0, 40000) r(k) WHERE k * 3 < length(text)),
m AS (SELECT conv_id, turn, piece_id, span_id, least(p.off, end_) - greatest(on_, start) AS o FROM p JOIN s USING (conv_id, turn) WHERE on_ < end_ AND p.off > start),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, piece_id ORDER BY o DESC, span_id) AS r FROM m WHERE o >= 1)
SELECT conv_id, turn, span_id AS word, count(*) AS pieces, CAST(sum(o) AS BIGINT) AS chars FROM b WHERE r = 1 GROUP BY ALL""")
def tokens_of_words(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of three characters and the words that hold most of each."""
    words = al.offsets(_words(spark, folder), ["conv_id", "turn"], "word", "t", 1).where("char_length(t) > 0").select("conv_id", "turn", F.col("word").alias("span_id"), F.col("on").alias("start"), F.col("off").alias("end"))
    size = F.char_length("text")
    c = table(spark, folder, "conversations").where(size > 0)
    pieces = c.select("conv_id", "turn", size.alias("_n"), F.explode(F.sequence(F.lit(0), F.floor((size - 1) / 3).cast("int"))).alias("piece_id"))
    pieces = pieces.select("conv_id", "turn", "piece_id", (F.col("piece_id") * 3).alias("on"), F.least(F.col("piece_id") * 3 + 3, F.col("_n")).alias("off"))
    found = al.tokens_to_words(pieces, words, ["conv_id", "turn"])
    return found.groupBy("conv_id", "turn", F.col("span_id").alias("word")).agg(F.count("*").alias("pieces"), F.sum("overlap").cast("long").alias("chars"))


@query("""SELECT c_custkey, coalesce(n_name, 'unknown') AS nation, CASE WHEN lower(left(c_mktsegment, 1)) IN ('n', 'v', 'a', 'm', 'q', 'i') THEN true ELSE false END AS content
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey""")
def mapped_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes by name, with a name for those that aren't listed, and a flag by the first letter of a tag."""
    nation = table(spark, folder, "nation").where("n_regionkey < 3")
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), al.content_word(F.col("c_mktsegment")).alias("content"))
    return al.mapped(c, "nation", nation, "n_nationkey", "n_name")


@query(f"""WITH {WORDS}, v AS (SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS t FROM benchmark) SELECT lower(t) AS word, count(*) AS n FROM w WHERE lower(t) IN (SELECT t FROM v) GROUP BY 1""")
def words_in_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Words of conversations that a vocabulary holds, by a semi-join."""
    vocabulary = table(spark, folder, "benchmark").select(F.explode(F.split("text", " ")).alias("t")).select(F.lower("t").alias("word"))
    return _words(spark, folder).select(F.lower("t").alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT l_suppkey, l_partkey, min(l_extendedprice / l_quantity) AS price FROM lineitem WHERE l_quantity > 25 GROUP BY ALL), k AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT k.l_suppkey, k.l_partkey, round(coalesce(o.price, p_retailprice), 6) AS price, CAST(round_even(coalesce(o.price, p_retailprice) * 100, 0) AS BIGINT) AS sample, CASE WHEN o.price IS NOT NULL THEN 'own' WHEN p_retailprice IS NOT NULL THEN 'shared' END AS source
FROM k LEFT JOIN o USING (l_suppkey, l_partkey) LEFT JOIN part ON l_partkey = p_partkey""")
def own_or_shared(spark: SparkSession, folder: str) -> DataFrame:
    """A supplier's own price of a part, else the shared one, also as a sample number."""
    li = table(spark, folder, "lineitem")
    own = li.where("l_quantity > 25").groupBy("l_suppkey", "l_partkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    shared = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("price"))
    found = al.first_given(li.select("l_suppkey", "l_partkey").distinct(), own, shared, ["l_suppkey", "l_partkey"], ["l_partkey"], "price")
    return rounded(found.withColumn("sample", F.rint(F.col("price") * 100).cast("long")), "price")


@query(f"""WITH {EV} SELECT a.user_id, a.event_id, string_agg(b.event_type, ',' ORDER BY b.us, b.event_type) AS context FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.us BETWEEN a.us - 86400000000 AND a.us GROUP BY ALL""")
def day_of_context(spark: SparkSession, folder: str) -> DataFrame:
    """The types of a user's events in the day up to each one."""
    ev = al.context(events(spark, folder), ["user_id"], "us", "event_type", 86_400_000_000)
    return ev.select("user_id", "event_id", F.array_join("context", ",").alias("context"))


@query(f"""WITH {EV}, h AS (SELECT p.user_id, j.pos - p.i AS at_, count(*) AS hits FROM (SELECT user_id, event_type, n - pos AS i0, pos - (n - 8) AS i FROM ev WHERE pos > n - 8) p JOIN ev j USING (user_id, event_type) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, at_) AS r FROM h), n AS (SELECT user_id, least(8, max(n)) AS k FROM ev GROUP BY user_id)
SELECT user_id, CAST(at_ AS INTEGER) AS start, hits, round(hits / k::DOUBLE, 6) AS share FROM b JOIN n USING (user_id) WHERE r = 1""")
def best_matching_span(spark: SparkSession, folder: str) -> DataFrame:
    """Where each user's last 8 event types fit best among all."""
    ev = events(spark, folder)
    pattern = ev.where("pos > n - 8").select("user_id", (F.col("pos") - (F.col("n") - 8)).alias("pos"), "event_type")
    found = al.best_span(pattern, ev.select("user_id", "pos", "event_type"), ["user_id"], "pos", "event_type")
    return rounded(found.withColumn("start", F.col("start").cast("int")), "share")


@query()
def greedy_word_match(spark: SparkSession, folder: str) -> DataFrame:
    """The words of a user's odd days against those of even ones: event types in order, up to 8 places ahead."""
    ev = events(spark, folder).select("user_id", "pos", F.pmod(F.floor(F.col("rel") / F.lit(86400000000.0)), F.lit(2)).cast("int").alias("side"), "event_type")
    return al.greedy_align(ev, ["user_id"], "side", "pos", "event_type")


@query(f"""WITH {EV}, i AS (SELECT user_id, event_type, coalesce(lead(rel) OVER (PARTITION BY user_id ORDER BY pos), rel) - rel AS d FROM ev), s AS (SELECT user_id, sum(d) AS whole FROM i GROUP BY user_id)
SELECT user_id, round(sum(d) FILTER (WHERE event_type = 'click') / max(whole), 6) AS click, round(sum(d) FILTER (WHERE event_type = 'view') / max(whole), 6) AS view, round(sum(d) FILTER (WHERE event_type NOT IN ('click', 'view')) / max(whole), 6) AS other FROM i JOIN s USING (user_id) WHERE whole > 0 GROUP BY user_id""")
def level_occupancy(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each user's time by the type of the event that began it."""
    w = Window.partitionBy("user_id").orderBy("pos")
    pieces = events(spark, folder).select("user_id", "event_type", F.col("rel").alias("on"), F.coalesce(F.lead("rel").over(w), F.col("rel")).alias("off"))
    return rounded(al.occupancy(pieces, ["user_id"], "event_type", ["click", "view"], "on", "off"), "click", "view", "other")


@query(f"""WITH {EV} SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE pos = 1) AS first FROM ev GROUP BY event_type""")
def level_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Users that have a type at all, and those that begin with it."""
    return events(spark, folder).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("pos") == 1).alias("first"))


@query(f"""WITH {EV}, a AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS g, count(DISTINCT event_type) AS points FROM ev WHERE pos <= 12 GROUP BY user_id),
c AS (SELECT g FROM a GROUP BY g ORDER BY count(*) DESC LIMIT 1) SELECT user_id, points, g = (SELECT g FROM c) AS same FROM a""")
def axis_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Users whose first 12 events have the types that most users' have."""
    return al.same_axis(events(spark, folder).where("pos <= 12"), ["user_id"], "event_type")


@query(f"""WITH {SCORES}, e AS (SELECT f AS family, t AS time, 100 AS n FROM (SELECT DISTINCT family AS f FROM scores), range(1, 14) r(t)), o AS (SELECT family, time, count(DISTINCT subject) AS n FROM scores GROUP BY ALL)
SELECT family, CAST(coalesce(e.time, o.time) AS INTEGER) AS time, CAST(e.n AS BIGINT) AS expected, o.n AS found, CASE WHEN o.n IS NULL THEN 'missing' WHEN e.n IS NULL THEN 'extra' WHEN e.n <> o.n THEN 'size' END AS problem FROM e FULL JOIN o USING (family, time)""")
def cell_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Expected cells of subjects by family and month, 13 of them, against those there are."""
    s = scores(spark, folder)
    expected = s.select("family").distinct().select("family", F.explode(F.sequence(F.lit(1), F.lit(13))).alias("time"), F.lit(100).cast("long").alias("n"))
    return al.inventory(expected, s.groupBy("family", "time").agg(F.count_distinct("subject").alias("n")), ["family", "time"], "n")


@query("""WITH a AS (SELECT month(l_shipdate) * 1.5 AS t, month(l_shipdate) AS i FROM lineitem GROUP BY ALL), w AS (SELECT DISTINCT l_quantity * 0.4 AS t FROM lineitem),
d AS (SELECT w.t, i, abs(a.t - w.t) AS d FROM w, a WHERE w.t BETWEEN (SELECT min(t) FROM a) AND (SELECT max(t) FROM a))
SELECT DISTINCT arg_min(i, row(d, i)) AS i FROM d GROUP BY t""")
def nearest_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of a short axis that are nearest to the wanted times."""
    li = table(spark, folder, "lineitem")
    axis = li.select(F.month("l_shipdate").alias("i")).distinct().select((F.col("i") * 1.5).alias("t"), F.col("i").cast("long").alias("i"))
    return al.nearest_sample(li.select((F.col("l_quantity") * 0.4).alias("t")).distinct(), axis, "t", "i")


@query("""WITH c AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS orders, sum(o_totalprice) AS total, avg(o_totalprice) AS mean FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
l AS (SELECT c_custkey, 'balance' AS score, c_acctbal AS x FROM c UNION ALL SELECT c_custkey, 'orders', orders FROM c WHERE orders > 0), r AS (SELECT c_custkey, 'total' AS behaviour, total AS y FROM c WHERE total IS NOT NULL UNION ALL SELECT c_custkey, 'mean', mean FROM c WHERE mean IS NOT NULL),
b AS (SELECT score, behaviour, rank() OVER (PARTITION BY score, behaviour ORDER BY x) + (count(*) OVER (PARTITION BY score, behaviour, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY score, behaviour ORDER BY y) + (count(*) OVER (PARTITION BY score, behaviour, y) - 1) / 2.0 AS ry FROM l JOIN r USING (c_custkey))
SELECT score, behaviour, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM b GROUP BY ALL""")
def correlation_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every score of a customer against every behaviour, by rank."""
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean"))
    c = table(spark, folder, "customer").join(o, "c_custkey", "left").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("orders").cast("double").alias("orders"), "total", "mean")
    return rounded(al.rank_grid(al.long_metrics(c, ["c_custkey"], ["balance", "orders"], "metric", "value"), al.long_metrics(c, ["c_custkey"], ["total", "mean"], "metric", "value"), "c_custkey", 6), "rho")


@query(f"""WITH {SCORES} SELECT family, time, count(score) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(avg((score > 25)::INT), 6) AS above FROM scores GROUP BY ALL""")
def column_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = scores(spark, folder)
    some = s.groupBy("family", "time").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.avg((F.col("score") > 25).cast("int")).alias("above"))
    return rounded(some.join(agg.quantiles(s, ["family", "time"], "score", {"median": 0.5}), ["family", "time"]), "mean", "median", "above")


@query(f"""WITH {SCORES}, f AS (SELECT family, time, median(score) AS floor, quantile_cont(score, 0.95) AS p95, avg(score) AS null_mean FROM scores WHERE NOT valid GROUP BY ALL), o AS (SELECT family, time, avg(score) AS observed FROM scores WHERE valid GROUP BY ALL)
SELECT family, time, family || '_' || lpad(time::VARCHAR, 2, '0') AS name, round(floor, 6) AS floor, round(p95, 6) AS p95, round(null_mean, 6) AS null_mean, round(observed, 6) AS observed FROM f LEFT JOIN o USING (family, time)""")
def column_null_floor(spark: SparkSession, folder: str) -> DataFrame:
    """Null floors of each column, its name, and the observed mean beside them."""
    s = scores(spark, folder)
    floor = agg.null_floor(s.where("not valid"), ["family", "time"], "score").select("family", "time", F.col("median").alias("floor"), "p95", F.col("mean").alias("null_mean"))
    observed = s.where("valid").groupBy("family", "time").agg(F.avg("score").alias("observed"))
    name = F.concat_ws("_", "family", F.lpad(F.col("time").cast("string"), 2, "0")).alias("name")
    return rounded(floor.join(observed, ["family", "time"], "left").select("family", "time", name, "floor", "p95", "null_mean", "observed"), "floor", "p95", "null_mean", "observed")


@query(f"""WITH {SCORES}, h AS (SELECT subject, split, avg(score) FILTER (WHERE family = 'A') AS a, avg(score) FILTER (WHERE family = 'N') AS n, avg(score) FILTER (WHERE family = 'R') AS r FROM scores GROUP BY ALL)
SELECT split, round(avg((least(a, n, r) < 24)::INT), 6) AS share, count(*) AS n FROM h GROUP BY split""")
def least_half_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of subjects whose least family mean is below 24, by split."""
    wide = scores(spark, folder).groupBy("subject", "split").pivot("family", ["A", "N", "R"]).agg(F.avg("score"))
    return rounded(wide.groupBy("split").agg(F.avg((F.least("A", "N", "R") < 24).cast("int")).alias("share"), F.count("*").alias("n")), "share")


@query("""SELECT page_id, sha256(html) AS digest, strlen(html) AS n_bytes FROM pages""")
def page_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Checksums that tell whether a source is the one that was used."""
    p = table(spark, folder, "pages")
    return p.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"))


@query("""WITH k AS (SELECT c_nationkey AS g, avg((c_acctbal > 0)::INT) AS keep FROM customer GROUP BY g), s AS (SELECT g, keep, arg_min(c_name, c_custkey) AS first FROM customer JOIN k ON c_nationkey = g WHERE keep >= 0.9 GROUP BY ALL)
SELECT g, round(keep, 6) AS keep, first FROM s""")
def kept_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups that keep 0.9 or more of their rows, with their first row's name."""
    c = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.avg((F.col("c_acctbal") > 0).cast("int")).alias("keep"), F.min_by("c_name", "c_custkey").alias("first"))
    return rounded(c.where("keep >= 0.9"), "keep")


@query("""WITH l AS (SELECT l_suppkey AS s, avg(l_quantity) AS a, sum(l_tax) AS b FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), r AS (SELECT l_suppkey AS s, avg(l_quantity) AS a, sum(l_tax) AS b FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1)
SELECT s, round(l.a, 6) AS L_a, round(l.b, 6) AS L_b, round(r.a, 6) AS R_a, round(r.b, 6) AS R_b FROM l JOIN r USING (s)""")
def prefixed_join(spark: SparkSession, folder: str) -> DataFrame:
    """Two sides of one measure side by side, their columns told apart by a prefix."""
    side = lambda cond, p: table(spark, folder, "lineitem").where(cond).groupBy(F.col("l_suppkey").alias("s")).agg(F.avg("l_quantity").alias(f"{p}_a"), F.sum("l_tax").alias(f"{p}_b"))
    return rounded(side("l_linestatus = 'F'", "L").join(side("l_linestatus <> 'F'", "R"), "s"), "L_a", "L_b", "R_a", "R_b")


@query(f"""WITH {EV}, l AS (SELECT user_id, regr_slope(value, pos) AS b, avg(pos) AS x, avg(value) AS y FROM ev GROUP BY user_id),
r AS (SELECT event_type, max(abs(value)) AS raw, max(abs(value - coalesce(b, 0) * (pos - x))) AS rest FROM ev JOIN l USING (user_id) GROUP BY event_type)
SELECT event_type, round(raw, 6) AS raw, round(rest, 6) AS rest, round(100 * (rest - raw) / raw, 6) AS change, rest < raw / 2 AS fell FROM r""")
def raw_against_residual(spark: SparkSession, folder: str) -> DataFrame:
    """Peaks before and after the drift is taken out, the change in per cent, and whether it is over half."""
    from ..operators.signals import drift_residual

    ev = drift_residual(events(spark, folder), ["user_id"], "pos", "value")
    mean = F.avg("value").over(Window.partitionBy("user_id"))
    ev = ev.withColumn("flat", F.col("residual") + mean)
    r = ev.groupBy("event_type").agg(F.max(F.abs("value")).alias("raw"), F.max(F.abs("flat")).alias("rest"))
    return rounded(r.select("*", (100 * (F.col("rest") - F.col("raw")) / F.col("raw")).alias("change"), (F.col("rest") < F.col("raw") / 2).alias("fell")), "raw", "rest", "change")


@query(f"""WITH {EV} SELECT user_id, CAST(pos AS INTEGER) AS n, round(rel / 1e6, 3) AS "on", round(coalesce(lead(rel) OVER (PARTITION BY user_id ORDER BY pos), rel) / 1e6, 3) AS off, event_type AS label FROM ev""")
def textgrid_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events written as an annotation tier, long form for even users and short for odd ones, and read back."""
    w = Window.partitionBy("user_id").orderBy("pos")
    ev = events(spark, folder).select("user_id", "pos", "event_type", F.col("rel").alias("a"), F.coalesce(F.lead("rel").over(w), F.col("rel")).alias("b"))
    at = lambda c: F.format_string("%.3f", F.col(c) / 1e6)
    long_row = F.format_string('intervals [%d]:\nxmin = %s\nxmax = %s\ntext = "%s"\n', "pos", at("a"), at("b"), "event_type")
    row = F.when(F.col("user_id") % 2 == 0, long_row).otherwise(F.format_string('%s\n%s\n"%s"\n', at("a"), at("b"), "event_type"))
    rows = ev.select("user_id", F.struct("pos", row.alias("row")).alias("r")).groupBy("user_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    body, n = F.array_join(F.transform("r", lambda x: x["row"]), ""), F.size("r")
    long_head = F.format_string('class = "IntervalTier"\nname = "events"\nxmin = 0\nxmax = 1\nintervals: size = %d\n', n)
    short_head = F.format_string('"IntervalTier"\n"events"\n0\n1\n%d\n', n)
    files = rows.select("user_id", F.concat(F.when(F.col("user_id") % 2 == 0, long_head).otherwise(short_head), body).alias("content"))
    return al.textgrid_intervals(files, "content", "events").select("user_id", "n", "on", "off", "label")


@query(f"""WITH {SCORES}, j AS (SELECT subject, family, time, avg(score) AS v, count(*) AS n FROM scores GROUP BY ALL), f AS (SELECT subject, list(v ORDER BY family, time) AS a FROM j GROUP BY subject), g AS (SELECT subject, list(n::DOUBLE ORDER BY family, time) AS b FROM j GROUP BY subject)
SELECT subject, len(list_concat(a, b)) AS width, round(list_sum(list_concat(a, b)), 4) AS total FROM f JOIN g USING (subject)""")
def joint_design(spark: SparkSession, folder: str) -> DataFrame:
    """Two blocks of features of a subject, each in order of family and time, as one row."""
    j = scores(spark, folder).groupBy("subject", "family", "time").agg(F.avg("score").alias("v"), F.count("*").cast("double").alias("n"))
    block = lambda c, out: j.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("family", "time", c))), lambda s: s[c]).alias(out))
    both = block("v", "a").join(block("n", "b"), "subject").withColumn("x", F.concat("a", "b"))
    return both.select("subject", F.size("x").cast("long").alias("width"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query(f"""WITH {EV}, i AS (SELECT DISTINCT left(event_type, k) AS e FROM ev, range(1, 4) r(k)), c AS (SELECT DISTINCT event_type FROM ev)
SELECT event_type, (SELECT arg_max(e, length(e)) FROM i WHERE starts_with(event_type, e)) AS canonical, (SELECT count(*) FROM ev x WHERE x.event_type = c.event_type) AS n FROM c""")
def canonical_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """The longest entry of an inventory that each type begins with."""
    ev = events(spark, folder)
    inventory = ev.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.left("event_type", k))).alias("e")).distinct()
    return al.canonical(ev.groupBy("event_type").agg(F.count("*").alias("n")), "event_type", inventory, "e")


@query("""WITH o AS (SELECT page_id, sha256(html) AS digest FROM pages WHERE page_id % 7 <> 0), n AS (SELECT page_id, sha256(CASE WHEN page_id % 5 = 0 THEN html || ' ' ELSE html END) AS digest FROM pages)
SELECT page_id, CASE WHEN o.digest IS NULL THEN 'new' ELSE 'changed' END AS reason FROM n LEFT JOIN o USING (page_id) WHERE o.digest IS DISTINCT FROM n.digest""")
def stale_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose checksum isn't the one on record."""
    p = table(spark, folder, "pages")
    record = p.where("page_id % 7 <> 0").select("page_id", F.sha2("html", 256).alias("digest"))
    now = p.select("page_id", F.sha2(F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")), 256).alias("digest"))
    return stale(record, now, ["page_id"], "digest")


@query()
def contrast_p_values(spark: SparkSession, folder: str) -> DataFrame:
    """Urgent orders against others by status: Welch's t with its degrees of freedom and p, and the rank-sum test."""
    o = table(spark, folder, "orders").select("o_orderstatus", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.col("o_totalprice").alias("x"))
    welch = dist.welch_test(o, ["o_orderstatus"], F.col("urgent"), "x")
    ranks = dist.rank_sum_test(o, ["o_orderstatus"], F.col("urgent"), "x")
    return rounded(welch.join(ranks, "o_orderstatus"), "t", "df", "p", "u", "p_ranks")
