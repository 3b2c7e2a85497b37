"""Queries on classes and residuals out of fold, filters, components, trees and word vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators import decoding as dec
from ..operators import permutation as perm
from ..operators import sequences, signals
from ..sources.tables import table
from .inference import HALF_SQL
from .registry import EV, events, query, rounded

ROLES = ["assistant", "system", "user"]
REPS = 200

#: Chances of each role by length of the turn in steps of 40 characters, from smoothed counts.
CHANCES = f"""t AS (SELECT conv_id * 1000 + turn AS id, role, CAST(floor(length(text) / 40) AS BIGINT) AS step FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL),
c AS (SELECT step, {", ".join(f"(count(*) FILTER (WHERE role = '{r}') + 1.0) / (count(*) + {len(ROLES)})::DOUBLE AS p{k}" for k, r in enumerate(ROLES))} FROM t GROUP BY step),
ps AS (SELECT id, CASE role {" ".join(f"WHEN '{r}' THEN {k}" for k, r in enumerate(ROLES))} END AS y, {", ".join(f"p{k}" for k in range(len(ROLES)))} FROM t JOIN c USING (step))"""


def _chances(spark: SparkSession, folder: str) -> DataFrame:
    """As CHANCES: id, role, probability."""
    t = table(spark, folder, "conversations").where("role is not null and text is not null")
    t = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.floor(F.char_length("text") / 40).alias("step"))
    p = F.array(*[(F.count_if(F.col("role") == r) + 1.0) / (F.count("*") + len(ROLES)) for r in ROLES])
    return t.join(t.groupBy("step").agg(p.alias("probability")), "step")


@query()
def grouped_class_prediction(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of embeddings by a multinomial logit out of fold: scores by fold. The labels are those of the table, in order."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    # One row a class: the number of classes bounds it.
    levels = [r.label for r in rows.where("label is not null").select("label").distinct().orderBy("label").collect()]
    found = dec.grouped_logit(rows, "vec_id", "embedding", "label", levels)
    return rounded(dec.class_scores(found, ["fold"], "label", levels, "probability"), "log_loss", "log_loss_prior", "brier", "accuracy")


@query(f"""WITH {CHANCES}, s AS (SELECT y, CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p, ({" + ".join(f"power((y = {k})::INT - p{k}, 2)" for k in range(3))}) / 3 AS gap,
    CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS best FROM ps WHERE y IS NOT NULL),
g AS (SELECT y, count(*) / (SELECT count(*) FROM s)::DOUBLE AS q FROM s GROUP BY y)
SELECT count(*) AS n, round(avg(-ln(p)), 6) AS log_loss, (SELECT round(sum(-q * ln(q)), 6) FROM g) AS log_loss_prior, round(avg(gap), 6) AS brier, round(avg((best = y)::INT), 6) AS accuracy FROM s""")
def class_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log loss, Brier score and accuracy of the roles' chances."""
    return rounded(dec.class_scores(_chances(spark, folder), [], "role", ROLES, "probability"), "log_loss", "log_loss_prior", "brier", "accuracy")


@query(f"""WITH {CHANCES}, k AS (SELECT * FROM ps WHERE y IS NOT NULL),
sorted AS (SELECT y, row_number() OVER (ORDER BY y) AS at_ FROM k),
dealt AS (SELECT rep, p0, p1, p2, y, row_number() OVER (PARTITION BY rep ORDER BY md5('deal|' || rep || '|' || id)[1:8], id) AS at_ FROM k, range(0, {REPS + 1}) r(rep)),
l AS (SELECT rep, avg(-ln(CASE CASE WHEN rep = 0 THEN dealt.y ELSE sorted.y END WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) AS loss FROM dealt JOIN sorted USING (at_) GROUP BY rep),
o AS (SELECT loss AS o FROM l WHERE rep = 0)
SELECT round(max(o), 6) AS log_loss, round(avg(loss) FILTER (WHERE rep > 0), 6) AS shuffled, round((1 + count(*) FILTER (WHERE rep > 0 AND loss <= o + 1e-9)) / {REPS + 1}.0::DOUBLE, 6) AS p FROM l, o""")
def class_shuffle_test(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the roles' chances beat roles dealt anew among all turns."""
    losses = dec.shuffled_losses(_chances(spark, folder), "id", "role", ROLES, "probability", REPS)
    return rounded(dec.shuffled_p(losses), "log_loss", "shuffled", "p")


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity - avg(l_quantity) OVER w AS a, (l_extendedprice - avg(l_extendedprice) OVER w) / 1000 AS b FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)),
c AS (SELECT var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab FROM m),
s AS (SELECT 0.9 * aa + 0.05 * (aa + bb) AS aa, 0.9 * bb + 0.05 * (aa + bb) AS bb, 0.9 * ab AS ab FROM c),
d AS (SELECT l_orderkey, l_linenumber, (bb * a * a - 2 * ab * a * b + aa * b * b) / (aa * bb - ab * ab) AS distance, ln(aa * bb - ab * ab) + 2 * ln(2 * pi()) AS size FROM m, s)
SELECT l_orderkey, l_linenumber, round(distance, 6) AS distance, round((distance + size) / 2, 6) AS surprise FROM d""")
def residual_distance(spark: SparkSession, folder: str) -> DataFrame:
    """How far each line item's quantity and price lie from their means by return flag, in a shrunk covariance."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    means = li.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("_q"), F.avg("l_extendedprice").alias("_p"))
    gaps = li.join(means, "l_returnflag").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - F.col("_q")).alias("a"), ((F.col("l_extendedprice") - F.col("_p")) / 1000).alias("b"))
    return rounded(dec.shrunk_distance(gaps, ["a", "b"]).drop("a", "b"), "distance", "surprise")


@query("""WITH b AS (SELECT CAST(floor(('0x' || md5('bucket|' || l_orderkey)[1:8])::BIGINT / 4294967296.0::DOUBLE * 64) AS INTEGER) AS bucket, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
o AS (SELECT split, bucket, row_number() OVER (PARTITION BY split ORDER BY md5('half|' || split || '|' || bucket), bucket) AS at_ FROM range(0, 40) s(split), range(0, 64) q(bucket)),
z AS (SELECT bucket, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y FROM b),
t AS (SELECT bucket, count(*) AS n, sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c FROM z GROUP BY bucket),
h AS (SELECT split, (at_ > 32)::INT AS half, sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM t JOIN o USING (bucket) GROUP BY ALL)
SELECT CAST(split AS INTEGER) AS split, half, CAST(n AS BIGINT) AS n, round(sqrt((a + c + sqrt(power(a - c, 2) + 4 * b * b)) / (a + c - sqrt(power(a - c, 2) + 4 * b * b))), 6) AS condition FROM h""")
def half_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """Condition of quantity and price in 40 random halves of the orders."""
    li = table(spark, folder, "lineitem").select("l_orderkey", F.array("l_quantity", F.col("l_extendedprice") / 1000).alias("x"))
    return rounded(dec.half_conditions(li, "l_orderkey", "x"), "condition")


@query("""WITH z AS (SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS a, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER () AS b FROM lineitem),
r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, round((a + sign(r) * b) / sqrt(2 * (1 + abs(r))), 5) AS score FROM z, r""")
def stimulus_components(spark: SparkSession, folder: str) -> DataFrame:
    """First principal component of standardised quantity and price."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_extendedprice").alias("x"))
    found = signals.standardised_components(li, "x", 1)
    return found.select("l_orderkey", "l_linenumber", F.round(F.col("components")[0], 5).alias("score"))


TAPS = signals.bandpass_taps(1.0, 0.05, 0.2, 24)


@query(f"""WITH {EV}, taps AS (SELECT unnest(range(-24, 25)) AS j, unnest([{", ".join(repr(float(t)) for t in TAPS)}]) AS h),
p AS (SELECT user_id, pos - 1 AS at_, n, value FROM ev), c AS (SELECT user_id, at_ AS to_, value FROM p UNION ALL SELECT user_id, -1 - at_, value FROM p UNION ALL SELECT user_id, 2 * n - 1 - at_, value FROM p)
SELECT p.user_id, p.at_ + 1 AS pos, round(sum(coalesce(c.value, 0) * h), 6) AS filtered FROM p JOIN taps ON true JOIN c ON c.user_id = p.user_id AND c.to_ = p.at_ + j GROUP BY ALL""")
def bandpass_events(spark: SparkSession, folder: str) -> DataFrame:
    """Slow waves of each user's values over the order of the events."""
    return rounded(signals.bandpass(events(spark, folder), ["user_id"], "pos", "value", TAPS), "filtered")


@query("""WITH s AS (SELECT vec_id, unnest(range(1, len(embedding) // 2 + 1)) AS place, unnest(embedding[:len(embedding) // 2])::DOUBLE AS a, unnest(embedding[len(embedding) // 2 + 1:])::DOUBLE AS b FROM embeddings),
m AS (SELECT vec_id, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab FROM s GROUP BY vec_id),
e AS (SELECT *, (aa + bb + sqrt(power(aa - bb, 2) + 4 * ab * ab)) / 2 AS l FROM m), v AS (SELECT *, CASE WHEN aa >= bb THEN l - bb ELSE ab END AS va, CASE WHEN aa >= bb THEN ab ELSE l - aa END AS vb FROM e)
SELECT vec_id, place, round(((a - ma) * va + (b - mb) * vb) / sqrt(va * va + vb * vb) / sqrt(l), 5) AS score FROM s JOIN v USING (vec_id)""")
def window_components(spark: SparkSession, folder: str) -> DataFrame:
    """Both halves of each embedding as one, on their first component."""
    found = signals.window_components(table(spark, folder, "embeddings").select("vec_id", "embedding"), "embedding", 2)
    return found.select("vec_id", F.posexplode("component").alias("place", "score")).select("vec_id", (F.col("place") + 1).cast("long").alias("place"), F.round("score", 5).alias("score"))


@query("""WITH x AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '[()]', ' ', 'g'), '</[a-z0-9]+>', ' ) ', 'g'), '<([a-z0-9]+)[^>]*>', ' (\\1 ', 'g') AS t FROM pages),
k AS (SELECT page_id, unnest(regexp_extract_all(t, '[()]|[^ \\t\\r\\n()]+')) AS t, unnest(range(0, len(regexp_extract_all(t, '[()]|[^ \\t\\r\\n()]+')))) AS i FROM x),
l AS (SELECT *, t NOT IN ('(', ')') AND coalesce(lag(t) OVER w, '') <> '(' AS word, sum(CASE t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS s, sum((t = '(')::INT) OVER w AS o, sum((t <> ')')::INT) OVER w AS run FROM k WINDOW w AS (PARTITION BY page_id ORDER BY i)),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS depth, count(*) FILTER (WHERE t = ')') OVER (PARTITION BY page_id, run) AS closing FROM l)
SELECT page_id, row_number() OVER w - 1 AS place, t AS word, CAST(o - coalesce(lag(o) OVER w, 0) AS BIGINT) AS n_opening, closing AS n_closing, CAST(greatest(0, depth - closing) + closing AS BIGINT) AS depth, CAST(greatest(0, depth - closing) AS BIGINT) AS n_open_nodes,
(row_number() OVER w - 1) / greatest(count(*) OVER (PARTITION BY page_id) - 1, 1)::DOUBLE AS linear_order, row_number() OVER w = count(*) OVER (PARTITION BY page_id) AS is_end FROM d WHERE word WINDOW w AS (PARTITION BY page_id ORDER BY i)""")
def tree_terminals(spark: SparkSession, folder: str) -> DataFrame:
    """The words of pages in the tree of their elements: how deep they are, what opens before and closes after them."""
    plain = F.regexp_replace("html", "[()]", " ")
    trees = F.regexp_replace(F.regexp_replace(plain, "</[a-z0-9]+>", " ) "), "<([a-z0-9]+)[^>]*>", " ($1 ")
    found = al.bracket_terminals(table(spark, folder, "pages").select("page_id", trees.alias("tree")), ["page_id"], "tree")
    return found.withColumn("place", F.col("place").cast("long"))


@query("""SELECT CAST(vec_id AS VARCHAR) AS word, CAST(len(embedding) AS INTEGER) AS width, round(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 6) AS size
FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part WHERE p_size > 10) AND len(embedding) = 64""")
def vocabulary_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors read from lines of text, for the words of a vocabulary."""
    lines = table(spark, folder, "embeddings").select("vec_id", F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.col("embedding").cast("array<string>"), " ")).alias("line"))
    words = table(spark, folder, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("word"))
    found = al.word_vectors(lines, "line", "vec_id", words, "word", 64)
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return rounded(found.select("word", F.size("vector").alias("width"), size.alias("size")), "size")


@query(f"""WITH {EV}, {HALF_SQL}, e AS (SELECT *, round_even(b * n / 8.0, 0) AS edge FROM (SELECT DISTINCT user_id, n FROM ev), range(0, 8) q(b)),
p AS (SELECT ev.*, (SELECT count(*) FROM e WHERE e.user_id = ev.user_id AND edge < pos) AS block, EXISTS (SELECT 1 FROM e WHERE e.user_id = ev.user_id AND b > 0 AND (abs(pos - edge) <= 3 OR abs(pos - edge - 1) <= 3)) AS near FROM ev)
SELECT CAST(split AS INTEGER) AS split, half, count(*) AS n, round(avg(value), 6) AS mean FROM p JOIN rows_ USING (block) WHERE NOT near GROUP BY ALL""")
def guarded_half_means(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced half-assignments of each user's events, without those within 3 places of a block's edge."""
    ev = events(spark, folder).where(~sequences.near_edge(F.col("pos"), F.col("n"), 8, 3)).withColumn("block", sequences.block_id(F.col("pos"), F.col("n"), 8))
    halves = perm.assignment_rows(spark, ["events"]).drop("section")
    return rounded(ev.join(F.broadcast(halves), "block").groupBy("split", "half").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")
