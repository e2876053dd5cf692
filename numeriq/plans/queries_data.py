"""Queries: preprocessing, metrics, sequences, sets and precision formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats as fmt
from ..operators import metrics, prep, sequences
from . import tuner
from .registry import query, read
from .tuner import format_counts, runtime_summary, sweep

KEY = ["l_orderkey", "l_linenumber"]


def lineitem(spark, sf_dir):
    return read(spark, sf_dir, "lineitem")


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- preprocessing ----------------------------------------------------------------------------------------------------


def scaled_sql(mean, dev, value="({c} - {m}) / {d}"):
    cs = ["l_quantity", "l_extendedprice", "l_discount"]
    stats = ", ".join(f"{mean.format(c=c)} AS m_{c}, {dev.format(c=c)} AS d_{c}" for c in cs)
    cols = ", ".join(f"round({value.format(c=c, m='m_' + c, d='d_' + c)}, 6) AS {c}" for c in cs)
    return f"WITH s AS (SELECT {stats} FROM lineitem) SELECT l_orderkey, l_linenumber, {cols} FROM lineitem, s"


@query(scaled_sql("avg({c})", "greatest(stddev_pop({c}), 1e-9)"))
def standard_scale(spark, sf_dir):
    c = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(prep.standard_scale(lineitem(spark, sf_dir).select(*KEY, *c), c), c)


@query(scaled_sql("avg({c})", "CASE WHEN stddev_samp({c}) < 1e-10 THEN 1 ELSE stddev_samp({c}) END"))
def sample_scale(spark, sf_dir):
    c = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(prep.sample_scale(lineitem(spark, sf_dir).select(*KEY, *c), c), c)


@query(scaled_sql("avg({c}) FILTER ({c} <> 0)", "greatest(stddev_pop({c}) FILTER ({c} <> 0), 1e-9)", "CASE WHEN {c} <> 0 THEN ({c} - {m}) / {d} ELSE 0 END"))
def sparse_scale(spark, sf_dir):
    c = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(prep.sparse_scale(lineitem(spark, sf_dir).select(*KEY, *c), c), c)


@query("SELECT l_orderkey, l_linenumber, round(l_quantity - (SELECT avg(l_quantity) FROM lineitem), 6) AS l_quantity FROM lineitem")
def center_columns(spark, sf_dir):
    return rounded(prep.center(lineitem(spark, sf_dir).select(*KEY, "l_quantity"), ["l_quantity"]), ["l_quantity"])


@query("""SELECT f AS feature, round(sum(x) / count(*), 8) AS mean, round(sqrt(sum(x * x) / count(*) - pow(sum(x) / count(*), 2)), 8) AS deviation FROM (
  SELECT 'l_tax' AS f, nullif(l_tax, 0) AS x FROM lineitem UNION ALL SELECT 'l_discount', nullif(l_discount, 0) FROM lineitem) GROUP BY f""")
def missing_aware_stats(spark, sf_dir):
    df = lineitem(spark, sf_dir).select(F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    return rounded(prep.missing_aware_stats(df, ["l_tax", "l_discount"]), ["mean", "deviation"], 8)


@query("SELECT l_orderkey, l_linenumber, round(coalesce(nullif(l_tax, 0), (SELECT avg(nullif(l_tax, 0)) FROM lineitem)), 8) AS l_tax FROM lineitem")
def fill_missing_mean(spark, sf_dir):
    df = lineitem(spark, sf_dir).select(*KEY, F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return rounded(prep.fill_missing(df, ["l_tax"]), ["l_tax"], 8)


@query("SELECT o_orderkey, round(CASE WHEN o_totalprice > 0 THEN ln(o_totalprice + 1e-10) ELSE o_totalprice END, 8) AS o_totalprice FROM orders")
def log_transform(spark, sf_dir):
    return rounded(prep.log_transform(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), ["o_totalprice"], 8)


@query("""WITH s AS (SELECT avg(l_extendedprice) AS m, greatest(stddev_pop(l_extendedprice), 1e-9) AS d, avg(l_quantity) AS m2, greatest(stddev_pop(l_quantity), 1e-9) AS d2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, s WHERE abs(l_extendedprice - m) / d <= 1.5 AND abs(l_quantity - m2) / d2 <= 1.5""")
def drop_outliers(spark, sf_dir):
    return prep.drop_outliers(lineitem(spark, sf_dir).select(*KEY, "l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"], 1.5).drop("l_quantity")


@query("SELECT o_orderkey, o_orderkey <= (SELECT quantile_disc(o_orderkey, 0.8) FROM orders) AS train FROM orders")
def ordered_split(spark, sf_dir):
    return prep.ordered_split(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, ((o_orderkey * 1103515245 + 12345) % 2147483648) / 2147483648.0 < 0.8 AS train FROM orders")
def hash_split(spark, sf_dir):
    return prep.hash_split(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings")
def vectors_to_coordinates(spark, sf_dir):
    return prep.to_coordinates(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("""SELECT l_suppkey AS i, sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END) AS c1, sum(CASE WHEN l_linenumber = 2 THEN l_quantity ELSE 0 END) AS c2,
  CAST(0 AS DOUBLE) AS c0 FROM lineitem GROUP BY 1""")
def coordinates_to_dense(spark, sf_dir):
    a = lineitem(spark, sf_dir).groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.sum("l_quantity").alias("v"))
    return prep.to_dense(a, 3)


# --- metrics ----------------------------------------------------------------------------------------------------------


@query("SELECT source, round(-sum(n / t * log2(n / t)), 8) AS entropy FROM (SELECT source, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER (PARTITION BY source) AS t FROM documents GROUP BY source, lang) GROUP BY source")
def label_entropy(spark, sf_dir):
    return rounded(metrics.entropy(read(spark, sf_dir, "documents"), "lang", ["source"]), ["entropy"], 8)


@query("SELECT source, round(1 - sum(n / t * (n / t)), 8) AS gini FROM (SELECT source, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER (PARTITION BY source) AS t FROM documents GROUP BY source, lang) GROUP BY source")
def label_gini(spark, sf_dir):
    return rounded(metrics.gini(read(spark, sf_dir, "documents"), "lang", ["source"]), ["gini"], 8)


@query("SELECT l_returnflag, round(var_pop(l_extendedprice) / 1e6, 4) AS variance FROM lineitem GROUP BY 1")
def variance_impurity(spark, sf_dir):
    return lineitem(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.var_pop("l_extendedprice") / 1e6, 4).alias("variance"))


@query("SELECT lang AS truth, source AS predicted, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def contingency_table(spark, sf_dir):
    return metrics.contingency(read(spark, sf_dir, "documents"), "lang", "source")


TABLE = "WITH n AS (SELECT lang AS t, source AS p, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY 1, 2), a AS (SELECT t, sum(n) AS a FROM n GROUP BY 1), b AS (SELECT p, sum(n) AS b FROM n GROUP BY 1), s AS (SELECT sum(n) AS s FROM n)"


@query(TABLE + """, x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS i, (SELECT sum(a * (a - 1) / 2) FROM a) AS ra, (SELECT sum(b * (b - 1) / 2) FROM b) AS rb, s * (s - 1) / 2 AS t FROM s)
SELECT round((i - ra * rb / t) / ((ra + rb) / 2 - ra * rb / t), 8) AS ari FROM x""")
def adjusted_rand_index(spark, sf_dir):
    return rounded(metrics.adjusted_rand_index(read(spark, sf_dir, "documents"), "lang", "source"), ["ari"], 8)


@query(TABLE + """, x AS (SELECT (SELECT sum(n / s * ln(n * s / (a * b))) FROM n JOIN a USING (t) JOIN b USING (p), s) AS mi, (SELECT -sum(a / s * ln(a / s)) FROM a, s) AS ha, (SELECT -sum(b / s * ln(b / s)) FROM b, s) AS hb)
SELECT round(greatest(-1, least(1, mi / ((ha + hb) / 2))), 8) AS ami FROM x""")
def mutual_information(spark, sf_dir):
    return rounded(metrics.mutual_information(read(spark, sf_dir, "documents"), "lang", "source"), ["ami"], 8)


PRICE = "WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"


def prices(spark, sf_dir):
    return lineitem(spark, sf_dir).select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))


@query(PRICE + " SELECT round(1 - sum((y - p) * (y - p)) / (sum((y - m) * (y - m)) + 1e-10), 8) AS r2 FROM x, (SELECT avg(y) AS m FROM x)")
def r2_score(spark, sf_dir):
    return rounded(metrics.r2_score(prices(spark, sf_dir), "y", "p"), ["r2"], 8)


@query(PRICE + " SELECT round(avg((y - p) * (y - p)) / 1e6, 4) AS mse, round(avg(CASE WHEN (y > 30000) = (p > 30000) THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM x")
def mse_and_accuracy(spark, sf_dir):
    return prices(spark, sf_dir).agg(F.round(metrics.mean_squared_error(F.col("y"), F.col("p")) / 1e6, 4).alias("mse"), F.round(metrics.accuracy(F.col("y") > 30000, F.col("p") > 30000), 8).alias("accuracy"))


@query(PRICE + " SELECT round(max(abs(y - p)), 6) AS max_abs, round(avg(abs(y - p)), 4) AS mean_abs, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(max(CASE WHEN abs(y) > 1e-10 THEN abs(y - p) / abs(y) END), 6) AS max_rel FROM x")
def error_metrics(spark, sf_dir):
    d = metrics.error_metrics(prices(spark, sf_dir), "y", "p")
    return d.select(F.round("max_abs", 6).alias("max_abs"), F.round("mean_abs", 4).alias("mean_abs"), F.round("rmse", 4).alias("rmse"), F.round("max_rel", 6).alias("max_rel"))


@query("""WITH x AS (SELECT n_chars AS s, toxic AS y FROM labels JOIN documents USING (doc_id)),
g AS (SELECT s, CAST(sum(y) AS DOUBLE) AS tp, CAST(sum(1 - y) AS DOUBLE) AS fp FROM x GROUP BY s),
w AS (SELECT *, coalesce(sum(tp) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
SELECT round(sum(fp * (b + tp / 2)) / (sum(tp) * sum(fp)), 8) AS auc FROM w""")
def roc_auc(spark, sf_dir):
    x = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(metrics.roc_auc(x, "n_chars", "toxic"), ["auc"], 8)


@query("""WITH x AS (SELECT label % 4 AS y, c, CAST(embedding[c + 1] AS DOUBLE) AS s FROM embeddings, generate_series(0, 3) t(c)),
g AS (SELECT c, s, CAST(count(*) FILTER (y = c) AS DOUBLE) AS tp, CAST(count(*) FILTER (y <> c) AS DOUBLE) AS fp FROM x GROUP BY c, s),
w AS (SELECT *, coalesce(sum(tp) OVER (PARTITION BY c ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
SELECT round(avg(a), 8) AS auc FROM (SELECT sum(fp * (b + tp / 2)) / (sum(tp) * sum(fp)) AS a FROM w GROUP BY c)""")
def macro_auc(spark, sf_dir):
    x = read(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("y"), F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("s"))
    return rounded(metrics.macro_auc(x, "s", "y", 4), ["auc"], 8)


# --- sequences --------------------------------------------------------------------------------------------------------


@query("SELECT event_id, round(sum(CAST(value AS DECIMAL(18, 4))) OVER (ORDER BY ts, event_id), 2)::DOUBLE AS total FROM events")
def running_total(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").cast("decimal(18,4)").alias("value"))
    return sequences.running_total(e, ["t", "event_id"], "value").select("event_id", F.round(F.col("total"), 2).cast("double").alias("total"))


@query("SELECT event_id, round(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value, 6) AS step FROM events")
def consecutive_differences(spark, sf_dir):
    return rounded(sequences.differences(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "step"), ["step"])


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY user_id), 8) AS cdf FROM events WHERE value > 0")
def cumulative_share(spark, sf_dir):
    return rounded(sequences.cumulative_share(read(spark, sf_dir, "events").filter("value > 0"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "cdf"), ["cdf"], 8)


def scan_sql(f, measure, digits=8):
    return f"""WITH r AS (SELECT CAST({f} AS DOUBLE) AS v, l_returnflag AS y FROM lineitem),
c AS (SELECT v, y, count(*) AS n FROM r GROUP BY v, y), vs AS (SELECT DISTINCT v FROM r), ys AS (SELECT DISTINCT y FROM r),
f AS (SELECT vs.v, ys.y, coalesce(n, 0) AS n FROM vs CROSS JOIN ys LEFT JOIN c ON c.v = vs.v AND c.y = ys.y),
w AS (SELECT v, y, CAST(sum(n) OVER (PARTITION BY y ORDER BY v) AS DOUBLE) AS l, CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) AS t FROM f),
g AS (SELECT v, sum(l) AS nl, sum(t) AS nt, {measure.format(c="l")} AS il, {measure.format(c="t")} AS it, {measure.format(c="(t - l)")} AS ir FROM w GROUP BY v),
h AS (SELECT *, lead(v) OVER (ORDER BY v) AS nx FROM g)
SELECT '{f}' AS feature, (v + nx) / 2 AS threshold, round(it - nl / nt * il - (nt - nl) / nt * ir, {digits}) AS gain FROM h WHERE nx IS NOT NULL"""


ENTROPY = "log2(sum({c})) - sum(CASE WHEN {c} > 0 THEN {c} * log2({c}) ELSE 0 END) / sum({c})"
GINI = "1 - sum({c} * {c}) / (sum({c}) * sum({c}))"


@query(scan_sql("l_quantity", ENTROPY).replace("log2(sum((t - l)))", "log2(greatest(sum(t - l), 1e-300))").replace("/ sum((t - l))", "/ greatest(sum(t - l), 1e-300)"))
def entropy_split_scan(spark, sf_dir):
    return rounded(sequences.split_scan(lineitem(spark, sf_dir), ["l_quantity"], "l_returnflag"), ["gain"], 8)


@query("SELECT feature, threshold, round(gain, 8) AS gain FROM (" + scan_sql("l_discount", GINI, 12).replace("/ (sum((t - l)) * sum((t - l)))", "/ greatest(sum(t - l) * sum(t - l), 1e-300)") + ") s ORDER BY s.gain DESC, threshold LIMIT 1")
def gini_best_split(spark, sf_dir):
    return rounded(sequences.best_split(sequences.split_scan(lineitem(spark, sf_dir), ["l_discount"], "l_returnflag", "gini")), ["gain"], 8)


@query("""WITH s AS (SELECT l_quantity AS v, CAST(count(*) AS DOUBLE) AS n, sum(l_extendedprice) AS s, sum(l_extendedprice * l_extendedprice) AS q FROM lineitem GROUP BY 1),
w AS (SELECT v, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(q) OVER o AS ql, sum(n) OVER () AS nt, sum(s) OVER () AS st, sum(q) OVER () AS qt, lead(v) OVER (ORDER BY v) AS nx FROM s WINDOW o AS (ORDER BY v))
SELECT 'l_quantity' AS feature, (v + nx) / 2 AS threshold, round(((qt / nt - pow(st / nt, 2)) - nl / nt * (ql / nl - pow(sl / nl, 2)) - (nt - nl) / nt * ((qt - ql) / (nt - nl) - pow((st - sl) / (nt - nl), 2))) / 1e6, 4) AS gain FROM w WHERE nx IS NOT NULL""")
def variance_split_scan(spark, sf_dir):
    return sequences.split_scan(lineitem(spark, sf_dir), ["l_quantity"], "l_extendedprice", "variance").withColumn("gain", F.round(F.col("gain") / 1e6, 4))


@query("SELECT c_nationkey, c_custkey, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) * 4 - 1) / count(*) OVER (PARTITION BY c_nationkey)) AS INTEGER) AS part FROM customer")
def contiguous_parts(spark, sf_dir):
    return sequences.contiguous_parts(read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], 4)


# --- sets -------------------------------------------------------------------------------------------------------------

SETS = """WITH u AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) FILTER (value > 50) AS a, list(DISTINCT event_type ORDER BY event_type) FILTER (value <= 50) AS b FROM events GROUP BY 1),
v AS (SELECT user_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM u)"""


@query(SETS + """ SELECT user_id, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS minus, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') AS both,
array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset FROM v""")
def set_operations(spark, sf_dir):
    sets = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(F.col("value") > 50, F.col("event_type")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("value") <= 50, F.col("event_type")))).alias("b"))
    join = lambda x: F.array_join(x, ",")
    return sets.select("user_id", join(F.array_except("a", "b")).alias("minus"), join(F.array_intersect("a", "b")).alias("both"), join(F.array_sort(F.array_union("a", "b"))).alias("either"), (F.size(F.array_except("a", "b")) == 0).alias("subset"))


@query("SELECT DISTINCT event_type FROM events")
def distinct_labels(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_type").distinct()


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def table_minus(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").exceptAll(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))).distinct()


# --- formats and tuning -----------------------------------------------------------------------------------------------


def quantize_sql(x, e, m):
    top, g = 2 ** (e - 1) - 1, f"floor(log2(abs({x})))"
    exact = f"(CASE WHEN pow(2.0, {g}) > abs({x}) THEN {g} - 1 WHEN pow(2.0, {g} + 1) <= abs({x}) THEN {g} + 1 ELSE {g} END)"
    step = f"pow(2.0, {m} - greatest({exact}, {1 - top}))"
    y = f"(round_even(CAST({x} * {step} AS DOUBLE), 0) / {step})"
    return f"CASE WHEN {x} = 0 THEN {x} WHEN abs{y} > {(2 - 2.0**-m) * 2.0**top!r} THEN sign({x}) * 'inf'::DOUBLE ELSE {y} END"


LOW = [("c", "E4M3"), ("w", "E5M2"), ("b", "BF16"), ("p", "FP16"), ("s", "FP32")]


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"{quantize_sql('l_extendedprice', *fmt.FORMATS[k][:2])} AS {n.lower()}" for k, n in LOW) + " FROM lineitem")
def quantize_prices(spark, sf_dir):
    return lineitem(spark, sf_dir).select(*KEY, *[fmt.quantize("l_extendedprice", *fmt.FORMATS[k][:2]).alias(n.lower()) for k, n in LOW])


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"abs(l_discount * 3.7 - q{k}) < abs(l_discount * 3.7) * 1e-3 OR (l_discount = 0 AND abs(q{k}) <= 1e-3) AS ok_{k}" for k, _ in LOW) + " FROM (SELECT *, " + ", ".join(f"{quantize_sql('(l_discount * 3.7)', *fmt.FORMATS[k][:2])} AS q{k}" for k, _ in LOW) + " FROM lineitem)")
def digits_kept(spark, sf_dir):
    x = F.col("l_discount") * 3.7
    return lineitem(spark, sf_dir).select(*KEY, *[fmt.within_digits(x, fmt.quantize(x, *fmt.FORMATS[k][:2]), 3).alias(f"ok_{k}") for k, _ in LOW])


@query("WITH x AS (SELECT " + ", ".join(f"{quantize_sql('o_totalprice', *fmt.FORMATS[k][:2])} AS {k}" for k, _ in LOW if k not in "cw") + ", o_totalprice AS d FROM orders) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS format, round(min(-log10(abs({k} - d) / d)) FILTER ({k} <> d AND abs({k}) < 1e300), 4) AS digits FROM x" for k, n in LOW if k not in "cw") + ")")
def least_digits_by_format(spark, sf_dir):
    each = F.array(*[F.struct(F.lit(k).alias("k"), fmt.quantize("o_totalprice", *fmt.FORMATS[k][:2]).alias("v")) for k, _ in LOW if k not in "cw"])
    x = read(spark, sf_dir, "orders").select("o_totalprice", F.explode(each).alias("x")).select("o_totalprice", "x.*")
    digits = F.when((F.col("v") != F.col("o_totalprice")) & (F.abs("v") < 1e300), fmt.correct_digits("o_totalprice", "v"))
    return x.groupBy(fmt.display_name("k").alias("format")).agg(F.round(F.min(digits), 4).alias("digits"))


def revenue(df):
    return df.groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_quantity").alias("quantity"))


@query()
def precision_sweep(spark, sf_dir):
    """Formats of three columns that keep 1 to 4 digits of grouped revenue and quantity."""
    cols = ["l_extendedprice", "l_discount", "l_quantity"]
    return sweep(lineitem(spark, sf_dir).select("l_returnflag", *cols), revenue, cols, ["l_returnflag"], ["revenue", "quantity"], range(1, 5))


@query()
def breaking_columns(spark, sf_dir):
    """What breaks four digits of grouped revenue when it is held in half precision beside what does not."""
    cols = ["l_extendedprice", "l_discount", "l_quantity"]
    found, _ = tuner.breaking_columns(lineitem(spark, sf_dir).select("l_returnflag", *cols), revenue, cols, ["l_returnflag"], ["revenue", "quantity"], 4, "h")
    return found


@query("""WITH s AS (SELECT p_brand, CASE WHEN p_size <= 15 THEN 's' WHEN p_size <= 30 THEN 'p' ELSE 'd' END AS format, p_partkey FROM part) SELECT p_brand, format, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2""")
def format_counts_by_brand(spark, sf_dir):
    kind = F.when(F.col("p_size") <= 15, "s").when(F.col("p_size") <= 30, "p").otherwise("d")
    return format_counts(read(spark, sf_dir, "part").select("p_brand", F.create_map(kind, F.array(F.col("p_partkey").cast("string"))).alias("settings")))


@query("SELECT l_linenumber AS digits, round(avg(l_quantity), 6) AS seconds FROM lineitem GROUP BY ROLLUP (l_linenumber)")
def runtime_averages(spark, sf_dir):
    return rounded(runtime_summary(lineitem(spark, sf_dir).select(F.col("l_linenumber").alias("digits"), F.col("l_quantity").alias("seconds"))), ["seconds"])


@query(
    "WITH q AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{quantize_sql(x, 5, 10)} AS {n}" for n, x in (("a", "l_quantity"), ("b", "(l_tax + 0.3)"))) + " FROM lineitem), f AS (SELECT l_orderkey, l_linenumber, sqrt(a) AS s, exp(b) AS e, ln(a + 1) AS l, a * b AS p FROM q) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{quantize_sql(x, 5, 10)} AS {n}" for n, x in (("root", "s"), ("power", "e"), ("logarithm", "l"), ("product", "p"))) + " FROM f"
)
def half_precision_math(spark, sf_dir):
    half = lambda f: fmt.in_format(f, 5, 10)
    a, b = F.col("l_quantity"), F.col("l_tax") + 0.3
    return lineitem(spark, sf_dir).select(
        *KEY, half(F.sqrt)(a).alias("root"), half(F.exp)(b).alias("power"), half(lambda x: F.log(x + 1))(a).alias("logarithm"), half(lambda x, y: x * y)(a, b).alias("product")
    )
