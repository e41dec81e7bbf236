"""Queries over scored rows, splits, relational operators and small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.operators import metrics as M
from flowloom.operators import splits as S
from flowloom.plans.registry import query, table

SCORED_SQL = "scored AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, round(o_totalprice / 500000, 3) AS p, CASE WHEN round(o_totalprice / 500000, 3) >= 0.5 THEN 1 ELSE 0 END AS pred, o_orderpriority AS family, o_custkey % 45 AS capture, o_orderdate FROM orders)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scored rows: the status is the label, the price the score."""
    p = F.round(F.col("o_totalprice") / 500000, 3)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), p.alias("p"), (p >= 0.5).cast("int").alias("pred"), F.col("o_orderpriority").alias("family"), (F.col("o_custkey") % 45).alias("capture"), "o_orderdate"
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


RATES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS fpr, round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 6) AS fnr"""
COUNTS = "count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp"


@query(f"WITH {SCORED_SQL}, c AS (SELECT {COUNTS} FROM scored) SELECT tn, fp, fn, tp, {RATES} FROM c")
def confusion_metrics(spark, sf_dir):
    return rounded(M.confusion(scored(spark, sf_dir)))


@query(f"WITH {SCORED_SQL}, c AS (SELECT capture, {COUNTS} FROM scored GROUP BY capture) SELECT capture, tn, fp, fn, tp, {RATES} FROM c")
def capture_metrics(spark, sf_dir):
    return rounded(M.confusion(scored(spark, sf_dir), ["capture"]))


CURVE = "c AS (SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p) WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {SCORED_SQL}, {CURVE} SELECT round(sum(pos / all_pos * (tp / (tp + fp))), 6) AS average_precision, round(sum(neg / all_neg * ((tp - pos / 2) / all_pos)), 6) AS roc_auc FROM c")
def avg_precision_auc(spark, sf_dir):
    return rounded(M.average_precision_auc(scored(spark, sf_dir)))


@query(f"WITH {SCORED_SQL} SELECT family, count(*) AS n_flows, round(avg(pred), 6) AS recall, round(avg(p), 6) AS mean_proba FROM scored GROUP BY family")
def family_recall(spark, sf_dir):
    return rounded(M.group_recall(scored(spark, sf_dir), "family"))


@query(f"WITH {SCORED_SQL} SELECT family, round(avg(p), 6) AS mean_p, round(stddev_samp(p), 6) AS std_p, round(avg(y), 6) AS mean_y, round(stddev_samp(y), 6) AS std_y FROM scored GROUP BY family")
def group_mean_std(spark, sf_dir):
    return rounded(scored(spark, sf_dir).groupBy("family").agg(F.avg("p").alias("mean_p"), F.stddev_samp("p").alias("std_p"), F.avg("y").alias("mean_y"), F.stddev_samp("y").alias("std_y")))


@query(f"WITH {SCORED_SQL} SELECT round(avg(p), 6) AS mean_p, round(stddev_samp(p), 6) AS std_p, round(avg(CASE WHEN family = '1-URGENT' AND y = 1 THEN p END), 6) AS mean_two_filters FROM scored")
def frame_mean_std(spark, sf_dir):
    two = F.when((F.col("family") == "1-URGENT") & (F.col("y") == 1), F.col("p"))
    return rounded(scored(spark, sf_dir).agg(F.avg("p").alias("mean_p"), F.stddev_samp("p").alias("std_p"), F.avg(two).alias("mean_two_filters")))


@query(f"WITH {SCORED_SQL}, b AS (SELECT least(greatest(CAST(floor(p * 15) AS INTEGER), 0), 14) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS r FROM scored GROUP BY 1) SELECT (SELECT round(avg((p - y) * (p - y)), 6) FROM scored) AS brier, round(sum(n * abs(r - mp)) / sum(n), 6) AS ece FROM b")
def brier_ece(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rounded(M.brier(s).crossJoin(F.broadcast(M.ece(s))))  # one row each


THRESHOLDS = [round(0.05 + 0.09 * k, 2) for k in range(11)]
_GRID = ", ".join(f"({t})" for t in THRESHOLDS)


@query(f"""WITH {SCORED_SQL}, c AS (SELECT t.threshold, count(*) FILTER (WHERE y = 0 AND p < t.threshold) AS tn, count(*) FILTER (WHERE y = 0 AND p >= t.threshold) AS fp, count(*) FILTER (WHERE y = 1 AND p < t.threshold) AS fn, count(*) FILTER (WHERE y = 1 AND p >= t.threshold) AS tp
  FROM scored, (SELECT CAST(v AS DOUBLE) AS threshold FROM (VALUES {_GRID}) AS x(v)) t GROUP BY t.threshold) SELECT threshold, tn, fp, fn, tp, {RATES}, fn AS missed_attacks, round(1000 * (CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END), 6) AS cost_fp_per_1k_benign FROM c""")
def threshold_grid(spark, sf_dir):
    return rounded(M.threshold_grid(scored(spark, sf_dir), THRESHOLDS))


@query(f"""WITH {SCORED_SQL}, {CURVE}, m AS (SELECT p, round(2 * (tp / (tp + fp)) * (tp / all_pos) / greatest(tp / (tp + fp) + tp / all_pos, 1e-12), 12) AS f1, round(tp / all_pos - fp / all_neg, 12) AS youden, fp / all_neg AS fpr FROM c)
SELECT max_by(p, (f1, p)) AS best_f1, max_by(p, (youden, p)) AS best_youden, coalesce(min(p) FILTER (WHERE fpr <= 0.01), min(p)) AS fpr_bound FROM m""")
def threshold_candidates(spark, sf_dir):
    return M.threshold_candidates(scored(spark, sf_dir))


@query(f"WITH {SCORED_SQL}, t AS (SELECT range / 100.0 AS threshold FROM range(50, 99)) SELECT min(threshold) AS threshold FROM (SELECT CAST(t.threshold AS DOUBLE) AS threshold FROM scored, t WHERE y = 0 GROUP BY t.threshold HAVING avg(CASE WHEN p >= t.threshold THEN 1 ELSE 0 END) <= 0.05)")
def op_point_walk(spark, sf_dir):
    return M.operating_point(scored(spark, sf_dir), 0.05)


@query(f"WITH {SCORED_SQL}, l AS (SELECT p FROM scored ORDER BY id DESC LIMIT 2000), a AS (SELECT list(p ORDER BY p) AS v FROM l) SELECT v[CAST(round_even(0.5 * (len(v) - 1), 0) AS INTEGER) + 1] AS p50, v[CAST(round_even(0.95 * (len(v) - 1), 0) AS INTEGER) + 1] AS p95, v[CAST(round_even(0.99 * (len(v) - 1), 0) AS INTEGER) + 1] AS p99 FROM a")
def nearest_rank_latency(spark, sf_dir):
    return M.nearest_rank(scored(spark, sf_dir), "p", "id", last=2000)


@query(f"WITH {SCORED_SQL}, c AS (SELECT y, count(*) AS n FROM scored GROUP BY y) SELECT y, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c")
def class_weights(spark, sf_dir):
    return rounded(M.class_weights(scored(spark, sf_dir)))


@query(f"WITH {SCORED_SQL} SELECT family, count(*) AS n FROM scored GROUP BY family")
def value_counts(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family")


@query(f"WITH {SCORED_SQL} SELECT family, id, p FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS rn FROM scored) WHERE rn <= 25")
def topk_per_group(spark, sf_dir):
    w = Window.partitionBy("family").orderBy("p", "id")
    return scored(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 25").select("family", "id", "p")


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_acctbal DESC, c_mktsegment, c_custkey LIMIT 1")
def best_trial(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_mktsegment", "c_custkey").limit(1).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def top_five(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5).select("p_partkey", "p_retailprice")


CAPTURES_SQL = "caps AS (SELECT o_custkey % 45 AS capture, CASE min(o_custkey % 45) % 6 WHEN 0 THEN 'udp_flood' WHEN 1 THEN 'tcp_rst' ELSE 'benign' END AS family, CAST(min(o_orderkey) AS DOUBLE) * 5000 AS first_ts, count(*) AS n_flows, CAST(sum(o_shippriority_) AS BIGINT) AS n_packets FROM (SELECT *, o_orderkey % 10 AS o_shippriority_ FROM orders) GROUP BY 1), ranked AS (SELECT *, row_number() OVER (ORDER BY first_ts, capture) - 1 AS i FROM caps)"
MANIFEST_SQL = """man AS (SELECT capture, family, first_ts, strftime(make_timestamp(CAST(first_ts AS BIGINT) * 1000000), '%Y-%m-%d') AS date, n_flows, n_packets,
  CASE WHEN i BETWEEN 28 AND 44 THEN 'final_test' WHEN i BETWEEN 9 AND 27 THEN 'val' ELSE 'train' END AS track_a_role,
  CASE WHEN i BETWEEN 28 AND 44 THEN -1 WHEN i < 22 THEN 3 WHEN i < 28 THEN 3 END AS track_a_fold,
  CASE WHEN i BETWEEN 28 AND 44 THEN 'final_test' WHEN family IN ('tcp_syn_flood', 'tcp_rst', 'udp_flood') THEN 'holdout' ELSE 'train' END AS track_b_role FROM ranked)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 45).alias("capture"), (F.col("o_orderkey") * 5000.0).alias("start_ts"), (F.col("o_orderkey") % 10).alias("n_packets"))
    family = F.when(F.col("capture") % 6 == 0, "udp_flood").when(F.col("capture") % 6 == 1, "tcp_rst").otherwise("benign")
    return S.capture_inventory(rows.withColumn("family", family))


@query(f"WITH {CAPTURES_SQL}, {MANIFEST_SQL} SELECT * FROM man")
def chrono_manifest(spark, sf_dir):
    return S.chronological_manifest(captures(spark, sf_dir))


@query(f"""WITH {CAPTURES_SQL}, f(fold, lo, hi, vlo, vhi) AS (VALUES (1, 0, 9, 9, 14), (2, 0, 14, 14, 22), (3, 0, 22, 22, 28)) SELECT capture, CAST(i AS INTEGER) AS rank, fold, CASE WHEN i >= vlo AND i < vhi THEN 'val' ELSE 'train' END AS part FROM ranked, f WHERE (i >= vlo AND i < vhi) OR (i >= lo AND i < hi)""")
def expanding_folds(spark, sf_dir):
    ranked = captures(spark, sf_dir).withColumn("rank", F.row_number().over(Window.orderBy("first_ts", "capture")) - 1)
    return S.expanding_folds(ranked)


@query(f"WITH {CAPTURES_SQL}, {MANIFEST_SQL} SELECT track_a_role, track_a_fold, count(*) AS captures, CAST(sum(n_flows) AS BIGINT) AS flows FROM man GROUP BY ALL")
def split_accounting(spark, sf_dir):
    return S.role_counts(S.chronological_manifest(captures(spark, sf_dir)))


@query("SELECT 'capture_listed_twice' AS rule, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'capture_in_two_roles', 0 UNION ALL SELECT 'final_test_differs_by_track', 0")
def manifest_verify(spark, sf_dir):
    return S.verify_manifest(S.chronological_manifest(captures(spark, sf_dir)))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def role_semi_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def holdout_anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey")
    c = table(spark, sf_dir, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, avg(s_acctbal) AS w FROM supplier GROUP BY 1) SELECT a.k AS config, round(v, 4) AS v, round(w, 4) AS w, round(v / (SELECT max(v) FROM a) - 1, 6) AS relative FROM a LEFT JOIN b ON a.k = b.k")
def left_join_baseline(spark, sf_dir):
    """A table joined to another on its configuration, with the change against the best row."""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("config")).agg(F.avg("c_acctbal").alias("v"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("config")).agg(F.avg("s_acctbal").alias("w"))
    top = F.broadcast(a.agg(F.max("v").alias("top")))  # one row
    out = a.join(b, "config", "left").crossJoin(top)
    return out.select("config", F.round("v", 4).alias("v"), F.round("w", 4).alias("w"), F.round(F.col("v") / F.col("top") - 1, 6).alias("relative"))


@query("SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def inner_join_rollup(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    counts = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return counts.join(n, counts["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("n_name", "r_name").agg(F.sum("customers").alias("customers"))


@query("SELECT n_nationkey AS k, coalesce(s.n, 0) AS suppliers, s.n IS NULL AS missing FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s.s_nationkey = n_nationkey")
def lookup_completeness(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    n = table(spark, sf_dir, "nation")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").select(F.col("n_nationkey").alias("k"), F.coalesce("n", F.lit(0)).alias("suppliers"), F.col("n").isNull().alias("missing"))


@query("WITH d AS (SELECT o_orderpriority AS f, count(*) - count(DISTINCT o_custkey) AS dups FROM orders GROUP BY 1), t AS (SELECT o_orderpriority AS f, count(*) AS n FROM orders GROUP BY 1) SELECT f AS family, dups, n, round(dups / n, 6) AS share FROM d JOIN t USING (f)")
def dup_share_by_family(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    each = o.groupBy(F.col("o_orderpriority").alias("family"), "o_custkey").agg(F.count("*").alias("n"))
    return each.groupBy("family").agg(F.sum(F.col("n") - 1).alias("dups"), F.sum("n").alias("n")).withColumn("share", F.round(F.col("dups") / F.col("n"), 6))


@query(f"WITH {SCORED_SQL} SELECT family, CASE WHEN pred = 1 THEN 'detected' ELSE 'missed' END AS part, quantile_cont(p, 0.5) AS median_p, quantile_cont(CAST(id AS DOUBLE), 0.5) AS median_id FROM scored WHERE y = 1 GROUP BY ALL")
def fn_evidence_medians(spark, sf_dir):
    part = F.when(F.col("pred") == 1, "detected").otherwise("missed")
    return scored(spark, sf_dir).where("y = 1").groupBy("family", part.alias("part")).agg(F.percentile("p", 0.5).alias("median_p"), F.percentile(F.col("id").cast("double"), 0.5).alias("median_id"))


@query(f"WITH {SCORED_SQL} SELECT family, count(*) AS missed, quantile_cont(least(greatest(p, 0.1), 0.4), 0.5) AS median_s, quantile_cont(least(greatest(p, 0.1), 0.4), 0.95) AS p95_s, max(least(greatest(p, 0.1), 0.4)) AS max_s FROM scored WHERE y = 1 AND pred = 0 GROUP BY family")
def decision_latency(spark, sf_dir):
    x = F.least(F.greatest("p", F.lit(0.1)), F.lit(0.4))
    return scored(spark, sf_dir).where("y = 1 and pred = 0").withColumn("x", x).groupBy("family").agg(F.count("*").alias("missed"), F.percentile("x", 0.5).alias("median_s"), F.percentile("x", 0.95).alias("p95_s"), F.max("x").alias("max_s"))


@query(f"WITH {SCORED_SQL} SELECT o_orderpriority AS family, count(*) AS files, CAST(sum(floor(o_totalprice)) AS BIGINT) AS bytes, CAST(sum(o_orderkey % 10) AS BIGINT) AS packets FROM orders GROUP BY 1")
def inventory_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("family")).agg(F.count("*").alias("files"), F.sum(F.floor("o_totalprice")).cast("long").alias("bytes"), F.sum(F.col("o_orderkey") % 10).alias("packets"))


@query("""WITH s AS (SELECT event_type AS scenario, CASE WHEN user_id % 4 = 0 THEN 'RECON' WHEN user_id % 4 = 1 THEN 'C2' END AS cls FROM events), g AS (SELECT scenario, count(*) FILTER (WHERE cls = 'RECON') AS recon, count(*) FILTER (WHERE cls = 'C2') AS c2 FROM s GROUP BY scenario)
SELECT scenario, recon, c2, CASE WHEN scenario = 'view' THEN CASE WHEN recon + c2 = 0 THEN 'PASS' ELSE 'FP' END WHEN recon > 0 THEN 'PASS' ELSE 'CHECK' END AS verdict FROM g""")
def scenario_verdict(spark, sf_dir):
    """Alerts per class of each scenario; the benign one (view) should have none."""
    cls = F.when(F.col("user_id") % 4 == 0, "RECON").when(F.col("user_id") % 4 == 1, "C2")
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("scenario")).agg(F.count_if(cls == "RECON").alias("recon"), F.count_if(cls == "C2").alias("c2"))
    verdict = F.when(F.col("scenario") == "view", F.when(F.col("recon") + F.col("c2") == 0, "PASS").otherwise("FP")).when(F.col("recon") > 0, "PASS").otherwise("CHECK")
    return g.withColumn("verdict", verdict)


@query("SELECT src, cls, count(*) AS n FROM (SELECT 'customer' AS src, c_mktsegment AS cls FROM customer UNION ALL SELECT 'part', p_brand FROM part) GROUP BY ALL")
def class_counts_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("src"), F.col("c_mktsegment").alias("cls"))
    return c.unionByName(table(spark, sf_dir, "part").select(F.lit("part").alias("src"), F.col("p_brand").alias("cls"))).groupBy("src", "cls").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k, 'union' AS op FROM customer UNION SELECT s_nationkey, 'union' FROM supplier UNION ALL (SELECT c_nationkey, 'intersect' FROM customer INTERSECT SELECT s_nationkey, 'intersect' FROM supplier) UNION ALL (SELECT n_nationkey, 'except' FROM nation EXCEPT SELECT s_nationkey, 'except' FROM supplier)")
def set_operations(spark, sf_dir):
    c, s, n = (table(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))

    def tag(df: DataFrame, op: str) -> DataFrame:
        return df.withColumn("op", F.lit(op))

    return tag(c.union(s).distinct(), "union").union(tag(c.intersect(s), "intersect")).union(tag(n.exceptAll(s.distinct()), "except"))


@query("""SELECT quality, toxic, count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS clean FROM labels GROUP BY ALL""")
def label_balance(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"))


@query("""SELECT c_custkey, trim(regexp_replace(lower(trim(c_mktsegment)), '[^a-z0-9]', '_', 'g'), '_') AS slug, starts_with(c_name, 'Customer') AS starts, contains(lower(c_name), '00') AND contains(lower(c_name), 'cust') AS has_all, left(c_name, 10) AS head, 'INC-' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS inc, CAST(c_custkey % 256 BETWEEN 224 AND 239 OR c_custkey % 100 = 255 AS BOOLEAN) AS multicast,
round(CASE WHEN c_acctbal > 0 THEN 1000 / c_acctbal ELSE 0 END, 6) AS safe, round(least(greatest(c_acctbal / 10000, 0), 1), 6) AS unit, strftime(make_timestamp(c_custkey * 86400000000), '%Y-%m-%d') AS day, CAST(c_custkey * 37 % 86400 AS DOUBLE) AS sod, md5(c_name) AS digest, TRY_CAST(substr(c_name, 10, 1) AS DOUBLE) AS digit FROM customer""")
def scalar_functions(spark, sf_dir):
    """Scalar functions on strings, numbers, dates and digests."""
    from flowloom.functions.packets import safe_ratio
    from flowloom.functions.text import contains_all, slugify
    from flowloom.operators.detectors import clamp01
    from flowloom.operators.document import number

    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        slugify(F.col("c_mktsegment")).alias("slug"),
        F.startswith("c_name", F.lit("Customer")).alias("starts"),
        contains_all(F.col("c_name"), ["00", "cust"]).alias("has_all"),
        F.left("c_name", F.lit(10)).alias("head"),
        F.format_string("INC-%04d", k).alias("inc"),
        ((k % 256).between(224, 239) | (k % 100 == 255)).alias("multicast"),
        F.round(safe_ratio(F.lit(1000.0), F.col("c_acctbal")), 6).alias("safe"),
        F.round(clamp01(F.col("c_acctbal") / 10000), 6).alias("unit"),
        F.date_format(F.timestamp_seconds(k * 86400), "yyyy-MM-dd").alias("day"),
        F.pmod(k * 37, F.lit(86400)).cast("double").alias("sod"),
        F.md5(F.col("c_name").cast("binary")).alias("digest"),
        number(F.substring("c_name", 10, 1)).alias("digit"),
    )


@query("SELECT l_orderkey, l_linenumber, CAST(l_discount > 0.05 AND NOT l_returnflag = 'N' AS INTEGER) AS pred, CASE WHEN lower(l_linestatus) <> 'o' THEN 1 ELSE 0 END AS y FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_quantity >= 10 AND NOT (l_tax > 0.06 AND l_discount < 0.02)")
def filters_and_labels(spark, sf_dir):
    """Membership, boolean masks, a threshold predicate and label binarisation, pushed to the scan."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "N") & (F.col("l_quantity") >= 10) & ~((F.col("l_tax") > 0.06) & (F.col("l_discount") < 0.02)))
    pred = ((F.col("l_discount") > 0.05) & (F.col("l_returnflag") != "N")).cast("int")
    return li.select("l_orderkey", "l_linenumber", pred.alias("pred"), (F.lower("l_linestatus") != "o").cast("int").alias("y"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS many, round(sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END), 2) AS discounted, round(avg(l_extendedprice), 4) AS mean_price, round(stddev_samp(l_quantity), 6) AS std_quantity FROM lineitem GROUP BY ALL")
def wide_conditional_agg(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("many"), F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).otherwise(0.0)), 2).alias("discounted"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.round(F.stddev_samp("l_quantity"), 6).alias("std_quantity")
    )


@query("WITH a AS (SELECT o_orderpriority AS k, round(avg(o_totalprice), 6) AS v FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS k, round(sum(o_totalprice) / count(*), 6) AS w FROM orders GROUP BY 1) SELECT k, abs(v - w) < 5e-4 AS consistent FROM a JOIN b USING (k)")
def metric_consistency(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"))
    a = o.agg(F.avg("o_totalprice").alias("v"), (F.sum("o_totalprice") / F.count("*")).alias("w"))
    return a.select("k", (F.abs(F.col("v") - F.col("w")) < 5e-4).alias("consistent"))


@query(f"WITH {SCORED_SQL} SELECT count(DISTINCT p) AS distinct_outputs, CASE WHEN count(DISTINCT p) <= 10 THEN 'sigmoid' ELSE 'isotonic' END AS method FROM scored")
def degeneracy_guard(spark, sf_dir):
    n = F.count_distinct("p")
    return scored(spark, sf_dir).agg(n.alias("distinct_outputs"), F.when(n <= 10, "sigmoid").otherwise("isotonic").alias("method"))
