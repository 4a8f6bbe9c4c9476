"""Registered queries: dataset fingerprints, change classes, snapshot diff, upsert."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigilo.operators import joins as J
from vigilo.operators import versions as V
from vigilo.plans.registry import register
from vigilo.session import scratch_dir
from vigilo.sources.tables import table

# All columns of the tables, with Spark's type names (the oracle has no other way to know them).
COLUMNS = {
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
                 "c_mktsegment": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
                 "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
                 "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
             "p_retailprice": "double"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "region": {"r_regionkey": "int", "r_name": "string"},
}
OLD_CUT = "1998-08-01 00:00:00"


def _field_sql(c: str, kind: str) -> str:
    if kind == "double":
        text = (f"CASE WHEN isnan({c}) THEN 'NaN' WHEN abs({c}) >= 9e18 THEN CASE WHEN {c} > 0 THEN 'big' ELSE '-big' END "
                f"ELSE CAST(floor({c}) AS BIGINT) || '.' || CAST(floor(({c} - floor({c})) * {1 << 52}.0::DOUBLE) AS BIGINT) END")
    else:
        text = f"CAST(epoch_us({c}) AS VARCHAR)" if kind == "timestamp_ntz" else f"CAST({c} AS VARCHAR)"
    return f"CASE WHEN {c} IS NULL THEN 'N' ELSE length({text}) || ':' || ({text}) END"


def _hash_sql(digest: str, at: int) -> str:
    return (f"list_reduce(list_transform(range(13), lambda i: CAST(strpos('0123456789abcdef', "
            f"substr({digest}, i + {at}, 1)) - 1 AS BIGINT)), lambda a, b: a * 16 + b)")


def _fingerprint_sql(name: str, src: str, cols: dict[str, str]) -> str:
    schema = ",".join(f"{c}:{kind}" for c, kind in cols.items())
    text = " || ".join(_field_sql(c, kind) for c, kind in cols.items())
    return (f"SELECT '{name}' AS dataset, count(*) AS row_count, {len(cols)} AS column_count, "
            f"md5('{schema}') AS schema_hash, coalesce(bit_xor({_hash_sql('digest', 1)}), 0) AS content_xor, "
            f"CAST(coalesce(sum({_hash_sql('digest', 14)}) % {V.SUM_MODULUS}, 0) AS BIGINT) AS content_sum "
            f"FROM (SELECT md5({text}) AS digest FROM {src})")


# ---- V1 -----------------------------------------------------------------------------
def manifest_q(spark, sf):
    return V.dataset_manifest({n: table(spark, sf, n) for n in ("orders", "customer", "lineitem")})


register("dataset_manifest", ops=("V1",), sql=" UNION ALL ".join(
    _fingerprint_sql(n, n, COLUMNS[n]) for n in ("orders", "customer", "lineitem")))(manifest_q)


def manifest_update(spark, sf):
    """Orders stored by year, fingerprinted, extended by the orders since the cut, fingerprinted again: only
    the added files are read the second time.  One row per folder."""
    path = scratch_dir(spark, f"orders-{uuid.uuid4().hex[:8]}")
    orders = table(spark, sf, "orders").withColumn("o_year", F.year("o_orderdate"))
    cut = F.lit(OLD_CUT).cast("timestamp_ntz")
    cols = list(COLUMNS["orders"])
    orders.filter(F.col("o_orderdate") < cut).write.partitionBy("o_year").parquet(path)
    first, _ = V.update_manifest(spark, path, cols=cols)
    first = first.checkpoint()
    orders.filter(F.col("o_orderdate") >= cut).write.mode("append").partitionBy("o_year").parquet(path)
    second, _ = V.update_manifest(spark, path, first, cols)
    second = second.checkpoint()
    year = F.regexp_extract("folder", "o_year=([0-9]+)$", 1).cast("int").alias("o_year")
    added = second.join(first.select("folder", "file"), ["folder", "file"], "left_anti") \
        .groupBy("folder").agg(F.sum("row_count").alias("rows_added"))
    return V.fold_manifest(second, ["folder"]).join(added, "folder", "left") \
        .select(year, "row_count", "content_xor", "content_sum", F.coalesce("rows_added", F.lit(0)).alias("rows_added"))


def _manifest_update_sql() -> str:
    text = " || ".join(_field_sql(c, kind) for c, kind in COLUMNS["orders"].items())
    return (f"SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, count(*) AS row_count, "
            f"bit_xor({_hash_sql('digest', 1)}) AS content_xor, "
            f"CAST(sum({_hash_sql('digest', 14)}) % {V.SUM_MODULUS} AS BIGINT) AS content_sum, "
            f"CAST(count(*) FILTER (o_orderdate >= TIMESTAMP '{OLD_CUT}') AS BIGINT) AS rows_added "
            f"FROM (SELECT *, md5({text}) AS digest FROM orders) GROUP BY ALL")


register("manifest_update", ops=("V1", "V6"), sql=_manifest_update_sql())(manifest_update)


# ---- V3 / V6: an older snapshot of the catalogue against the current one ---------------
def _old_new(spark, sf):
    t = lambda n: table(spark, sf, n)
    cut = F.lit(OLD_CUT).cast("timestamp_ntz")
    old = {
        "orders": t("orders").filter(F.col("o_orderdate") < cut),
        "customer": t("customer"),
        "supplier": t("supplier").drop("s_nationkey"),
        "part": t("part"),
        "region": t("region").withColumn("r_name", F.lower("r_name")),
    }
    new = {"orders": t("orders"), "customer": t("customer"), "supplier": t("supplier"), "nation": t("nation"),
           "region": t("region")}
    # One pass per table; both manifests are a row per table, written once for all their uses.
    return V.dataset_manifest(old).checkpoint(), V.dataset_manifest(new).checkpoint()


OLD_SQL = " UNION ALL ".join([
    _fingerprint_sql("orders", f"(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{OLD_CUT}')", COLUMNS["orders"]),
    _fingerprint_sql("customer", "customer", COLUMNS["customer"]),
    _fingerprint_sql("supplier", "supplier", {c: k for c, k in COLUMNS["supplier"].items() if c != "s_nationkey"}),
    _fingerprint_sql("part", "part", COLUMNS["part"]),
    _fingerprint_sql("region", "(SELECT r_regionkey, lower(r_name) AS r_name FROM region)", COLUMNS["region"]),
])
NEW_SQL = " UNION ALL ".join(_fingerprint_sql(n, n, COLUMNS[n])
                             for n in ("orders", "customer", "supplier", "nation", "region"))


def classify_change_q(spark, sf):
    old, new = _old_new(spark, sf)
    return V.classify_change(old, new)


register("classify_change", ops=("V3", "J10"), sql=f"""
WITH o AS ({OLD_SQL}), n AS ({NEW_SQL}),
j AS (SELECT coalesce(o.dataset, n.dataset) AS dataset, o.row_count AS old_row_count, n.row_count AS new_row_count,
             o.schema_hash AS os, n.schema_hash AS ns,
             o.content_xor = n.content_xor AND o.content_sum = n.content_sum AND o.row_count = n.row_count AS same
      FROM o FULL OUTER JOIN n ON o.dataset = n.dataset),
c AS (SELECT *, CASE WHEN old_row_count IS NULL THEN 'new' WHEN new_row_count IS NULL THEN 'deleted'
                     WHEN same THEN 'unchanged' WHEN os <> ns THEN 'schema'
                     WHEN old_row_count <> new_row_count THEN 'rows' ELSE 'content' END AS change FROM j)
SELECT dataset, change,
       CASE WHEN change IN ('deleted', 'schema') THEN 'major' WHEN change IN ('new', 'rows') THEN 'minor'
            WHEN change = 'content' THEN 'patch' ELSE 'none' END AS level,
       old_row_count, new_row_count FROM c""")(classify_change_q)


def verify_manifest_q(spark, sf):
    old, new = _old_new(spark, sf)
    return V.verify_manifest(old, new)


register("verify_manifest", ops=("V6",), sql=f"""
WITH o AS ({OLD_SQL}), n AS ({NEW_SQL})
SELECT o.dataset, CASE WHEN n.dataset IS NULL THEN 'missing'
                       WHEN o.content_xor = n.content_xor AND o.content_sum = n.content_sum
                            AND o.row_count = n.row_count THEN 'ok' ELSE 'mismatch' END AS status
FROM o LEFT JOIN n ON o.dataset = n.dataset""")(verify_manifest_q)


def version_history_q(spark, sf):
    old, new = _old_new(spark, sf)
    first = V.append_history(None, V.classify_change(old.limit(0), old), "2025-10-01", spark)
    hist = V.append_history(first, V.classify_change(old, new), "2025-10-17", spark)
    return V.history_stats(hist).join(hist.select("change_type", "version", "summary"), ["change_type"])


def _version_history_sql() -> str:
    return f"""
WITH o AS ({OLD_SQL}), n AS ({NEW_SQL}),
j AS (SELECT coalesce(o.dataset, n.dataset) AS dataset, o.row_count AS orc, n.row_count AS nrc,
             o.schema_hash AS os, n.schema_hash AS ns,
             o.content_xor = n.content_xor AND o.content_sum = n.content_sum AND o.row_count = n.row_count AS same
      FROM o FULL OUTER JOIN n ON o.dataset = n.dataset),
c AS (SELECT dataset, CASE WHEN orc IS NULL THEN 'new' WHEN nrc IS NULL THEN 'deleted' WHEN same THEN 'unchanged'
                           WHEN os <> ns THEN 'schema' WHEN orc <> nrc THEN 'rows' ELSE 'content' END AS change
      FROM j),
l AS (SELECT *, CASE WHEN change IN ('deleted', 'schema') THEN 3 WHEN change IN ('new', 'rows') THEN 2
                     WHEN change = 'content' THEN 1 ELSE 0 END AS lvl FROM c),
second AS (SELECT (['none', 'patch', 'minor', 'major'])[max(lvl) + 1] AS level,
                  coalesce(array_to_string(list_sort(list(dataset || ':' || change) FILTER (WHERE change <> 'unchanged')),
                                           '; '), '') AS summary FROM l),
h AS (SELECT '1.0.0' AS version, TIMESTAMP '2025-10-01' AS created_at, 'major' AS change_type,
             coalesce(array_to_string(list_sort(list(dataset || ':new')), '; '), '') AS summary FROM o
      UNION ALL
      SELECT CASE level WHEN 'major' THEN '2.0.0' WHEN 'minor' THEN '1.1.0' WHEN 'patch' THEN '1.0.1' ELSE '1.0.0' END,
             TIMESTAMP '2025-10-17', level, summary FROM second),
g AS (SELECT *, CAST(floor((epoch_us(created_at) - epoch_us(lag(created_at) OVER (ORDER BY created_at)))
                          / 86400000000.0) AS BIGINT) AS gap FROM h)
SELECT change_type, count(*) OVER (PARTITION BY change_type) AS versions,
       (SELECT avg(gap) FROM g) AS avg_gap_days, version, summary FROM g"""


register("version_history", ops=("V4", "V5", "W7"), sql=_version_history_sql())(version_history_q)


def dataset_metadata_q(spark, sf):
    return V.dataset_metadata(table(spark, sf, "labels"), "quality")


register("dataset_metadata", ops=("V2", "A7"), sql="""
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT (SELECT count(*) FROM labels) AS rows, 2 AS feature_count,
       (SELECT array_to_string(list_sort(list(CAST(quality AS VARCHAR) || '=' || CAST(n AS VARCHAR))), ',') FROM c)
         AS class_distribution,
       (SELECT array_to_string(list_filter([CASE WHEN count(*) > count(doc_id) THEN 'doc_id' END,
                                            CASE WHEN count(*) > count(quality) THEN 'quality' END,
                                            CASE WHEN count(*) > count(toxic) THEN 'toxic' END],
                                           lambda x: x IS NOT NULL), ',') FROM labels) AS columns_with_nulls""")(
    dataset_metadata_q)


# ---- J10: order status as recorded vs as implied by its line items -------------------------
def snapshot_diff(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    lines = (table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.when(F.min("l_linestatus") == F.max("l_linestatus"), F.min("l_linestatus"))
                  .otherwise(F.lit("P")).alias("status")))
    return J.diff_snapshots(orders, lines, "o_orderkey", ["status"]).select(
        "o_orderkey", "old_status", "new_status", "change")


register("snapshot_diff", ops=("J10",), sql="""
WITH o AS (SELECT o_orderkey, o_orderstatus AS status FROM orders),
n AS (SELECT l_orderkey AS o_orderkey,
             CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS status
      FROM lineitem GROUP BY 1)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.status AS old_status, n.status AS new_status,
       CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.o_orderkey IS NULL THEN 'deleted'
            WHEN o.status IS NOT DISTINCT FROM n.status THEN 'unchanged' ELSE 'modified' END AS change
FROM o FULL OUTER JOIN n ON o.o_orderkey = n.o_orderkey""")(snapshot_diff)


# ---- J14 ---------------------------------------------------------------------------------
def customer_upsert(spark, sf):
    cur = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    upd = (table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
           .agg(F.round(F.sum("o_totalprice"), 2).alias("c_acctbal")))
    return J.upsert(cur, upd, "c_custkey")


register("customer_upsert", ops=("J14",), sql="""
WITH u AS (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS c_acctbal FROM orders GROUP BY 1)
SELECT coalesce(u.c_custkey, c.c_custkey) AS c_custkey,
       CASE WHEN u.c_custkey IS NOT NULL THEN u.c_acctbal ELSE c.c_acctbal END AS c_acctbal, c.c_mktsegment
FROM customer c FULL OUTER JOIN u ON c.c_custkey = u.c_custkey""")(customer_upsert)


def assign_ids_q(spark, sf):
    new_rows = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("c_name"))
    out = J.assign_ids(table(spark, sf, "customer"), new_rows, "c_custkey", ["s_suppkey"])
    return out.select("s_suppkey", "c_name", "c_custkey")


register("assign_ids", ops=("J14",), sql="""
SELECT s_suppkey, s_name AS c_name,
       (SELECT coalesce(max(c_custkey), 0) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS c_custkey
FROM supplier""")(assign_ids_q)


# ---- V7: the customer table's profile against a model that was trained on it without the balance -----
MODEL_CATEGORICAL = ["c_mktsegment", "c_nationkey"]


def compatibility_q(spark, sf):
    from vigilo.operators.drift import reference_profile
    return V.check_compatibility(reference_profile(table(spark, sf, "customer")), 4, MODEL_CATEGORICAL)


def _compatibility_sql() -> str:
    from vigilo.presets import clinical as C
    kinds = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN {'true' if k == 'string' else 'false'} OR count(DISTINCT {c}) * 1.0 / count({c}) "
        f"< {C.CATEGORICAL_DISTINCT_SHARE} THEN 'categorical' ELSE 'numeric' END AS kind FROM customer"
        for c, k in COLUMNS["customer"].items())
    return f"""
WITH k AS ({kinds}),
a AS (SELECT count(*) AS data_features,
             coalesce(array_to_string(list_sort(list(feature) FILTER (WHERE kind = 'categorical')), ','), '') AS data_categorical
      FROM k),
i AS (SELECT *, data_features <> 4 AS c, data_categorical <> '' AND data_categorical <> '{",".join(MODEL_CATEGORICAL)}' AS s FROM a)
SELECT data_features, 4::BIGINT AS model_features, data_categorical, '{",".join(MODEL_CATEGORICAL)}' AS model_categorical,
       NOT c AND NOT s AS compatible,
       concat_ws('; ', CASE WHEN c THEN 'feature count mismatch' END, CASE WHEN s THEN 'categorical column mismatch' END) AS issues
FROM i"""


register("compatibility", ops=("V7",), sql=_compatibility_sql())(compatibility_q)
