"""Document library: lookups, joins over membership and sessions, and mutations as functions from an old table to a new one.

Tables are immutable here: a mutation returns the table after it. `write_partitioned` replaces only the partitions that a
DataFrame has rows for, which is the way to persist one at scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.operators import lookups as L
from folium.plans.registry import query
from folium.session import table

# ---------------------------------------------------------------- mutations


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in `new` are replaced by its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key by `order`; columns in keep_first keep the earliest value."""
    both = old.unionByName(new)
    w = Window.partitionBy(*keys)
    for c in keep_first:
        both = both.withColumn(c, F.min(c).over(w))
    return both.withColumn("__r", F.row_number().over(w.orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def upsert_by_either(users: DataFrame, logins: DataFrame, first: str, second: str, fill: str) -> DataFrame:
    """Rows of `users` updated from `logins` that match on one key or the other; unmatched logins are added. Two equi joins
    instead of one on OR, which would be a nested loop."""
    a = logins.select(F.col(first), F.struct(*logins.columns).alias("a"))
    b = logins.select(F.col(second), F.struct(*logins.columns).alias("b"))
    joined = users.join(a, first, "left").join(b, second, "left")
    hit = F.coalesce(F.col("a"), F.col("b"))
    updated = joined.select(*[F.coalesce(hit[c], F.col(c)).alias(c) if c == fill else F.coalesce(F.col(c), hit[c]).alias(c) for c in users.columns])
    added = logins.join(users.select(first), first, "left_anti").join(users.select(second), second, "left_anti").select(*users.columns)
    return updated.unionByName(added)


def delete_where(old: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The table without the rows, and how many there were."""
    hit = F.coalesce(condition, F.lit(False))
    return old.where(~hit), old.agg(F.count_if(hit).alias("deleted"))


def delete_by_keys(old: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return old.join(keys, on, "left_anti")


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the rows of the keys, and a row (store, deleted) for each."""
    left, counts = {}, None
    for name, (df, column) in tables.items():
        ids = keys.select(F.col(key).alias(column)).distinct()
        left[name] = df.join(ids, column, "left_anti")
        n = df.join(ids, column, "left_semi").agg(F.lit(name).alias("store"), F.count("*").alias("deleted"))
        counts = n if counts is None else counts.unionByName(n)
    return left, counts


def set_add(array: Column, value: Column) -> Column:
    """Adds a value that is not there; duplicates that are stay."""
    return F.when(F.array_contains(array, value), array).otherwise(F.array_append(array, value))


def set_remove(array: Column, values: Column) -> Column:
    """Removes all matches; other duplicates stay."""
    return F.filter(array, lambda x: ~F.array_contains(values, x))


def update_where(old: DataFrame, condition: Column, changes: dict[str, Column], only_set: bool = False) -> DataFrame:
    """Changed columns where the condition holds; with only_set, null changes leave the old value."""
    hit = F.coalesce(condition, F.lit(False))
    return old.withColumns({c: F.when(hit, F.coalesce(v, F.col(c)) if only_set else v).otherwise(F.col(c)) for c, v in changes.items()})


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def append_and_touch(sessions: DataFrame, messages: DataFrame, new: DataFrame, key: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Messages with the new ones, and sessions with updated_at at their latest message."""
    after = messages.unionByName(new)
    latest = after.groupBy(key).agg(F.max(at).alias("__latest"))
    return after, sessions.join(latest, key, "left").withColumn("updated_at", F.coalesce("__latest", "updated_at")).drop("__latest")


def keep_since(old: DataFrame, at: str, days: int, now: Column) -> DataFrame:
    return old.where(F.col(at) >= now - F.expr(f"interval {days} days"))


def truncate(old: DataFrame) -> tuple[DataFrame, DataFrame]:
    return old.limit(0), old.agg(F.count("*").alias("removed"))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that df has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def index_rows(chunks: DataFrame, vectors: DataFrame, on: str = "ordinal") -> DataFrame:
    """Chunks joined with their vectors by ordinal; rows without a chunk_id or vector are left out."""
    return chunks.join(vectors, on).where(F.col("chunk_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))


def track_retrieval(events: DataFrame, key: str, seq: str, found: str, payload: list[str]) -> DataFrame:
    """Per key, the payload of the first row that found something (else of the first row), and the tries after the first."""
    best = F.min(F.struct((~F.col(found)).alias("__miss"), F.col(seq), *payload))
    return events.groupBy(key).agg(best.alias("b"), (F.count("*") - 1).alias("retry_count"), F.max(found).alias(found)).select(key, *[F.col(f"b.{c}").alias(c) for c in payload], "retry_count", found)


# ---------------------------------------------------------------- lookups and joins


def search_any(rows: DataFrame, pattern: str, columns: list[str], arrays: list[str] = ()) -> DataFrame:
    """Rows where a column or an array element matches the pattern, case ignored; nulls don't match."""
    p = "(?i)" + pattern
    hits = [F.coalesce(F.col(c).rlike(p), F.lit(False)) for c in columns] + [F.coalesce(F.exists(a, lambda x: x.rlike(p)), F.lit(False)) for a in arrays]
    condition = hits[0]
    for h in hits[1:]:
        condition = condition | h
    return rows.where(condition)


def name_matches(name: Column, wanted: Column) -> Column:
    """Equal, prefix, or (three characters or more) contained, case and .pdf ignored."""
    a, b = (F.lower(T.document_key(x)) for x in (name, wanted))
    return a.startswith(b) | ((F.length(b) >= 3) & a.contains(b))


def recent_per_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The last n rows of each group, with their rank from the end; the ranking stops early, so a hot group costs no sort of all its rows."""
    return rows.withColumn("recency", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("recency") <= n)


def nest(parents: DataFrame, children: DataFrame, key: str, order: str, columns: list[str], name: str = "children") -> DataFrame:
    """Parents with their children as an array in order."""
    by = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))
    return parents.join(by, key, "left")


# ---------------------------------------------------------------- queries: mutations

_SHORT = "CASE WHEN c_mktsegment = 'BUILDING' THEN 'x' ELSE c_mktsegment END"


@query("k01_replace_by_key", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey % 5 = 0")
def k01(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    new = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").cast(old.schema["o_custkey"].dataType).alias("o_custkey"), F.lit(-1).cast(old.schema["o_orderkey"].dataType).alias("o_orderkey"))
    return replace_by_key(old, new, "o_custkey")


@query("k02_index_rows", "SELECT c.doc_id, sha1(doc_id || ':0:' || left(text, 200)) AS chunk_id, len(embedding) AS dims FROM documents c JOIN embeddings e ON doc_id = vec_id")
def k02(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), T.chunk_id(F.col("doc_id"), F.lit(0), F.col("text")).alias("chunk_id"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"))
    return index_rows(d, v).select(F.col("ordinal").alias("doc_id"), "chunk_id", F.size("vector").cast("long").alias("dims"))


_EV = "SELECT user_id, event_id, event_type, value FROM {events}"


@query("k14_upsert_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def k14(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("k15_upsert_keep_created", "SELECT user_id, event_type, event_id, created FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS created, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def k15(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("event_id").alias("created"))
    return upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id", ("created",))


@query("k16_upsert_by_either", """WITH u AS (SELECT c_custkey AS google_id, 'u' || c_custkey AS email, c_name AS name FROM customer WHERE c_custkey % 3 <> 0),
l AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000 END AS google_id, 'u' || c_custkey AS email, 'new ' || c_custkey AS name FROM customer WHERE c_custkey % 5 = 0)
SELECT u.google_id, u.email, coalesce(l.name, u.name) AS name FROM u LEFT JOIN l ON u.email = l.email UNION ALL SELECT * FROM l WHERE email NOT IN (SELECT email FROM u) AND google_id NOT IN (SELECT google_id FROM u)""")
def k16(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    u = c.where("c_custkey % 3 <> 0").selectExpr("cast(c_custkey as bigint) google_id", "concat('u', c_custkey) email", "c_name name")
    logins = c.where("c_custkey % 5 = 0").selectExpr("cast(case when c_custkey % 2 = 0 then c_custkey else c_custkey + 1000000 end as bigint) google_id", "concat('u', c_custkey) email", "concat('new ', c_custkey) name")
    return upsert_by_either(u, logins, "google_id", "email", "name")


def _members(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))


def _array(name: str, change, sql: str) -> None:
    query(name, f"WITH m AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string({sql}, ',') AS ids FROM m")(
        lambda spark, sf_dir: _members(spark, sf_dir).select("o_custkey", F.array_join(change(F.col("ids")).cast("array<string>"), ",").alias("ids"))
    )


_array("k18_set_add", lambda a: set_add(a, F.col("o_custkey")), "CASE WHEN list_contains(ids, o_custkey) THEN ids ELSE list_append(ids, o_custkey) END")
_array("k19_set_remove", lambda a: set_remove(a, F.array(F.element_at(a, 1))), "list_filter(ids, lambda x: x <> ids[1])")
_array("k20_clear_array", lambda a: F.expr("cast(array() as array<bigint>)"), "[]::BIGINT[]")
_array("u04_array_union", lambda a: F.array_union(a, F.array(F.element_at(a, 1), F.lit(-1).cast("long"))), "list_append(ids, -1)")
_array("u05_array_difference", lambda a: F.array_remove(a, F.element_at(a, -1)), "list_filter(ids, lambda x: x <> ids[-1])")
_array("u06_set_difference", lambda a: F.array_except(a, F.array(F.element_at(a, 1), F.element_at(a, -1))), "list_filter(ids, lambda x: x <> ids[1] AND x <> ids[-1])")
_array("u08_distinct_in_order", lambda a: F.array_distinct(F.transform(a, lambda x: x % 7)), "(SELECT list(v ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(ids) % 7 AS v, generate_subscripts(ids, 1) AS i) GROUP BY v))")


@query("k22_partial_update", f"SELECT c_custkey, {_SHORT} AS c_mktsegment FROM customer")
def k22(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return update_where(c, F.col("c_mktsegment") == "BUILDING", {"c_mktsegment": F.lit("x")})


@query("k27_update_non_null", "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'n' ELSE c_name END AS c_name FROM customer")
def k27(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return update_where(c, F.col("c_custkey") % 2 == 0, {"c_mktsegment": F.lit(None).cast("string"), "c_name": F.lit("n")}, only_set=True)


@query("k05_delete_count", "SELECT count(*) AS deleted FROM orders WHERE o_custkey % 4 = 0")
def k05(spark, sf_dir):
    return delete_where(table(spark, sf_dir, "orders"), F.col("o_custkey") % 4 == 0)[1]


@query("k04_delete_where", "SELECT o_orderkey FROM orders WHERE NOT o_custkey % 4 = 0")
def k04(spark, sf_dir):
    return delete_where(table(spark, sf_dir, "orders"), F.col("o_custkey") % 4 == 0)[0].select("o_orderkey")


@query("k23_delete_by_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def k23(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return delete_by_keys(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("k24_cascade_delete", """WITH k AS (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0) SELECT 'lineitem' AS store, count(*) AS deleted FROM lineitem WHERE l_orderkey IN (SELECT * FROM k)
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey IN (SELECT * FROM k)""")
def k24(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return cascade_delete({"lineitem": (lines, "l_orderkey"), "orders": (orders, "o_orderkey")}, orders.where("o_custkey % 10 = 0"), "o_orderkey")[1]


@query("k29_append_and_touch", "SELECT o_custkey, max(l_shipdate) AS updated_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def k29(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")).select("o_custkey", F.col("l_shipdate").alias("at"), "l_linenumber")
    sessions = m.select("o_custkey").distinct().withColumn("updated_at", F.lit(None).cast(m.schema["at"].dataType))
    return append_and_touch(sessions, m.where("l_linenumber = 1"), m.where("l_linenumber <> 1"), "o_custkey", "at")[1]


@query("k32_retrieval_tracking", """WITH e AS (SELECT user_id, event_id, event_type, value, value > 0 AS found FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY found DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id) - 1 AS retry_count, bool_or(found) OVER (PARTITION BY user_id) AS hit FROM e)
SELECT user_id, event_type, retry_count, hit AS found FROM r WHERE r = 1""")
def k32(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("value") > 0).alias("found"))
    return track_retrieval(e, "user_id", "event_id", "found", ["event_type"])


query("k33_retention", "SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAYS")(
    lambda spark, sf_dir: keep_since(table(spark, sf_dir, "orders"), "o_orderdate", 30, table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).scalar()).select("o_orderkey")
)


@query("k42_insert_absent", "SELECT c_custkey, c_name FROM customer")
def k42(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return insert_absent(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 <> 0 or c_custkey % 2 = 1"), "c_custkey")


@query("k48_truncate", "SELECT count(*) AS removed FROM embeddings")
def k48(spark, sf_dir):
    return truncate(table(spark, sf_dir, "embeddings"))[1]


# ---------------------------------------------------------------- queries: lookups, predicates, joins

query("p01_documents_of_owner", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")(
    lambda spark, sf_dir: L.matching(table(spark, sf_dir, "orders").where("o_custkey = 7"), table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))).select("o_orderkey", "o_orderdate")
)
query("p02_title_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)RED|blue')")(lambda spark, sf_dir: search_any(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "RED|blue", ["p_name"]))
query("p03_any_field_regex", "SELECT o_custkey FROM (SELECT o_custkey, list(o_orderpriority) AS p, min(o_orderstatus) AS s FROM orders GROUP BY o_custkey) WHERE regexp_matches(s, '(?i)f') OR len(list_filter(p, lambda x: regexp_matches(x, '(?i)urgent'))) > 0")(
    lambda spark, sf_dir: search_any(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"), F.min("o_orderstatus").alias("s")), "urgent", [], ["p"]).select("o_custkey").union(
        search_any(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("s")), "f", ["s"]).select("o_custkey")).distinct()
)
query("p04_by_two_keys", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem WHERE l_linenumber = 2) AND l_linenumber = 2")(
    lambda spark, sf_dir: L.matching(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "lineitem").where("l_linenumber = 2").agg(F.max("l_orderkey").alias("l_orderkey"), F.max("l_linenumber").alias("l_linenumber"))).select("l_orderkey", "l_linenumber", "l_quantity")
)
query("p05_by_year_text", "SELECT o_orderkey FROM orders WHERE CAST(year(o_orderdate) AS STRING) = '1995'")(
    lambda spark, sf_dir: L.of_year(table(spark, sf_dir, "orders"), "o_orderdate", "1995").select("o_orderkey")
)
query("p06_latest_of_document", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) q WHERE r = 1 AND lower(o_orderstatus) NOT IN ('none', 'null')")(
    lambda spark, sf_dir: L.latest_sessions(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus").select("o_orderkey", "o_custkey")
)
query("p07_document_name", "SELECT p_partkey FROM part WHERE starts_with(lower(p_name), 'b') OR contains(lower(p_name), 'red')")(
    lambda spark, sf_dir: table(spark, sf_dir, "part").where(name_matches(F.concat("p_name", F.lit(".PDF")), F.lit("b.pdf")) | name_matches(F.col("p_name"), F.lit(" RED.pdf"))).select("p_partkey")
)
query("p08_key_cascade", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN CAST(p_partkey AS STRING) = '17' THEN 0 WHEN p_name = '17' THEN 1 WHEN lower(p_name) LIKE '%17%' THEN 2 ELSE 3 END, p_partkey) AS r FROM part) q WHERE r = 1")(
    lambda spark, sf_dir: L.first_by_rank(table(spark, sf_dir, "part"), L.key_tests(F.col("p_partkey"), F.col("p_name"), F.col("p_name"), "17"), ["p_partkey"]).select("p_partkey")
)
query("p09_canonical_key", "SELECT c_custkey, regexp_replace(coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_mktsegment || '.PDF' END), ''), c_name), '(?i)\\.pdf$', '') AS k FROM customer")(
    lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", T.document_key(F.coalesce(F.nullif(F.trim(F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.concat("c_mktsegment", F.lit(".PDF")))), F.lit("")), F.col("c_name"))).alias("k"))
)
query("p10_sentinels", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS v FROM customer")(
    lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", T.blank_to_null(F.when(F.col("c_custkey") % 3 == 0, F.when(F.col("c_custkey") % 2 == 0, " None ").otherwise("")).otherwise(F.col("c_name"))).alias("v"))
)
query("p11_document_response", "SELECT c_custkey AS id, coalesce(c_name, 'Unknown') AS title, concat('/documents/', c_custkey, '/file') AS url FROM customer")(
    lambda spark, sf_dir: L.document_response(table(spark, sf_dir, "customer"), "c_custkey", "c_name")
)
query("p14_nested_drop", "SELECT c_custkey, c_name AS caption FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 2 <> 0")(
    lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", F.array(F.struct(F.col("c_name").alias("caption"), F.lit("p").alias("local_path"), F.lit("d").alias("data"))).alias("images")).select(
        "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.transform("images", lambda i: i.dropFields("local_path", "data"))).alias("images")
    ).select("c_custkey", F.try_element_at("images", F.lit(1))["caption"].alias("caption"))
)
query("p22_ordered_dedupe", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, round(l_quantity / 10), l_returnflag ORDER BY l_linenumber) AS r FROM lineitem) q WHERE r = 1")(
    lambda spark, sf_dir: L.best_per_group(table(spark, sf_dir, "lineitem"), ["l_orderkey", F.round(F.col("l_quantity") / 10), "l_returnflag"], ["l_linenumber"]).select("l_orderkey", "l_linenumber")
)
query("p23_retry_filter", "SELECT event_id FROM events WHERE NOT value > 50 AND event_id % 5 < 3")(
    lambda spark, sf_dir: L.to_retry(table(spark, sf_dir, "events"), F.col("value") > 50, F.col("event_id") % 5).select("event_id")
)
query("p24_recent_view", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) q")(
    lambda spark, sf_dir: L.first_rows(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 50).select("o_orderkey")
)
query("p25_contains_search", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%re%' OR lower(p_type) LIKE '%steel%' OR CAST(p_size AS STRING) LIKE '%7%'")(
    lambda spark, sf_dir: L.containing(table(spark, sf_dir, "part"), {"p_name": "re", "p_type": "steel", "p_size": "7"}).select("p_partkey")
)
query("p27_search_sorted", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size, p_partkey) AS BIGINT) AS n FROM part WHERE lower(p_name) LIKE '%a%'")(
    lambda spark, sf_dir: L.numbered(L.containing(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), {"p_name": "a"}), ["p_size", "p_partkey"]).select("p_partkey", "n")
)
query("p30_annotations_of_user", "SELECT event_id, value FROM events WHERE user_id = 3 AND event_type = (SELECT min(event_type) FROM events)")(
    lambda spark, sf_dir: L.matching(table(spark, sf_dir, "events").where("user_id = 3"), table(spark, sf_dir, "events").agg(F.min("event_type").alias("event_type"))).select("event_id", "value")
)
query("p31_without_system", "SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'")(
    lambda spark, sf_dir: L.history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")
)
query("p32_history_filter", "SELECT conv_id, turn FROM conversations c WHERE role <> 'system' AND NOT (role = 'user' AND trim(text) = (SELECT min(trim(text)) FROM conversations WHERE role = 'user'))")(
    lambda spark, sf_dir: L.history(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "conversations").where("role = 'user'").agg(F.min(F.trim("text"))).scalar()).select("conv_id", "turn")
)
query("p33_by_key", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")(
    lambda spark, sf_dir: table(spark, sf_dir, "customer").where("c_custkey = 42").select("c_custkey", "c_name")
)
query("p36_by_key_and_owner", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) AND o_custkey = (SELECT min_by(o_custkey, o_orderkey) FROM orders)")(
    lambda spark, sf_dir: L.matching(table(spark, sf_dir, "orders"), table(spark, sf_dir, "orders").agg(F.min("o_orderkey").alias("o_orderkey"), F.min_by("o_custkey", "o_orderkey").alias("o_custkey"))).select("o_orderkey", "o_custkey", "o_totalprice")
)
query("p38_exists", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")(
    lambda spark, sf_dir: L.with_exists(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "has_orders")
)
query("p44_chunks_of_document", "SELECT doc_id, source FROM (SELECT doc_id, source FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 20) q")(
    lambda spark, sf_dir: L.first_rows(table(spark, sf_dir, "documents").where("source = 'src1'").select("doc_id", "source"), ["doc_id"], 20)
)
query("p48_on_page", "SELECT page_id, url FROM pages WHERE page_id % 7 = 2")(
    lambda spark, sf_dir: table(spark, sf_dir, "pages").where("page_id % 7 = 2").select("page_id", "url")
)
query("p50_get_or_compute", "SELECT doc_id, quality AS v, 'saved' AS origin FROM labels UNION ALL SELECT d.doc_id, CAST(length(text) % 2 AS INT), 'computed' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")(
    lambda spark, sf_dir: L.get_or_compute(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "quality", (F.length("text") % 2).cast("int"))
)


@query("j09_membership_join", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 3 = 0")
def j09(spark, sf_dir):
    members = _members(spark, sf_dir).where("o_custkey % 3 = 0").select("o_custkey", F.explode("ids").alias("o_orderkey"))
    return members.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


query("j10_owned", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")(
    lambda spark, sf_dir: L.matching(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))).select("o_orderkey")
)


@query("j11_nested_sessions", "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def j11(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    nested = nest(c.select("conv_id").distinct(), c, "conv_id", "turn", ["role"], "messages")
    return nested.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query("j12_last_messages", "SELECT conv_id, least(count(*), 5) AS recent_count, count(*) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def j12(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    recent = recent_per_group(c, "conv_id", [F.desc("turn")], 5).groupBy("conv_id").agg(F.count("*").alias("recent_count"), F.max("turn").alias("last_turn"))
    return c.groupBy("conv_id").agg(F.count("*").alias("message_count")).join(recent, "conv_id")


@query("w10_recent_in_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 10")
def w10(spark, sf_dir):
    recent = recent_per_group(table(spark, sf_dir, "conversations"), "conv_id", [F.desc("turn")], 10)
    return recent.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("position"))


query("j02_two_key_fallback", "SELECT d.doc_id, coalesce(a.quality, b.toxic, -1) AS v FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id + 1")(
    lambda spark, sf_dir: L.look_up_first(table(spark, sf_dir, "documents").select("doc_id"), [(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "key"), F.col("doc_id"), "quality"), (table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "key"), F.col("doc_id") + 1, "toxic")], "v", F.lit(-1))
)
query("j22_seen_by_either_key", "SELECT c.c_custkey, coalesce(a.o_orderkey, b.o_orderkey) AS seen FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) a ON a.o_custkey = c.c_custkey LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) b ON b.o_custkey = c.c_custkey + 1")(
    lambda spark, sf_dir: L.look_up_first(table(spark, sf_dir, "customer").select("c_custkey"), [(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderkey").alias("seen")), F.col("c_custkey"), "seen"), (table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("seen")), F.col("c_custkey") + 1, "seen")], "seen")
)
query("j23_zip_by_ordinal", "SELECT d.doc_id, e.vec_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) d JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings) e ON d.n = e.n")(
    lambda spark, sf_dir: L.numbered(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]).join(L.numbered(table(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"]), "n").select("doc_id", "vec_id")
)
query("j14_previous_citations", "SELECT c.conv_id, c.turn, CAST(coalesce(CASE WHEN c.turn % 3 = 0 THEN length(p.text) END, length(c.text)) AS BIGINT) AS n FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")(
    lambda spark, sf_dir: L.with_previous(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("own")), "conv_id", "turn", "own", F.col("turn") % 3 == 0, "n").select("conv_id", "turn", "n")
)

query("a01_count_per_document", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")(
    lambda spark, sf_dir: L.counts_per(table(spark, sf_dir, "orders"), "o_custkey")
)
query("a02_stored_or_counted", "SELECT c_custkey, CASE WHEN c_custkey % 4 > 2 THEN c_custkey % 4 ELSE coalesce(n, 0) END AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")(
    lambda spark, sf_dir: L.look_up_first(table(spark, sf_dir, "customer").select("c_custkey"), [(L.counts_per(table(spark, sf_dir, "orders"), "o_custkey").withColumnRenamed("o_custkey", "key"), F.col("c_custkey"), "n")], "n", F.lit(0), F.when(F.col("c_custkey") % 4 > 2, F.col("c_custkey") % 4))
)
query("a08_reference_stats", "SELECT count(*) AS total, count(CASE WHEN value > 50 THEN 1 END) AS with_abstract, count(CASE WHEN NOT value > 50 THEN 1 END) AS without_abstract, count(CASE WHEN props IS NULL THEN 1 END) AS failed FROM events")(
    lambda spark, sf_dir: L.count_where(table(spark, sf_dir, "events"), "total", with_abstract=F.col("value") > 50, without_abstract=~(F.col("value") > 50), failed=F.col("props").isNull())
)
query("a09_label_counts", "SELECT count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, count(CASE WHEN event_type = 'view' THEN 1 END) AS views, count(*) AS n FROM events")(
    lambda spark, sf_dir: L.count_where(table(spark, sf_dir, "events"), "n", clicks=F.col("event_type") == "click", views=F.col("event_type") == "view")
)
query("a10_largest_groups", "SELECT source, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5) q")(
    lambda spark, sf_dir: L.largest_groups(table(spark, sf_dir, "documents"), "source", 5)
)
query("a15_grand_total", "SELECT CAST(sum(n) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM documents GROUP BY source) q")(
    lambda spark, sf_dir: L.counts_per(table(spark, sf_dir, "documents"), "source").agg(F.sum("n").alias("total"))
)
query("a31_newest", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) q WHERE r = 1")(
    lambda spark, sf_dir: L.best_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey")
)
query("a34_embedding_stats", "SELECT count(*) AS total, count(CASE WHEN vec_id IS NULL THEN 1 END) AS unembedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id")(
    lambda spark, sf_dir: L.count_where(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings"), F.col("vec_id") == F.col("doc_id"), "left"), "total", unembedded=F.col("vec_id").isNull())
)
query("o04_paging", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200) q")(
    lambda spark, sf_dir: L.first_rows(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 100, 200)
)
query("o05_newest_first", "SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20) q")(
    lambda spark, sf_dir: L.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 20)
)
query("o11_first_of_either", "SELECT c_custkey FROM (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 5 ORDER BY c_custkey LIMIT 1) q")(
    lambda spark, sf_dir: L.first_rows(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' or c_nationkey = 5"), ["c_custkey"], 1).select("c_custkey")
)
query("u07_union_of_stores", "SELECT doc_id AS id, lang, CAST(NULL AS STRING) AS url FROM documents UNION ALL SELECT page_id, CAST(NULL AS STRING), url FROM pages")(
    lambda spark, sf_dir: L.union_of_stores(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"))
)
query("u09_ego_graph", """SELECT id, role FROM (SELECT id, role, row_number() OVER (PARTITION BY id ORDER BY rank, id) AS r FROM (
  SELECT 5 AS id, 'central' AS role, 0 AS rank FROM (SELECT min(n_nationkey) AS x FROM nation) z UNION ALL SELECT n_nationkey, 'sibling', 1 FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 5)
  UNION ALL SELECT n_nationkey, 'descendant', 2 FROM nation WHERE n_nationkey > 10) q) w WHERE r = 1""")(
    lambda spark, sf_dir: L.roles_of_nodes("n_nationkey", central=table(spark, sf_dir, "nation").where("n_nationkey = 5"), sibling=L.matching(table(spark, sf_dir, "nation"), table(spark, sf_dir, "nation").where("n_nationkey = 5").select("n_regionkey")), descendant=table(spark, sf_dir, "nation").where("n_nationkey > 10"))
)
