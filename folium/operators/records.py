"""Single records of a library: stamped inserts, updates that return the rows after them, guarded additions, deletes by owner, and
the shapes in which records are shown.

Tables are immutable as in `library`: a mutation returns the table after it, and where asked the rows it touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType, TimestampType

from folium.operators.library import delete_where, replace_by_key, update_where
from folium.plans.registry import query
from folium.session import table

# ---------------------------------------------------------------- mutations


def insert_stamped(old: DataFrame, new: DataFrame, now: Column, defaults: dict[str, Column] | None = None) -> DataFrame:
    """New rows with created_at and updated_at at `now` and defaults where a column is missing or null; other missing columns are null."""
    stamped = new.withColumns({"created_at": now, "updated_at": now})
    for name, value in (defaults or {}).items():
        stamped = stamped.withColumn(name, F.coalesce(F.col(name), value) if name in new.columns else value)
    return old.unionByName(stamped, allowMissingColumns=True)


def insert_and_read(old: DataFrame, new: DataFrame, key: str, value: object) -> tuple[DataFrame, DataFrame]:
    """The table with the new rows, and all its rows of one key, as they are after the insert."""
    after = old.unionByName(new)
    return after, after.where(F.col(key) == value)


def update_returning(old: DataFrame, condition: Column, changes: dict[str, Column], only_set: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table after an update, and the updated rows. The condition is of the rows before."""
    hit = F.coalesce(condition, F.lit(False))
    marked = update_where(old.withColumn("__hit", hit), F.col("__hit"), changes, only_set)
    return marked.drop("__hit"), marked.where("__hit").drop("__hit")


def add_guarded(collections: DataFrame, documents: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Requests (collection_id, user_id, document_id) put documents into collections (collection_id, user_id, document_ids, updated_at)
    if the user owns both. Ids that are there stay where they are, and such a request alone does not touch updated_at.
    Also returns the collections as they are after, of the granted requests. Requests of one collection are added in order of id."""
    owned = requests.join(documents.select("document_id", "user_id"), ["document_id", "user_id"], "left_semi")
    granted = owned.join(collections.select("collection_id", "user_id"), ["collection_id", "user_id"], "left_semi")
    wanted = granted.groupBy("collection_id").agg(F.array_sort(F.collect_set("document_id")).alias("__wanted"))
    both = collections.join(wanted, "collection_id", "left")
    have = F.coalesce(F.col("document_ids"), F.array().cast(collections.schema["document_ids"].dataType))
    fresh = F.filter("__wanted", lambda d: ~F.array_contains(have, d))
    grown = F.coalesce(F.size(fresh), F.lit(0)) > 0
    after = both.withColumn("updated_at", F.when(grown, now).otherwise(F.col("updated_at"))).withColumn("document_ids", F.when(grown, F.concat(have, fresh)).otherwise(F.col("document_ids")))
    columns = collections.columns
    return after.select(columns), after.where("__wanted is not null").select(columns)


def delete_of(old: DataFrame, **keys: object) -> tuple[DataFrame, DataFrame]:
    """The table without the rows that equal all the keys (an id and its owner, say), and how many there were."""
    if not keys:
        raise ValueError("a delete needs a key")
    condition = F.lit(True)
    for name, value in keys.items():
        condition = condition & (F.col(name) == value)
    return delete_where(old, condition)


def find(rows: DataFrame, newest: str | None = None, **keys: object) -> DataFrame:
    """Rows that equal all the keys, the newest first where a column is named."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.desc(newest)) if newest else rows


# ---------------------------------------------------------------- shapes


def stringified(kind: DataType, ids: tuple[str, ...]) -> DataType:
    """A type with all fields of these names as strings, at any depth, and arrays of them as arrays of strings."""
    def of(field: DataType, name: str) -> DataType:
        if isinstance(field, StructType):
            out = StructType()
            for f in field.fields:
                out = out.add(f.name, of(f.dataType, f.name), f.nullable)
            return out
        if isinstance(field, ArrayType):
            return ArrayType(of(field.elementType, name), field.containsNull)
        if isinstance(field, MapType):
            return MapType(field.keyType, of(field.valueType, name), field.valueContainsNull)
        return StringType() if name in ids else field

    return of(kind, "")


def with_string_ids(rows: DataFrame, *ids: str) -> DataFrame:
    """Columns and nested fields of these names as strings."""
    shape = stringified(rows.schema, ids)
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in shape.fields])


def collection_response(collections: DataFrame) -> DataFrame:
    """Ids as strings, an empty list for none, and their number."""
    ids = F.coalesce(F.transform("document_ids", lambda i: i.cast("string")), F.expr("cast(array() as array<string>)"))
    return collections.select(F.col("collection_id").cast("string").alias("id"), "name", ids.alias("document_ids"), F.size(ids).alias("document_count"))


def hit_response(hits: DataFrame, score: str = "score") -> DataFrame:
    """Rank, score, text, and all other columns as metadata."""
    rest = [c for c in hits.columns if c not in ("rank", "text", score)]
    return hits.select("rank", F.col(score).alias("score"), "text", F.struct(*rest).alias("metadata"))


def normalised_assets(paths: Column, tables: Column) -> tuple[Column, Column]:
    """Image paths as (data), and tables (data, relative_path, label) with the path for a missing data; no list is an empty one."""
    images = F.transform(F.coalesce(paths, F.expr("cast(array() as array<string>)")), lambda p: F.struct(F.coalesce(p, F.lit("")).alias("data")))
    kept = F.transform(tables, lambda t: F.struct(F.coalesce(F.nullif(t["data"], F.lit("")), t["relative_path"], F.lit("")).alias("data"), t["label"].alias("label")))
    return images, F.coalesce(kept, F.expr("cast(array() as array<struct<data:string,label:string>>)"))


def has_image(content: Column, images: Column) -> Column:
    return (F.coalesce(F.size(images), F.lit(0)) > 0) | F.coalesce(content.contains("data:image/"), F.lit(False))


def inline_images(content: Column) -> Column:
    """The bytes of images that are written into a text."""
    found = F.regexp_extract_all(content, F.lit(r"data:image/[^;]+;base64,([A-Za-z0-9+/=]+)"), 1)
    return F.filter(F.transform(found, lambda b: F.try_to_binary(b, F.lit("base64"))), lambda b: b.isNotNull())


def on_shown_page(highlights: DataFrame, labels: list[str], page: int) -> DataFrame:
    """Highlights of a visible label with a box on the page; boxes count pages from 0."""
    return highlights.where(F.col("label").isin(labels) & F.exists("boxes", lambda b: b["page"] == page - 1))


def summary_fields(summaries: DataFrame, field: str | None = None) -> DataFrame:
    """The final summary, the important sections, or both."""
    shown = {"summary_final": F.col("summary_template").alias("summary_final"), "important_sections": F.col("important_sections")}
    if field is not None and field not in shown:
        raise ValueError(f"{field} is no field of a summary")
    return summaries.select("document_id", *[c for name, c in shown.items() if field in (None, name)])


def iso_times(rows: DataFrame) -> DataFrame:
    """Timestamps as ISO 8601 text, at the top level; null stays null."""
    times = [f.name for f in rows.schema.fields if isinstance(f.dataType, TimestampType) or f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in times})


def boxes_of_text(coordinates: Column, sizes: Column) -> Column:
    """Boxes (page, x, y, w, h) of 'page,x,y,w,h;...'. `sizes`, a map of page to (w, h), gives shares of the page where it knows it;
    groups that don't parse are left out."""
    def box(group: Column) -> Column:
        p = F.split(group, ",")
        number = lambda i: F.get(p, F.lit(i)).try_cast("double")
        page = F.get(p, F.lit(0)).try_cast("int")
        size = F.try_element_at(sizes, page)
        by = lambda v, s: F.when(size.isNotNull(), v / s).otherwise(v)
        return F.struct(page.alias("page"), by(number(1), size["w"]).alias("x"), by(number(2), size["h"]).alias("y"), by(number(3), size["w"]).alias("w"), by(number(4), size["h"]).alias("h"))

    found = F.transform(F.split(coordinates, ";"), box)
    return F.coalesce(F.filter(found, lambda b: b["page"].isNotNull() & b["x"].isNotNull() & b["y"].isNotNull() & b["w"].isNotNull() & b["h"].isNotNull()), F.array().cast("array<struct<page:int,x:double,y:double,w:double,h:double>>"))


def section_texts(wanted: DataFrame, sections: DataFrame, group: str = "doc_id", order: str = "pos") -> DataFrame:
    """Per group, the texts of the wanted titles (title, ord), each the first section of that title, joined by an empty line."""
    first = sections.groupBy(group, "title").agg(F.min_by("text", order).alias("text"))
    found = first.join(F.broadcast(wanted), "title")  # a template's titles
    return found.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


# ---------------------------------------------------------------- queries


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("k12_insert_and_read", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def k12(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    first = o.agg(F.min("o_custkey")).first()[0]
    return insert_and_read(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", first)[1]


@query("k13_replace_references", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 4 <> 1 UNION ALL SELECT o_custkey, -o_orderkey FROM orders WHERE o_custkey % 4 = 1")
def k13(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_custkey", "o_orderkey")
    return replace_by_key(o, o.where("o_custkey % 4 = 1").select("o_custkey", (-F.col("o_orderkey")).alias("o_orderkey")), "o_custkey")


@query("k21_insert_stamped", "SELECT c_custkey, 7::BIGINT AS created_at, 7::BIGINT AS updated_at, CASE WHEN c_mktsegment = 'BUILDING' THEN '#ffff00' ELSE c_mktsegment END AS color FROM customer")
def k21(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("color"))
    now = F.lit(7).cast("long")
    none = c.limit(0).withColumns({"created_at": now, "updated_at": now})
    return insert_stamped(none, c, now, {"color": F.lit("#ffff00")})


@query("k25_update_returning", "SELECT o_orderkey, 'done' AS o_orderstatus, o_orderpriority FROM orders WHERE o_custkey % 6 = 2 AND o_orderstatus = 'O'")
def k25(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return update_returning(o, F.expr("o_custkey % 6 = 2 and o_orderstatus = 'O'"), {"o_orderstatus": F.lit("done")})[1].drop("o_custkey")


@query("k39_update_non_null_returning", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 6 = 2 THEN 'low' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def k39(spark, sf_dir):
    after, _ = update_returning(_orders(spark, sf_dir), F.col("o_custkey") % 6 == 2, {"o_orderstatus": F.lit(None).cast("string"), "o_orderpriority": F.lit("low")}, only_set=True)
    return after.drop("o_custkey")


@query("k26_guarded_add", """WITH c AS (SELECT o_custkey AS id, o_custkey % 3 AS u, list(o_orderkey ORDER BY o_orderkey) AS d FROM orders GROUP BY o_custkey), r AS (SELECT o_custkey AS id, o_custkey % 3 AS u, unnest([o_custkey + 1, min(o_orderkey), o_custkey + 3]) AS w FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey),
g AS (SELECT r.id, list(DISTINCT w ORDER BY w) AS w FROM r JOIN (SELECT DISTINCT o_orderkey, o_orderkey % 3 AS du FROM orders) x ON w = o_orderkey AND du = r.u GROUP BY r.id)
SELECT c.id AS collection_id, (CASE WHEN g.w IS NULL THEN len(d) ELSE len(list_distinct(list_concat(d, g.w))) - len(list_distinct(d)) + len(d) END)::INT AS documents, (CASE WHEN g.w IS NOT NULL AND len(list_filter(g.w, lambda x: NOT list_contains(d, x))) > 0 THEN 1 ELSE 0 END)::INT AS updated_at FROM c LEFT JOIN g USING (id)""")
def k26(spark, sf_dir):
    o = _orders(spark, sf_dir)
    c = o.groupBy(F.col("o_custkey").alias("collection_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("document_ids"), F.min("o_orderkey").alias("least"))
    c = c.withColumn("user_id", F.col("collection_id") % 3).withColumn("updated_at", F.lit(0))
    d = o.select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderkey") % 3).alias("user_id")).distinct()
    r = c.where("collection_id % 2 = 0").select("collection_id", "user_id", F.explode(F.array(F.col("collection_id") + 1, "least", F.col("collection_id") + 3)).alias("document_id"))
    after, _ = add_guarded(c.drop("least"), d, r, F.lit(1))
    return after.select("collection_id", F.size("document_ids").alias("documents"), "updated_at")


@query("k28_delete_of_owner", "SELECT count(*) AS deleted FROM events WHERE user_id = 3 AND event_type = 'click'")
def k28(spark, sf_dir):
    return delete_of(table(spark, sf_dir, "events"), user_id=3, event_type="click")[1]


@query("k44_delete_owned", "SELECT event_id FROM events WHERE NOT coalesce(event_id = 5 AND user_id = (SELECT min(user_id) FROM events WHERE event_id = 5), false)")
def k44(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return delete_of(e, event_id=5, user_id=e.where("event_id = 5").agg(F.min("user_id")).first()[0])[0].select("event_id")


query("p35_newest_of_owner", "SELECT event_id, user_id FROM events WHERE user_id = 3")(lambda spark, sf_dir: find(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", user_id=3))
query("p12_collection_response", "SELECT o_custkey::VARCHAR AS id, 'c' || o_custkey AS name, count(*)::INT AS document_count, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS document_ids FROM orders GROUP BY o_custkey")(
    lambda spark, sf_dir: collection_response(
        _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("collection_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("document_ids")).withColumn("name", F.concat(F.lit("c"), "collection_id"))
    ).withColumn("document_ids", F.array_join("document_ids", ","))
)
query("p13_hit_response", "SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, turn AS score, text, conv_id, role FROM conversations")(
    lambda spark, sf_dir: hit_response(
        table(spark, sf_dir, "conversations").withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")), "turn"
    ).select("rank", "score", "text", "metadata.conv_id", "metadata.role")
)
query("p15_string_ids", "SELECT o_custkey::VARCHAR AS o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey")(
    lambda spark, sf_dir: with_string_ids(_orders(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey"))).alias("items")), "o_custkey", "o_orderkey").select("o_custkey", F.array_join("items.o_orderkey", ",").alias("ids"))
)
query("p16_normalised_assets", "SELECT p_partkey, p_name AS image, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS data FROM part")(
    lambda spark, sf_dir: (lambda p, a: p.select("p_partkey", a[0].alias("i"), a[1].alias("t")).select("p_partkey", F.get("i", F.lit(0))["data"].alias("image"), F.get("t", F.lit(0))["data"].alias("data")))(
        table(spark, sf_dir, "part"), normalised_assets(F.array("p_name"), F.array(F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("data"), F.col("p_brand").alias("relative_path"), F.lit("l").alias("label"))))
    )
)


def _messages(spark, sf_dir) -> DataFrame:
    """Messages, every other one with an image in its text."""
    image = F.concat(F.lit(" data:image/png;base64,"), F.base64(F.encode("role", "UTF-8")), F.lit(" end"))
    return table(spark, sf_dir, "conversations").withColumn("content", F.concat("text", F.when(F.col("turn") % 2 == 0, image).otherwise("")))


query("p45_has_image", "SELECT conv_id, turn, turn % 2 = 0 OR turn % 3 = 0 AS image FROM conversations")(
    lambda spark, sf_dir: _messages(spark, sf_dir).select("conv_id", "turn", has_image(F.col("content"), F.when(F.col("turn") % 3 == 0, F.array(F.lit("a")))).alias("image"))
)
query("p46_inline_images", "SELECT conv_id, turn, role AS image FROM conversations WHERE turn % 2 = 0")(
    lambda spark, sf_dir: _messages(spark, sf_dir).select("conv_id", "turn", F.explode(inline_images(F.col("content"))).alias("b")).select("conv_id", "turn", F.decode("b", "UTF-8").alias("image"))
)
query("p47_on_shown_page", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND (event_id % 5 = 2 OR event_id % 7 = 2)")(
    lambda spark, sf_dir: on_shown_page(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"), F.array(F.struct((F.col("event_id") % 5).alias("page")), F.struct((F.col("event_id") % 7).alias("page"))).alias("boxes")), ["click", "view"], 3).select("event_id")
)
query("p49_summary_fields", "SELECT p_partkey AS document_id, p_name AS summary_final FROM part")(
    lambda spark, sf_dir: summary_fields(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("summary_template"), F.array("p_type").alias("important_sections")), "summary_final")
)
query("f78_iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events")(lambda spark, sf_dir: iso_times(table(spark, sf_dir, "events").select("event_id", "ts")))
query("f28_boxes_of_text", "SELECT p_partkey, 1::INT AS page, p_size / 100.0::DOUBLE AS x, 5 / 200.0::DOUBLE AS y FROM part UNION ALL SELECT p_partkey, 9, p_size::DOUBLE, 5.0 FROM part")(
    lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", F.explode(boxes_of_text(
        F.concat(F.lit("1,"), F.col("p_size").cast("string"), F.lit(",5,1,1;bad;2,x,1,1,1;9,"), F.col("p_size").cast("string"), F.lit(",5,1,1")), F.expr("map(1, named_struct('w', 100D, 'h', 200D))"))).alias("b")).select("p_partkey", "b.page", "b.x", "b.y")
)
query("f74_section_texts", "WITH f AS (SELECT conv_id, role, min_by(text, turn) AS text FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL) SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY role DESC) AS text FROM f GROUP BY conv_id")(
    lambda spark, sf_dir: section_texts(spark.createDataFrame([("user", 0), ("assistant", 1)], "title string, ord int"), table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("title"), "text"), "conv_id")
)
