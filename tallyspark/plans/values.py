"""Column functions over whole given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, names, text
from . import views
from .registry import query


@query("titled_names", """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'mr' WHEN 1 THEN 'mrs' WHEN 2 THEN 'miss' WHEN 3 THEN 'dr' WHEN 4 THEN '' ELSE 'ms' END AS honorific,
 CASE c_custkey % 6 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Female' WHEN 5 THEN 'Female' END AS gender FROM customer""")
def titled_names(spark, sf_dir):
    title = F.element_at(F.array(*map(F.lit, ("Mr. ", "Mrs ", " MISS ", "Dr. ", "", "ms "))), (F.col("c_custkey") % 6 + 1).cast("int"))
    c = views.table(spark, sf_dir, "customer").select("c_custkey", F.concat(title, "c_name").alias("full_name"))
    return c.select("c_custkey", names.honorific("full_name").alias("honorific"), names.gender_from_title("full_name").alias("gender"))


@query("answers_normalised", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Yes' WHEN 3 THEN 'No' ELSE event_type END AS answer FROM events""")
def answers_normalised(spark, sf_dir):
    raw = F.element_at(F.array(F.lit(" Y"), F.lit("NONE."), F.lit("true"), F.lit("0"), F.col("event_type")), (F.col("event_id") % 5 + 1).cast("int"))
    return views.table(spark, sf_dir, "events").select("event_id", labels.yes_no(raw).alias("answer"))


@query("doubled_words_repaired", "SELECT p_partkey, p_name AS repaired FROM part")
def doubled_words_repaired(spark, sf_dir):
    """Part names printed with every letter of their longer words doubled, and repaired."""
    printed = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.when(F.length(w) >= 2, F.regexp_replace(w, "(.)", "$1$1")).otherwise(w)), " ")
    return views.table(spark, sf_dir, "part").select("p_partkey", text.repair_doubled(printed).alias("repaired"))


@query("pages_cited", """SELECT l_orderkey, l_linenumber, array_to_string(list_transform(list_sort(list_distinct(list_concat(range(l_linenumber, l_linenumber + CAST(l_quantity AS BIGINT) + 1), [99]))), lambda x: CAST(x AS VARCHAR)), ',') AS pages
 FROM (SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem)""")
def pages_cited(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").cast("long").alias("q"), "l_quantity").distinct()
    note = F.concat(F.lit("see pages "), F.col("l_linenumber").cast("string"), F.lit(" - "), (F.col("l_linenumber") + F.col("q")).cast("string"), F.lit(" and Page 99"))
    return li.select("l_orderkey", "l_linenumber", F.array_join(text.cited_pages(note).cast("array<string>"), ",").alias("pages"))


@query("json_maps", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS entries FROM events""")
def json_maps(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    made = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("id")))
    m = labels.json_map(F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(made))
    return e.select("event_id", F.try_element_at(m, F.lit("kind")).alias("kind"), F.size(m).alias("entries"))


@query("names_joined", """WITH n AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS a FROM nation GROUP BY 1 UNION ALL SELECT 100 + n_nationkey, [n_name] FROM nation)
 SELECT n_regionkey AS key, CASE len(a) WHEN 1 THEN a[1] ELSE array_to_string(a[1:len(a) - 1], ', ') || ' and ' || a[len(a)] END AS joined FROM n""")
def names_joined(spark, sf_dir):
    """Names of each region's nations as one phrase, and each nation by itself; a region has a handful."""
    n = views.table(spark, sf_dir, "nation")
    lists = n.groupBy(F.col("n_regionkey").cast("long").alias("key")).agg(F.array_sort(F.collect_list("n_name")).alias("a")).unionByName(
        n.select((100 + F.col("n_nationkey")).cast("long").alias("key"), F.array("n_name").alias("a")))
    return lists.select("key", labels.join_names("a").alias("joined"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", labels.content_hash("text").alias("content_hash"))
