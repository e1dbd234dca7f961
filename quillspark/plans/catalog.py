"""Queries of sources and their documents. The sources of the documents table stand in; nations are those that come new."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..registry import query, table

TYPE = "CASE WHEN min(doc_id) % 2 = 0 THEN 'notion' ELSE 'swagger' END"
SOURCES = f"(SELECT min(doc_id) AS source_id, source AS name, {TYPE} AS source_type FROM documents WHERE source IS NOT NULL GROUP BY source)"
NEW = "(SELECT n_nationkey + 1000000000 AS source_id, CASE WHEN n_nationkey < 20 THEN 'src' || n_nationkey ELSE 'nation' || n_regionkey END AS name, 'swagger' AS source_type FROM nation)"
DOCUMENTS = f"(SELECT d.doc_id, s.source_id, d.lang || ':' || d.doc_id AS external_id FROM documents d JOIN {SOURCES} s ON s.name = d.source)"


def _sources(spark, sf_dir):
    kind = F.when(F.min("doc_id") % 2 == 0, "notion").otherwise("swagger").alias("source_type")
    return table(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("name")).agg(F.min("doc_id").alias("source_id"), kind).select("source_id", "name", "source_type")


def _new(spark, sf_dir):
    name = F.when(F.col("n_nationkey") < 20, F.concat(F.lit("src"), "n_nationkey")).otherwise(F.concat(F.lit("nation"), "n_regionkey"))
    return table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1_000_000_000).cast("long").alias("source_id"), name.alias("name"), F.lit("swagger").alias("source_type"))


def _documents(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(_sources(spark, sf_dir).withColumnRenamed("name", "source"), "source")
    return joined.select("doc_id", "source_id", F.concat("lang", F.lit(":"), "doc_id").alias("external_id"))


@query(f"SELECT source_id, name, source_type FROM {SOURCES} UNION ALL SELECT min(source_id), name, 'swagger' FROM {NEW} WHERE name NOT IN (SELECT name FROM {SOURCES}) GROUP BY name")
def sources_added(spark, sf_dir):
    return C.add_sources(_sources(spark, sf_dir), _new(spark, sf_dir))


@query(f"SELECT source_id, CASE WHEN source_type = 'notion' THEN upper(name) ELSE name END AS name, source_type FROM {SOURCES}")
def sources_updated(spark, sf_dir):
    known = _sources(spark, sf_dir)
    changes = known.where("source_type = 'notion'").select("source_id", F.upper("name").alias("name"), F.lit(None).cast("string").alias("source_type"))
    return C.update_sources(known, changes)


@query(f"SELECT source_id, name, CASE WHEN name IN (SELECT name FROM {SOURCES}) THEN 'Source with name ''' || name || ''' already exists' ELSE 'Name ''' || name || ''' is given twice' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source_id) AS k FROM {NEW}) WHERE k > 1 OR name IN (SELECT name FROM {SOURCES})")
def sources_refused(spark, sf_dir):
    """New sources whose name is taken, and why."""
    return C.refused_sources(_sources(spark, sf_dir), _new(spark, sf_dir)).select("source_id", "name", "reason")


@query(f"SELECT source_id, 'changed' AS name, 'Source with ID ''' || source_id || ''' not found' AS reason FROM {NEW}")
def sources_unknown(spark, sf_dir):
    """Changes of sources that aren't there, and of some that are."""
    known = _sources(spark, sf_dir)
    changes = known.unionByName(_new(spark, sf_dir)).select("source_id", F.lit("changed").alias("name"))
    return C.unknown_sources(known, changes)


@query(f"SELECT source_id, name, source_type FROM {SOURCES} WHERE source_id = 5")
def source_by_id(spark, sf_dir):
    return C.by_id(_sources(spark, sf_dir), 5)


@query(f"SELECT s.source_id, count(d.doc_id) AS documents FROM (SELECT * FROM {SOURCES} WHERE source_type <> 'notion') s LEFT JOIN {DOCUMENTS} d ON d.source_id = s.source_id GROUP BY s.source_id")
def source_cascade(spark, sf_dir):
    """Sources of one type are deleted; what is left of the others and their documents."""
    known = _sources(spark, sf_dir)
    left, documents = C.delete_sources(known, _documents(spark, sf_dir), C.by_type(known, "notion"))
    return left.select("source_id").join(documents, "source_id", "left").groupBy("source_id").agg(F.count("doc_id").alias("documents"))


@query(f"SELECT source_id, name FROM {SOURCES} WHERE source_type = 'notion'")
def sources_by_type(spark, sf_dir):
    return C.by_type(_sources(spark, sf_dir), "notion").select("source_id", "name")


@query(f"SELECT source_id, name, source_type FROM {SOURCES} WHERE name = 'src3'")
def source_by_name(spark, sf_dir):
    return C.by_name(_sources(spark, sf_dir), "src3")


@query(f"SELECT doc_id, external_id FROM {DOCUMENTS} WHERE source_id = (SELECT source_id FROM {SOURCES} WHERE name = 'src3')")
def documents_by_source(spark, sf_dir):
    known = C.by_name(_sources(spark, sf_dir), "src3").select("source_id")
    return _documents(spark, sf_dir).join(known, "source_id", "left_semi").select("doc_id", "external_id")


@query(f"SELECT doc_id, source_id, external_id FROM {DOCUMENTS} WHERE external_id = 'en:93'")
def document_by_external_id(spark, sf_dir):
    return C.documents_of(_documents(spark, sf_dir), external_id="en:93").select("doc_id", "source_id", "external_id")


@query("SELECT external_id, arg_min(way, w) AS way FROM (SELECT url AS external_id, 'page' AS way, 0 AS w FROM pages WHERE url LIKE '%ref=%' UNION ALL SELECT url, 'item', 1 FROM pages WHERE url LIKE '%page=%') GROUP BY external_id")
def pages_reached_once(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("external_id")).distinct()
    ways = [pages.where(F.col("external_id").contains(mark)).withColumn("way", F.lit(way)) for mark, way in (("ref=", "page"), ("page=", "item"))]
    return C.reached_once(*ways)
