"""Queries of files, table documents and typed search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..registry import query, table
from ..sources import files as S
from .search import SCORED, _asked

TYPES = ["image/png", "text/plain", "image/webp", "image/tiff"]


@query("SELECT page_id, array_to_string(list_transform(list_filter(list_transform(range(6), lambda i: {'n': 'f' || i, 't': (['image/png', 'text/plain', 'image/webp', 'image/tiff'])[((page_id + i) % 4 + 1)::INT], 's': length(html) * i}), lambda f: f.t IN ('image/png', 'image/webp') AND f.s <= 8000)[1:2], lambda f: f.n), ',') AS names FROM pages")
def usable_images(spark, sf_dir):
    """Six files a page; of those of a supported type and size the first two."""
    files = F.array(*[F.struct(F.lit(f"f{i}").alias("name"), F.array(*map(F.lit, TYPES))[((F.col("page_id") + i) % 4).cast("int")].alias("mimetype"), (F.length("html") * i).cast("long").alias("size")) for i in range(6)])
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(S.usable_images(files, 8_000, 2), lambda f: f["name"]), ",").alias("names"))


@query("SELECT 'region' AS name, 'Table: region' || chr(10) || string_agg('- ' || column_name || ' (' || CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END || ')', chr(10) ORDER BY ordinal_position) || chr(10) || 'Samples:' || chr(10) || (SELECT string_agg('r_regionkey=' || r_regionkey || ', r_name=' || r_name, chr(10) ORDER BY r_regionkey) FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 3)) AS content FROM information_schema.columns WHERE table_name = 'region'")
def table_document(spark, sf_dir):
    return S.table_document(table(spark, sf_dir, "region"), "region", ["r_regionkey"])


@query(f"{SCORED} SELECT query_id, id, score, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s JOIN documents d ON d.doc_id = s.id WHERE d.lang = 'en' AND score >= 0.1) WHERE rank <= 20")
def typed_search(spark, sf_dir):
    """Documents of a language that are like the query's vector; filters that are empty don't count."""
    known = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("language")), "vec_id")
    return R.search(_asked(spark, sf_dir), known, R.SearchFilter(language="en", source_type=""), limit=20, threshold=0.1).select("query_id", "id", "score", "rank")
