"""Queries of paged sources and page records. The rows of ``pages`` stand in for the records of a workspace."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import page_records as P
from ..registry import query, shared_folder, table
from ..sources import paged


#: Four lists of pages; the title hides in a property of another name and type from page to page.
RECORD = """concat('{"id":"p', page_id, '","url":"', url, '","created_time":"2024-01-', lpad(CAST(page_id % 28 + 1 AS varchar(2)), 2, '0'), 'T00:00:00Z","created_by":{"id":"u', page_id % 7, '"},',
 CASE page_id % 3 WHEN 0 THEN '"archived":true,' WHEN 1 THEN '"archived":"unknown",' ELSE '' END,
 CASE page_id % 4 WHEN 0 THEN '"icon":{"type":"emoji","emoji":"📄"},' WHEN 1 THEN concat('"icon":{"type":"external","external":{"url":"https://icons.example/', page_id, '"}},') WHEN 2 THEN '"icon":{"type":"file"},' ELSE '"icon":null,' END,
 '"properties":{"Status":{"type":"select","select":{"name":"open"}},"Tags":{"type":"multi_select","multi_select":[{"name":"a"},{"name":"b"}]},"Votes":{"type":"number","number":', page_id, '}',
 CASE page_id % 5 WHEN 0 THEN concat(',"Name":{"type":"title","title":[{"plain_text":"Page "},{"plain_text":"', page_id, '"}]}') WHEN 1 THEN concat(',"Zeta":{"type":"title","title":[{"plain_text":"Z', page_id, '"}]}')
  WHEN 2 THEN ',"Name":{"type":"rich_text","rich_text":[{"plain_text":"no title"}]}' WHEN 3 THEN concat(',"title":{"type":"title","title":[]},"이름":{"type":"title","title":[{"plain_text":"이름 ', page_id, '"}]}') ELSE '' END, '}}')"""


def _records(spark, sf_dir):
    found = table(spark, sf_dir, "pages")
    return found.select(F.concat(F.lit("list"), F.col("page_id") % 4).alias("collection"), F.col("page_id").alias("position"), F.expr(RECORD).alias("record"))


def _paged(spark, sf_dir, page_size: int = 20):
    folder = shared_folder(spark, "pages")
    names = paged.write_pages(_records(spark, sf_dir), folder, page_size)
    return paged.read_paged(spark, "quillspark.sources.paged:folder_pages", names, folder, page_size)


@query("SELECT 'list' || page_id % 4 AS collection, nullif((row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) - 1) // 20, 0)::VARCHAR AS cursor, ((row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) - 1) % 20)::INTEGER AS position, 'p' || page_id AS id FROM pages")
def paged_records(spark, sf_dir):
    """Every record once, in the page in which it was handed out."""
    return _paged(spark, sf_dir).select("collection", "cursor", "position", F.try_variant_get(F.try_parse_json("record"), "$.id", "string").alias("id"))


@query("""SELECT 'p' || page_id AS id, CASE page_id % 5 WHEN 0 THEN 'Page ' || page_id WHEN 1 THEN 'Z' || page_id WHEN 3 THEN '이름 ' || page_id ELSE '제목 없음' END AS title, url,
 '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' AS created_time, NULL::VARCHAR AS last_edited_time, 'u' || page_id % 7 AS created_by, NULL::VARCHAR AS last_edited_by,
 page_id % 3 = 0 AS archived, CASE page_id % 4 WHEN 0 THEN '📄' WHEN 1 THEN 'https://icons.example/' || page_id END AS icon FROM pages""")
def page_metadata(spark, sf_dir):
    """Title, times, authors and icon of records that come page by page."""
    return P.page_rows(_paged(spark, sf_dir))
