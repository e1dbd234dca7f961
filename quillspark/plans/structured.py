"""Queries of structured sources. Each nation and each region's depot has a specification made from its row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, table
from ..sources import openapi as O

#: The same text in Spark and in SQL: shipments of a nation in version 3, depots of odd nations in version 2.
SPEC = """concat('{"info":{"title":"Cargo ', n_nationkey, '"},', CASE WHEN n_nationkey % 2 = 0 THEN concat('"openapi":"3.0.3","servers":[{"url":"https://cargo', n_nationkey, '.example/v', n_regionkey, '/"}]')
 ELSE concat('"swagger":"2.0","host":"depot', n_nationkey, '.example","basePath":"/v', n_regionkey, '","schemes":["http"]') END,
 ',"paths":{"/shipments/', n_nationkey, '":{"get":{"operationId":"ship', n_nationkey, '","summary":"', n_name, '","tags":["cargo","n', n_nationkey, '"],"parameters":[{"name":"deck","in":"query","required":true,"schema":{"type":"integer"},"description":"Level"}],"responses":{"200":{"description":"here"},"404":{"description":"lost"}}},"put":{"deprecated":', CASE WHEN n_nationkey % 3 = 0 THEN 'true' ELSE 'false' END, '},"x-note":{}}},',
 '"components":{"schemas":{"Crate":{"title":"Crate ', n_nationkey, '"},"a/b":{"title":"Slash"}}}}')"""
BASE = "CASE WHEN n_nationkey % 2 = 0 THEN concat('https://cargo', n_nationkey, '.example/shipments/', n_nationkey) ELSE concat('http://depot', n_nationkey, '.example/shipments/', n_nationkey) END"
PATH = "concat('/shipments/', n_nationkey)"


def _specs(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.expr(SPEC).alias("value"))


@query(f"""SELECT concat('GET:', {PATH}) AS external_id, {PATH} AS path, 'GET' AS http_method, concat('ship', n_nationkey) AS operation_id, 1::BIGINT AS n_parameters, false AS deprecated, {BASE} AS url FROM nation
 UNION ALL SELECT concat('PUT:', {PATH}), {PATH}, 'PUT', '', 0, n_nationkey % 3 = 0, {BASE} FROM nation""")
def openapi_endpoints(spark, sf_dir):
    return O.endpoints(_specs(spark, sf_dir)).select("external_id", "path", "http_method", "operation_id", "n_parameters", "deprecated", "url")


@query(f"""SELECT concat('GET:', {PATH}) AS external_id, concat('[GET] ', {PATH}, ' - ', n_name) AS title, concat('# GET ', {PATH}, chr(10), chr(10), '**API**: Cargo ', n_nationkey, chr(10), '**Summary**: ', n_name, chr(10), chr(10), '**Tags**: cargo, n', n_nationkey, chr(10), chr(10), '## Parameters', chr(10), chr(10), '- **deck** (query, integer) (required)', chr(10), '  - Level', chr(10), chr(10), '## Responses', chr(10), chr(10), '- **200**: here', chr(10), '- **404**: lost') AS content FROM nation
 UNION ALL SELECT concat('PUT:', {PATH}), concat('[PUT] ', {PATH}), concat('# PUT ', {PATH}, chr(10), chr(10), '**API**: Cargo ', n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN concat(chr(10), chr(10), '⚠️ **DEPRECATED**: 이 엔드포인트는 더 이상 사용되지 않습니다.') ELSE '' END) FROM nation""")
def openapi_documents(spark, sf_dir):
    return O.documents_of(_specs(spark, sf_dir)).drop("metadata")


REFS = ["#/components/schemas/Crate", "#/components/schemas/a~1b", "#/components/schemas/Lost", "other.json#/components/schemas/Crate"]


@query(f"SELECT n_nationkey, ref, CASE WHEN ref LIKE '#/%' THEN json_extract_string(spec, substr(ref, 2) || '/title') END AS title FROM (SELECT n_nationkey, {SPEC} AS spec FROM nation), (SELECT unnest({REFS}) AS ref)")
def openapi_refs(spark, sf_dir):
    each = _specs(spark, sf_dir).select("n_nationkey", "value", F.explode(F.array(*map(F.lit, REFS))).alias("ref"))
    return each.select("n_nationkey", "ref", F.get_json_object(O.resolve(F.col("ref"), F.col("value")), "$.title").alias("title"))


#: Operations that name their parameters, bodies and answers: directly, through another reference, in a circle, and in vain.
LINKED = """concat('{"openapi":"3.1.0","info":{"title":"Port ', n_nationkey, '"},"servers":[{"url":"https://port.example"}],"paths":{"/berths/', n_nationkey, '":{"post":{"operationId":"berth","tags":["port"],"parameters":[{"$ref":"#/components/parameters/Lane"},{"$ref":"#/components/parameters/Again"},{"name":"kind","in":"header","schema":{}},{"$ref":"#/components/parameters/Round"},{"$ref":"other.json#/x"}],"requestBody":',
 CASE n_nationkey % 4 WHEN 0 THEN '{"$ref":"#/components/requestBodies/Ship"}' WHEN 1 THEN '{"required":true,"content":{"text/plain":{},"application/json":{"schema":{"type":"object"}}}}' WHEN 2 THEN '{"$ref":"#/components/requestBodies/Lost"}' ELSE '{}' END,
 ',"responses":{"201":{"$ref":"#/components/responses/Made"},"404":{"description":"no berth ', n_nationkey, '"}}}}},"components":{"parameters":{"Lane":{"name":"lane","in":"path","required":true,"description":"Lane ', n_regionkey, '","schema":{"type":"integer"}},"Again":{"$ref":"#/components/parameters/Twice"},"Twice":{"$ref":"#/components/parameters/Lane"},"Round":{"$ref":"#/components/parameters/Trip"},"Trip":{"$ref":"#/components/parameters/Round"}},',
 '"requestBodies":{"Ship":{"description":"Ship of ', n_name, '","content":{"application/json":{},"application/xml":{}}}},"responses":{"Made":{"$ref":"#/components/responses/Done"},"Done":{"description":"berthed"}}}}')"""
LANE = "'- **lane** (path, integer) (required)', chr(10), '  - Lane ', n_regionkey, chr(10)"


@query(f"""SELECT concat('POST:/berths/', n_nationkey) AS external_id, 'berth' AS operation_id, concat('# POST /berths/', n_nationkey, chr(10), chr(10), '**API**: Port ', n_nationkey, chr(10), chr(10), '**Tags**: port', chr(10), chr(10), '## Parameters', chr(10), chr(10), {LANE}, {LANE}, '- **kind** (header, object)', chr(10), '- **** (, string)', chr(10), '- **** (, string)', chr(10), chr(10),
 CASE n_nationkey % 4 WHEN 0 THEN concat('## Request Body', chr(10), 'Ship of ', n_name, chr(10), '**Content-Type**: application/json, application/xml', chr(10), chr(10)) WHEN 1 THEN concat('## Request Body', chr(10), '**Content-Type**: text/plain, application/json', chr(10), chr(10)) WHEN 2 THEN concat('## Request Body', chr(10), chr(10)) ELSE '' END,
 '## Responses', chr(10), chr(10), '- **201**: berthed', chr(10), '- **404**: no berth ', n_nationkey) AS content FROM nation""")
def openapi_linked_documents(spark, sf_dir):
    """Endpoints whose parts are references, followed to their ends."""
    specs = table(spark, sf_dir, "nation").select(F.expr(LINKED).alias("value"))
    return O.documents_of(specs).select("external_id", F.col("metadata.operation_id").alias("operation_id"), "content")
