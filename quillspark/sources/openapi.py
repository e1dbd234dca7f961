"""OpenAPI and Swagger documents as endpoint rows: from_json, two explodes, and references followed by a recursive query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERBS = ["get", "post", "put", "delete", "patch", "head", "options"]
# What may be a reference is kept as JSON until that is followed.
OPERATION = "struct<operationId:string,summary:string,description:string,tags:array<string>,parameters:array<string>,requestBody:string,deprecated:boolean,responses:map<string,string>>"
SPEC = f"info struct<title:string>, openapi string, swagger string, host string, basePath string, schemes array<string>, servers array<struct<url:string>>, paths map<string,map<string,{OPERATION}>>"
PARAMETER = "struct<name:string,`in`:string,required:boolean,description:string,schema:struct<type:string>,type:string>"
BODY = "struct<description:string,required:boolean,content:map<string,string>>"


def url_join(base: Column, path: Column) -> Column:
    """An absolute path replaces that of the base."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return F.when(F.coalesce(base, F.lit("")) == "", path).when(path.startswith("/"), F.concat(origin, path)).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), path))


def reference(node: Column) -> Column:
    """The pointer of a JSON object that is a reference, else null."""
    return F.get_json_object(node, "$['$ref']")


def resolve(ref: Column, spec: Column) -> Column:
    """The JSON of what a reference into its own document names; an object without fields where it names nothing or another document."""
    parts = F.transform(F.split(F.substr(ref, F.lit(3)), "/"), lambda p: F.concat(F.lit("['"), F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")), F.lit("']")))
    found = F.call_function("get_json_object", spec, F.concat(F.lit("$"), F.array_join(parts, "")))
    return F.when(ref.startswith("#/"), F.coalesce(found, F.lit("{}"))).otherwise(F.lit("{}"))


def closure(refs: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec, ref, node): what each reference names in the end, of references (spec, ref) into documents (spec, value).

    A recursive query follows a node that is a reference itself, one step a round. A circle of references has no end and
    gives no row. Spark fails, rather than return a part, beyond its limits of recursion.
    """
    following = "get_json_object(w.node, '$[\\'$ref\\']')"
    steps = refs.sparkSession.sql(
        f"""WITH RECURSIVE walked AS (
             SELECT spec, ref, node, array(ref) AS passed FROM {{first}}
             UNION ALL
             SELECT w.spec, w.ref, nvl(get_json_object(s.value, concat('$', array_join(transform(split(substr({following}, 3), '/'),
                 p -> concat("['", replace(replace(p, '~1', '/'), '~0', '~'), "']")), ''))), '{{{{}}}}') AS node, concat(w.passed, array({following})) AS passed
             FROM walked w JOIN {{specs}} s ON s.spec = w.spec WHERE {following} LIKE '#/%' AND NOT array_contains(w.passed, {following}))
           SELECT spec, ref, node FROM walked""",
        first=refs.join(specs, "spec").select("spec", "ref", resolve(F.col("ref"), F.col("value")).alias("node")), specs=specs,
    )
    return steps.where(reference(F.col("node")).isNull())


def _base_url() -> Column:
    version = F.coalesce("openapi", "swagger")
    old = F.concat(F.coalesce(F.element_at("schemes", 1), F.lit("https")), F.lit("://"), F.coalesce("host", F.lit("")), F.coalesce("basePath", F.lit("")))
    refused = F.raise_error(F.concat(F.lit("unsupported version: "), F.coalesce(version, F.lit("none"))))
    return F.when(version.startswith("2."), old).when(version.startswith("3."), F.try_element_at("servers", F.lit(1))["url"]).otherwise(refused)


def operations(specs: DataFrame, text: str = "value") -> DataFrame:
    """One row per path and verb of JSON documents of version 2.x or 3.x; other versions fail the query.

    api, base_url, path, method, operation_id, summary, description, tags, deprecated, parameters (name, in, required,
    description, type), body (description, required, media_types; null where there is none) and responses (status,
    description) in the document's order. Parameters, bodies and responses that are references stand as what these name
    in the end, without fields where that is nothing. The parts of a document that are references are looked up once for
    each document, however many operations name them.
    """
    keyed = specs.select(F.sha2(text, 256).alias("spec"), F.col(text).alias("value"))
    parsed = keyed.select("spec", F.from_json("value", SPEC).alias("s")).select("spec", "s.*")
    paths = parsed.select("spec", F.col("info.title").alias("api"), _base_url().alias("base_url"), F.explode("paths").alias("path", "verbs"))
    each = paths.select("spec", "api", "base_url", "path", F.explode("verbs").alias("verb", "o")).where(F.lower("verb").isin(VERBS))
    none = F.array().cast("array<string>")
    parts = F.concat(F.coalesce("o.parameters", none), F.coalesce(F.map_values("o.responses"), none), F.array("o.requestBody"))
    refs = each.select("spec", F.explode(F.transform(parts, reference)).alias("ref")).where("ref is not null").distinct()
    known = closure(refs, keyed.distinct()).groupBy("spec").agg(F.map_from_entries(F.collect_list(F.struct("ref", "node"))).alias("known"))
    met = each.join(known, "spec", "left")
    found = lambda ref: F.coalesce(F.try_element_at("known", ref), F.lit("{}"))
    plain = lambda node: F.when(reference(node).isNotNull(), found(reference(node))).otherwise(node)
    some = lambda c: F.coalesce(c, F.lit(""))

    def parameter(node: Column) -> Column:
        p, has_schema = F.from_json(plain(node), PARAMETER), F.get_json_object(plain(node), "$.schema").isNotNull()
        kind = F.when(has_schema, F.coalesce(p["schema"]["type"], F.lit("object"))).otherwise(F.coalesce(p["type"], F.lit("string")))
        return F.struct(some(p["name"]).alias("name"), some(p["in"]).alias("in"), F.coalesce(p["required"], F.lit(False)).alias("required"), some(p["description"]).alias("description"), kind.alias("type"))

    body = F.from_json(plain(F.col("o.requestBody")), BODY)
    media = F.coalesce(F.map_keys(body["content"]), none)
    asked = F.struct(some(body["description"]).alias("description"), F.coalesce(body["required"], F.lit(False)).alias("required"), media.alias("media_types"))
    response = lambda e: F.struct(e["key"].alias("status"), some(F.get_json_object(plain(e["value"]), "$.description")).alias("description"))
    return met.select(
        "api", "base_url", "path", F.upper("verb").alias("method"), some(F.col("o.operationId")).alias("operation_id"), some(F.col("o.summary")).alias("summary"), some(F.col("o.description")).alias("description"),
        F.coalesce("o.tags", none).alias("tags"), F.coalesce("o.deprecated", F.lit(False)).alias("deprecated"),
        F.transform(F.coalesce("o.parameters", none), parameter).alias("parameters"), F.when(~F.coalesce("o.requestBody", F.lit("{}")).isin("{}", "null"), asked).alias("body"),
        F.transform(F.map_entries(F.coalesce("o.responses", F.create_map().cast("map<string,string>"))), response).alias("responses"),
    )


def external_id() -> Column:
    return F.concat("method", F.lit(":"), "path")


def endpoints(specs: DataFrame, text: str = "value") -> DataFrame:
    """What a list of endpoints shows of ``operations``."""
    return operations(specs, text).select(
        external_id().alias("external_id"), "path", F.col("method").alias("http_method"), "operation_id", "summary", "tags", F.size("parameters").cast("long").alias("n_parameters"),
        F.array_sort(F.transform("responses", lambda r: r["status"])).alias("statuses"), "deprecated", url_join(F.col("base_url"), F.col("path")).alias("url"),
    )


def title(method: Column, path: Column, summary: Column) -> Column:
    return F.concat(F.lit("["), method, F.lit("] "), path, F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit(" - "), summary)).otherwise(""))


# The headings of an endpoint's text, and the line of one that is out of use.
PARAMETERS, REQUEST, RESPONSES, CONTENT_TYPE = "## Parameters", "## Request Body", "## Responses", "**Content-Type**: "
DEPRECATED = "⚠️ **DEPRECATED**: 이 엔드포인트는 더 이상 사용되지 않습니다."


def markdown() -> Column:
    """A row of ``operations`` as Markdown: what is there of its API, summary, description, tags, warning, parameters, body and responses."""
    some = lambda c: F.nullif(c, F.lit(""))
    line = lambda mark, c: F.concat(F.lit(mark), some(c))
    parameter = lambda p: F.concat_ws("\n", F.concat(F.lit("- **"), p["name"], F.lit("** ("), p["in"], F.lit(", "), p["type"], F.lit(")"), F.when(p["required"], " (required)").otherwise("")), line("  - ", p["description"]))
    listed = lambda heading, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"\n{heading}\n\n"), F.array_join(rows, "\n")))
    response = lambda r: F.concat(F.lit("- **"), r["status"], F.lit("**: "), r["description"])
    body = F.col("body")
    return F.concat_ws(
        "\n", F.concat(F.lit("# "), "method", F.lit(" "), "path", F.lit("\n")), line("**API**: ", F.col("api")), line("**Summary**: ", F.col("summary")), line("\n", F.col("description")),
        F.when(F.size("tags") > 0, F.concat(F.lit("\n**Tags**: "), F.array_join("tags", ", "))), F.when(F.col("deprecated"), f"\n{DEPRECATED}"),
        listed(PARAMETERS, F.transform("parameters", parameter)),
        F.when(body.isNotNull(), F.concat_ws("\n", F.lit(f"\n{REQUEST}"), some(body["description"]), F.when(F.size(body["media_types"]) > 0, F.concat(F.lit(CONTENT_TYPE), F.array_join(body["media_types"], ", "))))),
        listed(RESPONSES, F.transform("responses", response)),
    )


def documents_of(specs: DataFrame, text: str = "value") -> DataFrame:
    """(external_id, title, content, metadata) of every endpoint of JSON documents."""
    metadata = F.struct("method", "path", "operation_id", "tags", "deprecated")
    return operations(specs, text).select(external_id().alias("external_id"), title(F.col("method"), F.col("path"), F.col("summary")).alias("title"), markdown().alias("content"), metadata.alias("metadata"))
