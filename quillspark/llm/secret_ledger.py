"""Secret scans with a ledger of blobs: each text is scanned once for each version of a rule, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Settled, fresh_path, settle

#: Copies of a blob with findings that one part of the last join takes, and the most blobs that are dealt to several parts.
PART_ROWS, MOST_HOT = 2_000, 10_000


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters or more.

    ``hint`` is a string that every match holds. A rule that changes gets another version and is scanned anew. The
    pattern takes time in proportion to the text, whatever the text.
    """

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    hint: str = ""


# The kinds of the contract and their patterns.
BASE = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, 0, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 24),
)
#: Further kinds.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, "gh"),
    Rule("google", 1, r"AIza[0-9A-Za-z_-]{35}", 0, 0, "AIza"),
    Rule("slack", 1, r"xox[abprs]-[0-9A-Za-z-]{10,}", 0, 0, "xox"),
)
RULES = BASE + MORE

HITS = "array<struct<kind:string,version:int,at:int,gap:int,size:int,kept:boolean>>"
SPANS = "array<struct<kind:string,version:int,start:long,end:long>>"
PAIRS = "array<struct<kind:string,version:int>>"


def blob_of(text: Column) -> Column:
    """The address of a text: the SHA-256 of its UTF-8 bytes; null is an empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _pair(rule: Rule) -> Column:
    return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, pending, hits) of (blob, text, pending). A rule that isn't pending for a blob doesn't look at its text."""
    found = blobs
    for rule in rules:
        here = F.array_contains("pending", _pair(rule))
        here = here & F.contains("text", F.lit(rule.hint)) if rule.hint else here
        matches = F.when(here, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)))
        found = found.withColumn(f"m_{rule.kind}", F.coalesce(matches, F.array().cast("array<string>")))
    for rule in rules:  # the lengths of what lies before each match: the text cut at the matches
        pieces = F.when(F.size(f"m_{rule.kind}") > 0, F.split("text", rule.pattern, -1))
        found = found.withColumn(f"g_{rule.kind}", F.transform(pieces, lambda s: F.length(s)))
    return found.select("blob", "pending", F.concat(*map(_hits, rules)).alias("hits"))


def _hits(rule: Rule) -> Column:
    def hit(match: Column, at: Column) -> Column:
        value = F.regexp_extract(match, rule.pattern, rule.group) if rule.group else match
        gap = F.get(F.col(f"g_{rule.kind}"), at)
        return F.struct(F.lit(rule.kind), F.lit(rule.version), at, gap, F.length(match), F.length(value) >= rule.least)

    return F.transform(f"m_{rule.kind}", hit).cast(HITS)


def _spans(scanned: DataFrame) -> DataFrame:
    """(blob, spans) of the blobs that have any: a match ends where all gaps and matches up to it end."""
    each = scanned.select("blob", F.explode("hits").alias("hit")).select("blob", "hit.*")
    upto = F.sum((F.col("gap") + F.col("size")).cast("long")).over(W.partitionBy("blob", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    placed = each.withColumn("end", upto).where("kept").select("blob", F.struct("kind", "version", (F.col("end") - F.col("size")).alias("start"), "end").alias("span"))
    return placed.groupBy("blob").agg(F.collect_list("span").alias("spans"))


class Ledger:
    """A table of (blob, rules, spans): which versions of which rules have seen a text, and what they found in it.

    It is only appended to, a row for each blob and scan, by one commit after all of a scan is done: a scan that breaks
    off leaves nothing, and one that is repeated finds the same, which counts once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._spark = path, spark
        nothing = spark.range(0).select(F.lit("").alias("blob"), F.array().cast(PAIRS).alias("rules"), F.array().cast(SPANS).alias("spans"))
        self._schema = nothing.schema
        nothing.write.mode("ignore").parquet(path)

    def entries(self) -> DataFrame:
        """(blob, rules, spans), a row for each blob."""
        rows = self._spark.read.schema(self._schema).parquet(self.path)
        every = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("rules", "spans")]
        return rows.groupBy("blob").agg(*every)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
        """Scans the texts that some of the rules, in their present versions, have not seen, and no others.

        ``versions`` are texts of any time and place. Copies are put together before their texts leave the task, so each
        text is scanned once however often it is there; a text that stands in the ledger is passed over without being
        looked at, but for rules that are new or have another version. Null is an empty text. An empty table adds nothing.
        """
        copies = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        blobs = copies.groupBy("blob").agg(F.first("text").alias("text"))
        known = self.entries().select("blob", F.col("rules").alias("known"))
        wanted = F.array(*map(_pair, rules)).cast(PAIRS)
        pending = F.array_except(wanted, F.coalesce("known", F.array().cast(PAIRS)))
        unseen = blobs.join(known, "blob", "left").select("blob", "text", pending.alias("pending")).where(F.size("pending") > 0)
        scanned = Settled(_scan(unseen, rules), "scanned")
        spans = _spans(scanned.df)
        entries = scanned.df.join(spans, "blob", "left").select("blob", F.col("pending").alias("rules"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
        entries.write.mode("append").parquet(self.path)
        scanned.drop()

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, spans) of the blobs in which the rules, in their present versions, found something; spans by start, then rule."""
        order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(k))])
        name = lambda s: F.concat(s["kind"], F.lit(":"), s["version"])
        placed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[name(s)].alias("rule"), s["end"].alias("end"), s["kind"].alias("kind"), s["version"].alias("version")))
        sound = F.array_sort(F.filter(placed, lambda s: s["rule"].isNotNull()))
        spans = F.transform(sound, lambda s: F.struct(s["kind"], s["version"], s["start"], s["end"])).cast(SPANS)
        return self.entries().select("blob", spans.alias("spans")).where(F.size("spans") > 0)


def with_findings(versions: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``versions``, without their text, with what ``found`` (blob, ...) has for it, null where it has nothing.

    A blob with many copies is dealt to several parts: with T rows in all, those with more than max(PART_ROWS,
    T / MOST_HOT) copies, of which there are MOST_HOT at most, so that their list can be sent to the tasks.
    """
    paths = settle(versions.withColumns({"__qs_row": F.monotonically_increasing_id(), "blob": blob_of(F.col(text))}).drop(text), "paths")
    most = max(PART_ROWS, paths.count() // MOST_HOT)
    hot = F.broadcast(paths.groupBy("blob").agg(F.count("*").alias("__qs_n")).where(F.col("__qs_n") > most).select("blob", F.ceil(F.col("__qs_n") / most).alias("__qs_parts")))
    parts = F.coalesce("__qs_parts", F.lit(1))
    dealt = paths.join(hot, "blob", "left").withColumn("__qs_part", F.pmod("__qs_row", parts))
    copied = found.join(hot, "blob", "left").withColumn("__qs_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__qs_parts")
    return dealt.join(copied, ["blob", "__qs_part"], "left").drop("__qs_part", "__qs_parts", "__qs_row")


def report(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, one row per row of ``docs``, after a scan of what is new.

    Offsets are code points, ends exclusive. Each row is a version of its document: null ids and repeated rows each keep
    their own. Without a ledger a new one is begun in the shared folder. Columns other than doc_id and text take no part.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, fresh_path(spark, "ledger"))
    versions = docs.select("doc_id", "text")
    ledger.scan(versions, rules)
    base = [r.kind for r in BASE]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    found = ledger.findings(rules).select("blob", *counts, F.sha2(listed(of(*base)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
    zeros = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in base]
    rest = [F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")]
    return with_findings(versions, found).select("doc_id", *zeros, *rest)


def _kind_sql(k: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    value = f"regexp_extract(m, '{pattern}', {rule.group})"
    return f"""SELECT r, {k} AS o, '{rule.kind}' AS kind, e - length(m) AS s, e FROM (
  SELECT r, m, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM (
    SELECT r, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (
      SELECT r, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gaps FROM d) WHERE len(ms) > 0))
  WHERE length({value}) >= {rule.least}"""


REPORT_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),\nf AS ("
    + "\nUNION ALL ".join(_kind_sql(k, rule) for k, rule in enumerate(RULES))
    + """),
g AS (SELECT r, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""
)
