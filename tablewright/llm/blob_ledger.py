"""Secret scans over a ledger of blobs, with DataFrame functions alone.

Every version of a text is addressed by the SHA-256 of its content. A scan looks at the pairs of a blob and
a rule version that the ledger doesn't hold yet, adds what it finds, and joins the ledger's findings back
to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import Scratch, col, whole_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost first and not overlapping, of which those stay
    whose ``group`` has at least ``least`` characters. ``hint`` must occur in any text that can match."""

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 0


# The base patterns, then further well-known token forms.
# The least lengths of access and hex stand in the pattern: a shorter run can hold no longer match.
BASE = [
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i:passw|secret|token|api_?key)", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", r"AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, r"[0-9a-f]{32,}", r"[0-9a-f]{32}"),
]
MORE = [
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
]
RULES = BASE + MORE


def blob_id(text: str) -> Column:
    return F.sha2(whole_text(text), 256)


def _matches(rule: Rule) -> Column:
    """The matches of a rule in ``content``, each with the text before it since the last one, as lengths."""
    texts = F.regexp_extract_all("content", F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split("content", rule.pattern, -1), F.char_length)
    groups = F.regexp_extract_all("content", F.lit(rule.pattern), F.lit(rule.group))
    parts = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(texts)).alias("gap"), F.transform(texts, F.char_length).alias("size"), F.transform(groups, F.char_length).alias("length"))

    def row(part: Column, nth: Column) -> Column:
        fields = {"kind": F.lit(rule.kind), "version": F.lit(rule.version), "nth": nth, "gap": part["gap"], "size": part["size"], "kept": part["length"] >= rule.least}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    return F.when(F.array_contains("kinds", rule.kind) & F.col("content").rlike(rule.hint), F.transform(parts, row))


def scan_blobs(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings ``blob, kind, version, start, end`` of ``blobs`` (``blob``, ``content``, ``kinds``); offsets in code points.

    A match lies between two pieces of the text cut at the matches, so adding up the lengths of pieces and
    matches gives its place. The sums run over the matches of one blob, not within an array, so a text with
    very many matches costs no more per match.
    """
    any_hint = F.lit(False)
    for rule in rules:
        any_hint = any_hint | F.col("content").rlike(rule.hint)
    none = F.array().cast("array<struct<kind:string,version:int,nth:int,gap:int,size:int,kept:boolean>>")
    found = blobs.where(any_hint).select("blob", F.inline(F.concat(*[F.coalesce(_matches(r), none) for r in rules])))
    upto = Window.partitionBy("blob", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ends = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).where("kept")
    return ends.select("blob", "kind", "version", (F.col("end") - F.col("size")).alias("start"), "end")


def scan(docs: DataFrame, rules: list[Rule] = RULES, ledger: DataFrame | None = None, findings: DataFrame | None = None,
         key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paths, the ledger and its findings after scanning what the ledger doesn't hold.

    ``ledger`` holds ``blob, kind, version`` for each pair scanned so far and ``findings`` what was found;
    both start empty. Returned are the paths (``doc_id, blob``), and the new ledger and findings, written to
    the shared folder. Of texts with one content only one is read, whatever their number; a null text is an
    empty one. Rows that repeat an id and a text are one path each. An empty table gives empty tables.
    """
    scratch = Scratch(docs.sparkSession, "ledger")
    paths = scratch.put("paths", docs.select(col(key).alias("doc_id"), blob_id(text).alias("blob")))
    pair = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])).alias("r")
    pairs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).select("blob", "doc_id", pair).select("blob", "doc_id", "r.*")
    if ledger is not None:
        pairs = pairs.join(ledger, ["blob", "kind", "version"], "left_anti")
    new = scratch.put("pairs", pairs)
    due = new.groupBy("blob", "doc_id").agg(F.collect_set("kind").alias("kinds")).alias("due")
    content = docs.select(col(key).alias("doc_id"), whole_text(text).alias("content"), blob_id(text).alias("blob")).alias("docs")
    content = content.join(due, F.col("docs.doc_id").eqNullSafe(F.col("due.doc_id")) & (F.col("docs.blob") == F.col("due.blob")))
    found = scan_blobs(content.select("due.blob", "content", "kinds"), rules)
    # Rows that repeat an id and a text find the same spans again.
    found = (found if findings is None else found.unionAll(findings.select(found.columns))).distinct()
    entries = new.select("blob", "kind", "version")
    return paths, entries if ledger is None else ledger.select(entries.columns).unionAll(entries), scratch.put("findings", found)


def path_findings(paths: DataFrame, findings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Per path the counts of the base kinds, the digest of the base spans, and all spans in order.

    Only findings of the given rules in their given versions count; those of older versions stay in the ledger's findings.
    """
    current = reduce(Column.__or__, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules], F.lit(False))
    findings = findings.where(current)
    place = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))]), F.col("kind"))
    span = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    rows = findings.select("blob", "kind", F.struct(F.col("start"), place.alias("place"), span.alias("span")).alias("s"))
    base = [r.kind for r in BASE]
    per_blob = rows.groupBy("blob").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base],
        F.array_sort(F.collect_list(F.when(F.col("kind").isin(base), F.col("s")))).alias("base"),
        F.array_sort(F.collect_list("s")).alias("all"),
    )
    texts = lambda c: F.array_join(F.transform(c, lambda s: s["span"]), ",")
    per_blob = per_blob.select("blob", *[f"n_{k}" for k in base], F.sha2(texts("base"), 256).alias("base_sha256"), texts("all").alias("spans"))
    joined = paths.join(per_blob, "blob", "left")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op9_blob_ledger(spark, folder: str) -> DataFrame:
    from tablewright.plans.tables import table

    paths, _, findings = scan(table(spark, folder, "documents").select("doc_id", "text"))
    return path_findings(paths, findings)


def _sql() -> str:
    parts = []
    for i, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, '{rule.kind}' AS kind, {i} AS place, unnest(string_split_regex(t, '{pattern}')[:len(regexp_extract_all(t, '{pattern}'))]) AS gap,
            unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(regexp_extract_all(t, '{pattern}', {rule.group})) AS g, {rule.least} AS least,
            unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS nth FROM d WHERE regexp_matches(t, '{pattern}')""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY nth)::BIGINT AS stop FROM m),
s AS (SELECT doc_id, kind, place, stop - length(m) AS start, kind || ':' || (stop - length(m)) || ':' || stop AS span FROM e WHERE length(g) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (place < 3), '') AS base, string_agg(span, ',' ORDER BY start, place) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


OP9_SQL = _sql()
