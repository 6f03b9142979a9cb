"""Secrets in texts, scanned through a ledger of blobs.

A text is filed under its SHA-256; equal texts, wherever and whenever they occur, are one blob.  A rule has a version, the hash
of its definition.  Only pairs of blob and rule version that no earlier run has scanned are scanned; findings are
kept by blob and joined back to every path (document) that holds it.  DataFrame functions only.

A rule finds the leftmost non-overlapping matches of its pattern and drops those whose group is too short.  Places are in code
points: splitting a text at the pattern gives what lies between the matches, so running sums give their ends.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqrec.session import cut


@dataclass(frozen=True)
class Rule:
    """kind; Java pattern; the group whose length counts (0: all), and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules, then the formats of common keys.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the same matches as [0-9a-f]+ of 24 or more, as a run is always taken whole
)
# A private key as far as its END line; without one as far as its last base64 line.  Possessive, so that Java's matcher needs no stack.
_GAP, _CODE, _EOL = r"""(?:[\s>#*|"',]|\\[nr]|\+(?=\s))*+""", "[A-Za-z0-9+/=]", r"""(?=[\x20\t"',]*+(?:\\[nr]|(?![^\r\n])))"""
_PEM = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+-----END [A-Z ]*PRIVATE KEY-----|"
        rf"(?:{_GAP}(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:(?:{_GAP}(?:{_CODE}{{32,}}+|{_CODE}{{16,}}+{_EOL}))++(?:{_GAP}{_CODE}++{_EOL})?+)?+)")
RULES = BASE + (
    Rule("pem", _PEM),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("bearer", r"(?i)bearer\x20+([A-Za-z0-9+/_.=-]{20,})"),
)


def version(rule: Rule) -> str:
    """Hash of a rule's definition."""
    return hashlib.sha256(f"{rule.kind}|{rule.pattern}|{rule.group}|{rule.least}".encode()).hexdigest()


def _matches(rules: tuple[Rule, ...]):
    """Array of (rule_no, k, gap, hit, part): for the k-th match of a rule the characters before it, in it and in its group."""
    parts = []
    for no, rule in enumerate(rules):
        text = F.col("_text")
        zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"),
                              F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part"))
        rows = F.transform(F.filter(zipped, lambda z: z["hit"].isNotNull()), lambda z, k: F.struct(
            F.lit(no).alias("rule_no"), k.alias("k"), F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("hit"), F.length(z["part"]).alias("part")))
        empty = F.array().cast("array<struct<rule_no:int,k:int,gap:int,hit:int,part:int>>")
        parts.append(F.when(F.array_contains("_rules", no) & text.rlike(rule.pattern), rows).otherwise(empty))
    return F.concat(*parts)


def scan(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
         id_col: str = "doc_id", text_col: str = "text") -> dict[str, DataFrame]:
    """{"paths", "findings", "ledger"}.

    paths: one row per input row, (id, blob, spans); spans is the array of (start, rule_no, kind, end) found in its blob, in
    order.  findings: (blob, rule_version, rule_no, kind, start, end) of all blobs and rules so far; ledger: the (blob,
    rule_version) pairs scanned so far.  Keep both as tables and pass them to the next run, which scans nothing twice;
    findings of rules that are not in `rules` stay in the table but not in spans.  A null text counts as empty; rows with the same id
    stay apart; other columns are ignored.
    """
    versions = [version(r) for r in rules]
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    docs = docs.withColumn("blob", F.sha2("_text", 256))
    paths = cut(docs.select("id", "blob"), "paths")
    every = F.array(*[F.struct(F.lit(no).alias("rule_no"), F.lit(v).alias("rule_version")) for no, v in enumerate(versions)])
    blobs = paths.groupBy("blob").agg(F.min(F.struct(F.col("id").alias("at"))).alias("one"))
    if ledger is None:
        todo = blobs.select("blob", F.col("one.at").alias("at"), F.transform(every, lambda r: r["rule_no"]).alias("_rules"))
    else:
        pairs = blobs.select("blob", F.col("one.at").alias("at"), F.explode(every).alias("r")).select("blob", "at", "r.*")
        todo = (pairs.join(ledger.select("blob", "rule_version").distinct(), ["blob", "rule_version"], "left_anti")
                .groupBy("blob").agg(F.first("at").alias("at"), F.collect_list("rule_no").alias("_rules")))
    todo = cut(todo, "todo")
    # one path stands for each blob with something to scan: only its text is moved
    texts = docs.join(todo.withColumnRenamed("blob", "b"), F.col("id").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("b")))
    found = texts.select("blob", F.explode(_matches(rules)).alias("m")).select("blob", "m.*").distinct()
    so_far = Window.partitionBy("blob", "rule_no").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.array(*[F.lit(r.least) for r in rules])
    found = (found.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(so_far)).where(F.col("part") >= least[F.col("rule_no")])
             .select("blob", F.array(*map(F.lit, versions))[F.col("rule_no")].alias("rule_version"), "rule_no",
                     F.array(*[F.lit(r.kind) for r in rules])[F.col("rule_no")].alias("kind"), (F.col("end") - F.col("hit")).alias("start"), "end"))
    new_ledger = todo.select("blob", F.explode("_rules").alias("no")).select("blob", F.array(*map(F.lit, versions))[F.col("no")].alias("rule_version"))
    found = cut(found if findings is None else found.unionByName(findings.select(found.columns)), "findings")
    own = F.array_position(F.array(*map(F.lit, versions)), F.col("rule_version")) - 1
    spans = (found.withColumn("no", own.cast("int")).where("no >= 0").groupBy("blob")
             .agg(F.sort_array(F.collect_list(F.struct("start", F.col("no").alias("rule_no"), "kind", "end"))).alias("spans")))
    empty = F.array().cast("array<struct<start:bigint,rule_no:int,kind:string,end:bigint>>")
    paths = paths.join(spans, "blob", "left").select(F.col("id").alias(id_col), "blob", F.coalesce("spans", empty).alias("spans"))
    return {"paths": paths, "findings": found, "ledger": new_ledger if ledger is None else ledger.select("blob", "rule_version").unionByName(new_ledger)}


def redact(docs: DataFrame, paths: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by [kind]; overlapping spans are replaced once, as far as the last of them ends, by the first's kind.

    paths is scan()'s table over the same rows; rows are matched by id and blob, so repeated rows stay as they are.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = paths.where(F.size("spans") > 0).dropDuplicates([id_col, "blob"]).select(F.col(id_col).alias("_id"), F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    joined = docs.withColumn("_of", F.sha2(text, 256)).join(some, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_blob")), "left")
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(F.struct(
        F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at")))
    done = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
    new = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(F.aggregate("_spans", state, step, done))
    return joined.withColumn("_new", new).select(*[F.col("_new").alias(c) if c == text_col else F.col(c) for c in docs.columns])
