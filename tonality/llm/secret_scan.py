"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every historical version of a text is addressed by its content (SHA-256). The ledger holds, for
each blob, the rule versions it was scanned with and what they found. A scan

1. reduces the versions to blobs, one row each, however many paths share a blob,
2. anti-joins them with the ledger: only unseen pairs of blob and rule version are scanned,
3. joins old and new findings back to all paths of the blob.

A finding is a span ``(kind, start, stop)`` in code points, end exclusive: the leftmost
non-overlapping matches of the rule's pattern that pass its check.

Spans without Python: a text is split at the matches of a pattern; the lengths of the pieces and
of the matches in turn give all positions.

Defined cases: null text is the empty blob, without findings; repeated rows and equal texts get
equal findings and are scanned once; an empty table gives an empty result; rules and ledger may be
empty; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import texts


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    ``pattern`` finds matches, ``group`` must have ``min_chars`` characters, and texts without any of
    ``hints`` (plain strings of lower-case letters, digits and signs, looked up in the lower-cased
    text) cannot match. A change of the rule needs a new ``version``.
    """

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1
    hints: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The contract's three patterns; spans are listed in this order. A run of one character
# class is as long as it can be, so its minimum length may stand in the pattern; a failing run holds no
# shorter match that passes.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12,
         ("password", "passwd", "secret", "token", "api_key", "apikey")),
    Rule("access", r"AKIA[A-Z0-9]{14,}", hints=("akia",)),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Published token formats beyond the base kinds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hints=("eyj",)),
)
RULES = BASE + MORE

SPANS = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def spans(text: Column, lowered: Column, rule: Rule, rank: int) -> Column:
    """The passing matches of one rule in a text, in order."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, 0)
    checked = F.regexp_extract_all(text, pattern, rule.group) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    # position after match i = sum of the gaps up to i and of the matches up to i
    rows = F.zip_with(F.slice(gaps, 1, F.size(found)), F.arrays_zip(found.alias("m"), checked.alias("g")),
                      lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m["m"]).alias("size"),
                                              F.char_length(m["g"]).alias("checked")))
    walked = F.aggregate(
        rows, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")),
        lambda acc, r: F.struct(
            (acc["at"] + r["gap"] + r["size"]).alias("at"),
            F.when(r["checked"] >= rule.min_chars,
                   F.concat(acc["out"], F.array(F.struct(
                       (acc["at"] + r["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                       (acc["at"] + r["gap"] + r["size"]).alias("stop")))))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    hint = F.lit(False)
    for h in rule.hints:
        hint = hint | F.contains(lowered, F.lit(h))
    may = text.rlike(rule.pattern)
    return F.when((hint & may) if rule.hints else may, walked).otherwise(F.array().cast(SPANS))


def blob_id(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"blob string, rule string, spans {SPANS}")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows ``blob, rule, spans`` for every unseen pair of blob and rule version.

    Append them to the ledger: also pairs without findings are listed, so they are not scanned again.
    """
    blobs = texts(docs).select(blob_id().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("todo", keys)
    else:
        seen = ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn(
            "todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    todo = todo.withColumn("lowered", F.lower("text"))
    found = F.array(*[F.struct(F.lit(r.key).alias("rule"),
                               F.when(F.array_contains("todo", r.key), spans(F.col("text"), F.col("lowered"), r, i)).alias("spans"))
                      for i, r in enumerate(rules)])
    rows = F.filter(found, lambda f: f["spans"].isNotNull())
    return todo.select("blob", F.explode(rows).alias("f")).select("blob", "f.rule", "f.spans")


def findings(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, blob, spans`` for every path (row of ``docs``): all spans of its blob, by start and rule order."""
    found = scan(docs, ledger, rules)
    if ledger is not None:
        found = ledger.where(F.col("rule").isin([r.key for r in rules])).select("blob", "rule", "spans").unionByName(found)
    by_blob = (found.where(F.size("spans") > 0).groupBy("blob")
               .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")))
    paths = texts(docs).select("doc_id", blob_id().alias("blob"))
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of spans in order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
