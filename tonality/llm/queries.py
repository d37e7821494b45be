"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonality.llm import (bpe, collocations, decontaminate, html_text, language_id, line_dedup, pii, ppm, quality, secret_scan,
                          simhash, spelling, substring_dedup)
from tonality.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Fixed value: the contract's words, for SQL.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_simhash_near_dedup")
def q_simhash(spark, sf):
    """Shingles of 3 words, links at 2 bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


LOWER_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LINE_SPACE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op2_line_dedup", f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT doc_id, pos, line, {LOWER_AZ.format(f"trim(line, {LINE_SPACE})")} AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM hot)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM hot)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id""")
def q_line_dedup(spark, sf):
    """Keys of 1 code point or more in 10 documents or more lose all their lines."""
    done = line_dedup.dedup_lines(table(spark, sf, "documents"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_decontamination")
def q_decontamination(spark, sf):
    """Windows of 8 template tokens, 13 tokens in step."""
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), window=8, min_tokens=13, by_run=True)


@query("op9_language_id")
def q_language_id(spark, sf):
    """Trigrams in 1,024 dimensions."""
    return language_id.identify(table(spark, sf, "documents"), n=3, dims=1024)


@query("op4_bpe")
def q_bpe(spark, sf):
    """The public 49k word-level file; ids and decoded texts leave the tasks as digests."""
    import public_tokenizers

    done = bpe.encode_texts(table(spark, sf, "documents").select("doc_id", "text"),
                            public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))
    return done.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op10_quality_rules", f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (
        SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
x AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS s FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i FROM k JOIN (SELECT doc_id, s FROM k WHERE s IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, s)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g) GROUP BY doc_id),
m AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, x, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY doc_id),
c AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
             coalesce(n_repeat, 0) AS n_repeat_words, length(t) - length(replace(t, '!', '')) AS marks, n_lines, top
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN m USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words::DOUBLE BETWEEN 2.0 AND 25.0 AND n_symbols <= 0.3::DOUBLE * n_words
       AND marks <= 0.3::DOUBLE * n_words AND n_dup_lines <= 0.5::DOUBLE * n_lines AND top / n_words::DOUBLE <= 0.4::DOUBLE AS kept FROM b""")
def q_quality(spark, sf):
    """The base rule of the contract, then the cascade of default rules (in whatever order was measured)."""
    return quality.cascade(table(spark, sf, "documents")).drop("rejected_by")


def _spans_sql(rule, rank: int) -> str:
    """Spans of one kind: gaps and matches of the pattern in turn give the positions."""
    p = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, stop - length(m) AS start, stop FROM (
  SELECT doc_id, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
    SELECT doc_id, unnest(string_split_regex(t, '{p}')) AS gap, unnest(regexp_extract_all(t, '{p}')) AS m,
           unnest(regexp_extract_all(t, '{p}', {rule.group})) AS g, generate_subscripts(string_split_regex(t, '{p}'), 1) AS i FROM d)
  WHERE m IS NOT NULL) WHERE length(g) >= {rule.min_chars}"""


_LISTED = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"


@query("op5_secret_scan", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_spans_sql(r, i) for i, r in enumerate(secret_scan.RULES))}),
a AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)},
             {_LISTED} FILTER (WHERE rank < {len(secret_scan.BASE)}) AS base, {_LISTED} AS spans FROM s GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)""")
def q_secrets(spark, sf):
    """A first scan: the ledger is empty, every blob is scanned once with every rule."""
    base = [r.kind for r in secret_scan.BASE]
    found = secret_scan.findings(table(spark, sf, "documents"))
    kinds = F.col("spans.kind")
    count = {k: F.size(F.array_remove(kinds, k)) for k in base}
    count = {k: (F.size(kinds) - rest).cast("long").alias(f"n_{k}") for k, rest in count.items()}
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *count.values(), F.sha2(secret_scan.listed(of_base), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("spans")).alias("spans"))


@query("op3_html_extraction")
def q_html(spark, sf):
    """The tree of the default labelled table."""
    return html_text.extract(table(spark, sf, "pages"))


@query("op7_substring_dedup", f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
again AS (SELECT doc_id, i FROM v WHERE h IN (SELECT h FROM v GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again),
n AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text, count(*) AS k FROM n ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(k, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""")
def q_substring(spark, sf):
    """Windows of 35 words; anchors of 15 words at 5 of 21 positions."""
    done = substring_dedup.remove_repeated(table(spark, sf, "documents"), length=35, period=21)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_lm_scoring")
def q_ppm(spark, sf):
    """Contexts of up to 5 bytes."""
    return ppm.score(table(spark, sf, "documents"), order=5)


def _kind_sql(rank: int, kind: str, pattern: str, passes: str, group: int = 0) -> str:
    """Spans of one kind of personal data: gaps and matches in turn; ``passes`` tells of the match or its group ``g``."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, stop - length(g) AS start, stop FROM (
  SELECT doc_id, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
    SELECT doc_id, unnest(string_split_regex(t, '{p}')) AS gap, unnest(regexp_extract_all(t, '{p}')) AS m,
           unnest(regexp_extract_all(t, '{p}', {group})) AS g, generate_subscripts(string_split_regex(t, '{p}'), 1) AS i FROM d)
  WHERE m IS NOT NULL) WHERE {passes}"""


_DIGITS = "regexp_replace(g, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT
  ELSE 2 * substr(reverse({_DIGITS}), i, 1)::INT - CASE WHEN substr(reverse({_DIGITS}), i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_CODE = "replace(g, ' ', '')"
_MOD97 = f"""list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(
  string_split(substr({_CODE}, 5) || substr({_CODE}, 1, 4), ''),
  lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), ''), ''), lambda d: d::INT)), lambda x, y: (10 * x + y) % 97) = 1"""
_PII_SQL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
     "len(list_filter(string_split(g, '.'), lambda x: length(ltrim(x, '0')) > 3 OR lpad(ltrim(x, '0'), 3, '0') > '255')) = 0", 0),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}", 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15", 0),
    ("login", r"(?:(?i:https?|s?ftp|ssh)://)[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*", "true", 0),
    ("iban", r"(?i:iban)[\x20:#]{0,3}([A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?))\b",
     f"length({_CODE}) BETWEEN 15 AND 34 AND {_MOD97}", 1),
    ("account", r"(?i:account|acct)(?:\x20(?:number|no\.?|nr\.?))?\x20*[:#]\x20*([0-9](?:[\x20-]?[0-9])+)", f"length({_DIGITS}) BETWEEN 8 AND 17", 1),
    ("ssn", r"(?i:ssn|social security)(?:\x20number)?[\x20:#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})\b",
     "substr(g, 1, 3) NOT IN ('000', '666') AND substr(g, 1, 1) <> '9' AND substr(g, 5, 2) <> '00' AND substr(g, 8) <> '0000'", 1),
]
_PII_BASE = [k.name for k in pii.BASE]


@query("op11_pii", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_kind_sql(i, kind, pattern, passes, group) for i, (kind, pattern, passes, group) in enumerate(_PII_SQL))}),
a AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _PII_BASE)},
             {_LISTED} FILTER (WHERE rank < {len(_PII_BASE)}) AS base, {_LISTED} AS spans FROM s GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _PII_BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)""")
def q_pii(spark, sf):
    """The contract's four kinds and those that need a scheme or a cue word."""
    found = pii.find(table(spark, sf, "documents"))
    kinds = F.col("spans.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in _PII_BASE]
    of_base = F.filter("spans", lambda s: s["kind"].isin(_PII_BASE))
    return found.select("doc_id", *counts, F.sha2(pii.listed(of_base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


# crc32 by a table of its 256 steps, over the bytes of ``<doc_id>:<run>``
_STEPS = """SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps"""
_CRC = """4294967295 - list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, list_extract(steps, xor(c & 255, b) + 1)))"""


@query("op12_spelling_variants", f"""
WITH RECURSIVE steps AS ({_STEPS}),
r AS (SELECT doc_id, unnest(regexp_extract_all({LOWER_AZ.format("text")}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
d AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h, count(*) AS n FROM r GROUP BY doc_id, run),
x AS (SELECT run, n, {_CRC} AS crc FROM d, steps),
w AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
      FROM x GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7),
-- a letter left out, and where: words that share it and the place have a replaced letter there; a word that is one has a letter less
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM v a JOIN w b ON a.v = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM v a JOIN w b ON a.v = b.word),
best AS (SELECT word, n, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY 1, 2),
forms AS (SELECT best.word, min(near) AS form, any_value(top) AS form_n FROM best JOIN near ON near.word = best.word AND near_n = top
  WHERE top >= 10 * best.n GROUP BY 1),
chain AS (SELECT word, form AS root, 1 AS steps FROM forms UNION ALL SELECT chain.word, forms.form, steps + 1 FROM chain JOIN forms ON forms.word = chain.root),
ends AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY 1)
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n
FROM w LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)""")
def q_spelling(spark, sf):
    """Words of 7 letters and 2 occurrences; a form is 10 times as frequent."""
    return spelling.variants(table(spark, sf, "documents"), min_chars=7, min_count=2, ratio=10, one_in=31)


@query("op13_collocations", f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER_AZ.format("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g1 AS (SELECT lang, x AS p1, count(*) AS f FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY 1, 2),
g2 AS (SELECT lang, x[1] AS p1, x[2] AS p2, count(*) AS f FROM (
  SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i:i + 1])) AS x FROM w) GROUP BY 1, 2, 3 HAVING count(*) >= 10),
g3 AS (SELECT lang, x[1] AS p1, x[2] AS p2, x[3] AS p3, count(*) AS f FROM (
  SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) AS x FROM w) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
longer AS (SELECT lang, p1, p2, max(f) AS f FROM (SELECT lang, p1, p2, f FROM g3 UNION ALL SELECT lang, p2, p3, f FROM g3) GROUP BY 1, 2, 3),
c2 AS (SELECT g2.lang, g2.p1 || ' ' || g2.p2 AS phrase, g2.f AS a, l.f AS l, r.f AS r,
              1000000::HUGEINT * g2.f * g2.f // (l.f::HUGEINT * r.f) AS score
       FROM g2 JOIN g1 l ON l.lang = g2.lang AND l.p1 = g2.p1 JOIN g1 r ON r.lang = g2.lang AND r.p1 = g2.p2
       LEFT JOIN longer x ON x.lang = g2.lang AND x.p1 = g2.p1 AND x.p2 = g2.p2 WHERE x.f IS NULL OR 100 * x.f < 50 * g2.f),
t3 AS (SELECT g3.lang, g3.p1 || ' ' || g3.p2 || ' ' || g3.p3 AS phrase, g3.f AS a, a1.f AS f1, a23.f AS f23, a12.f AS f12, a3.f AS f3,
              1000000::HUGEINT * g3.f * g3.f // (a1.f::HUGEINT * a23.f) AS s1, 1000000::HUGEINT * g3.f * g3.f // (a12.f::HUGEINT * a3.f) AS s2
       FROM g3 JOIN g1 a1 ON a1.lang = g3.lang AND a1.p1 = g3.p1 JOIN g1 a3 ON a3.lang = g3.lang AND a3.p1 = g3.p3
       JOIN g2 a12 ON a12.lang = g3.lang AND a12.p1 = g3.p1 AND a12.p2 = g3.p2
       JOIN g2 a23 ON a23.lang = g3.lang AND a23.p1 = g3.p2 AND a23.p2 = g3.p3),
c AS (SELECT * FROM c2 UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN f1 ELSE f12 END, CASE WHEN s1 <= s2 THEN f23 ELSE f3 END, least(s1, s2) FROM t3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM k JOIN (SELECT lang, sum(f)::BIGINT AS n FROM g1 GROUP BY lang) USING (lang) WHERE rank <= 2000""")
def q_collocations(spark, sf):
    """Phrases of two or three words found 10 times; covered at 50 per cent; 2,000 per language."""
    return collocations.collocations(table(spark, sf, "documents"), min_count=10, cover=50, top=2000)
