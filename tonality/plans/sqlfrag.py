"""DuckDB SQL fragments shared by the oracle queries (the independent check of each operator)."""

from __future__ import annotations

from tonality.functions.text import WS_CHARS, WS_CLASS

EDGE = f"^{WS_CLASS}+|{WS_CLASS}+$"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '{EDGE}', '', 'g')"


def normalize_text(x: str) -> str:
    return f"coalesce({strip_ws(f'lower(CAST({x} AS VARCHAR))')}, '')"


def clean_ascii(x: str) -> str:
    kept = f"regexp_replace(lower(coalesce(CAST({x} AS VARCHAR), '')), '[^a-z{WS_CHARS}]', '', 'g')"
    return strip_ws(f"regexp_replace({kept}, '{WS_CLASS}+', ' ', 'g')")


def label_le2(r: str) -> str:
    return (f"CAST(CASE WHEN {r} IS NULL THEN NULL WHEN isnan({r}) THEN 2 WHEN {r} <= 2 THEN 0 "
            f"WHEN {r} = 3 THEN 1 ELSE 2 END AS INTEGER)")


def label_ge4(r: str) -> str:
    return (f"CAST(CASE WHEN {r} IS NULL THEN NULL WHEN isnan({r}) THEN 0 WHEN {r} >= 4 THEN 2 "
            f"WHEN {r} = 3 THEN 1 ELSE 0 END AS INTEGER)")


def label_name(c: str) -> str:
    return f"(CASE {c} WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' END)"


def hash_order(key: str, seed: int) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}')"


def hash_unit(key: str, seed: int) -> str:
    return f"(CAST(('0x' || substr({hash_order(key, seed)}, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def reviews() -> str:
    return "SELECT doc_id AS review_id, text AS verified_reviews, CAST(doc_id % 5 + 1 AS DOUBLE) AS rating FROM documents"


def order_ratings() -> str:
    return "SELECT o_orderkey AS review_id, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS rating FROM orders"


def truth_prediction() -> str:
    return (f"SELECT review_id, {label_le2('rating')} AS truth, CAST(review_id % 3 AS INTEGER) AS prediction "
            f"FROM ({order_ratings()})")


def emoji_lexicon() -> str:
    return ("SELECT CAST(l_partkey AS VARCHAR) AS Emoji, "
            "CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS Negative, "
            "CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS Neutral, "
            "CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS Positive, "
            "CAST(count(*) AS BIGINT) AS Occurrences FROM lineitem GROUP BY l_partkey")


def dvec(x: str) -> str:
    """float vector -> double vector."""
    return f"CAST({x} AS DOUBLE[])"


def weight(i: str, j: str, salt: int) -> str:
    """Closed-form layer weight, the same rule as ``tonality.operators.fuse.closed_form_weight``."""
    return f"(CAST(((31 * {i} + 17 * {j} + {salt}) % 101) - 50 AS DOUBLE) / 100.0)"


def bias(i: str, salt: int) -> str:
    return f"(CAST(((13 * {i} + {salt}) % 101) - 50 AS DOUBLE) / 100.0)"


def project(x: str, d_out: int, d_in: int, salt: int) -> str:
    """W x + b with the closed-form parameters; ``x`` is a 1-based DOUBLE[] of length d_in."""
    return (f"list_transform(range({d_out}), lambda i: "
            f"list_sum(list_transform(range({d_in}), lambda j: {x}[j + 1] * {weight('i', 'j', salt)})) "
            f"+ {bias('i', salt)})")


def l2norm(x: str) -> str:
    return (f"list_transform({x}, lambda v: v / greatest(sqrt(list_sum(list_transform({x}, lambda u: u * u))), "
            f"1e-12))")


def widen(x: str, dim: int, prefix: str = "emb_", digits: int = 6) -> str:
    return ", ".join(f"round({x}[{i + 1}], {digits}) AS {prefix}{i}" for i in range(dim))


def sigmoid(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(len({a})), lambda k: {a}[k + 1] * {b}[k + 1]))"


def softmax(x: str) -> str:
    return (f"list_transform({x}, lambda v: exp(v - list_max({x})) / "
            f"list_sum(list_transform({x}, lambda u: exp(u - list_max({x})))))")


def argmax(x: str) -> str:
    return f"CAST(list_position({x}, list_max({x})) - 1 AS INTEGER)"


def hashed_vectors(name: str, source: str, key: str, words_expr: str, dim: int) -> str:
    """CTEs ending in ``name(k, v)``: signed md5 feature hashing of the words of each row of
    ``source`` into ``dim`` slots, L2-normalised (a row without words gets zeros)."""
    return f"""{name}_d AS (SELECT {key} AS k, {words_expr} AS l FROM ({source})),
{name}_t AS (SELECT k, md5(unnest(l)) AS h FROM {name}_d),
{name}_s AS (SELECT k, CAST(CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % {dim} AS INTEGER) AS slot,
             CASE WHEN CAST(('0x' || substr(h, 9, 1)) AS INTEGER) < 8 THEN 1.0 ELSE -1.0 END AS sg FROM {name}_t),
{name}_a AS (SELECT k, slot, sum(sg) AS v FROM {name}_s GROUP BY 1, 2),
{name}_g AS (SELECT {name}_d.k, r.slot FROM {name}_d, (SELECT unnest(range({dim})) AS slot) r),
{name}_w AS (SELECT g.k, list(CAST(coalesce(a.v, 0) AS DOUBLE) ORDER BY g.slot) AS raw
      FROM {name}_g g LEFT JOIN {name}_a a ON g.k = a.k AND g.slot = a.slot GROUP BY g.k),
{name} AS (SELECT k, list_transform(raw, lambda u: u / greatest(sqrt(list_sum(list_transform(raw, lambda q: q * q))),
           1e-12)) AS v FROM {name}_w)"""


def page_words(url: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({url}), '[^a-z]+'), lambda w: length(w) > 0)"


def text_words(text: str) -> str:
    return f"list_filter(string_split({clean_ascii(text)}, ' '), lambda w: length(w) >= 1)"
