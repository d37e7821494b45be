"""Vocabulary, bag of words and token ids.

The reference uses a pretrained WordPiece tokenizer; here the vocabulary is a table
(``term, term_id``) fitted with Spark, and token ids come from a join against it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.operators.split import positional_index
from tonality.session import materialize, ship_package

# Special token ids of the uncased BERT vocabulary, and the first id given to a
# fitted word (ids below it are reserved).
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 100, 101, 102, 103
FIRST_WORD_ID = 1000
POSTINGS = 4096  # word lists in an Arrow batch


def terms(df: DataFrame, tokens: str, key: str | None = None, min_len: int = 1) -> DataFrame:
    """One row per token occurrence (``key, term``), tokens shorter than ``min_len`` dropped."""
    cols = [key] if key else []
    # explode_outer: a plain explode lets the optimizer infer ``size(tokens) > 0`` and push that
    # (with the whole tokenising expression) below an earlier repartition, computing it twice
    return (df.select(*cols, F.explode_outer(tokens).alias("term"))
            .where(F.col("term").isNotNull() & (F.length("term") >= min_len)))


def token_bundle(df: DataFrame) -> DataFrame:
    """The word lists of ``df`` written once, for the operators below to read.

    A vocabulary is fitted by several passes (sample, range partitioning, ids) and its users read the documents again;
    without the copy every pass cleans and splits every text anew. Parquet keeps a list of words as codes into the
    dictionary of its column chunk, and a reader takes only the columns it names.
    """
    return materialize(df, "token-bundle")


def fit_vocabulary(df: DataFrame, tokens: str, min_len: int = 2) -> DataFrame:
    """``term, term_id`` with ids 0.. in term order (code-point order), from the distinct terms.

    The distinct step is a map-side-deduplicated aggregate; the ids are positions in a range
    partitioning of the terms, so no task holds more than its share, whatever their beginnings.
    """
    vocab = terms(df, tokens, min_len=min_len).distinct()
    return positional_index(vocab, "term", name="term_id").select("term", "term_id")


def postings(df: DataFrame, key: str, tokens: str, min_len: int = 1) -> DataFrame:
    """``term, keys, counts``: each word of an Arrow batch once, with the rows that hold it and how often.

    The lists of a word lie side by side, so a word travels once per batch instead of once per document. Rows of equal key
    are not merged, and a word comes back with every batch: a user sums the counts.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = pc.list_flatten(b.column("tokens")).dictionary_encode()
            owner = pc.list_parent_indices(b.column("tokens")).to_numpy()
            code = coded.indices.fill_null(-1).to_numpy().astype(np.int64)
            keep = np.append(pc.greater_equal(pc.utf8_length(coded.dictionary), min_len).to_numpy(zero_copy_only=False), False)[code]
            pairs, n = np.unique(code[keep] * b.num_rows + owner[keep], return_counts=True)
            code, owner = pairs // b.num_rows, pairs % b.num_rows
            edges = np.flatnonzero(np.diff(code, prepend=-1, append=-1))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), x)
            if len(pairs):
                out = pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[edges[:-1]])), lists(b.column("key").take(pa.array(owner))),
                                                  lists(pa.array(n, pa.int64()))], names=["term", "keys", "counts"])
                for at in range(0, out.num_rows, POSTINGS):
                    yield out.slice(at, POSTINGS)
    src = df.select(F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    return src.mapInArrow(run, f"term string, keys array<{src.schema['key'].dataType.simpleString()}>, counts array<long>")


def listed(found: DataFrame, key: str, *columns: str) -> DataFrame:
    """``key, count`` and ``columns``: one row for each entry of the lists of :func:`postings`."""
    return found.select(*columns, F.inline(F.arrays_zip("keys", "counts")).alias(key, "count"))


def bag_of_words(df: DataFrame, key: str, tokens: str, vocab: DataFrame, min_len: int = 2) -> DataFrame:
    """sparse count vectors ``key, term_id, count``; terms outside the vocabulary are dropped.

    The join sees the packed lists of a word (:func:`postings`), so only they and, once, the numbers ``key, term_id, count``
    travel; no text of a word is shuffled per document.
    """
    found = postings(df, key, tokens, min_len).join(vocab.select("term", "term_id"), "term")
    return listed(found, key, "term_id").groupBy(key, "term_id").agg(F.sum("count").alias("count"))


def extend_vocabulary(vocab: DataFrame, df: DataFrame, tokens: str, min_len: int = 1) -> DataFrame:
    """append unseen tokens to a vocabulary; new ids follow the largest id, in term order."""
    new = terms(df, tokens, min_len=min_len).distinct().join(vocab.select("term"), "term", "left_anti")
    top = vocab.agg(F.max("term_id")).first()[0]  # one number
    added = positional_index(new, "term", name="_i")
    return vocab.select("term", "term_id").unionByName(
        added.select("term", (F.col("_i") + F.lit(0 if top is None else top + 1)).cast("long").alias("term_id")))


def encode_tokens(df: DataFrame, key: str, tokens: str, vocab: DataFrame, max_len: int = 64,
                  pad: str = "longest") -> DataFrame:
    """``input_ids`` = [CLS] word ids [SEP], truncated to ``max_len``, padded with [PAD]; and
    ``attention_mask`` (1 for real tokens).

    Word id = ``FIRST_WORD_ID + term_id``; an unknown word is [UNK]. ``pad="longest"`` pads to
    the longest sequence of the whole frame (known before the join: one number from a narrow
    aggregate over the token counts), ``pad="max_length"`` to ``max_len``. Tokens past the truncation point are dropped before the join.
    """
    body = max_len - 2
    # posexplode_outer keeps one (null) row for a document without words, so every document
    # reaches the group-by and no join back to the input is needed
    occ = df.select(key, F.posexplode_outer(F.slice(tokens, 1, body)).alias("pos", "term"))
    ids = (occ.join(vocab.select("term", "term_id"), "term", "left")
           .select(key, "pos", F.coalesce(F.col("term_id") + F.lit(FIRST_WORD_ID), F.lit(UNK_ID)).cast("int").alias("_tid")))
    seqs = ids.groupBy(key).agg(F.array_sort(F.collect_list(
        F.when(F.col("pos").isNotNull(), F.struct("pos", "_tid")))).alias("_s"))
    base = seqs.select(key, F.transform("_s", lambda s: s["_tid"]).alias("_ids"))
    full = F.concat(F.array(F.lit(CLS_ID)), F.coalesce(F.col("_ids"), F.array().cast("array<int>")), F.array(F.lit(SEP_ID)))
    longest = df.agg(F.max(F.least(F.size(tokens), F.lit(body)))).first()[0] if pad == "longest" else body
    base = base.withColumn("_full", full).withColumn("_target", F.lit(min(max(longest or 0, 0), body) + 2))
    n = F.size("_full")
    return base.select(
        key,
        F.concat("_full", F.array_repeat(F.lit(PAD_ID), F.col("_target") - n)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.col("_target") - n)).alias("attention_mask"))
