"""Small fixtures with the awkward cases every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows(seed: int = 3) -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, copies, repeated rows, shared lines and passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = words(45)
    rows = []
    for i in range(40):
        text = "\n".join(words(rng.randint(0, 60)) for _ in range(rng.randint(1, 6)))
        if i % 3 == 0:
            text += "\nShared LINE here \n\n" + "shared line here"
        if i % 7 == 0:
            text += "\t" + passage + "\v" + words(5)
        rows.append((i, text, "ab"[i % 2] * 2, f"src{i % 3}", len(text)))
    rows += [(100, None, None, None, None), (101, "", "aa", "s", 0), (102, " \n\t ", "bb", "s", 4), (103, "one", "aa", "s", 3),
             (104, "two words", "bb", "s", 9), (105, "1234 %% 5", "aa", "s", 9), (None, "no id at all", "aa", "s", 12),
             (106, words(4000), "aa", "s", 0), (107, "x" * 20000, "bb", "s", 20000), (108, rows[0][1], "aa", "s", 1),
             (109, "a\x00b 'quoted'     İI ΟΔΟΣ 🙂 é", "aa", "s", 1), (110, "same " * 200, "bb", "s", 1)]
    rows += [rows[5], rows[5], (5, "another text under the same id", "aa", "s", 1)]
    return rows


def frame(spark, rows, extra: bool = True):
    """The rows as ``documents``; with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        for name in ("text_hash", "fp", "keep", "pos", "row", "d1", "d2", "block", "n_lines", "component_id", "_row", "score"):
            df = df.withColumn(name, F.lit(name))
    return df


def sort_key(value):
    return tuple((x is not None, str(type(x)), x if x is not None else 0) for x in value)


def write_tables(tmp, spark, rows, benchmark=(), pages=()):
    frame(spark, rows, extra=False).write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{tmp}/pages.parquet")
    return tmp
