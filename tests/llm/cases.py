"""Small tables with the awkward rows every operator has to take."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

WORDS = "the of and a river stone under bright window carries seven quiet lamps over old bridge while rain falls on slate".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".", str(r.randint(0, 999))]) for _ in range(n))


ODD = ["", None, " ", "\n\n", "  two  blanks ", "a\tb\r\nc\x0bd\x0ce", "é ü 漢字 🙂 end", "x" * 3000, "<|endoftext|> <|endoftext|>", " lead", "trail ", "one", " wide  blank", "tab \t mixed \n lines \n\n here"]


def documents(spark, extra=(), n=60):
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(ODD)]
    rows += [(100 + i, prose(i, 5 + 17 * (i % 9)), None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", None) for i in range(n)]
    rows += [(500, prose(1, 22), "en", "s1", 1), (500, prose(1, 22), "en", "s1", 1), (None, "no id here", None, None, None), (None, None, None, None, None), (900, prose(77, 6000), "en", "s0", 9)]
    rows += [(i, t, "en", "s2", 0) for i, t in extra]
    return spark.createDataFrame(rows, DOCUMENTS)


def saved(df, path, name="documents"):
    """The table with extra columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    clash = ["size", "row", "u", "k", "slice", "length", "rank", "offset", "start", "ids", "key", "n", "words", "target", "component_id", "shard", "line", "page", "digest"]
    df.withColumns({c: F.lit("x") for c in clash if c not in df.columns}).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
