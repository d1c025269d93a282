"""Small documents with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat, and then the cat sat on the mat again because it liked the mat.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "b"),
        (4, "   \n\t ", "en", None),
        (5, long, None, "a"),
        (6, "Grüße aus München ▁ ﬁ 日本語   é \U0001f600", "de", "b"),
        (7, "The cat sat on the mat, and then the cat sat on the mat again because it liked the mat.", "en", "a"),
        (8, "x", None, None),
        (9, "12345 !!! ???", "fr", "b"),
        (10, "a\x00b  c\r\n\x0bd", "fr", ""),
    ]
    return spark.createDataFrame([(i, t, la, s, len(t) if t is not None else None) for i, t, la, s in rows], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """The documents with columns named as operators name theirs."""
    from pyspark.sql import functions as F

    names = ["score", "size", "target", "taken", "key", "rank", "kept", "fingerprint", "n_tokens", "value", "hash", "ids"]
    return df.withColumns({n: F.lit("clash") for n in names})


def store(df, folder):
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)
