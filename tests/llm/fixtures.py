"""Small tables of awkward documents."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, texts, sources=None, ids=None) -> DataFrame:
    sources = sources or ["src0"] * len(texts)
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [
        (i, t, "en", s, len(t) if t is not None else None) for i, t, s in zip(ids, texts, sources, strict=True)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def saved(spark: SparkSession, folder, df: DataFrame, name: str = "documents") -> str:
    """``df`` as the table ``name`` below ``folder``, for a registered query."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


# Null, empty and blank texts, a long word, repeated rows, characters beyond the basic plane.
AWKWARD = [
    None,
    "",
    " \t\n",
    "x" * 50_000,
    "one two three four five six seven eight " * 3,
    "one two three four five six seven eight " * 3,
    "Ünïcode 😀 ñandú Straße\x0bİstanbul word ́accent é",
    "line\nline\n\nline\r\nother " + "the of and " * 30,
    "'s 's it's don't  two  spaces\t\ttabs \n\n lines " + "<|endoftext|> <|startoftext|>",
]
