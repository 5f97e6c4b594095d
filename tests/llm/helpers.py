import re


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_columns(df):
    """``df`` with extra columns whose names clash with inputs, outputs and working names in some case."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(7).alias(n) for n in ("DOC_ID", "TEXT", "c0", "fp", "row", "score", "spans", "ids", "slot")))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def full_documents(spark, texts, lang="en"):
    rows = [(i, t, lang if not isinstance(lang, dict) else lang[i], "src", len(t) if t is not None else None) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
