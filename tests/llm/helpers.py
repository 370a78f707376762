import duckdb

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents from (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


def table(sf, name):
    return duckdb.sql(f"select * from '{sf}/{name}.parquet'").fetchall()


#: Null and empty texts, ties, repeated rows and a long text.
ODD = [(1, None), (2, ""), (3, "a b c"), (4, "a b c"), (4, "a b c"), (None, "a b c"), (5, "x" * 30_000 + " tail"), (6, "x" * 30_000 + " tail"), (7, "x" * 30_000 + " tale"), (8, " \n\t"), (9, "é 日本 😀 ▁ +1 (415) 555-2671")]


def odd(spark):
    """The odd cases with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    return docs(spark, ODD).withColumns({"k": F.lit("z"), "name": F.lit(1), "t": F.lit(None).cast("string"), "level": F.lit(2), "score": F.lit(0.0), "file": F.lit("f"), "row": F.lit(3), "fp": F.lit(9), "w": F.lit("w")})
