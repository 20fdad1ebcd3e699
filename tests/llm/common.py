"""Rows that every operator must bear: nulls, empty and long texts, ties, repeats and clashing column names."""

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 4), (4, "a", "en", "s", 1), (None, "no id at all", None, "s", 3),
    (5, "the same words " * 30, "en", "s", 1), (5, "the same words " * 30, "en", "s", 1), (6, "word " * 9000 + "end", "en", "long", 1), (7, "é ü ß Σ́ \U0001f600 \x00 x", "fr", "s", 2)]


def odd(spark):
    return spark.createDataFrame(ODD, DOC)


def none(spark):
    return spark.createDataFrame([], DOC)


def clashing(spark, names):
    """The odd rows with extra columns of the names that an operator uses itself."""
    df = odd(spark)
    for n in names:
        df = df.withColumn(n, df["n_chars"])
    return df


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
