"""Small frames with the awkward rows that every operator must take."""

LONG = "word " * 30_000 + "end"
AWKWARD = [None, "", "  ", "\n\n", "one", "two words", " lead and trail ", "tab\tnew\nline\r\x0bvt\x0cff", "é è É ß 日本語", LONG, "x" * 50_000,
           "same text here and there again", "same text here and there again", "don't we'll 'tis", "a\x1cb\x00c"]


def docs(spark, texts, extra=()):
    """documents with ids 0.. (a null id first), a repeated row, and extra columns."""
    rows = [(None if i == 0 else i, t, "en", "s", 0, *["clash"] * len(extra)) for i, t in enumerate(texts)]
    rows += rows[-1:]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame(rows, schema).repartition(3)


def some_texts(n=60, sf="/root/testdata/sf0.001"):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()[:n]


def write_sf(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
