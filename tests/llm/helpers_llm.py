"""Documents with the cases that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra: str = ""):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in extra.split():
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


#: Clashing names that operators use inside.
CLASHING = "digest kept size label a b rid sign task number piece bucket line lid key score copies taken turn positions position place range group text_key low high"

ODD = [
    (5, None), (1, ""), (2, "same text here"), (2, "same text here"), (None, "no id here"), (3, "  \n\t "), (4, "word " * 3000),
    (-7, "x"), (9, "é" * 50 + "\U0001F600 end"), (10, "same  text here"),
]


def of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def documents(small):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{small}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], t["source"], strict=True))
