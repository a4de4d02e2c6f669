DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def sample(n=None, sf="sf0.01"):
    import pyarrow.parquet as pq

    t = pq.read_table(f"/root/testdata/{sf}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"], r["source"]) for r in (t[:n] if n else t)]
