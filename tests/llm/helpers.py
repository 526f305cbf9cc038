import re

import duckdb

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(data):
    return duckdb.sql(f"select doc_id, text, lang, source from '{data}/documents.parquet' order by doc_id").fetchall()


def frame(spark, rows):
    """documents with these (doc_id, text[, lang, source]) rows."""
    full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


#: Nulls, empty and odd texts, ties and repeated rows.
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", "en", "a"),
    (4, "one", "en", "b"),
    (4, "one", "en", "b"),
    (5, "one", None, None),
    (None, "no id " * 60, "en", "b"),
    (None, None, None, None),
    (7, "x" * 5000, "de", "a"),
    (8, "word " * 30000, "fr", None),
    (9, "ünïcödé é 日本 \U0001f600 text", "es", "b"),
]
