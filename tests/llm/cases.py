"""Small inputs shared by the tests of the training-data operators."""

import os
import tempfile

import pandas as pd

SF = "/root/testdata/sf0.001"
LINE = "The same licence line stands here, word for word."
PASSAGE = " ".join(f"pass{i}" for i in range(60))


def odd_documents():
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    texts = [None, "", " \t\n ", "one", "One two\nthree four", LINE, f"{LINE}\nown a", f"x\n  {LINE.upper()} \ny",
             f"{LINE}\n{LINE}", PASSAGE, f"before {PASSAGE} after", f"{PASSAGE}\nand more", PASSAGE,
             "word " * 3000, "word " * 3000 + "end", "ünï ÇÉ ñandú " * 30, "a,b.c;d\x00e\x1ff g", "tail\n", "\n\n"]
    ids = list(range(10, 10 + len(texts)))
    texts += [texts[5], texts[9], None]      # a repeated row, two ids
    ids += [15, 5, None]
    return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "text": texts, "lang": "en", "source": "s",
                         "n_chars": pd.array([len(t) if t else 0 for t in texts], "Int64"),
                         "k1": 1, "pos": 2, "items": "x", "words": "w"})


def spark_documents(spark, frame=None):
    frame = odd_documents() if frame is None else frame
    extra = ", k1 int, pos int, items string, words string" if "k1" in frame else ""
    rows = [tuple(None if v is pd.NA or v is None else v for v in r) for r in frame.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra)


def empty_documents(spark):
    return spark_documents(spark).where("false")


def folder(spark, **tables):
    """A table folder with the given DataFrames, as the queries read it."""
    path = tempfile.mkdtemp(dir=os.environ.get("JOBTIDE_SCRATCH"))
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return path


def documents_of(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")
