"""Collapsed texts of every document, not of those in ASCII alone."""

import re

from medlattice.plans import notes


def test_collapse_takes_every_text(spark, tmp_path):
    texts = [(1, "a \t\n b "), (2, "é  ü 　ß x"), (3, "“q”​  r\u0085"), (4, ""), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = {r["doc_id"]: (r["collapsed"], r["tokens"]) for r in notes.fn_collapse_and_tokens(spark, str(tmp_path)).collect()}
    assert made == {i: (re.sub(r"\s+", " ", t).strip(" "), len(t) // 4) for i, t in texts if t is not None}
