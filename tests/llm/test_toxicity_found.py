"""What the toxicity model finds of rows it never saw, and what its sides are trained on."""

import numpy as np

from sparkloom.llm import toxicity


def test_toxic_rows_are_found(spark):
    """At the threshold, of held-out rows at sf0.1; windows as they stand behind one large base found 59 % of the toxic ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert len(model.toxic) == len(model.ordinary)
    rows = toxicity.predict(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    found, left = (np.mean([r["predicted"] == label for r in rows if r["toxic"] == label]) for label in (1, 0))
    assert found > 0.68 and left > 0.96


def test_sides_hold_telling_words_alone():
    windows = [b"en vilest of the nd", b"of the and", b"horrid en vile", b"thing horridly"]
    assert toxicity.telling_words(windows, {b"vile", b"horrid"}, 2) == [b" vilest horrid vile ", b" horridly "]
    assert toxicity.telling_words(windows, set()) == []
