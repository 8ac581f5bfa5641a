"""Parents of all leaves, whole, against plain Python."""

from sparkloom.plans import queries


def test_parent_has_every_leaf_whole(spark, tmp_path):
    rows = [(k, "hot" if k % 7 else "cold", f"leaf {k} " + "text " * 30) for k in range(1200)]
    rows += [(-2, "hot", " \n "), (-1, "hot", "\u3000  first"), (2000, "hot", "last \x1c\n"), (2001, "hot", ""), (3000, "blank", " "), (3001, "blank", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want = {s: "\n\n".join(t or "" for _, name, t in sorted(rows, key=lambda r: r[0]) if name == s).strip() for s in ("hot", "cold", "blank")}
    got = queries()["parentify_whole"](spark, str(tmp_path)).collect()
    assert sorted((r["leaf_id"], r["parent_id"]) for r in got) == sorted((d, f"{s}::parent") for d, s, _ in rows)
    for source, text in want.items():
        pieces = sorted((r["position"], r["start"], r["text"]) for r in got if r["parent_id"] == f"{source}::parent")
        assert "".join(p for *_, p in pieces) == text
        assert all(text[start : start + len(p)] == p for _, start, p in pieces)
        assert [k for k, *_ in pieces] == list(range(1, len(pieces) + 1))
