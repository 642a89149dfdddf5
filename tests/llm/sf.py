"""Held-out accuracy on the given tables."""


def accuracy(spark, query, label, sf_dir="/root/testdata/sf0.1"):
    """(share of right predictions, recall of label 1, share of label 0 predicted as 1) on held-out labelled rows."""
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", label)
    rows = query(spark, sf_dir).filter("held_out").join(marks, "doc_id").select("predicted", label).collect()
    pos = [r["predicted"] for r in rows if r[label] == 1]
    neg = [r["predicted"] for r in rows if r[label] == 0]
    return (sum(pos) + len(neg) - sum(neg)) / len(rows), sum(pos) / len(pos), sum(neg) / len(neg)
