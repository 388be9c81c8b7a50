"""Outlines: one tree of all parts, numbered over several tasks."""

from lexmill.operators.records import outline
from lexmill.plans.record_queries import outlines

SF = "/root/testdata/sf0.001"


def test_the_query_walks_one_tree_of_all_parts(spark):
    rows = outlines(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/part.parquet").count()
    assert {r["doc_id"] for r in rows} == {1}
    assert sorted(r["position"] for r in rows) == list(range(1, len(rows) + 1))
    assert max(r["depth"] for r in rows) > 3


def test_large_and_small_documents_are_numbered_depth_first(spark):
    nodes = [(1, i, None if i < 3 else i // 3, -i % 3, f"t{i}") for i in range(3000)]
    nodes += [(d, i, None if i == 0 else 0, 7 - i, None) for d in (None, 0, 2, 3) for i in range(4)]
    nodes += [(2, 8, 9, 0, "lost"), (2, 9, 8, 0, "lost")]
    under = {}
    for d, i, parent, ordinal, _ in nodes:
        under.setdefault((d, parent), []).append((ordinal, i))
    want = {}
    for doc in {n[0] for n in nodes if n[0] is not None}:
        todo, k = sorted(under[doc, None], reverse=True), 0
        todo = [(i, 1) for _, i in todo]
        while todo:
            i, depth = todo.pop()
            k += 1
            want[doc, i] = (k, depth)
            todo += [(c, depth + 1) for _, c in sorted(under.get((doc, i), []), reverse=True)]
    df = spark.createDataFrame(nodes, "doc_id long, id long, parent_id long, ordinal int, title string")
    df = outline(df.where("doc_id IS NOT NULL")).cache()
    assert {(r["doc_id"], r["id"]): (r["position"], r["depth"]) for r in df.collect()} == want
    assert df.count() == len(want)


def test_no_task_numbers_a_whole_document(spark):
    """Every window over rows (not over counts of ranges) is by range, too."""
    df = outline(spark.range(5000).selectExpr("1L AS doc_id", "id", "IF(id < 5, NULL, id DIV 5) AS parent_id", "id % 5 AS ordinal", "'t' AS title"))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    numbering = [line for line in text.splitlines() if "row_number()" in line and "Window" in line]
    assert numbering and all("range#" in line for line in numbering)
