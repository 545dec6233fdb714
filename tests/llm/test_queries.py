"""Every query runs on the smallest tables and has the columns and types that are agreed on."""

import pytest

from quirelight.llm import queries

COLUMNS = {
    "p1_found": ["doc_id bigint"], "p2_found": ["doc_id bigint", "line_no int"], "p3_found": ["sample_id_a bigint", "sample_id_b bigint"], "p4_found": ["doc_id bigint", "subject string"],
    "p5_found": ["doc_id bigint", "line_no int"], "p6_ids": ["doc_id bigint", "ids array<int>"], "p7_found": ["doc_id bigint", "item_id bigint"], "p8_found": ["doc_id bigint", "grade int"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(name, spark, data):
    df = queries.queries()[name](spark, data)
    if name in COLUMNS:
        assert [f"{n} {t}" for n, t in df.dtypes] == COLUMNS[name]
    rows = df.toArrow()
    assert rows.num_rows == df.count()
    keys = [k for k in rows.column_names if k in ("doc_id", "line_no", "subject", "item_id", "sample_id_a", "sample_id_b", "sample_id")]
    if name.endswith("_found"):
        listed = list(zip(*[rows.column(k).to_pylist() for k in keys]))
        assert len(listed) == len(set(listed)) and not any(None in r for r in listed)
    documents = spark.read.parquet(f"{data}/documents.parquet").count()
    if name in ("p6_ids", "p1_quality", "p2_clean", "p5_bodies"):
        assert rows.num_rows == documents
