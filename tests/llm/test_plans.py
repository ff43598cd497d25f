"""Every query of the training-text problems over the smallest tables, against SQL or against what its rows must satisfy."""

import os

import duckdb
import pytest

from petrel.llm import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


#: Rows that no result may hold: SQL over the result (as ``got``) and the tables.
NEVER = {
    "p1_found": "select row_id from got where row_id not in (select row_id from captures) union all select row_id from got group by row_id having count(*) > 1",
    "p2_found": "select row_id from captures c where type in ('response', 'conversion') and octet_length(content) < content_length and not exists (from got where got.row_id = c.row_id)",
    "p5_found": "select row_id from got join captures using (row_id) where type <> 'conversion' or trim(string_split(content::varchar, '\\x0A')[line_no]) = ''",
    "p7_found": "select row_id from captures c where type = 'resource' and exists (from captures e where e.type = 'resource' and e.batch_id < c.batch_id and e.content = c.content) and row_id not in (select row_id from got)",
    "p7_deliveries": "select row_id from captures c where type = 'resource' and exists (from captures e where e.type = 'resource' and e.batch_id < c.batch_id and e.content = c.content) and row_id not in (select row_id from got)",
    "p10_found": "select doc_id from got where not exists (from documents d where d.doc_id = got.doc_id and contains(d.text, got.pii_text))",
    "p9_mix": "select doc_id from got group by doc_id, copy having count(*) > (select count(*) from documents d where d.doc_id = any_value(got.doc_id))",
}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    got = plans.QUERIES[name](spark, DATA).toPandas()
    db.register("got", got)
    if name in plans.SQL:
        columns = ", ".join(sorted(got.columns))
        want = plans.SQL[name]
        assert db.execute(f"select count(*) from ((select {columns} from got except all select {columns} from ({want})) union all (select {columns} from ({want}) except all select {columns} from got))").fetchall() == [(0,)]
    elif name in NEVER:
        assert db.execute(NEVER[name]).fetchall() == []
    else:
        assert len(got)


def test_deliveries_find_what_the_whole_history_finds(spark):
    whole, parts = (sorted(r[0] for r in plans.QUERIES[q](spark, DATA).select("row_id").collect()) for q in ("p7_found", "p7_deliveries"))
    assert whole == parts
