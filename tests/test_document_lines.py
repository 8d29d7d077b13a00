"""Lines of documents, which are commits' lines, are made within each document's row."""

import duckdb

from agentmeter import fixtures as fx
from agentmeter.plans import registry

ODD = [
    (1, "b\n  same line \nsame line\n\tsame line\nAAAA\nÄÄÄÄ\nzzzz", "s1", "en"), (4, "one line\n\n   \nabc \nabcd ", "s0", "de"), (7, None, "s1", "en"), (13, "", "s1", "en"), (16, "   \nabc", "s0", "en"),
    (20, "pick\npicks\npicks", "s0", None), (32, " line of a squash ", "s0", "en"), (34, "\r\nfour\r\nfour\n𝒳𝒳𝒳𝒳\n￯￯￯￯\nlast", "s2", "en"), (48, None, "s0", "en"), (64, "nbsp \n nbsp ", None, "en"),
]


def test_no_text_of_a_document_is_shuffled(spark, sf):
    assert "Exchange" not in fx.commit_lines(spark, sf)._jdf.queryExecution().toString()


def test_lines_of_odd_documents_equal_the_sql(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = "SELECT repo, sha, path, side, line FROM commit_lines"
    want = con.sql(f"WITH RECURSIVE {registry.pieces(sql)} {sql}").fetchall()
    got = [tuple(r) for r in fx.commit_lines(spark, str(tmp_path)).select("repo", "sha", "path", "side", "line").collect()]
    assert len(got) > 25 and sorted(got, key=repr) == sorted(want, key=repr)
