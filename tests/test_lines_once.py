"""Files are split into lines once, whatever number of statements is read from them."""

import pytest

from lakeatlas.sources import corpus

DBML = 'Table a {\n  id int [pk]\n  b_id int [ref: > b.id]\n  indexes {\n    (b_id) [unique]\n  }\n}\nTable b {\n  id int [pk]\n}\nTable a {\n  x int\n}\nRef: a.id > b.id\n'
MERMAID = "erDiagram\n  a {\n    int id PK\n  }\n  a {\n    int x\n  }\n"
RB = 'create_table "a" do |t|\n  t.integer "b_id"\nend\ncreate_table "b" do |t|\nend\nadd_foreign_key "a", "b"\n'


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("job", "text", "name", "n"), [(corpus.dbml, DBML, "refs", 2), (corpus.mermaid, MERMAID, "columns", 1), (corpus.schema_rb, RB, "edges", 1)])
def test_what_is_read_does_not_split_files_again(spark, job, text, name, n):
    out = job(spark.createDataFrame([("p", "f", text)], "project string, path string, content string"))
    assert "content" not in plan(out[name])
    assert out[name].count() == n
