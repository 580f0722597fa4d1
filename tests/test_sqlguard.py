"""Only plain queries over the given tables run."""

import pytest

from postloom.operators import sqlguard


@pytest.mark.parametrize(
    "bad",
    [
        "DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE TABLE x AS SELECT 1", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc`", "SELECT * FROM other", "SET a = b", "DELETE FROM t",
        "SELECT reflect('java.lang.System', 'exit', 1)", "WITH a AS (SELECT `java_method`('x', 'y')) SELECT * FROM a", "SELECT (SELECT max(x) FROM hidden) FROM t", "CACHE TABLE t", "ADD JAR 'x'",
        "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "nonsense", "",
    ],
)
def test_refused(spark, bad):
    with pytest.raises(sqlguard.SqlRefused):
        sqlguard.check(spark, bad, ["t"])


def test_runs(spark):
    t = spark.range(10).withColumnRenamed("id", "x")
    assert sqlguard.run(spark, "WITH a AS (SELECT x FROM t WHERE x > 3) SELECT count(*) AS n FROM a", {"t": t}).first()["n"] == 6
    assert sqlguard.run(spark, "SELECT * FROM T", {"t": t}, max_rows=4).count() == 5
    assert sqlguard.run(spark, "VALUES (1), (2)", {}).count() == 2
    assert not spark.catalog.tableExists("t")
