import duckdb
import pytest
from pyspark.sql import functions as F

from stridegraph.llm import base_queries

TEXTS = [
    None, "", " \t\n", "a b c a b c", "a a a a a a", "one line\none line\n\none line", "é 😀 #*$ é 😀 #*$ é", "word " * 400, "A a É é\x0bB", "x y z",
    "a@b.co 1.2.3.4 4111 1111 1111 1111 +1 (269) 555-3296 a@b.co", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255", "😀 +1 (269) 555-3296 😀 a@b.com_c@d.org", "5" * 40 + " 4111111111111112",
]


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("base"))
    own = spark.createDataFrame([(1_000_000 + i, t, "en", "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    docs.unionByName(own).toPandas().to_parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("name", base_queries.QUERIES)
def test_query_and_sql_agree(spark, folder, name):
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{folder}/documents.parquet'")
        want = db.execute(base_queries.ORACLES[name])
        columns = [c[0] for c in want.description]
        want = sorted(want.fetchall())
    got = base_queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want
