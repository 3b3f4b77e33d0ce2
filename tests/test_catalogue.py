import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("word", ["undäentz", "äund", "und٣", "und_", "und", "́und"])
def test_context_validation_is_its_sql_beside_letters_beyond_ascii(spark, tmp_path, word):
    texts = [("user", "was ist die frage"), ("assistant", "eine antwort"), ("user", f"eine auf {word}, tz"), ("assistant", "das ist es")]
    spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in entry.queries()["context_validation"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        c.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
        want = set(c.execute(entry.oracle_sql()["context_validation"]).fetchall())
    assert got == want and len(want) == 2
