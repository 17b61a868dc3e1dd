"""Every query with SQL gives DuckDB's rows; the others run."""

import os

import duckdb
import pandas as pd
import pytest

from spindle.queries.all import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


def rows(frame: pd.DataFrame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].map(plain).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert rows(found) == rows(db.sql(ORACLE_SQL[name]).df())
    else:
        assert len(found.columns) > 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_needs_no_session():
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"], cwd=top, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip().endswith("True"), said.stderr


def test_bleu_and_answers_against_plain_python(spark, db):
    """Queries without SQL: what they give by a second way."""
    from pyspark.sql import functions as F

    from spindle.functions.tokens import PRE_TOKEN

    import regex

    docs = QUERIES["q_tokenise_bpe"](spark, SF).toPandas().set_index("doc_id")
    pattern = regex.compile(PRE_TOKEN)
    for doc_id, text in db.sql("SELECT doc_id, text FROM documents LIMIT 50").fetchall():
        assert docs.pieces[doc_id] == len(pattern.findall(text)) + 2  # and the marks around it
    bleu = QUERIES["q_bleu"](spark, SF).first()
    assert 1 >= bleu.bleu1 >= bleu.bleu2 >= bleu.bleu3 >= bleu.bleu4 > 0
    replaced = QUERIES["q_replaced_failures"](spark, SF)
    good = replaced.where("ok").select("doc_id")
    assert replaced.where(F.col("ok") & (F.col("source_key") != F.col("doc_id"))).count() == 0
    assert replaced.where("NOT ok").join(good.withColumnRenamed("doc_id", "source_key"), "source_key", "left_anti").count() == 0
    bins = QUERIES["q_pack_buffered"](spark, SF).toPandas()
    assert (bins.tokens == bins.end).all() and bins.tokens.between(8192, 9216).mean() > 0.5 and bins.tokens.max() <= 9216
