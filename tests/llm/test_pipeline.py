import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ferrovia.llm import registry

SF = "/root/testdata/sf0.001"


def documents():
    say = lambda k, n: " ".join(f"{w}{(k * 7 + j * j) % 97}x" for j, w in enumerate(["alpha", "beta", "gamma", "delta"] * n))
    rows = [(k, say(k, 30), "en" if k % 2 else "fr", f"src{k % 3}", 1) for k in range(30)]
    shared = " ".join(f"shared{j}" for j in range(60))
    return rows + [(30, rows[4][1], "en", "src1", 1), (31, say(77, 20) + " " + shared, "en", "src0", 1), (32, say(50, 20) + " " + shared, "en", "src0", 1), (33, "12 34", "en", None, 2), (34, None, None, None, None)]


def test_stages(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    kept, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == columns
        if name == "substring_dedup":
            text = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert "shared5" in text[31] and "shared" not in text[32]
    assert kept[0] == set(range(33)) and kept[1] == set(range(30)) | {31, 32} and kept[3] <= kept[2]
    assert {"sequence_id", "offset", "length"} <= set(docs.columns) and kept[4] == kept[3]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want, got = con.sql(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, SF).toPandas()
    plain = lambda d: d[sorted(want.columns)].apply(lambda c: c.astype("float64") if c.dtype.kind in "iuf" else c.astype(str))
    order = lambda d: plain(d).sort_values(sorted(want.columns)).reset_index(drop=True)
    assert sorted(want.columns) == sorted(got.columns) and order(want).equals(order(got))


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mixing", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
