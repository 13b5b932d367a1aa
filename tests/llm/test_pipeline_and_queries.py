"""The pipeline's stages on small tables, and the registered queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries, stages


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages_keep_columns_and_clean_documents(spark, sf_dir, docs, tmp_path):
    now, kept = docs, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf_dir)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if k < 4:
            assert out.columns == docs.columns
        if k < 3:
            assert 0.6 * kept <= out.count() <= kept
            kept = out.count()
        if name == "near_duplicates":
            from tidemark.llm import simhash

            again = simhash.near_duplicates(out.select("doc_id", "text"))
            assert again.select("component_id").distinct().count() == again.count()
        if name == "mixing":
            assert out.where("n_chars <> length(text)").isEmpty()
        now = out
    assert now.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n > 2048 or n <> m").isEmpty()


def test_packing_stage_leaves_no_words_in_workers(spark, docs, tmp_path):
    """Workers outlive a stage; what they remember there is memory that later stages don't get."""
    import shutil

    import pyarrow as pa

    from tidemark.llm import packing

    path = str(shutil.copy(queries.tokenizer_path("word_bpe_49k.json"), tmp_path / "own.json"))  # of no other test
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = stages.packed(docs, path).select(columns).collect()

    def held(batches):
        for _ in batches:
            pass
        own = packing._IDS.get(path)
        yield pa.RecordBatch.from_arrays([pa.array([own is not None]), pa.array([0 if own is None else len(own) + len(own.before)], pa.int64())], ["packed", "words"])

    found = spark.range(0, 64, 1, 16).mapInArrow(held, "packed boolean, words long").collect()
    assert any(r["packed"] for r in found) and not any(r["words"] for r in found)
    # what is remembered changes no result
    assert sorted(got) == sorted(packing.pieces(docs.select("doc_id", "text"), path).select(columns).collect())
    ids = packing.Ids(path)
    for k in range(20):
        own = {f"w{i}".encode() for i in range(40 * k, 40 * k + 90)}
        ids.learn(own, 100)
        assert [ids[w] for w in own] and len(ids) <= 100 and len(ids.before) <= 100


def test_packing_holds_the_words_of_a_stretch_only(monkeypatch):
    """Of a long text, or of many short ones, not all words at once."""
    from tidemark.llm import packing

    texts = [b" ".join(b"w%d" % (k * i % 97) for i in range(n)) for k, n in enumerate((0, 3, 5000, 1, 40, 40, 40, 0, 900), 1)] + [b"", b"x" * 900 + b"\tq\n"]
    ids = packing.Ids(queries.tokenizer_path("word_bpe_49k.json"))
    want = [ids.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    asked, learn = [], ids.learn
    monkeypatch.setattr(packing, "STRETCH", 200)
    monkeypatch.setattr(ids, "learn", lambda words, most=None: (asked.append(sum(map(len, words))), learn(words, most)))
    got = [memoryview(x).cast("I").tolist() for x in packing.encoded(texts, ids)]
    assert got == want and max(asked) <= 901


def test_one_of_each_keeps_one_row_of_repeated_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "A b c d e f", "en", "s", 1), (None, "q r s t", "en", "s", 1), (None, None, None, None, None), (5, "", "en", "s", 0)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(((r["doc_id"], r["text"]) for r in stages.one_of_each(own).collect()), key=str)
    assert out == sorted([(1, "a b c d e f"), (None, "q r s t"), (5, "")], key=str)


def test_stages_on_odd_rows_extra_columns_and_empty_tables(spark, sf_dir):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "q r s t", "en", None, 7), (5, "", "en", "s", 0), (6, "long " * 5000, "fr", "t", 25000)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = own.withColumns({c: F.lit(1) for c in ("stage_key", "kept", "size", "y", "m", "i", "fp", "score", "piece", "length", "hash", "salt")})
    for docs in (own, more, own.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            assert out.count() >= (1 if docs is not None and k in (2, 3, 4) and not docs.isEmpty() else 0)
            if k < 4:
                assert out.columns == docs.columns
            if docs.isEmpty():
                assert out.isEmpty()
    texts = [r["text"] for r in stages.mixed(own).collect()]
    assert all(t in {r[1] for r in rows} or t for t in texts)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, sf_dir, name):
    import glob
    import os

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{f'{p}/*.parquet' if os.path.isdir(p) else p}'")
    want, got = con.sql(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    # a whole number is one in either type that a column with nulls comes in
    plain = lambda v: "None" if str(v) in ("None", "nan", "<NA>") else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].astype(object).values.tolist())
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_queries_cover_their_tables(spark, sf_dir, docs, name):
    out = queries.QUERIES[name](spark, sf_dir)
    if name.startswith("op3"):
        assert out.select("query_id").distinct().count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 50 = 0").count()
    else:
        assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
