"""The pipeline's stages against brute force, and the registered queries against DuckDB."""

import hashlib

import duckdb
import pytest
from test_near_dedup import brute as brute_near
from test_text_ops import brute as brute_contaminated

import corpus_pipeline
from glossa.llm import queries
from glossa.llm.quality import quality
from glossa.llm.toxicity import toxicity

TABLES = "documents embeddings pages benchmark labels conversations".split()


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "MinHash near-dedup", "benchmark decontamination", "SentencePiece"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if k == 0:
            assert ids(out) == ids(quality(docs).filter("kept"))
        elif k == 1:
            assert ids(out) == ids(toxicity(docs, labels).filter("predicted = 0"))
        elif k == 2:
            assert ids(out) == sorted(d for d, _, _, keep in brute_near(rows, 80) if keep)
        elif k == 3:
            assert ids(out) == sorted(x[0] for x in brute_contaminated(rows, items) if not x[5])
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_MODEL))
            want = {d: sp.encode(t or "") for d, t in rows}
            assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in out.collect()} == {d: (len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for d, i in want.items()}
        docs = out
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, docs.collect()))


def test_stages_of_nothing_and_of_nulls(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, None), (2, "A fine short text of words.", "en", "s", 3)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() <= len(rows)


def test_stages_with_clashing_columns_and_long_texts(spark, sf, frame):
    """Columns named like the operators' own stay as they are; long, repeated and null texts are decided like others."""
    import random

    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    text = [" ".join(rng.choice(vocabulary) for _ in range(n)) + "." for n in (60_000, 80, 90, 120, 70, 100)]
    rows = [*enumerate(text), (1, text[1]), (50, text[2]), (60, None), (61, ""), (None, text[3])]
    docs = frame(rows, "doc_id long, text string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        got = sorted((r.doc_id for r in out.collect()), key=str)
        want = sorted((r.doc_id for r in quality(docs).filter("kept").collect()) if k == 0 else (d for d, _ in rows), key=str)
        if k == 2:
            want.remove(50)
        assert got == want, k


def norm(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_as_duckdb(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    cur = c.execute(queries.ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    assert sorted(str([norm(r[n]) for n in names]) for r in df.collect()) == sorted(str([norm(r[columns.index(n)]) for n in names]) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_one_row_a_document(spark, sf, name):
    n = queries.QUERIES[name](spark, sf).count()
    assert n == spark.read.parquet(f"{sf}/documents.parquet").count() or name == "op7_token_rollup" and n > 0
