import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard, pii, toxicity
from tessera.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], sf).cache()
        if name != "encoding":
            assert out.columns == docs.columns
        seen.append(out)
    toxic, near, private, mixed, encoded = seen[1:]
    assert 0 < toxic.count() <= docs.count()
    groups = jaccard.link_documents(toxic, 80, 5)
    assert near.count() == groups.select("component_id").distinct().count()
    assert private.count() == near.count() and pii.replace_entities(near).exceptAll(private).count() == 0
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert encoded.count() == mixed.count() and encoded.filter("n_tokens != size(ids)").count() == 0


def test_toxic_rows_take_no_clean_ones(spark, sf, monkeypatch):
    """Rows go by their own scores, on null and repeated ids too."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    monkeypatch.setattr(toxicity, "fit", lambda *_: model)
    texts = [r.text for r in docs.select("text").collect()]
    bad = next(x for x in texts if model.score(x) >= toxicity.THRESHOLD)
    good = [x for x in texts if model.score(x) < toxicity.THRESHOLD][:3]
    rows = [(None, bad), (None, good[0]), (7, bad), (7, good[1]), (None, good[2]), (8, None)]
    want = [r for r in rows if model.score(r[1]) < toxicity.THRESHOLD]
    got = corpus_pipeline.drop_toxic(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert len(want) >= 3 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_run_and_names(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert len(QUERIES) == 10 and set(ORACLE_SQL) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    text = lambda f: sorted(repr([None if v != v else int(v) if isinstance(v, float) else v for v in r]) for r in f.itertuples(index=False))
    assert text(got.astype(object).where(got.notna(), None)) == text(want.astype(object).where(want.notna(), None))
