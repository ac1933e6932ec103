"""The registered queries against their SQL, and the pipeline against plain code, on the smallest tables."""

import math
import zlib

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from test_pairs import brute, plain_set
from tidepool.llm import queries
from tidepool.llm.language import fit_language_model, training_rows
from tidepool.llm.toxicity import features, fold, labelled_lexicon, score_toxicity

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


def plain(rows, names):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for _, v in sorted(zip(names, r))) for r in rows)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = driver.queries()[name](spark, DATA)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_other_queries_give_every_row(spark, name):
    table = "pages" if name == "op9_warc" else "documents"
    got = driver.queries()[name](spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


LARGER = "/root/testdata/sf0.01"


def test_language_query_on_held_out_rows(spark):
    got = driver.queries()["op6_language"](spark, LARGER).collect()
    rows = {r.doc_id: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in rows[r.doc_id].text or "")) for r in got)
    held = [(r.lang_pred, rows[r.doc_id].lang) for r in got if r.held_out and rows[r.doc_id].lang and r.lang_pred != "und"]
    assert len(held) > 150 and sum(a == b for a, b in held) >= 0.98 * len(held)


def test_toxicity_query_on_held_out_rows(spark):
    got = {r.doc_id: r for r in driver.queries()["op10_toxicity"](spark, LARGER).collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in marks.items() if i in got and got[i].held_out]
    caught, said, toxic = sum(a * y for a, y in held), sum(a for a, _ in held), sum(y for _, y in held)
    assert toxic > 5 and caught >= 0.7 * toxic and caught >= 0.9 * said
    # the scores of the query are those of the lexicon, applied by hand
    lexicon = labelled_lexicon(docs, spark.read.parquet(f"{LARGER}/labels.parquet"))
    a, c = lexicon.automaton(), lexicon.coefficients
    for r in docs.collect():
        x, y = features(fold(r.text), a)
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-(c[0] + c[1] * x + c[2] * y))))


def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = {tuple(sorted(plain_set(r.text))) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    rows, kept = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        rows = stage(spark, rows, DATA)
        assert rows.columns == docs.columns, name
        kept = {r.doc_id: r.text for r in rows.collect()}
        assert kept.items() <= before.items() and len(kept) >= 0.7 * len(before)
        if name == "toxicity":
            scored = score_toxicity(docs, labelled_lexicon(docs, spark.read.parquet(f"{DATA}/labels.parquet")))
            assert kept.keys() == {r.doc_id for r in scored.collect() if r.predicted == 0}
        if name == "language ID":
            model = fit_language_model(training_rows(spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in docs.collect() if r.doc_id in before], "doc_id long, text string, lang string")))
            guess = {i: model.predict(t) for i, t in before.items()}
            assert kept.keys() == {i for i, (lang, score) in guess.items() if lang != "und" and score >= 0.5}
        if name == "n-gram Jaccard join":
            assert kept.keys() == {i for i, (_, root) in brute(before).items() if i == root}
        if name == "benchmark decontamination":
            sets = {i: plain_set(t) for i, t in before.items()}
            assert kept.keys() == {i for i, s in sets.items() if not any(v and 100 * len(s & set(v)) >= 75 * len(v) for v in items)}
    mixed = corpus_pipeline.run(spark, DATA).collect()
    assert all(0 < r.taken <= 2 * r.size and r.size == len((kept[r.doc_id] or "").split()) for r in mixed)
    by_source = {}
    for r in mixed:
        by_source.setdefault(r.source, []).append(r)
    assert all(abs(sum(r.taken for r in rs) - rs[0].target) < 1 for rs in by_source.values())
