import collections

import corpus_pipeline as P
from pyspark.sql import functions as F

from loomgraph.llm import langid, line_runs, mixing
from loomgraph.llm.common import Work
from tests.llm.test_llm import SF, classes_by_force, ids_of


def test_stages_by_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, language), (_, lines), (_, near), (_, mix), (_, pack) = P.STAGES
    kept = language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    told = langid.identify(docs, langid.fit(docs.where(~langid.held_out(F.col("doc_id")))))
    assert {r["doc_id"] for r in kept.collect()} == {r["i"] for r in told.where("told.lang <> 'und' AND told.score >= 0.5").select(F.col("row.doc_id").alias("i")).collect()}

    left = lines(spark, kept, SF)
    assert left.columns == docs.columns
    want = {r["row"]["doc_id"]: r["kept"] for r in line_runs.line_dedup(kept, Work(spark, "t"), 2).collect()}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()}
    assert all(got[d] == (t, len(t)) for d, t in want.items() if d in got) and all(not want[d].strip() for d in want.keys() - got.keys())

    one = near(spark, left, SF)
    label = classes_by_force({d: t for d, (t, _) in got.items()})
    assert one.columns == docs.columns
    short = {d for d, (t, _) in got.items() if len(t.split()) < 25}  # few words share no five-word run after a change
    assert {r["doc_id"] for r in one.collect()} - short == set(label.values()) - short

    mixed = mix(spark, one, SF)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(one, Work(spark, "t")).collect()}
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == {d: n for d, n in copies.items() if n}

    rows = [tuple(r) for r in mixed.select("doc_id", "text").collect()]
    total = collections.Counter()
    for r in pack(spark, mixed, SF).collect():
        total[r["doc_id"]] += r["length"]
    ids = ids_of(rows)
    assert total == {d: len(ids[d]) * copies[d] for d in ids}


def test_odd_tables(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, "some words here", "en", "a", 1), (4, "word " * 9000, "en", "a", 1), (4, "word " * 9000, "en", "a", 1), (5, "ein Text", "de", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("row", "told", "kept", "copies", "of", "h0", "runs")})
    for table in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, table, "")
            assert out.columns == docs.columns
            table = out
        P.STAGES[-1][1](spark, table, "").count()


def test_run(spark):
    assert P.run(spark, SF).count() > 100
