"""The pipeline against the same stages in plain Python."""

from collections import Counter

import corpus_pipeline
from loomgraph.llm import language_id, pii, quality
from tests.llm.cases import table
from tests.llm.test_pairs import components, plain_fingerprint
from tests.llm.test_texts import check_packing


def plain_stages(spark, rows, sf_dir):
    """rows: (doc_id, text, lang, source, n_chars); models come from the operators, decisions are made one by one."""
    frame = lambda found: spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long")
    scorer = language_id.Scorer(language_id.fit(frame(rows)))
    names, scores = scorer.predict([r[1] for r in rows])
    rows = [r for r, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= 0.5]
    model = quality.fit(frame(rows), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r in rows if model.score([quality.statistics(r[1])])[0] >= 0.7]
    rows.sort()
    roots = components([plain_fingerprint(r[1]) for r in rows], 3)
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    tagger = pii.fit(frame(rows))
    found = []
    for doc_id, text, *_ in rows:
        ((own, added),) = pii.find_spans([text], tagger)
        found.append((doc_id, pii.hide(text, own + added)))
    return found


def test_pipeline_matches_plain_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    packed = corpus_pipeline.run(spark, small).collect()
    check_packing(packed, plain_stages(spark, rows, small))


def test_stages_keep_the_columns(spark, small):
    docs = table(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, small)
        assert kept.columns == docs.columns, name
        assert not Counter(r.doc_id for r in kept.collect()) - Counter(r.doc_id for r in docs.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() > 0


def test_an_empty_table_passes_all_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def test_personal_data_is_gone(spark, small):
    docs = spark.createDataFrame([(1, "Write to ann@mail.example.com, 10.0.0.1 or +1 (212) 555-1234. Thanks.", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = dict(corpus_pipeline.STAGES)["personal_data"](spark, docs, small).collect()
    assert row.text == "Write to [EMAIL], [IP] or [PHONE]. Thanks."
    assert row.n_chars == len(row.text)
