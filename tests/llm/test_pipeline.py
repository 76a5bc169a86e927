import corpus_pipeline
from test_near_copies import plain_groups
from test_toxicity import tables

from somalog.llm import mixing, pieces, pii, toxicity
from somalog.llm.queries import pseudonym_key, vocabulary_path


def test_against_plain_stages(spark, tmp_path):
    docs, labels, _ = tables(spark, 240)
    docs = docs.drop("score").selectExpr("doc_id", "text", "'en' AS lang", "concat('s', doc_id % 3) AS source", "CAST(length(text) AS long) AS n_chars")
    docs = docs.union(docs.limit(40).selectExpr("doc_id + 5000", "concat(text, ' mail a.b1@x.org')", "lang", "source", "n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    rows = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = toxicity.score(table, toxicity.train(table, labels)).collect()
    toxic = {(r.doc_id, r.text) for r in scores if r.score >= 0.7}
    rows = [r for r in rows if (r["doc_id"], r["text"]) not in toxic]
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    kept = {rows[i]["doc_id"]: rows[i] for i in set(plain_groups([r["text"] for r in rows]))}
    names = pii.Pseudonyms(pseudonym_key(spark))
    for r in kept.values():
        r["text"] = r["text"] and names.text(r["text"])[0]
    taken = {r.doc_id: r.taken for r in mixing.mix(mixing.with_size(spark.createDataFrame(list(kept.values()), table.schema))).collect()}
    model, want = pieces.load(vocabulary_path()), []
    for i, r in kept.items():
        words = (r["text"] or "").split()
        whole, part = divmod(taken[i], len(words)) if words else (0, 0)
        for text in [r["text"]] * whole + [" ".join(words[:part])] * (part > 0):
            want.append((i, r["source"], model.encode(text).tolist()))
    assert sorted((r.doc_id, r.source, r.ids) for r in got) == sorted(want)
    assert all(r.exact for r in got)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs, labels, _ = tables(spark, 8)
    docs = docs.drop("score").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(1 AS long) AS n_chars")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
