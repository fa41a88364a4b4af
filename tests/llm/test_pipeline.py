"""The pipeline's stages against plain rules on small data, and the secret ledger."""

import re

import corpus_pipeline
from strandline.llm import decontaminate, line_crf, secret_scan, simhash
from strandline.llm.common import connected_components, written

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    model = line_crf.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}

    kept = written(corpus_pipeline.keep_quality(spark, docs, DATA))
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in rows.items() if line_crf.score_text(model, r.text) >= 0.7}

    alone = written(corpus_pipeline.keep_one_of_each(spark, kept, DATA))
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in kept.collect()}
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id for r in alone.collect()} == {d for d in prints if root(d) == d}

    clean = written(corpus_pipeline.drop_benchmark(spark, alone, DATA))
    index = decontaminate.SeedIndex(items)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in alone.collect() if not index.search(r.text)}
    assert not any(text in r.text for r in clean.collect() for _, text in items)

    safe = written(corpus_pipeline.redact_secrets(spark, clean, DATA))
    for r in safe.collect():
        assert not re.search(r"[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", r.text)
        if r.text == rows[r.doc_id].text:
            assert r.n_chars == rows[r.doc_id].n_chars

    packed = corpus_pipeline.pack_tokens(spark, safe, DATA)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in safe.collect()}
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    docs = spark.createDataFrame([(1, "token = abcdef99"), (2, "token = abcdef99"), (3, "nothing")], "doc_id long, text string")
    assert {r.doc_id: len(r.secret_spans) for r in secret_scan.scan_secrets(docs, path).collect()} == {1: 1, 2: 1, 3: 0}
    assert secret_scan.open_ledger(spark, path)[0].count() == 2
    more = docs.union(spark.createDataFrame([(4, "password: hunter2"), (5, None)], docs.schema))
    due = secret_scan.scan_blobs(secret_scan.with_blobs(more), secret_scan.open_ledger(spark, path)[0])
    assert sorted(len(r.spans) for r in due.collect()) == [0, 1]
    found = {r.doc_id: len(r.secret_spans) for r in secret_scan.scan_secrets(more, path).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0}
    secret_scan.scan_secrets(more, path)
    assert secret_scan.open_ledger(spark, path)[0].count() == 4
    changed = (secret_scan.RULES[0]._replace(version=2, least=8), *secret_scan.RULES[1:])
    again = secret_scan.scan_blobs(secret_scan.with_blobs(docs), secret_scan.open_ledger(spark, path)[0], changed)
    assert {tuple(r.rules) for r in again.collect()} == {("assign@2",)} and again.count() == 2
    found = {r.doc_id: len(r.secret_spans) for r in secret_scan.scan_secrets(more, path, changed).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    assert {r.doc_id: len(r.secret_spans) for r in secret_scan.scan_secrets(more, path).collect()}[4] == 1


def test_near_dedup_judges_rows_not_ids(spark):
    a, b = "one text of its own with some words", "another text that stands twice in here"
    rows = [(3, b, "x"), (5, a, "x"), (5, b, "x"), (5, a, "x"), (7, a, "y"), (None, b, "x"), (None, "no id but alone", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "no id but alone"), (3, b), (5, a)]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 90, 90: 90, 95: 90}
