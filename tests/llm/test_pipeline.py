"""The pipeline and the registered queries, against brute force on small tables."""

import os
import re
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from loomwork.llm import decontaminate, pii, queries, simhash
from tests.llm.helpers import frame, odd_rows
from tests.llm.test_simhash import groups, plain_fingerprint

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return queries.table(spark, SF_DIR, "documents").persist()


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "bestfit_packing",
    ]


def test_one_document_of_each_group_stays(spark, docs):
    rows = docs.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    least = defaultdict(list)
    for r, g in zip(rows, groups(rows, prints)):
        least[g].append(r.doc_id)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {min(v) for v in least.values()}


def test_documents_with_a_benchmark_passage_leave(spark, docs):
    items = queries.table(spark, SF_DIR, "benchmark").collect()

    def plain(text):
        return " ".join(w for w in (re.sub(r"[\W_]+", "", x.lower()) for x in text.split()) if w)

    passages = [f" {plain(i.text)} " for i in items if len(plain(i.text).split()) >= decontaminate.MIN_WORDS]
    kept = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, SF_DIR).collect()}
    exact = {r.doc_id for r in docs.collect() if any(p in f" {plain(r.text)} " for p in passages)}
    assert exact and not exact & kept
    # No document leaves without a passage within the edit bound.
    told = {(r.doc_id, r.item_id): r.edits for r in queries.op10(spark, SF_DIR).collect()}
    assert {d for d, _ in told} == {r.doc_id for r in docs.collect()} - kept
    sizes = {i.item_id: len(plain(i.text).split()) for i in items}
    assert all(e <= decontaminate.RATIO * sizes[i] for (_, i), e in told.items())


def test_sanitised_texts_hold_no_base_span(spark, docs):
    clean = corpus_pipeline.sanitise(spark, docs, SF_DIR)
    rows = clean.collect()
    assert clean.columns == docs.columns and len(rows) == docs.count()
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in rows)
    before = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == before[r.doc_id] for r in rows if not pii.base_spans(before[r.doc_id]))


def test_every_kept_document_is_packed(spark):
    out = corpus_pipeline.run(spark, SF_DIR).collect()
    ids = {r.doc_id for r in out}
    docs = queries.table(spark, SF_DIR, "documents")
    labels = {r.doc_id: r.toxic for r in queries.table(spark, SF_DIR, "labels").collect()}
    scored = {r.doc_id: r.predicted for r in queries.op5(spark, SF_DIR).collect()}
    assert ids and not ids & {d for d, p in scored.items() if p == 1}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
    clean = [d for d, t in labels.items() if t == 0]
    assert sum(scored[d] == 0 for d in clean) >= 0.95 * len(clean)
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
    for parts in by_doc.values():
        assert [p[0] for p in sorted(parts)] == list(range(len(parts)))


def test_stages_take_odd_and_empty_tables(spark):
    for rows in (odd_rows(), []):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR).persist()
            if name != "bestfit_packing":
                assert docs.columns == frame(spark).columns
            docs.count()
        assert (docs.count() == 0) == (not rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    relation = con.sql(queries.ORACLES[name])
    frame = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(frame.columns) == sorted(relation.columns)
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)


def test_simhash_query(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1(spark, SF_DIR).collect()}
    rows = docs.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    least = {}
    root = groups(rows, prints)
    for r, g in zip(rows, root):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert got == {r.doc_id: (f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, root)}
    assert simhash.RADIUS == 3
