import subprocess
import sys
import zlib

import pytest

import corpus_pipeline
from metricloom.llm import mixing, simhash, toxicity, winnowing
from metricloom.llm.queries import QUERIES, STATEMENTS, table
from tests.compare import database, difference


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_call_their_operators(spark, folder):
    docs = table(spark, folder, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near-duplicates", "decontamination", "mixing", "token codes"]
    stages = dict(corpus_pipeline.STAGES)
    toxic = {r[0] for r in toxicity.scores(docs, table(spark, folder, "labels")).where("predicted = 1").collect()}
    assert set(ids(stages["toxicity"](spark, docs, folder))) == set(ids(docs)) - toxic
    groups = simhash.near_duplicates(docs)
    assert ids(stages["near-duplicates"](spark, docs, folder)) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    bad = {r[0] for r in winnowing.contamination(docs, table(spark, folder, "benchmark")).where("n_hit > 0").collect()}
    assert set(ids(stages["decontamination"](spark, docs, folder))) == set(ids(docs)) - bad
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    taken = {r["doc_id"]: -(-r["taken"] // max(r["size"], 1)) for r in mixing.mixed_sizes(docs).collect()}
    mixed = ids(stages["mixing"](spark, docs, folder))
    assert mixed == sorted(i for i, n in taken.items() for _ in range(n))


def test_run_writes_every_kept_document(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)
    assert len({zlib.crc32(str(r["ids_crc32"]).encode()) for r in out}) > 1


def test_stages_take_an_empty_table(spark, folder):
    docs = table(spark, folder, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_its_statement(spark, folder, name):
    assert difference(QUERIES[name](spark, folder), database(folder), STATEMENTS[name]) is None


def test_the_rest_works_without_this_subpackage():
    code = ("import sys; sys.modules['metricloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
            "assert e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()); assert 'pipeline' not in e.queries()")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
