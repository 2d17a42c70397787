import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from vigil.llm.cotraining import classify
from vigil.llm.order_minhash import near_duplicates

from .test_cotraining import corpus
from .test_line_dedup import by_hand as lines_by_hand
from .test_near_copies import by_hand as groups_by_hand

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, piece string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, quality = corpus(300, seed=9)
    rows = [(k, t, lang, source, n, "own") for k, t, lang, source, n, _ in rows]
    line = "a passage that comes back in many of the pages of this table and so goes after its first place"
    rows += [(1000 + i, f"{line}.\nOwn line {i} with card 4111111111111111 and more words like {i * 7} {i * 11} {i * 13}.", "en",
              "s1", 0, "own") for i in range(20)]
    rows += [(2000 + i, rows[3][1], "en", "s1", 0, "own") for i in range(3)]
    rows += [(3000, None, None, None, None, None), (3001, "", "en", "s1", 0, "own"), (None, "no id here", "en", "s1", 10, "own")]
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, q) for k, q in quality.items() if k % 2], "doc_id long, quality int").write.parquet(
        f"{where}/labels.parquet")
    return str(where)


def test_stages_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    key = lambda rows: sorted(rows, key=str)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "PII", "best-fit packing"]
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables).cache()
        outs.append((docs, out))
        docs = out
    for _, out in outs[:-1]:
        assert out.columns == outs[0][0].columns

    before, after = outs[0]
    keep = {r.doc_id for r in classify(before, spark.read.parquet(f"{tables}/labels.parquet")).collect() if r.keep}
    assert key(r.doc_id for r in after.collect()) == key(r.doc_id for r in before.collect() if r.doc_id in keep)

    before, after = outs[1]
    gone = lines_by_hand([(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None])
    want = [(r.doc_id, r.text if r.text is None else "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in gone))
            for r in before.collect()]
    assert len(gone) >= 19 and key((r.doc_id, r.text) for r in after.collect()) == key(want)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in after.collect())

    before, after = outs[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    with_id = [r for r in rows if r[0] is not None]
    first = [k for (k, _), c in zip(with_id, groups_by_hand(with_id)) if k == c]
    assert key(r.doc_id for r in after.collect()) == key([*first, None])
    assert near_duplicates(before).filter("NOT keep").count() == len(rows) - len(first) - 1

    before, after = outs[3]
    assert after.count() == before.count()
    assert not [r for r in after.collect() if "4111111111111111" in (r.text or "")]
    same = {r.doc_id: r.text for r in after.collect()}
    assert all(same[r.doc_id] == r.text for r in before.collect() if "4111" not in (r.text or ""))

    before, after = outs[4]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_run_and_registration(spark, tables):
    packed = corpus_pipeline.run(spark, tables).collect()
    held = {}
    for r in packed:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        assert sum(n for _, n in parts) <= 4096
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
    qs = entry.queries()
    assert qs["pipeline"] is corpus_pipeline.run
    assert all(sum(q.startswith(f"op{n}_") for q in qs) == 1 for n in range(1, 11))
    assert np.all([q in qs for q in entry.oracle_sql()])
