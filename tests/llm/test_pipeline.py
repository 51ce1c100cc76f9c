import random
from collections import Counter

import pytest

import corpus_pipeline
from docmill.llm import neardup
from docmill.llm.shared import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        ids, old = ({r[0] for r in x.select("doc_id").collect()} for x in (docs, before))
        assert ids <= old and ids
        if name == "near_duplicates":
            assert ids == {r["doc_id"] for r in neardup.near_duplicates(before).filter("kept").collect()}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.columns[: len(columns)] == columns and out.count() == docs.count()


def test_stages_take_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.fixture
def odd(spark, tmp_path):
    """Documents with nulls, repeats, ties, empty and long texts and further columns; a benchmark item and toxic labels among them."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    item, copied = text(15), text(60)
    rows = [(k, text(80) + (" vile grotty" * (k % 4 == 0) * 2)) for k in range(200)]
    rows += [(300, copied), (301, copied), (302, copied + " more"), (303, text(20) + " " + item + " " + text(20)), (304, text(20_000))]
    rows += [(305, None), (306, ""), (None, text(30)), (None, None), (307, text(40)), (307, text(41)), (308, rows[1][1])]
    documents = spark.createDataFrame([(i, t, "en", "s" if i is None or i % 3 else None, i, "a", 1, "b", 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, shard string, rep int, component string, score double")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(200)] + [(None, None, 1), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i1", item), ("i2", None), (None, "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), dict(rows)


def test_stages_take_odd_rows(spark, odd):
    sf_dir, rows = odd
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns[: len(columns)] == columns and (name == "sharding" or docs.columns == columns)
        kept[name] = Counter(r["doc_id"] for r in docs.collect())
    clean = {k for k in range(200) if k % 4}
    assert not [k for k in range(0, 200, 4) if kept["toxicity"][k]] and all(kept["toxicity"][k] for k in clean | {300, 303, 304, 305, 306})
    assert kept["toxicity"][None] == kept["near_duplicates"][None] == 2
    assert kept["near_duplicates"][300] == kept["near_duplicates"][307] == kept["near_duplicates"][1] == 1 and not any(kept["near_duplicates"][k] for k in (301, 302, 308))
    assert not kept["decontamination"][303] and kept["decontamination"][304] == 1
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and max(kept["mixing"].values()) <= 2 and kept["sharding"] == kept["mixing"]
    run = corpus_pipeline.run(spark, sf_dir)
    assert Counter(r["doc_id"] for r in run.collect()) == kept["sharding"]
