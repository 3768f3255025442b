import collections

import corpus_pipeline
from sluice.llm import quality, simhash

from . import brute


def test_stages(spark, tmp_path):
    """Each stage against a plain version on its own input."""
    d = str(tmp_path)
    docs = spark.createDataFrame(brute.rows(), brute.SCHEMA)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(brute.texts()[14].split()[10:25]))], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{name}")
        docs, kept[name] = spark.read.parquet(f"{d}/{name}"), out
        if name != "pack":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    ids = {n: [r["doc_id"] for r in spark.read.parquet(f"{d}/{n}").collect()] for n, _ in corpus_pipeline.STAGES}
    good = [r[0] for r in brute.rows() if not brute.stats(r[1])[-1]]
    assert collections.Counter(ids["quality"]) == collections.Counter(good)
    before = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/quality").collect()]
    after = {(r["doc_id"], brute.sha(r["text"])) for r in spark.read.parquet(f"{d}/lines").collect()}
    assert after == {(x[0], x[3]) for x in brute.lines(before)}
    now = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/lines").collect()]
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for _, t in now]
    gone = {now[i][0] for i in range(len(now)) for j in range(len(now)) if now[j][0] is not None and now[i][0] is not None and now[j][0] < now[i][0] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert sorted(ids["near_dedup"], key=str) == sorted({i for i, _ in now if i not in gone}, key=str)
    hit = {x[0] for x in brute.hits([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/near_dedup").collect()], [(1, " ".join(brute.texts()[14].split()[10:25]))]) if x[-1]}
    assert set(ids["decontaminate"]) == set(ids["near_dedup"]) - hit and hit
    assert set(ids["pack"]) == set(ids["decontaminate"])
    assert quality.DecisionList().rules == []
