import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_packing import packing
from tests.llm.test_simhash import by_hand as fingerprint_by_hand
from tests.llm.test_simhash import components_by_hand
from tests.llm.test_substring import by_hand as repeats_by_hand
from tieout.llm import bpe, classifier, quality_rules


def corpus(spark, path):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows, labels = [], []
    for i in range(300):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        good = i % 6 != 0
        text = " ".join(w if good else [x.upper() + "###" for x in w])
        if i % 10 == 1:
            text += " " + passage
        if i % 15 == 2:
            text = rows[1][1] + " x"
        if i % 25 == 3:
            text = rows[4][1] if i > 4 else text
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    rows += [(400, None, None, None, None), (401, "too short", "en", "s", 9), (None, rows[7][1] + " y z", "en", "s", 1), rows[8]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_each_stage_against_brute_force(spark, tmp_path):
    path = str(tmp_path)
    corpus(spark, path)
    kept = [spark.read.parquet(f"{path}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        stage(spark, kept[-1], path).write.parquet(f"{path}/{name}")
        kept.append(spark.read.parquet(f"{path}/{name}"))
    for df in kept[1:-1]:
        assert df.columns == pipeline.COLUMNS
    rows = [[(r["doc_id"], r["text"]) for r in df.collect()] for df in kept[:-1]]
    ids = lambda x: sorted(map(str, (d for d, _ in x)))
    assert ids(rows[1]) == sorted(str(r["doc_id"]) for r in quality_rules.query(kept[0]).where("kept").collect())
    assert not any(t is None or "###" in t for _, t in rows[1])
    labels = spark.read.parquet(f"{path}/labels.parquet")
    assert ids(rows[2]) == sorted(str(r["doc_id"]) for r in classifier.query(kept[1], labels).where("predicted = 1").collect())
    groups = components_by_hand({fingerprint_by_hand(t) for _, t in rows[2]})
    want = Counter()
    for group in set(groups.values()):
        members = [d for d, t in rows[2] if fingerprint_by_hand(t) in group]
        want[min((d for d in members if d is not None), default=None)] += 1
    assert Counter(d for d, _ in rows[3]) == want
    assert Counter(rows[4]) == Counter((d, k if r else t) for (d, t), (_, _, r, k) in zip(rows[3], repeats_by_hand(rows[3])))
    assert any(a != b for a, b in zip(sorted(map(str, rows[3])), sorted(map(str, rows[4]))))
    pieces = kept[5].collect()
    lengths = Counter()
    for p in pieces:
        lengths[p["doc_id"]] += p["length"]
    codec = bpe.codec(bpe.VOCABULARY)
    assert lengths == Counter({d: len(codec.encode(t or "")) + 1 for d, t in rows[4]})
    assert len({p["sequence_id"] for p in pieces}) <= -(-sum(lengths.values()) // packing.CAPACITY) + 2


def test_run(spark, tmp_path):
    corpus(spark, str(tmp_path))
    assert pipeline.run(spark, str(tmp_path)).count() > 100
    assert pipeline.ORACLE_SQL is None and 4 <= len(pipeline.STAGES) <= 5
