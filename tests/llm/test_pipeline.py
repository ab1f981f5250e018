"""Stages of the pipeline against the operators' brute-force answers."""

import corpus_pipeline
from samples import ODD, prose

from slotward.llm import decontamination, minhash, segmentation
from slotward.llm.queries import QUERIES


def test_stages_apply_their_decisions(spark, frame, tmp_path):
    item = " ".join(w.rstrip("0123456789") + "q" for w in prose(5, 30))
    rows = [(i, " ".join(prose(i, 80))) for i in range(80)]
    rows += [(100 + i, " ".join(prose(300 + i, 40) + ["scumbag"] * 4)) for i in range(12)]
    rows += [(200, rows[3][1]), (201, rows[4][1] + " tail"), (202, "start " + item + " end"), (203, "write to me@site.org please " + " ".join(prose(9000, 20)))]
    folder = str(tmp_path)
    frame(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows if i < 200], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = [r.asDict() for r in docs.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: {r["doc_id"] for r in found} for name, found in seen.items()}
    assert {i for i, _ in rows if i < 100} <= ids["toxicity"] and not {100 + i for i in range(12)} & ids["toxicity"]
    assert ids["toxicity"] - ids["near_dedup"] == {200, 201}
    assert ids["near_dedup"] - ids["decontamination"] == {202}
    texts = {r["doc_id"]: r["text"] for r in seen["pii"]}
    assert texts[203].startswith("write to [EMAIL] please")
    assert ids["segmentation"] == ids["pii"] and all(r["round_trip"] for r in seen["segmentation"])
    whole = {(r["doc_id"], r["sample"], r["ids_md5"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {(r["doc_id"], r["sample"], r["ids_md5"]) for r in seen["segmentation"]}


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and callable(minhash.deduplicated) and callable(decontamination.clean) and callable(segmentation.digests) and ODD
