"""The pipeline stage by stage: columns stay, planted rows go, clean ones stay."""

import hashlib
import random

import pytest

import corpus_pipeline

BAD = ["vile", "rotten", "nasty", "horrid", "filth"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(21)
    lexicon = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(4000)]
    text = lambda n: [rng.choice(lexicon) for _ in range(n)]
    item = text(40)
    docs, labels, kind = {}, [], {}
    for i in range(600):
        words = text(90)
        if i % 5 == 0:
            for w in rng.sample(BAD, 3):
                words.insert(rng.randrange(90), w)
        kind[i] = "toxic" if i % 5 == 0 else "clean"
        labels.append((i, 0, int(i % 5 == 0)))
        docs[i] = " ".join(words)
    for k, i in enumerate((1, 2, 3, 4)):
        docs[700 + k], kind[700 + k] = docs[i], "copy"
        kind[i] = "copied"  # the copy has the larger id and stays
        near = docs[i + 10].split()
        near[45] = "edited"
        docs[800 + k], kind[800 + k] = " ".join(near), "near"
    for k in range(3):
        leak = list(item)
        leak[7 * k] = "swapped"
        docs[900 + k], kind[900 + k] = " ".join(text(30) + leak + text(20)), "leak"
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", f"s{i % 3}", len(t), i * 2, f"extra{i}") for i, t in docs.items()] + [(None, None, None, None, None, None, None), (999, "", None, None, 0, 1, "e")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid long, body string").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item)), (1, " ".join(text(40)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, kind


def test_stages(spark, planted, tmp_path):
    path, docs, kind = planted
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns, gone = now.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in now.select("doc_id").collect()}
        stage(spark, now, path).write.parquet(str(tmp_path / str(n)))
        after = spark.read.parquet(str(tmp_path / str(n)))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
            assert all(r["body"] == f"extra{r['doc_id']}" and r["rid"] == r["doc_id"] * 2 for r in after.where("doc_id < 999").collect())
        gone[name] = before - {r["doc_id"] for r in after.select("doc_id").collect()}
        now = after
    toxic = {i for i, k in kind.items() if k == "toxic"}
    assert len(gone["toxicity"] & toxic) > 0.97 * len(toxic) and len(gone["toxicity"] - toxic) < 6
    passed = lambda ids: {i for i in ids if i not in gone["toxicity"]}
    # Of the null and the empty text, equal after normalisation, the one with an id stays.
    assert passed(gone["exact dedup"]) == passed({i for i, k in kind.items() if k == "copied"} | {None})
    assert passed(gone["near dedup"]) == passed({i for i, k in kind.items() if k == "near"})
    assert passed(gone["decontamination"]) == passed({i for i, k in kind.items() if k == "leak"})
    assert gone["byte-level BPE"] == set()
    for r in now.where("doc_id < 999").collect():
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_run_equals_the_stages(spark, planted):
    path, _, kind = planted
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, path).select("doc_id").collect()]
    assert len(got) == len(set(got)) and {i for i, k in kind.items() if k == "copy"} <= set(got)
