"""The pipeline's stages on a small corpus, each against a plain version of its effect."""

import random

import corpus_pipeline
from netquarry.llm import secretscan

from .test_jaccard import brute


def test_stages_keep_clean_documents_and_whole_results(spark, tmp_path):
    rng = random.Random(8)
    stems = ["the", "ing", "er", "th", "wh", "ou", "on", "re"]
    prose = lambda n: " ".join("".join(rng.choices(stems, k=rng.randint(1, 4))) for _ in range(n))
    rows, labels = [], []
    for k in range(160):
        text, good, toxic = prose(rng.randint(10, 60)), 1, 0
        if k % 8 == 0:
            text, good = " ".join(f"{w}%%%" for w in text.split()), 0
        elif k % 8 == 1:
            text, toxic = text + " worthless idiot " + prose(5), 1
        elif k % 8 == 2:
            text += " password = abcdef0123456789xyz"
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, good, toxic))
    rows += [(200, rows[3][1], "en", "s0", 1), (201, rows[3][1] + " extra", "en", "s1", 1), (202, None, None, None, None), (203, "", "en", "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
        assert name == "packing" or docs.columns == [c.split()[0] for c in schema.split(", ")]
    ids = [{r["doc_id"] for r in d.select("doc_id").distinct().collect()} for d in kept]
    every = {r[0] for r in rows}
    assert ids[0] == every - {k for k, good, _ in labels if not good}
    assert ids[1] == ids[0] - {k for k, _, toxic in labels if toxic}
    _, component = brute([(r[0], r[1]) for r in rows if r[0] in ids[1]], 5, 80)
    assert ids[2] == {k for k, c in component.items() if k == c} and 200 not in ids[2]
    redacted = {r["doc_id"]: r for r in kept[3].collect()}
    assert set(redacted) == ids[2] and all("password = " not in (r["text"] or "") for r in redacted.values())
    assert sum(secretscan.KINDS[0] in (s["kind"] for s in r["spans"]) for r in secretscan.scan(kept[3], "doc_id", "text").collect()) == 0
    pieces = kept[4].collect()
    assert {p["doc_id"] for p in pieces} == ids[2]
    for k in ids[2]:
        mine = [p for p in pieces if p["doc_id"] == k]
        assert sum(p["length"] for p in mine) == mine[0]["doc_tokens"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)
