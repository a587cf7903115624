"""The whole pipeline against brute force, stage by stage."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from meterline.llm import op3_secrets
from meterline.llm.tables import Run
from tests.llm.test_corpus_operators import VOCAB, brute_components, brute_leaks, prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Texts and labels; toxic ones hold a word that no other text has."""
    rng = random.Random(21)
    items = [(i, " ".join(f"q{i}x{rng.choice(VOCAB)}" for _ in range(25))) for i in range(4)]
    texts, toxic = [], set()
    for i in range(260):
        own = prose(rng, rng.randrange(30, 90))
        if i % 5 == 1:
            own[rng.randrange(len(own))] = rng.choice(["vileword", "awfulword"])
            toxic.add(i)
        if i % 20 == 2:
            own[10:10] = rng.choice(items)[1].split()
        if i % 20 == 3:
            own[5:5] = ["token=abcdefgh1234"]
        if i % 20 == 4 and i > 20:
            own = texts[i - 20].split()
            own[3] = "changed"
        texts.append(" ".join(own))
    texts += [None, "", "one two"]
    return texts, toxic, items


def test_pipeline_matches_brute_force(spark, tmp_path):
    texts, toxic, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "encode"]
    stages, frame = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns, name
        stages.append({r["doc_id"]: r["text"] for r in frame.collect()})

    want = {i: t for i, t in enumerate(texts) if i not in toxic}
    assert stages[0] == want
    parts = brute_components(list(want.items()), n=5)
    want = {i: t for i, t in want.items() if parts[i][1] == i}
    assert len(want) < len(stages[0]) and stages[1] == want
    leaks = {d for d, _ in brute_leaks([(i, t or "") for i, t in want.items()], items)}
    want = {i: t for i, t in want.items() if i not in leaks}
    assert leaks and stages[2] == want
    want = {i: t if t is None else t.replace("token=abcdefgh1234", "[SECRET]") for i, t in want.items()}
    assert stages[3] == want and any("[SECRET]" in (t or "") for t in want.values())
    assert not any(op3_secrets.scan(t or "") for t in stages[3].values())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for i, text in want.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_pass_texts_to_python_in_batches_of_2_mb(spark, tmp_path, monkeypatch):
    """Larger ones, held several times over outside the heap, took an executor's memory over its limit in the last stage."""
    texts, toxic, items = corpus()
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts[:90])], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, seen, keep = "spark.sql.execution.arrow.maxBytesPerBatch", set(), Run.keep
    monkeypatch.setattr(Run, "keep", lambda self, df: (seen.add((self.folder.rsplit("/", 1)[1].rsplit("-", 1)[0], spark.conf.get(name))), keep(self, df))[1])
    for step, stage in corpus_pipeline.STAGES:
        if step != "decontaminate":  # no Python there
            stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert seen == {(k, str(2 << 20)) for k in ("labelled", "toxicity", "minhash", "minhash-kept", "secrets", "bpe")}
