import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as vocab
from tokenizers import Tokenizer

import corpus_pipeline
from blockloom.llm import queries, toxicity_fm
from blockloom.llm.shared import Scratch

from .data import empty_documents, odd_documents, prose


def labelled(spark, n=900):
    """Toxic: an insult, or a mild word together with a group's name; either of these alone is clean."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 60)).split()
        kind = rng.randrange(8)
        words += {0: ["zzinsult"], 1: ["mild", "groupname"], 2: ["mild"], 3: ["groupname"]}.get(kind, [])
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(kind in (0, 1))))
    labels += [(0, 1, None), (None, 1, 1), (5, 1, labels[5][2])]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_with_interactions(spark):
    docs, labels = labelled(spark)
    model = toxicity_fm.train(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity_fm.score(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id is not None}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scores[i] >= 0.5) == truth[i] for i in out]) > 0.97
    assert model.factors.shape[1] == toxicity_fm.FACTORS


def test_pairs_that_weights_alone_miss():
    """Label: exactly one of two kinds of words. Each kind tells nothing by itself."""

    def made(n, seed):
        rng, texts, labels = random.Random(seed), [], []
        noise = [prose(random.Random(i), 1) for i in range(2500)]
        for _ in range(n):
            words, a, b = [rng.choice(noise) for _ in range(40)], rng.random() < 0.5, rng.random() < 0.5
            words += [rng.choice(["qwerty", "zuxval", "yopfem"])] * a + [rng.choice(["hexxam", "wixtor", "rovnel"])] * b
            rng.shuffle(words)
            texts.append(" ".join(words))
            labels.append(int(a != b))
        return texts, np.array(labels)

    texts, labels = made(3000, 1)
    model = toxicity_fm.fit([toxicity_fm.places_of(t) for t in texts], labels)
    tests, truth = made(1000, 2)
    assert np.mean([(model.score(t) >= 0.5) == v for t, v in zip(tests, truth)]) > 0.95
    alone = toxicity_fm.Model(model.bias, model.places, model.weights, np.zeros_like(model.factors))
    assert np.mean([(alone.score(t) >= 0.5) == v for t, v in zip(tests, truth)]) < 0.7
    for t in tests[:50]:  # the score is that of the plain double sum
        active = np.flatnonzero(np.isin(model.places, toxicity_fm.places_of(t)))
        margin = model.bias + sum(model.weights[i] for i in active) + sum(model.factors[i] @ model.factors[j] for i in active for j in active if i < j)
        assert abs(model.score(t) - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))) < 1e-9


def test_whole_words_and_long_runs_count():
    run = "".join(chr(0x4E00 + i) for i in range(40))
    a, b = toxicity_fm.places_of(run + "甲乙丙"), toxicity_fm.places_of(run + "丁戊己")
    assert len(np.intersect1d(a, b)) > 30 and len(np.setdiff1d(a, b)) >= 3 and len(np.setdiff1d(b, a)) >= 3
    rng = random.Random(2)
    bad = ["".join(chr(0x4E00 + rng.randrange(300)) for _ in range(40)) + "坏人坏" * (i % 2) + "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(20)) for i in range(600)]
    model = toxicity_fm.fit([toxicity_fm.places_of(t) for t in bad], np.arange(600) % 2)
    assert model.score(run + "坏人坏") > 0.8 > 0.2 > model.score(run + "天地玄")


def test_odd_rows_and_no_labels(spark):
    docs = odd_documents(spark)
    none = toxicity_fm.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    found = toxicity_fm.score(docs, none).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in docs.collect())
    assert len({r.score for r in found}) == 1 and 0 < found[0].score < 1
    kept = toxicity_fm.keep_clean(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity_fm.score(empty_documents(spark), none).collect() == []
    marked = docs.select("doc_id", toxicity_fm.held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in marked)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Toxic rows go, each group of near copies keeps one, passages are cut, and every id that is left is packed once."""
    rng = random.Random(5)
    docs, labels = labelled(spark, 300)
    rows = [tuple(r) for r in docs.collect()]
    copy, passage = prose(rng, 90), prose(rng, 70)
    rows += [(1000 + i, copy) for i in range(12)] + [(1100 + i, copy + f" tail{i}") for i in range(5)]
    rows += [(1200 + i, " ".join([prose(rng, 80), passage, prose(rng, 80)])) for i in range(10)] + [(1300, ""), (1301, None)]
    full = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    scratch = Scratch(spark, "test")
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        at = scratch.keep(stage(spark, at, str(tmp_path)), name)
        seen[name] = at
    for name in list(seen)[:-1]:
        assert tuple(seen[name].columns) == corpus_pipeline.COLUMNS
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    toxic = {r.doc_id for r in labels.collect() if r.toxic}
    clean = {i for i, _ in rows} - toxic
    assert len(clean - ids["toxicity"]) <= 3 and len(toxic & ids["toxicity"]) <= 0.2 * len(toxic)
    assert ids["line_dedup"] == ids["toxicity"]
    assert ids["toxicity"] - ids["near_duplicates"] == {*range(1001, 1012), *range(1100, 1105)}
    assert ids["substring_dedup"] == ids["near_duplicates"] == ids["packing"]
    texts = {r.doc_id: r.text for r in seen["substring_dedup"].collect()}
    assert sum(" ".join(passage.split()[25:45]) in (t or "") for t in texts.values()) == 1
    slow = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    packed = Counter()
    for r in seen["packing"].collect():
        packed[r.doc_id] += r.length
    assert packed == {i: len(slow.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, seen["packing"].collect()))


def test_stages_begin_without_heap_of_others(spark):
    """Each stage begins with full collections, a task for each core, so the heap of the stage before is no load on it."""
    beans = spark._jvm.java.lang.management.ManagementFactory

    def full() -> int:
        return sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Young" not in b.getName() and "Concurrent" not in b.getName())

    docs = empty_documents(spark)
    for name, stage in corpus_pipeline.STAGES[-1:] + corpus_pipeline.STAGES[1:2]:
        before = full()
        stage(spark, docs, "")
        assert full() > before, name


def test_all_are_registered():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
    assert set(queries.oracles()) <= names
