import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import line_templates, parity_join, passage_dedup, shared, spotsigs
from blockloom.llm.shared import Scratch, components

from .data import empty_documents, odd_documents, prose

# ---- components -----------------------------------------------------------------------------


def union(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(5, i) for i in range(200, 300)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(-3, -8), (7, 7)]
    found = components(spark, spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()
    want = {k: v for k, v in union([e for e in edges if e[0] != e[1]]).items()}
    assert {r.node: r.component for r in found} == want and len(found) == len(want)
    assert components(spark, spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "t")).collect() == []


@pytest.mark.parametrize("most", [shared.LOCAL_EDGES, -1])
def test_few_edges_and_many_have_the_same_components(spark, monkeypatch, most):
    """Few edges are joined without a shuffle: by three jobs at most, where each round of shuffles had several."""
    monkeypatch.setattr(shared, "LOCAL_EDGES", most)
    rng = random.Random(14)
    edges = [(i + 1, i) for i in range(400)] + [(rng.randint(-900, 9000), rng.randint(-900, 9000)) for _ in range(3000)] + [(-(1 << 63), (1 << 63) - 1)]
    scratch = Scratch(spark, "t")
    kept = scratch.keep(spark.createDataFrame(edges, "a bigint, b bigint"), "given")
    group = f"components-{most}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = components(spark, kept, scratch).collect()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert {r.node: r.component for r in found} == union([e for e in edges if e[0] != e[1]])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert jobs <= 3 if most > 0 else jobs > 10


def test_roots_hook_until_no_edge_crosses():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50, 3000):
        a, b = rng.integers(-n, n + 1, (2, n))
        node, to = shared.joined(a, b)
        want = union([*zip(a.tolist(), b.tolist()), *((x, x) for x in a.tolist())])
        assert dict(zip(node.tolist(), to.tolist())) == want


# ---- spot signatures --------------------------------------------------------------------------


def signatures(text):
    words = [""] + [w for w in re.split(r"[\W_]+", text.lower()) if w]
    out = set()
    for i, w in enumerate(words):
        if w == "" or w in spotsigs.ANCHORS:
            after = [x for x in words[i + 1 : i + 1 + spotsigs.REACH] if x not in spotsigs.ANCHORS]
            out.add((w, " ".join(after[: spotsigs.CHAIN])))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b)


def anchored(rng, n):
    return " ".join(rng.choice(["the", "of", "la", "und", "que"]) if rng.random() < 0.3 else w for w in prose(rng, n).split())


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(9)
    texts = [anchored(rng, rng.randint(1, 90)) for _ in range(40)] + ["", None, "x", anchored(rng, 20_000)]
    rows = [(i * 7, t, "clash") for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in spotsigs.fingerprint_edits(spark.createDataFrame(rows, "doc_id bigint, text string, sigs string")).collect()}
    ordered = sorted(rows, reverse=True)
    for i, (key, text, _) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = found[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.fingerprint) == 8 * len(signatures(text)) and len(r.edited_fingerprint) == 8 * len(signatures(edited))
        assert r.near_edited == pytest.approx(jaccard(signatures(text), signatures(edited)))
        assert r.near_next == pytest.approx(jaccard(signatures(text), signatures(after)))


def test_fingerprints_of_odd_rows(spark):
    docs = odd_documents(spark)
    found = spotsigs.fingerprint_edits(docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in docs.collect())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert spotsigs.fingerprint_edits(empty_documents(spark)).collect() == []
    one = spotsigs.fingerprint_edits(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(2)
    base = [sorted(rng.sample(range(-(10**6), 10**6), n)) for n in (3, 8, 20, 50)]
    sets = []
    for b in base:
        for _ in range(12):
            drop = set(rng.sample(b, rng.randint(0, max(1, len(b) // 5))))
            sets.append(sorted({*b} - drop | {rng.randint(0, 10**6) for _ in range(rng.randint(0, 2))}))
    sets += [[], sets[0], sets[5]]
    members, pairs = spotsigs.similar_pairs(spark.createDataFrame(list(enumerate(sets)), "id bigint, signatures array<int>"))
    named = {r.id: r.class_id for r in members.collect()}
    assert len(named) == len([s for s in sets if s])
    got = {(r.a, r.b) for r in pairs.collect()}
    want = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if sets[i] and sets[j]:
                if sets[i] == sets[j]:
                    assert named[i] == named[j]
                elif jaccard(set(sets[i]), set(sets[j])) >= 0.8:
                    want.add(tuple(sorted((named[i], named[j]))))
    assert got == want


# ---- parity sketches --------------------------------------------------------------------------


def word_sets(rows):
    out = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        out.append((r.doc_id, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute_components(sets):
    known = [(k, s) for k, s in sets if k is not None]
    edges = [(a, a) for a, _ in known]
    edges += [(a, b) for i, (a, s) in enumerate(known) for b, t in known[i + 1 :] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    return union(edges)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    tried = 0
    for _ in range(6000):
        n = int(rng.choice([4, 5, 6, 8, 9, 10, 12, 15, 20, 30, 50, 100, 300]))
        a = parity_join.mix(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.concatenate([a[int(rng.integers(0, n // 5 + 1)) :], parity_join.mix(rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64))])
        a, b = np.unique(a), np.unique(b)
        if parity_join.linked(a, b) and not np.array_equal(a, b):
            tried += 1
            assert set(parity_join.segment_keys(a).tolist()) & set(parity_join.segment_keys(b).tolist())
            assert set(parity_join.segment_keys(a, 16).tolist()) & set(parity_join.segment_keys(b, 16).tolist())
            assert 9 * parity_join.bits_apart(parity_join.whole_sketch(a), parity_join.whole_sketch(b)) <= len(a) + len(b)
    assert tried > 1000


def test_halves_never_contradict_whole_hashes():
    rng = np.random.default_rng(7)
    told = Counter()
    for _ in range(3000):
        n = int(rng.integers(1, 200))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        if rng.random() < 0.3:
            a[: n // 2] = (a[: n // 2] & np.uint64(0xFFFFFFFF)) | np.uint64(5 << 32)  # many of one half
        b = np.concatenate([a[int(rng.integers(0, n // 4 + 1)) :], rng.integers(0, 2**64, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        halves = [np.unique((x >> np.uint64(32)).astype(np.uint32)) for x in (a, b)]
        verdict = parity_join.judged(*halves, len(a), len(b))
        told[verdict] += 1
        assert not verdict or (verdict == 1) == parity_join.linked(a, b)
    assert min(told[1], told[-1], told[0]) > 50


@pytest.mark.parametrize("broadcast, small", [(parity_join.BROADCAST_IDS, 256), (0, 0)])
def test_similar_components_against_brute_force(spark, monkeypatch, broadcast, small):
    monkeypatch.setattr(parity_join, "BROADCAST_IDS", broadcast)
    monkeypatch.setattr(parity_join, "SMALL", small)
    monkeypatch.setattr(parity_join, "FOLLOWERS", 3)
    rng = random.Random(6)
    rows = odd_documents(spark).collect()
    texts = []
    for _ in range(6):
        base = prose(rng, rng.choice([4, 6, 12, 60, 200])).split()
        for _ in range(9):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 9))
            texts.append(" ".join(words[: len(words) - rng.randint(0, len(words) // 8)]))
    docs = spark.createDataFrame([tuple(r) for r in rows] + [(1000 + i, t, *([None] * 7)) for i, t in enumerate(texts)], odd_documents(spark).schema)
    sets = word_sets(docs.collect())
    want = brute_components(sets)
    found = parity_join.similar_components(docs).collect()
    assert sorted([(r.doc_id, r.n_shingles) for r in found], key=str) == sorted([(k, len(s)) for k, s in sets], key=str)
    assert {r.doc_id: r.component_id for r in found} == {**want, None: None}
    kept = parity_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    alone = Counter(r.doc_id for r in kept.collect())
    assert {k for k in alone if k is not None} == {c for c in want.values()} and alone[36] == 1


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_large_keys_are_split_and_lose_no_link(spark, monkeypatch, rounds):
    monkeypatch.setattr(parity_join, "PAIRED", 4)
    monkeypatch.setattr(parity_join, "ROUNDS", rounds)
    rng = random.Random(9)
    common = prose(rng, 60)
    texts = []
    for _ in range(40):  # all hold one passage; each has a near copy that others don't come near to
        own = prose(rng, rng.choice([20, 40, 60])).split()
        texts += [" ".join([common, *own]), " ".join([common, *own[1:]])]
    base = prose(rng, 70).split()
    texts += [" ".join([*base[:i], *(f"w{i}x{j}" for j in range(6)), *base[i:]]) for i in range(0, 60, 4)]  # like each other, not linked or just so
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in parity_join.similar_components(docs).collect()}
    assert found == brute_components(word_sets(docs.collect()))


def test_folded_sketches_lose_no_link():
    rng = np.random.default_rng(3)
    tried = 0
    for _ in range(3000):
        n = int(rng.choice([5, 31, 32, 64, 100, 127, 128, 300, 700]))
        a = parity_join.mix(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.concatenate([a[int(rng.integers(0, n // 5 + 1)) :], parity_join.mix(rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64))])
        a, b = np.unique(a), np.unique(b)
        if parity_join.linked(a, b):
            tried += 1
            assert 9 * parity_join.bits_apart(*(parity_join.folded_sketch(parity_join.whole_sketch(x)) for x in (a, b))) <= len(a) + len(b)
    assert tried > 500


def test_chance_meetings_send_no_whole_sketches(spark, monkeypatch):
    """Texts that share one short passage meet in its keys; their whole sketches stay where they are."""
    rows = Counter()
    keep = shared.Scratch.keep

    def counted(self, df, label):
        kept = keep(self, df, label)
        rows[label, "sketch" in df.columns] += kept.count()
        return kept

    monkeypatch.setattr(shared.Scratch, "keep", counted)
    rng = random.Random(11)
    common = prose(rng, 14)
    texts = [f"{common} {prose(rng, 55)}" for _ in range(200)]
    texts += [texts[0] + " end", texts[0] + " other end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in parity_join.similar_components(docs).collect()}
    assert found == {i: 0 if i >= 200 else i for i in range(202)}
    assert rows["met", False] > 100 and rows["apart", False] > 50 and rows["apart", True] < 10


def test_pairs_are_dealt_alike_on_the_driver_and_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "FOLLOWERS", 3)
    rng = random.Random(21)
    pairs = sorted({(a, b) for a, b in ((rng.choice([2, 4, rng.randint(0, 40)]) * 2, 100 + 2 * rng.randint(0, 60)) for _ in range(200))})
    close = spark.createDataFrame([(a, b, a + 1, b + 1, 7 * a, 7 * b) for a, b in pairs], ", ".join(f"{n} bigint" for n in parity_join.PAIRS.names))
    reps, wanted = parity_join._dealt(*(c.to_numpy() for c in close.toArrow().columns))
    reps_by_tasks, wanted_by_tasks = parity_join._Verifier(close, close, None)._dealt_by_tasks(close)
    assert set(reps["doc_id"].tolist()) == {r.doc_id for r in reps_by_tasks.collect()}
    rows = list(zip(*(wanted[n].tolist() for n in ("a", "salt", "lead", "node", "n"))))
    told = [tuple(r) for r in wanted_by_tasks.collect()]
    followers = lambda rows: sorted((a, node, n) for a, _, lead, node, n in rows if not lead)
    leaders = lambda rows: sorted((a, salt, n) for a, salt, lead, node, n in rows if lead and a == node)
    assert followers(rows) == followers(told) == [(a, b, 7 * b) for a, b in pairs] and leaders(rows) == leaders(told)
    assert {r[:2] for r in rows if not r[2]} <= {r[:2] for r in rows if r[2]} and len(rows) == len(told)


def test_few_sketches_are_broadcast_with_the_same_result(spark, monkeypatch):
    """Large keys, repeated rows and edits: components don't depend on how sketches travel, and few make fewer tables."""
    monkeypatch.setattr(parity_join, "PAIRED", 8)
    rng, made = random.Random(23), Counter()
    keep = shared.Scratch.keep

    def counted(self, df, label):
        made[few] += 1
        return keep(self, df, label)

    monkeypatch.setattr(shared.Scratch, "keep", counted)
    common, texts = prose(rng, 40), []
    for _ in range(30):
        own = prose(rng, rng.choice([20, 60])).split()
        texts += [" ".join([common, *own]), " ".join([common, *own[1:]])]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (3, texts[9])], "doc_id bigint, text string")
    found = {}
    for few in (0, 1 << 20):
        rows = parity_join._classes(docs, "doc_id", "text", rounds=0, few=few).collect()
        found[few] = sorted((r.doc_id, r.n_shingles, r.node, r.component_id) for r in rows)
    assert found[0] == found[1 << 20] and len(found[0]) == 62 and len({r[3] for r in found[0]}) == 30  # one a pair; that of texts 8 and 9 has the least key 3
    assert made[1 << 20] <= made[0] - 3


def test_rows_of_one_key_go_by_their_own_texts(spark):
    rng = random.Random(4)
    a, b, c = (prose(rng, 50) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, b), (5, b + " more"), (7, "\t"), (7, "\t"), (7, None), (9, c), (None, a)]
    kept = parity_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    left = Counter((r.doc_id, r.text) for r in kept)
    assert left[(1, a)] == left[(9, c)] == left[(None, a)] == left[(7, None)] == 1 and left[(7, "\t")] == 2
    assert (5, a) not in left and left[(5, b)] == 1 and left[(5, b + " more")] == 1


def test_similar_components_of_nothing(spark):
    assert parity_join.similar_components(empty_documents(spark)).collect() == []


def test_meeting_rows_across_batches():
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((rng.randint(0, 60), 2 * rng.randint(0, 6) | (rng.random() < 0.1)) for _ in range(200))
    nodes, flags = defaultdict(set), defaultdict(bool)
    for k, n in rows:
        nodes[k].add(n & ~1)
        flags[k] |= bool(n & 1)
    for cut in (1, 3, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + cut]]), pa.array([n for _, n in rows[i : i + cut]])], names=["key", "node"]) for i in range(0, 200, cut)]
        found = [tuple(r.values()) for b in parity_join._meet(iter(batches)) for r in b.to_pylist()]
        assert {r[:3] for r in found} == {(k, n, min(ns)) for k, ns in nodes.items() if len(ns) > 1 for n in ns}
        for k in {r[0] for r in found}:
            if len(nodes[k]) > 2 or flags[k]:
                # Whoever the batches' cuts may hide, every node has a row that says so, or all but a leader told before.
                assert {n for kk, n, _, many in found if kk == k and many} | {min(nodes[k])} == nodes[k]


def test_keys_are_combined_before_the_shuffle():
    keys = [np.array(k, np.int64) for k in ([1, 5, 9], [5, 7], [], [5, 9])]
    sends, led, leaders = parity_join._combined(keys, [10, 20, 30, 40])
    assert [k.tolist() for k, _ in sends] == [[1, 5, 9], [7], [], []] and [f.tolist() for _, f in sends] == [[False, True, True], [False], [], []]
    assert [x.tolist() for x in led] == [[5, 9], [5], [], [5, 9]] and [x.tolist() for x in leaders] == [[10, 10], [10], [], [10, 10]]
    assert [len(k) for k, _ in parity_join._combined([np.zeros(0, np.int64)], [1])[0]] == [0]


# ---- line templates ---------------------------------------------------------------------------


def line_documents(spark):
    rng = random.Random(8)
    rows = []
    for i in range(30):
        lines = [prose(rng, 12) for _ in range(4)]
        lines.insert(2, "Click here to subscribe today")
        lines.insert(0, f"Posted on {i} May by user{i} at {i}:00")
        lines.append(f"All rights reserved worldwide by {['Acme', 'Blue', 'Corn'][i % 3]} company and partners")
        rows.append((i, "\n".join(lines)))
    copy = "\n".join(prose(rng, 12) for _ in range(6))
    rows += [(100 + i, copy) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "\n\n \n"), (203, "7\n8"), (204, "9")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("broadcast", [shared.BROADCAST_BYTES, -1])
def test_recurring_lines_go_and_copies_stay(spark, monkeypatch, broadcast):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", broadcast)
    docs = line_documents(spark)
    found = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert found[0].text == before[0] and found[0].n_dropped == 0
    for i in range(1, 30):
        lines = before[i].split("\n")
        assert found[i].text == "\n".join(lines[1:3] + lines[4:6]), i
        assert (found[i].n_lines, found[i].n_dropped) == (7, 3)
    for i in [*range(100, 120), 200, 201, 202, 203, 204]:
        assert found[i].text == before[i] and found[i].n_dropped == 0


def test_lines_against_sql(spark):
    import duckdb

    docs = line_documents(spark)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(f"SELECT doc_id, n_lines, n_dropped, clean_text FROM ({line_templates.OP3_SQL})").fetchall()
    found = line_templates.drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_lines_that_recur_together_go(spark):
    rng = random.Random(12)
    rows, dropped = [], {}
    for k, own in ((1, 5), (6, 1), (20, 1), (20, 5)):
        block = [prose(rng, 8) for _ in range(k)]
        for i in range(40):
            rows.append((len(rows), "\n".join([*block[: k // 2], *(prose(rng, 9) for _ in range(own)), *block[k // 2 :]])))
            dropped[rows[-1][0]] = k if i else 0
    found = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_dropped for r in found} == dropped


def test_copies_keep_their_lines_and_protect_no_boilerplate(spark):
    rng = random.Random(13)
    rows = []
    base = [prose(rng, 14) for _ in range(9)]
    for i in range(150):  # copies, most with edited words, of a document that holds a line which others hold too
        words = [line.split() for line in base]
        for _ in range(i % 3):
            line = rng.choice(words)
            line[rng.randrange(len(line))] = "edit" + rng.choice("abcdefghijk") * rng.randint(1, 4)
        rows.append((i, "\n".join([" ".join(w) for w in words] + ["Terms and conditions apply to all"])))
    for i in range(8):
        rows.append((200 + i, "\n".join([prose(rng, 9), "Terms and conditions apply to all", prose(rng, 9)])))
        rows.append((300 + i, "\n".join([prose(rng, 9), f"{rng.choice('abcdefgh') * (i + 1)} has written this for the daily", "2024 11 05", prose(rng, 9)])))
    rows += [(400 + i, "\n".join(["one line that four documents share", prose(rng, 9)])) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs).collect()}
    before = dict(rows)
    for i in range(150):
        assert found[i].text.split("\n")[:9] == before[i].split("\n")[:9] and found[i].n_dropped == (i > 0)
    for i in range(8):
        assert found[200 + i].n_dropped == 1 and found[300 + i].n_dropped == (2 if i else 0)
    assert all(found[400 + i].n_dropped == 0 for i in range(4))
    again = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring_lines(docs, contexts=4).collect()}
    assert [again[400 + i] for i in range(4)] == [0, 1, 1, 1]


def test_lines_of_odd_rows(spark):
    docs = odd_documents(spark)
    cut = line_templates.drop_recurring_lines(docs)
    assert cut.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted(map(str, cut.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert line_templates.drop_recurring_lines(empty_documents(spark)).collect() == []


# ---- passages ---------------------------------------------------------------------------------


def test_passages_are_caught_and_clean_texts_left(spark):
    rng = random.Random(11)
    passage = prose(rng, 51)
    rows, planted = [], set()
    for i in range(300):
        words = prose(rng, 150).split()
        if i % 3 == 0:
            at = rng.randint(0, 150)
            words[at:at] = passage.split()
            planted.add(i)
        if i % 4 == 0:
            words[10:10] = "a short line that many texts share and that is no passage".split()
        rows.append((i, " ".join(words)))
    found = passage_dedup.passage_spans(passage_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    got = {r.doc_id for r in found}
    assert got <= planted and len(got) >= 0.97 * len(planted)
    cut = {r.doc_id: r.text for r in passage_dedup.cut_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    middle = " ".join(passage.split()[20:30])
    assert sum(middle in t for t in cut.values()) <= 3
    assert all(cut[i] == t for i, t in rows if i not in planted)


def test_edited_passages_are_likened(spark):
    """A word changed in a long passage: paragraphs apart from it are equal, and those with it alike."""
    rng = random.Random(12)
    passage = prose(rng, 200).split()
    rows = []
    for i in range(40):
        mine = list(passage)
        mine[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join([prose(rng, 60), *mine, prose(rng, 60)])))
    found = passage_dedup.passage_spans(passage_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    assert len(found) == 40
    assert sum(sum(s.end_word - s.first_word for s in r.removed) for r in found if r.doc_id) >= 39 * 150


@pytest.mark.parametrize("broadcast", [passage_dedup.BROADCAST_ROWS, 0])
def test_passages_of_odd_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(passage_dedup, "BROADCAST_ROWS", broadcast)
    docs = odd_documents(spark)
    cut = passage_dedup.cut_passages(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    found = {r.doc for r in passage_dedup.repeated_paragraphs(docs).collect()}
    assert found == {36, 39, 42, 45, 48}  # the base text, its copies and edits
    assert passage_dedup.repeated_paragraphs(empty_documents(spark)).collect() == []


def test_colliding_rows_across_batches():
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted((rng.randint(0, 30), rng.randint(0, 5), rng.randint(0, 3), rng.randint(0, 9) << 32) for _ in range(240))
    want = None
    for cut in (240, 1, 4, 50):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + cut]]) for c in range(4)], schema=passage_dedup.ROWS) for i in range(0, 240, cut)]
        rows_found = [tuple(r.values()) for b in passage_dedup._collide(iter(batches)) for r in b.to_pylist()]
        found = Counter(x[:3] for x in rows_found)
        contents = defaultdict(set)
        for key, _, content, _ in rows:
            contents[key].add(content)
        told = {x[0] for x in rows_found if x[3]}
        assert all(cs <= told for key, cs in contents.items() if len(cs) > 1 and len({d for k, d, _, _ in rows if k == key}) > 1)
        want = want or found
        assert found == want
    docs = defaultdict(set)
    for key, doc, _, _ in rows:
        docs[key].add(doc)
    assert sum(want.values()) == sum(len(docs[r[0]]) > 1 for r in rows)


def test_all_paragraphs_of_a_key_are_compared(spark):
    """Against all pairs of the paragraphs that meet another document's: also those whose key's first document is like neither."""
    rng = random.Random(21)
    phrases, passages, loop = [prose(rng, 14) for _ in range(4)], [prose(rng, 30) for _ in range(6)], "ab cd ab cd ab ef "
    rows = []
    for i in range(160):
        words = [prose(rng, 25), rng.choice(phrases), prose(rng, 20), rng.choice(passages), prose(rng, 25)]
        if i % 5 == 0:
            words += [loop * rng.randint(5, 8), rng.choice(["x", "y"]) * 3, prose(rng, 10)]
        rows.append((rng.randint(0, 9) * 1000 + i, " ".join(words)))
    met, sets = defaultdict(set), {}
    for doc, text in rows:
        _, s = passage_dedup.ordered_shingles(text)
        for key, _, content, p in zip(*(x.tolist() for x in passage_dedup.paragraphs([text]))):
            if p < 1 << 32:
                sets[content] = frozenset(s[p : p + passage_dedup.SHINGLES].tolist())
                met[key].add((doc, p, content))
    found = {r for rs in met.values() if len({d for d, _, _ in rs}) > 1 for r in rs}
    nodes = sorted({c for _, _, c in found})
    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if jaccard(sets[a], sets[b]) >= 0.8]
    place = union([*pairs, *((n, n) for n in nodes)])
    groups = defaultdict(set)
    for doc, p, c in found:
        groups[place[c]].add((doc, p))
    want = {frozenset(g) for g in groups.values() if len({d for d, _ in g}) > 1}
    got = defaultdict(set)
    for r in passage_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        if r.place < 1 << 32:
            got[r.component].add((r.doc, r.place))
    assert {frozenset(g) for g in got.values()} == want


def test_each_long_run_opens_a_window():
    rng = random.Random(31)
    for _ in range(200):
        run = prose(rng, 51).split()
        opened = []
        for _ in range(2):
            before = prose(rng, rng.randint(0, 60)).split()
            text = " ".join([*before, *run, *prose(rng, rng.randint(0, 60)).split()])
            _, _, content, place = passage_dedup.paragraphs([text])
            opened.append({c for c, p in zip(content.tolist(), place.tolist()) if 0 <= p - len(before) <= len(run) - passage_dedup.LENGTH})
        assert opened[0] & opened[1]
    together = [prose(rng, n) + "\n" + prose(rng, 40) for n in (0, 3, 40, 31, 200)] + [None, ""]
    apart = [(i, *row) for i, t in enumerate(together) for row in zip(*(x.tolist() for j, x in enumerate(passage_dedup.paragraphs([t])) if j != 1))]
    keys, of, content, place = passage_dedup.paragraphs(together)
    assert sorted(apart) == sorted(zip(of.tolist(), keys.tolist(), content.tolist(), place.tolist()))


def test_recall_of_windows_against_all_pairs():
    """Windows of one run of words that are alike but not equal: how many pairs meet in a band."""
    rng, met, tried = random.Random(33), 0, 0
    for _ in range(150):
        run = prose(rng, passage_dedup.LENGTH - rng.randint(0, 3)).split()
        seen = []
        for _ in range(6):
            text = " ".join([*prose(rng, rng.randint(0, 3)).split(), *run, *prose(rng, 3).split()][: passage_dedup.LENGTH])
            keys, *_ = passage_dedup.paragraphs([text])
            _, s = passage_dedup.ordered_shingles(text)
            if len(s) == passage_dedup.SHINGLES:
                seen.append((set(keys[: passage_dedup.BANDS].tolist()), set(s.tolist())))
        for i, (a, x) in enumerate(seen):
            for b, y in seen[:i]:
                if x != y and jaccard(x, y) >= 0.8:
                    tried, met = tried + 1, met + bool(a & b)
    assert tried > 300 and met >= 0.9 * tried


def test_edited_lines_are_linked_like_all_pairs(spark):
    """Recall of links between lines of different documents, against all pairs; no component joins what all pairs keep apart."""
    rng = random.Random(32)
    bases, rows = [prose(rng, rng.randint(40, 90)).split() for _ in range(40)], []
    for i in range(200):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["new"], [words[at], "more"]])
        rows.append((i, "\n".join([prose(rng, 9), " ".join(words), prose(rng, 50)])))
    lines = {i: word_sets([type("Row", (), {"doc_id": i, "text": t.split("\n")[1]})])[0][1] for i, t in rows}
    want = {(a, b) for a in lines for b in range(a) if jaccard(lines[a], lines[b]) >= 0.8}
    group = union([*want, *((i, i) for i in lines)])
    of = {}
    for r in passage_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        if r.place >> 32 and 0 < r.place & 0xFFFFFFFF < 12:
            of[r.doc] = r.component
    assert sum(of.get(a) == of.get(b) is not None for a, b in want) >= 0.95 * len(want) > 90
    apart = defaultdict(set)
    for doc, component in of.items():
        apart[component].add(group[doc])
    assert all(len(g) == 1 for g in apart.values())


def test_plain_paragraphs_are_linked_by_runs():
    rng = random.Random(22)
    near = 0
    for _ in range(20_000):
        n = rng.choice([8, 20, 60, 400])
        words = [rng.randrange(n) for _ in range(60)]
        other = list(words)
        for _ in range(rng.randint(0, 2)):
            at, to, size = rng.randrange(60), rng.randrange(60), rng.randint(0, 4)
            other[at : at + rng.randint(0, 4)] = words[to : to + size]
        k = rng.randint(7, 13)
        a, b = (np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in (words[10:42], (other + words)[k : k + 32]))
        if not passage_dedup.plain(np.stack([a, b])).all():
            continue
        s = [np.array([hash(tuple(x[i : i + passage_dedup.WORDS])) & (1 << 63) - 1 for i in range(passage_dedup.SHINGLES)], np.uint64) for x in (a.tolist(), b.tolist())]
        likeness = jaccard(set(s[0].tolist()), set(s[1].tolist()))
        ra, rb = passage_dedup.runs(np.stack(s)).tolist()
        assert bool(set(ra) & set(rb)) == (likeness >= 0.8), (words, other)
        near += 0.8 <= likeness < 1
    assert near > 100


def test_spans_merge():
    assert passage_dedup.merged_spans([(0, 5, 9), (10, 4, 8), (42, 6, 7), (90, 1, 1)]) == [(0, 74, 4, 7), (90, 122, 1, 1)]
    assert passage_dedup.merged_spans([]) == []
