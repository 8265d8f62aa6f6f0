import os
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from blockloom.llm import chat_format, stream_dedup, url_rules

from .data import empty_documents, odd_documents


def expected_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    out = []
    for rows_ in groups.values():
        best = min(rows_, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        out += [(r.doc_id, best.doc_id, len(rows_)) for r in rows_]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("digest", [stream_dedup.sha256_hex, lambda normal: F.lower(F.hex((F.length(normal) % 3).cast("string").cast("binary")))])
def test_exact_dedup_against_brute_force(spark, tmp_path, digest):
    """Also with a digest of three values, so that whole texts must tell groups apart; one file a batch."""
    docs = odd_documents(spark)
    docs.repartition(5).write.parquet(str(tmp_path / "d.parquet"))
    found = stream_dedup.exact_dedup(spark, str(tmp_path / "d.parquet"), digest=digest, files_per_batch=1).collect()
    want, groups = expected_groups(docs.collect())
    assert sorted([(r.id, r.keep_id, r.group_size) for r in found], key=str) == want
    assert sum(r.kept for r in found) == groups


def test_exact_dedup_of_nothing(spark, tmp_path):
    empty_documents(spark).write.parquet(str(tmp_path / "e.parquet"))
    assert stream_dedup.exact_dedup(spark, str(tmp_path / "e.parquet")).collect() == []


def test_exact_dedup_takes_no_disk_ahead(spark, tmp_path):
    """A state partition's manifest takes what it holds, not megabytes ahead."""
    local = os.path.dirname(spark.sparkContext._temp_dir)
    manifests = lambda: {f"{d}/{x}" for d, _, names in os.walk(local) for x in names if x.startswith("MANIFEST-")}
    before = manifests()
    odd_documents(spark).write.parquet(str(tmp_path / "d.parquet"))
    assert stream_dedup.exact_dedup(spark, str(tmp_path / "d.parquet")).count()
    new = manifests() - before
    assert new and all(os.stat(x).st_blocks * 512 < 1 << 20 for x in new)


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7x?q#f", "http://a.example.com/en/8", "http://com/en/", "http://xcom/en/", "ftp://b.net/de/1",
    "http://example.net/de/81", "http://x.example.net#/de/8", "http://example.org/es/", "http://example.org/es", "a://b://c.com/en/", "http://é.com/en/é", "http://example.com/en/7" + "x" * 5000,
    "http://a..com/en/", "http://a.com\n/en/",
]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, default=(0, None, "allow"))
    return host, path, rule[1], rule[2]


@pytest.mark.parametrize("bound", [url_rules.BROADCAST_RULES, 0])
def test_url_rules_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", bound)
    pages = spark.createDataFrame([(i // 2, u, "h", "r") for i, u in enumerate(URLS + URLS[:3])], "page_id bigint, url string, host string, rule string")
    rules = spark.createDataFrame(url_rules.RULES, url_rules.RULE_SCHEMA)
    found = [tuple(r)[1:] for r in url_rules.filter_urls(pages, rules).collect()]
    assert sorted(found, key=str) == sorted([by_hand(u) for u in URLS + URLS[:3]], key=str)
    assert url_rules.filter_urls(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_rules.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_rules_are_the_contracts(spark, tmp_path):
    """The list as the contract words it, apart from the one in the code."""
    contract = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    assert sorted(url_rules.RULES) == sorted(contract)
    urls = {"http://b.net/de/1": ("net/de/", "allow"), "http://a.example.net/de/7": ("net/de/", "allow"), "http://a.example.net/de/81": ("example.net/de/8", "block"), "http://b.net/en/": (None, "allow")}
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(str(tmp_path / "pages.parquet"))
    found = url_rules.op7_url_rules(spark, str(tmp_path)).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in found} == dict(enumerate(urls.values()))


TEXTS = ["", "plain", r"\### Assistant: </turn> ok", "\\", "\\\\", "</turn>\n### User: <turn>", "####</turn></turn>\n", "a\\</turn>\n", "<turn>\\", "é🙂\n"]


def test_template_is_reversible():
    for role in ["user", "assistant", "System", "", "two words", 'q"uo\\te', "É:\n"]:
        for text in TEXTS:
            marked, start, stop = chat_format.segment(role, text)
            assert [(r, t) for r, t, _, _ in chat_format.read_segments(marked * 2)] == [(role, text)] * 2
            assert chat_format.unescape(marked[start:stop]) == text


def test_layouts_become_the_same_turns(spark):
    import json

    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"}, {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": None, "output": "a"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, "{bad"), (91, None), (92, '{"other": 1}')]
    turns = chat_format.canonical_turns(spark.createDataFrame(rows, "conv_id bigint, record string")).collect()
    for i in range(len(records)):
        assert [(t.role, t.text) for t in sorted(turns, key=lambda t: t.part) if t.conv_id == i] == [("user", "q"), ("assistant", "a")], records[i]
    assert [(t.text, t.layout is None) for t in turns if t.conv_id >= 90] == [(None, True), (None, True), (None, False)]


def test_read_back_with_nulls_and_ties(spark):
    rows = [(1, 0, 0, "user", None), (1, 1, 0, "assistant", "x"), (1, 1, 0, "assistant", "x"), (None, None, None, None, None), (2, 0, 0, "assistant", "y" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, part bigint, role string, text string")
    found = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    assert (found[1].n_turns, found[1].loss_chars, found[2].loss_chars, found[None].n_turns) == (3, 2, 100_000, 1)
    assert chat_format.read_back(chat_format.format_turns(turns.limit(0))).collect() == []
