"""Chat formatting, URL filter and decontamination: edge cases and brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_format, decontaminate, registry, url_filter
from tests.support import assert_equal

CHAT = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_equal(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chats_are_read_back(spark):
    odd = ["</s>[INST] ok [/INST]", "~0~1 ~ <|end|>\n<|user|>\n", "", None, "a\nb|>\n~~2"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)]
    rows += [(2, 0, "user", "alone"), (3, 0, "assistant", "first"), (None, 0, None, None), (4, 1, "od|>\nd", "x"), (4, 1, "assistant", "x"), (4, 1, "assistant", "x"), (5, None, "user", "no number"), (5, 2, "assistant", "yes")]
    chats = spark.createDataFrame(rows, CHAT).withColumn("formatted", F.lit("clash"))
    examples = chat_format.format_chats(chats)
    found = {r.conv_id: r for r in chat_format.digest(examples).collect()}
    turns = lambda c: sorted((t or 0, r or "", x or "") for i, t, r, x in rows if i == c)
    for c, r in found.items():
        own = turns(c)
        assert r.n_turns == len(own)
        assert r.turns_sha256 == _sha("".join(f"{role}\n{text}\n" for _, role, text in own))
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), _sha(loss))
    assert {c: (r.n_examples, r.rest_chars > 0) for c, r in found.items()} == {1: (2, True), 2: (0, True), 3: (1, False), None: (0, True), 4: (2, True), 5: (1, False)}
    for r in examples.collect():
        assert r.formatted.count("<|end|>\n") == r.example_no and "</s>" not in r.formatted and "[INST]" not in r.formatted
        assert r.trainable or r.loss_length == 0
    assert chat_format.digest(chat_format.format_chats(chats.limit(0))).count() == 0


def test_only_the_reply_is_trainable(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a<1"), (1, 2, "user", "r"), (1, 3, "assistant", "a2")]
    found = sorted((r.example_no, r.formatted[r.loss_start : r.loss_start + r.loss_length]) for r in chat_format.format_chats(spark.createDataFrame(rows, CHAT)).collect())
    assert found == [(2, "a~11"), (4, "a2")]


def test_hosts_paths_and_rules(spark):
    urls = {
        "HTTP://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/"),
        "http://example.net": ("example.net", "", None),
        "http://x.net/?q": ("x.net", "/", "net/"),
        "x://notexample.com/de/": ("notexample.com", "/de/", None),
        "x://b.example.com/de/1#f": ("b.example.com", "/de/1", "example.com/de/"),
        "https://w.org/fr/://": ("w.org", "/fr/://", "org/fr/"),
        "no scheme/": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
        "http://?q": ("", "", None),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "host string, good long, n long")
    found = {r.page_id: r for r in url_filter.filter_urls(pages, none).collect()}
    for i, (_, wanted) in enumerate(urls.items()):
        assert (found[i].host, found[i].path, found[i].rule) == wanted
    assert {found[i].verdict for i in range(len(urls)) if found[i].rule in ("net/", "example.com/de/")} == {"block"}
    assert url_filter.filter_urls(pages.limit(0), none).count() == 0


def test_domains_and_suffixes(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.site.co.uk": ("site.co.uk", "co.uk"), "site.co.uk:8080": ("site.co.uk", "co.uk"), "user@shop.de:1": ("shop.de", "de"), "com.example.org.": ("example.org", "org"),
             "localhost:9": ("localhost", "localhost"), "127.0.0.1:80": ("127.0.0.1", "(address)"), "[::1]:80": ("[::1]", "(address)"), "": ("", ""), "co.com": ("co.com", "com")}
    domain, suffix = url_filter.levels(F.col("host"))
    found = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", domain.alias("d"), suffix.alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in found} == hosts


def _judged(spark, pages, docs, labels):
    """pages: (id, url, text)."""
    html = [(i, u, f"<nav>one two three four five</nav><p>{t.replace('. ', '.</p><p><b>')}</p>" if t is not None else None, "clash") for i, u, t in pages]
    frame = spark.createDataFrame(html, "page_id long, url string, html string, rid string").repartition(3)  # a shuffle, and a clashing name
    outcomes = url_filter.page_outcomes(frame, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    return {r.page_id: r for r in url_filter.filter_urls(frame, outcomes).collect()}, {r.host: (r.good, r.n) for r in outcomes.collect()}


def _story(i, n=4):
    return ". ".join(f"Word{i} number{j} tells of thing{i * j} and more" for j in range(n)) + "."


def test_bad_hosts_are_blocked_and_unlabelled_ones_follow_their_domain(spark):
    docs = [(i, _story(i)) for i in range(240)] + [(500, None), (None, _story(3))]
    labels = [(i, 0 if i < 40 else 1) for i in range(240)] + [(100, None), (None, 0), (500, 0)]
    pages = [(i, f"http://bad.site.com/{i}", _story(i)) for i in range(40)] + [(100 + i, f"http://h{i % 20}.fine.com/{i}", _story(40 + i)) for i in range(200)]
    pages += [(999, "http://new.fine.com/", "Nothing that any labelled document has said before."), (1000, "http://x.site.com/", None), (1001, "http://bad.site.com/", "")]
    pages += [(1002, "http://odd.org/", _story(5, 1) + " One that is not known to anyone. And another that nobody knows either.")]
    verdict, outcomes = _judged(spark, pages, docs, labels)
    assert verdict[0].verdict == verdict[1001].verdict == "block"
    assert verdict[1000].verdict == "block"  # its domain's only other host is bad
    assert verdict[100].verdict == verdict[999].verdict == "allow"
    assert outcomes["bad.site.com"] == (0, 40) and outcomes["new.fine.com"] == (0, 0) and outcomes["odd.org"] == (0, 0)
    assert sum(n for _, n in outcomes.values()) == 240


def test_outcomes_of_empty_tables(spark):
    assert _judged(spark, [], [(1, _story(1))], [(1, 1)]) == ({}, {})
    verdict, outcomes = _judged(spark, [(1, None, _story(1))], [], [])
    assert outcomes == {"": (0, 0)} and verdict[1].host == "" and verdict[1].rule is None


def test_repeated_pages_and_common_sentences(spark):
    docs, labels = [(i, "All of them say this one thing. " + _story(i)) for i in range(30)], [(i, i % 3 > 0) for i in range(30)]
    pages = [(7, "http://a.com/", _story(1))] * 3 + [(i, "http://b.com/", "All of them say this one thing.") for i in range(5)]
    verdict, outcomes = _judged(spark, pages, docs, [(d, int(q)) for d, q in labels])
    assert outcomes == {"a.com": (3, 3), "b.com": (5, 5)} and len(verdict) == 6


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(docs, items):
    out = []
    for d, text in docs:
        words, hit, found = _words(text), set(), set()
        for i, item in items:
            own = _words(item)
            n = min(13, len(own))
            windows = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if own else set()
            for s in range(len(words) - n + 1) if windows else ():
                if tuple(words[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= {str(i)} if i is not None else set()
        out.append((d, len(words), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


def test_contamination_equals_brute_force(spark):
    random.seed(11)
    vocabulary = ["Aa", "bé", "c", "d", "É", "x1", "the"]
    say = lambda n: " ".join(random.choice(vocabulary) + random.choice(["", ".", ",\n"]) for _ in range(n))
    items = [(i, say(random.choice([1, 2, 3, 5, 13, 14, 40]))) for i in range(12)] + [(100, ""), (101, None), (102, "!!"), (None, say(3)), (3, say(20))]
    docs = [(i, say(random.choice([0, 1, 5, 20, 60])) + " " + (items[i % 12][1] if i % 2 else "") + " " + say(4)) for i in range(60)]
    docs += [(1000, None), (1001, ""), (None, items[6][1]), (7, docs[7][1]), (7, docs[8][1]), (1002, " ".join(t for _, t in items[:12]) * 20)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(frames[0].withColumn("key", F.lit(1)), frames[1]).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found), key=repr) == _brute(docs, items)


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [(r.doc_id, r.n_words, r.n_hit) for r in decontaminate.decontaminate(docs, items).orderBy("doc_id").collect()] == [(1, 2, 0), (2, 0, 0)]
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


def test_large_benchmarks_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert_equal(spark, registry.QUERIES["op5_decontaminate"], registry.ORACLE_SQL["op5_decontaminate"])
