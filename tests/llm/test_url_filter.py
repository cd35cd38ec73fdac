import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from retenta.llm import url_filter
from retenta.llm.url_filter import ORDER, Rule

RULES = (Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"))
URLS = ["https://www.Example.com/en/1?x=/y#z", "http://example.com/en/", "http://badexample.com/en/1", "https://a.b.net/es/", "https://net/es/x", "https://x.net?q=/es/",
        "no scheme", None, "", "://", "a://b://c/d", "https://x.com", "https://x.com#/en/", "HTTP://É.ÀB.com/Ü", "x://y.com/\n/z", "https://user@h.com:80/en/"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name()), default=None)
    return host, path, best.name() if best else None, best.verdict if best else None


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "z", "z") for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string, ratio string")


def test_rules_equal_a_plain_reading(spark):
    found = {r.page_id: (r.host, r.path, r.rule, r.decided) for r in url_filter.with_rule(pages(spark, URLS), RULES).collect()}
    assert found == {i: plain(u) for i, u in enumerate(URLS)}


def test_models_equal_plain_counting(spark):
    train = [("http://ab.com/1", 1), ("http://ab.com/22", 1), ("http://ba.net/x", 0), ("http://ba.net/x", 0), ("", 0)]
    models = url_filter.count(spark.createDataFrame(train, "url string, accepted int"))

    def probability(label, text):
        counts, after = defaultdict(int), defaultdict(set)
        for u, y in train:
            s = "^" * ORDER + u + "$"
            for i in range(ORDER, len(s)):
                for n in range(ORDER + 1):
                    if y == label:
                        counts[s[i - n:i], s[i]] += 1
                        counts[s[i - n:i]] += 1
                        after[s[i - n:i]].add(s[i])
        s, total = "^" * ORDER + text + "$", 0.0
        for i in range(ORDER, len(s)):
            p = 1 / 256
            for n in range(ORDER + 1):
                c = s[i - n:i]
                if counts[c]:
                    p = (counts[c, s[i]] + len(after[c]) * p) / (counts[c] + len(after[c]))
            total += math.log(p)
        return total / (len(text) + 1)

    texts = ["http://ab.com/9", "http://ba.net/x", "", "zzz"]
    asked = spark.createDataFrame([(t, "z", "y") for t in texts], "url string, key string, accepted string").repartition(2)
    for block in (20, url_filter.BLOCK):
        got = {r.url: r.ratio for r in url_filter.score(asked, models, block=block).collect()}
        assert got == pytest.approx({t: probability(1, t) - probability(0, t) for t in texts}, abs=1e-9)


def test_models_grow_with_the_urls(spark):
    rng = random.Random(3)
    urls = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789/-.") for _ in range(40)) for _ in range(6000)]
    models = url_filter.count(spark.createDataFrame([(u, i % 2) for i, u in enumerate(urls)], "url string, accepted int"))
    padded = ["^" * ORDER + u + "$" for u in urls]
    contexts = {(s[i - n:i]) for s in padded for i in range(ORDER, len(s)) for n in range(ORDER + 1)}
    grams = {(s[i - n:i], s[i]) for s in padded for i in range(ORDER, len(s)) for n in range(ORDER + 1)}
    assert len(contexts) > 100_000
    assert models.count() == len(contexts) + len(grams) and models.select("key").distinct().count() == len(contexts) + len(grams)
    total = models.agg(F.sum("rejected"), F.sum("accepted"), F.sum("kinds0")).first()
    half = sum(len(s) - ORDER for s in padded[::2])
    assert (total[0], total[1]) == (2 * (ORDER + 1) * half, 2 * (ORDER + 1) * sum(len(s) - ORDER for s in padded[1::2]))


def test_null_ids_repeats_and_clashing_names(spark):
    rows = [(None, "http://a.com/x"), (1, "http://a.com/x"), (1, "http://a.com/x"), (1, None), (None, None), (2, "http://q.org/y" + "z" * 30_000)]
    kinds = "page_id bigint, url string, block string, key string, accepted string, ratio string, decided string, rule string"
    df = spark.createDataFrame([(*r, *["z"] * 6) for r in rows], kinds)
    got = url_filter.judge(df, RULES).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert sum(r.verdict == "allow" and r.rule == "com/" for r in got) == 3
    assert got[0].__fields__ == ["page_id", "host", "path", "rule", "ratio", "verdict"]


def test_undecided_urls_get_the_nearer_model(spark):
    urls = [f"http://good{i}.com/story/{i}" for i in range(60)] + [f"http://pills{i}.net/es/cheap-{i}" for i in range(60)]
    more = ["http://good7.org/story/5", "http://pills3.org/fr/cheap-8"]
    rows = {r.page_id: r for r in url_filter.judge(pages(spark, urls + more + [None, "x"]), RULES).collect()}
    assert (rows[120].verdict, rows[121].verdict) == ("allow", "block")
    assert all(rows[i].verdict == ("allow" if i < 60 else "block") for i in range(120))
    assert len(rows) == 124 and rows[122].host == "" and rows[122].rule is None


def test_threshold_and_empty_tables(spark):
    scored = spark.createDataFrame([(0.5, "allow"), (0.7, "allow"), (-0.5, "block"), (0.1, "block"), (9.0, None)], "ratio double, decided string")
    assert 0.1 <= url_filter.threshold(scored) <= 0.5
    assert url_filter.threshold(scored.filter("decided = 'allow'")) == -np.inf
    assert url_filter.judge(pages(spark, []), RULES).collect() == []
    assert {r.verdict for r in url_filter.judge(pages(spark, ["http://x.org/a", None]), RULES).collect()} == {"allow"}
