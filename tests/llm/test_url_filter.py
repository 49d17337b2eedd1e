import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from impactlens.llm import url_filter as U
from impactlens.llm.queries import URL_RULES, op11_url_filter


def model(texts, order):
    """Probabilities of a character after a context, as a plain function."""
    counts = defaultdict(Counter)
    for t in texts:
        t = "\x02" * order + t + "\x03"
        for i in range(order, len(t)):
            for n in range(order + 1):
                counts[t[i - n:i]][t[i]] += 1

    def probability(context, c, p):
        for n in range(len(context) + 1):
            seen = counts.get(context[len(context) - n:], Counter())
            if seen:
                p = (seen[c] + len(seen) * p) / (seen.total() + len(seen))
        return p
    return probability


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(str.maketrans(U._UPPER, U._LOWER)), m[2]) if m else ("", "")


@pytest.mark.parametrize("order", [1, 4])
def test_ratios_against_plain_model(spark, order):
    good, bad = ["a.com/x", "abc/é🙂", "a.com/x"], ["zz.net", "z", ""]
    texts = [(t, True) for t in good] + [(t, False) for t in bad] + [("a.net/é?", None), ("", None)]
    rows = spark.createDataFrame(texts, "text string, accepted boolean")
    counted = U.windows(rows, "text", "accepted", order=order).groupBy("window").agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    got = {r.window: r.ratio for r in U.log_ratios(counted, order).collect()}
    symbols = {c for t, _ in texts for c in t + "\x03"}
    a, b = model(good, order), model(bad, order)
    padded = ["\x02" * order + t + "\x03" for t, _ in texts]
    want = {}
    for t in padded:
        for i in range(order, len(t)):
            p = [m(t[i - order:i], t[i], 1 / (len(symbols) + 1)) for m in (a, b)]
            want[t[i - order:i + 1]] = (math.log(p[0]) - math.log(p[1])) * U.MILLION
    assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1 for w in want)


URLS = [
    ("http://a.com/x", "a.com", "/x", "com/"), ("http://com", "com", "", None), ("http://com/", "com", "/", "com/"),
    ("HTTP://WWW.Example.COM/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/"),
    ("https://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/"),
    ("https://blog.example.com/en/2", "blog.example.com", "/en/2", "example.com/en/"),
    ("https://blog.example.com/EN/2", "blog.example.com", "/EN/2", "com/"),
    ("https://badexample.com/en/2", "badexample.com", "/en/2", "com/"),
    ("x://net/es/", "net", "/es/", "net/es/"), ("x://a.net/es", "a.net", "/es", None), ("x://a.net/fr/x", "a.net", "/fr/x", "net/fr/"),
    ("x://a.com:80/x", "a.com:80", "/x", None), ("://a.com/y://b", "a.com", "/y://b", "com/"), ("a.com/x", "", "", None),
    ("", "", "", None), (None, "", "", None), ("x://a.com?u=/en/", "a.com", "", None), ("x://a\n.com/\n#", "a\n.com", "/\n", "com/"),
    ("x://É.com/é", "É.com", "/é", "com/"), ("x://" + "a" * 50_000 + ".org/" + "b" * 50_000, "a" * 50_000 + ".org", "/" + "b" * 50_000, None)]


def test_rules_nulls_and_clashing_columns(spark):
    rows = [(i, u[0], "x", 1) for i, u in enumerate(URLS)] + [(3, URLS[1][0], "x", 1)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, row int")
    got = U.judge_urls(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    for i, (url, host, path, rule) in enumerate(URLS):
        own = [r for r in got if r.page_id == i]
        assert (host, path, rule) in {(r.host, r.path, r.rule) for r in own}
        assert parts(url) == (host, path)
    assert all(r.verdict == (URL_RULES[r.rule] if r.rule else r.verdict) and r.verdict in ("allow", "block") for r in got)
    assert len({r.verdict for r in got if r.host == "com" and r.path == ""}) == 1
    assert U.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_no_rule_no_model(spark):
    pages = spark.createDataFrame([(1, "x://a.com/b")], "page_id long, url string")
    r = U.judge_urls(pages, {"net/": "block"}).first()
    assert (r.verdict, r.total, r.rule) == ("allow", 0, None)


def test_calibration(spark):
    rows = [(True, 5 * U.BIN, 1), (True, 40 * U.BIN, 2), (False, -U.BIN, 1), (False, 2 * U.BIN, 1)]
    assert U.calibrate(spark.createDataFrame(rows, "accepted boolean, total long, places long")) == 4 * U.BIN
    rows += [(True, -8 * U.BIN, 1), (False, 100 * U.BIN, 1)]  # one error of each kind
    assert U.calibrate(spark.createDataFrame(rows, "accepted boolean, total long, places long")) == 4 * U.BIN
    assert U.calibrate(spark.createDataFrame(rows[:2], "accepted boolean, total long, places long")) == 0


def test_separates_unseen_urls(spark):
    """Rules accept one kind of URL under com and reject another under net;
    under org, where no rule reaches, the kinds are told apart."""
    r = random.Random(5)
    kinds = {"com": ["news", "article", "story", "report", "archive"], "net": ["casino", "bonus", "win", "free", "pills"]}
    rows = []
    for i in range(600):
        kind = r.choice(list(kinds))
        words = [r.choice(kinds[kind]) for _ in range(r.randint(2, 9))]
        end = "org" if i % 2 else kind
        rows.append((i, f"http://{words[0]}{i}.{end}/{'-'.join(words[1:])}", kind))
    pages = spark.createDataFrame(rows, "page_id long, url string, kind string")
    got = U.judge_urls(pages, {"com/": "allow", "net/": "block"}).where("rule is null").collect()
    kind = {i: k for i, _, k in rows}
    right = [(kind[x.page_id] == "com") == (x.verdict == "allow") for x in got]
    assert len(right) == 300 and sum(right) / 300 >= 0.97


def test_native(spark, sf_small, monkeypatch):
    """No step runs Python, pandas or Arrow code."""
    plans, store = [], U.materialise

    def stored(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return store(df, name)

    monkeypatch.setattr(U, "materialise", stored)
    plans.append(op11_url_filter(spark, sf_small)._jdf.queryExecution().toString())
    assert len(plans) == 5 and not re.search("Python|Arrow|Pandas|MapIn|CartesianProduct|NestedLoop", "".join(plans))
