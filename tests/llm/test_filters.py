import re
from collections import Counter

import pytest
import regex
from helpers import SCHEMA, awkward_docs, prose

from shotweave.llm import decontam, license_scan, url_filter
from shotweave.llm.queries import URL_RULES

LABELS = "doc_id long, quality int, toxic int"


def leak_pairs(docs, items):
    cut = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w]
    grams = lambda w: [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
    out = {}
    for d, t in docs:
        for i, it in items:
            if None in (d, t, i, it):
                continue
            if 0 < len(cut(it)) < 5:
                w, item = cut(t), cut(it)
                if any(w[s:s + len(item)] == item for s in range(len(w) - len(item) + 1)):
                    out[d, i] = 1.0
                continue
            own, n = Counter(grams(cut(it))), max(len(cut(it)) - 4, 1)
            g = grams(cut(t))
            if not own or not g:
                continue
            best = 0
            for s in range(max(len(g) - n, 0) + 1):
                c = Counter(g[s:s + n])
                shared = sum((c & own).values())
                best = max(best, shared / (c.total() + own.total() - shared))
            if best >= 0.8:
                out[d, i] = max(out.get((d, i), 0), round(best, 6))
    return out


def test_leaks_match_brute_force(spark, empty):
    items = [(i, prose(700 + i, 8 + 5 * i)) for i in range(12)] + [(20, "of the same of the same of the same of the same"), (21, "tiny item"), (22, None), (23, "  ..  "), (None, prose(9, 30)), (24, prose(800, 300))]
    docs = [(i, prose(i, 60) + " " + items[i % 12][1].upper() + ". " + prose(50 + i, 40)) for i in range(24)]
    for i in range(24, 60):  # edited and cut passages, over and under the limit
        w = items[i % 12][1].split()
        w[len(w) // 2:len(w) // 2 + 1] = ["x"] * (i % 3)
        docs.append((i, prose(i, 50) + " " + " ".join(w[i % 4:]) + " " + prose(90 + i, 50)))
    docs += [(70, "Tiny, item!"), (71, "a tiny item in a text"), (76, "a tiny item"), (77, "tiny"), (78, "x tiny, ITEM " * 40), (72, "of the same " * 30), (73, items[5][1]), (74, items[11][1][:-9]), (75, prose(1, 20) + items[-1][1]), (75, prose(1, 20) + items[-1][1])]
    rows = [(d, t, "", "", 0) for d, t in docs] + awkward_docs()
    got = decontam.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = leak_pairs([r[:2] for r in rows], items)
    assert len(want) > 20 and {(70, 21), (71, 21), (76, 21), (78, 21)} <= want.keys()
    assert {r.n_windows for r in got if (r.doc_id, r.item_id) == (78, 21)} == {40}
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == pytest.approx(want, abs=1e-6)


def test_leaking_documents_go(spark, docs, empty):
    bench = spark.createDataFrame([(1, prose(3, 80))], "item_id long, text string")
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {9}
    assert decontam.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert decontam.contaminated(empty, bench).count() == 0


def test_leaks_with_shuffle_joins(spark, docs, clashing, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame([(1, prose(3, 80)), (2, prose(1, 120))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(clashing, bench).collect()} == {(9, 1), (0, 2), (1, 2), (2, 2)}


def test_licences(spark, clashing, empty):
    mit = license_scan.TEMPLATES["MIT-text"]
    rows = [(1, "x\nReleased under the MIT license\ny"), (2, "Released by the MIT"), (3, mit), (4, "intro line\n\n" + mit[:200] + "\n" + mit[200:] + "\n\nlast"),
            (5, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (6, "Licensed under the Apache License, Version 3.0!")]
    got = {(r.doc_id, r.license): (r.n_units, r.dice) for r in license_scan.scan(spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], SCHEMA)).collect()}
    assert got[1, "MIT"] == (2, 1.0) and (2, "MIT") not in got and got[3, "MIT-text"] == (1, 1.0) and got[4, "MIT-text"][0] == 2 and got[4, "MIT-text"][1] > 0.95
    assert got[5, "CC-BY-NC-4.0"] == (2, 1.0) and (6, "Apache-2.0") not in got  # 5 of 7 bigrams
    assert license_scan.scan(clashing).count() == 0 and license_scan.scan(empty).count() == 0


def test_notices_among_other_words(spark):
    """In a prose line, over comment lines, after CRLF, twice in a row, with a word exchanged, in a very long text."""
    mit, gpl = license_scan.TEMPLATES["MIT-text"], license_scan.TEMPLATES["GPL-3.0-header"]
    w = gpl.split()
    wrapped = "#!/bin/sh\n" + "\n".join(" * " + " ".join(w[i:i + 7]) for i in range(0, len(w), 7)) + "\nint main() {}"
    rows = [(1, "Copyright 2020 Foo. Released under the MIT License. More words follow it here."), (2, "a\r\n\r\n" + mit.replace(". ", ".\r\n") + "\r\n\r\nint x;"), (3, wrapped),
            (4, prose(1, 30_000) + " " + license_scan.TEMPLATES["CC0-1.0"].replace("waived", "kept") + " " + prose(2, 9000)), (5, "released under the the MIT license"), (6, "Licensed under CC BY " * 300),
            (7, "released under some other license"), (8, "MIT License. Released under the")]
    got = {(r.doc_id, r.license): (r.n_units, r.dice) for r in license_scan.scan(spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], SCHEMA)).collect()}
    cut = lambda t: re.findall("[a-z0-9]+", t.lower())
    want = {}
    for d, t in rows:
        g = list(zip(cut(t), cut(t)[1:]))
        for name, text in license_scan.TEMPLATES.items():
            own = Counter(zip(cut(text), cut(text)[1:]))
            b = own.total()
            best = max((sum((Counter(g[i:i + b]) & own).values()) / b for i in range(len(g)) if g[i] in own), default=0)
            if best >= 0.8 - 1e-9:
                want[d, name] = best
    assert want.keys() <= got.keys() and {(1, "MIT"), (2, "MIT-text"), (3, "GPL-3.0-header"), (4, "CC0-1.0")} <= want.keys()
    assert all(got[k][1] >= v - 1e-6 for k, v in want.items()) and all(n or k in want for k, (n, _) in got.items())
    assert got[1, "MIT"] == (0, 1.0) and not {k for k in got if k[0] in (7, 8)}


def test_licence_size_bounds_lose_nothing():
    for n in range(1, 60):
        low, high = license_scan.size_bounds(n, 0.8)
        for m in range(1, 120):
            if 2 * min(n, m) / (n + m) >= 0.8:
                assert low <= m <= high


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1", "https://example.net/de/2", "x.net/en/", None, "", "http://sub.example.com/de/3?q=1", "ftp://b.org/fr/4#x", "http://org/fr/", "http://borg/fr/",
            "http://c.net?x", "http://u@d.co.uk:80/a", "//e.com/", "https://www.fine.org/en/10", "https://bad.example.org/en/11", "http://f.com/a?u=http://net/"]
    pages = spark.createDataFrame([(i, u, "h", "z", 1) for i, u in enumerate(urls)] + [(0, urls[0], "h", "z", 1), (None, urls[1], "h", "z", 1)], "page_id long, url string, html string, host string, doc int")
    labels = spark.createDataFrame([(10, 1, 0), (11, 0, 0), (11, 1, 0), (None, 0, 1), (12, None, None)], LABELS)
    rows = url_filter.judge(pages, labels, URL_RULES).collect()
    assert len(rows) == pages.count()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[1] == ("example.net", "/de/2", "net/", "block")

    assert got[3][:3] == ("", "", None) and got[4][:3] == ("", "", None) and got[2][:3] == ("", "", None)
    assert got[5] == ("sub.example.com", "/de/3", "example.com/de/", "block") and got[6][2:] == ("org/fr/", "allow")
    assert got[7][2] == "org/fr/" and got[8][2] is None and got[9] == ("c.net", "", None, got[9][3]) and got[10][:2] == ("u@d.co.uk:80", "/a")
    assert got[11][:2] == ("", "") and got[14][:2] == ("f.com", "/a")
    odd = spark.createDataFrame([(1, "http://a.com/x\u0001y/en/1"), (2, "http://a.com/\n://b.net/")], "page_id long, url string")
    assert {r.page_id: (r.host, r.path) for r in url_filter.judge(odd, labels, URL_RULES).collect()} == {1: ("a.com", "/x\u0001y/en/1"), 2: ("a.com", "/\n://b.net/")}
    none = pages.limit(0)
    assert url_filter.judge(none, labels, URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, labels.limit(0), []).collect()} == {"allow"}


def test_reputation_shrinks_to_the_parents(spark):
    hosts = [(f"h{i}.good.com", 0.0, 40.0) for i in range(20)] + [(f"h{i}.bad.com", 36.0, 40.0) for i in range(20)] + [("new.bad.com", 0.0, 0.0), ("new.good.com", 0.0, 0.0), ("one.good.com", 1.0, 1.0)]
    mean = {r.host: r.mean for r in url_filter.reputation(spark.createDataFrame(hosts, "host string, bad double, n double")).collect()}
    assert mean["new.bad.com"] > 0.7 and mean["new.good.com"] < 0.15 and mean["one.good.com"] < 0.6 and mean["h1.bad.com"] > 0.8


def test_ports_users_and_addresses(spark):
    from pyspark.sql import functions as F

    hosts = ["a.com:80", "u:p@b.com", "10.0.0.1", "10.0.0.1:8080", "[::1]", "[::1]:443"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").withColumn("n", url_filter.name_of(F.col("h"))).withColumn("s", url_filter.suffix_of(F.col("n")))
    got = {r.h: (r.s, r.d) for r in df.withColumn("d", url_filter.domain_of(F.col("n"), F.col("s"))).collect()}
    assert got == {"a.com:80": ("com", "a.com"), "u:p@b.com": ("com", "b.com"), "10.0.0.1": ("10.0.0.1",) * 2, "10.0.0.1:8080": ("10.0.0.1",) * 2, "[::1]": ("[::1]",) * 2, "[::1]:443": ("[::1]",) * 2}


def test_parts_of_hosts(spark):
    rows = spark.createDataFrame([("a.b.example.co.uk",), ("example.com",), ("com",), ("",), ("x.org",)], "h string").collect()
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows).select("h", url_filter.suffix_of(F.col("h")).alias("s")).withColumn("d", url_filter.domain_of(F.col("h"), F.col("s")))
    assert {r.h: (r.s, r.d) for r in df.collect()} == {"a.b.example.co.uk": ("co.uk", "example.co.uk"), "example.com": ("com", "example.com"), "com": ("com", "com"), "": ("", ""), "x.org": ("org", "x.org")}
