"""Benchmark passages, licences, urls and top-k against brute force and SQL."""

import math
import os
import random

import duckdb
import numpy as np
import pytest

from tidegauge.llm import decontamination, licenses, registry, topk, urls
from tidegauge.llm.batches import ready
from tidegauge.llm.queries import urls as url_query

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.collect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=str)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    assert len(got) == len(want) > 0
    for g, w in zip(got, want):
        assert all(a == b or (isinstance(a, float) and math.isclose(a, b)) for a, b in zip(g, w)), (g, w)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


@pytest.fixture(scope="module")
def passages():
    random.seed(11)
    vocabulary = [f"v{i}" for i in range(200)]
    items = [[random.choice(vocabulary) for _ in range(n)] for n in (5, 8, 12, 20, 33, 60)]
    docs, truth = [], set()
    for d in range(60):
        words = [random.choice(vocabulary) for _ in range(random.randrange(10, 120))]
        if d % 2:
            i = d % len(items)
            item = list(items[i])
            for _ in range(random.randrange(int(0.2 * len(item)) + 1)):
                at = random.randrange(len(item))
                item[at:at + random.randrange(2)] = [] if random.random() < 0.4 else ["new"]
            at = random.randrange(len(words))
            words[at:at] = item
        docs.append((d, " ".join(words).title() + "."))
    for d, text in docs:
        words = text[:-1].lower().split()
        for i, item in enumerate(items):
            e = int(0.2 * len(item))
            if any(edits(item, words[a:b]) <= e for a in range(len(words)) for b in range(a + len(item) - e, min(len(words), a + len(item) + e) + 1)):
                truth.add((d, i))
    return items, docs, truth


def test_leaks_equal_brute_force(spark, passages, monkeypatch):
    items, docs, truth = passages
    benchmark = ready(spark).createDataFrame([(i, " ".join(x), "c") for i, x in enumerate(items)] + [(90, None, "c"), (91, "", "c"), (None, "v1 v2 v3 v4 v5", "c"), (92, "v1 v2", "c")],
                                             "item_id long, text string, doc_id string")
    table = spark.createDataFrame([(d, t, 1) for d, t in docs] + [(None, docs[1][1], 1), (98, None, 1), (99, "", 1)], "doc_id long, text string, item_id int")
    rows = decontamination.find_leaks(table, benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in rows if r.doc_id is not None}
    assert got <= truth and len(got) >= 0.97 * len(truth)
    assert all(r.edits <= 0.2 * r.item_words for r in rows)
    clean = decontamination.without_leaks(table, benchmark)
    assert clean.columns == table.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got} | {98, 99}
    monkeypatch.setattr(decontamination, "ITEM_WORDS", 1)
    blocks = list(decontamination.item_blocks(benchmark, item_words=20))
    assert len(blocks) > 1 and sorted(i for b in blocks for i in b.ids) == [0, 1, 2, 3, 4, 5, 91, 92]
    assert decontamination.find_leaks(table.limit(0), benchmark).count() == 0
    assert decontamination.find_leaks(table, benchmark.limit(0)).count() == 0


def test_leaks_do_not_depend_on_the_batch(spark):
    benchmark = ready(spark).createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string")
    short, item = "alpha beta gamma delta", [f"q{i}" for i in range(20)]
    edited = [*item[:7], "x", *item[8:]]
    texts = [short, " ".join([f"a{i}" for i in range(40)] + item + ["z"] * 9), " ".join(edited + item + ["z"]), "other words here " * 30]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(0, 1): (0, 1), (1, 2): (40, 0), (2, 2): (20, 0)}
    together = {(r.doc_id, r.item_id): (r.first_word, r.edits) for r in decontamination.find_leaks(frame.coalesce(1), benchmark).collect()}
    alone = {(r.doc_id, r.item_id): (r.first_word, r.edits) for i in range(len(texts)) for r in decontamination.find_leaks(frame.where(f"doc_id = {i}"), benchmark).collect()}
    assert together == alone == want


def test_embedding_is_closer_than_chance():
    random.seed(2)
    rng = np.random.default_rng(0)
    hits, n = 0, 60
    for _ in range(n):
        words = rng.integers(0, 1 << 60, 30).astype(np.uint64)
        other = np.delete(np.insert(words, random.randrange(30), np.uint64(5)), random.randrange(30))
        one, two = np.array([0]), np.array([30])
        hits += any(decontamination.keys(words, one, two, 30, r)[0] == decontamination.keys(other, one, two, 30, r)[0] for r in range(decontamination.repetitions()))
    assert hits == n


def test_licences_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "UNDER the MIT-license under THE mit license"), (4, "Apache License, Version 2 x cc by/nc"), (5, "under the mit licenses"), (6, "Kunder the mit license"),
            (7, "This work is licensed under the GNU General Public License, version 3."), (None, "cc by nc"), (8, "é" * 100000), (8, "Released under the MIT License."), (9, "under the mıt license")]
    docs = ready(spark).createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, n_words int, labels string")
    got = {(r.doc_id, r.n_words): (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert len(got) == len(rows)
    assert got[1, 0] == got[2, 0] == (0, None, None, "", "", 0.0)
    assert got[3, 8][:4] == (2, 0, 4, "mit")
    assert got[4, 8][:4] == (2, 0, 5, "apache-2,cc-by-nc")
    assert got[5, 4][0] == got[6, 4][0] == got[9, 4][0] == 0
    assert got[7, 12][3:] == ("", "gpl-3", 1.0)
    assert got[None, 3] == (1, 0, 0, "cc-by-nc", "cc-by-nc", 1.0)
    assert got[8, 5][3] == "mit" and got[8, 1][4] == "mit"
    assert licenses.scan(docs.limit(0)).count() == 0


def test_wrapped_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    cc = "# This work is licensed under a Creative Commons\r\n# Attribution-NonCommercial 4.0\r\n# International License.\r\n"
    rows = [(1, mit), (2, bsd), (3, cc), (4, "Some words first.\n" + " * ".join(bsd.splitlines(True)) + "\n1. more"), (5, mit.replace("\n", "\n\n")), (6, bsd.replace("\n", ".\n")),
            (7, "released\n" + "other words\n" * 9 + "under the\n" + "other words\n" * 9 + "license"), (8, mit + "\n\n" + bsd), (9, bsd.replace("\n", " "))]
    docs = ready(spark).createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert got == {1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("cc-by-nc", 1.0), 4: ("bsd", 1.0), 5: ("", 0.0), 6: ("", 0.0), 7: ("", 0.0), 8: ("bsd,mit", 1.0), 9: ("bsd", 1.0)}


def test_urls_of_odd_rows(spark):
    link = '<head><link href="https://b.example.org/x" rel="canonical"></head>'
    rows = [(1, None, None), (2, "no scheme", "<p>"), (3, "http://A.example.NET/en/x?y#z", None), (4, "http://a.example.net", None), (5, "http://a.example.net/de/", None),
            (6, "https://x.example.com/de/1", link), (7, "http://b.example.org/x/", None), (8, "https://b.example.org/x#frag", "<meta http-equiv='refresh' content='0; url=/y'>"),
            (9, "https://b.example.org/y", None), (10, "https://c.example.org/fr/q", '<link rel=canonical href="https://x.example.com/de/2">'), (11, "https://x.example.com/de/2", None),
            (12, "http://x.example.com/de/2", None), (13, "https://d.example.org/q", '<link rel=canonical href="https://c.example.org/fr/q">'), (1, None, None)]
    pages = ready(spark).createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, verdict string")
    got = [tuple(r) for r in urls.judge(pages, url_query.RULES).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert len(got) == len(rows)
    by_id = {r[0]: r[1:] for r in got}
    assert by_id[1] == by_id[2] == ("", "", None, "allow")
    assert by_id[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by_id[4] == ("a.example.net", "", None, "allow") and by_id[5][2:] == ("net/", "block")
    assert by_id[6][3] == by_id[7][3] == by_id[8][3] == by_id[9][3] == "block"  # through the canonical link and the redirect
    assert by_id[7][2] is None
    assert by_id[10][2:] == ("org/fr/", "allow") and by_id[11][3] == by_id[12][3] == "block"
    assert by_id[13][2:] == (None, "allow")  # an allowed member keeps the block from spreading
    assert urls.judge(pages.limit(0), url_query.RULES).count() == 0


def _tagged(*links):
    return "<head>" + "".join(f'<link rel="canonical" href="{x}">' for x in links) + "</head>"


def test_links_of_every_form_meet(spark):
    """Relative targets, query-only targets, escaped ampersands and second tags lead to the page they name, in SQL too."""
    base = "https://h.example.org/a/b/p.html"
    cases = {"other.html": "https://h.example.org/a/b/other.html", "./x": "https://h.example.org/a/b/x", "../en/": "https://h.example.org/a/en/",
             "../../../up": "https://h.example.org/up", "?p=2": "https://h.example.org/a/b/p.html?p=2", "/r/../s/.?q=/../z": "https://h.example.org/s/?q=/../z",
             "//k.example.org/t": "https://k.example.org/t", "https://x.example.com/de/1?a=1&amp;b=2": "https://x.example.com/de/1?a=1&b=2",
             "n?u=http://z.org/": "https://h.example.org/a/b/n?u=http://z.org/", "#top": None, "mailto:a@b.org": None}
    rows = [(i, base + f"?case={i}" if t.startswith("?") is False else base, _tagged(t)) for i, t in enumerate(cases)]
    rows += [(100 + i, t, None) for i, t in enumerate(cases.values()) if t]
    rows += [(200, "https://m.example.org/1", _tagged("https://m.example.org/2", "https://x.example.com/de/9")), (201, "https://m.example.org/2", None),
             (202, "https://x.example.com/de/9", "<meta http-equiv=refresh content='0;url=last'><meta http-equiv=refresh content='5;url=/other'>"),
             (203, "https://x.example.com/de/last", None), (204, "https://x.example.com/other", None), (205, "no scheme", _tagged("rel.html")),
             (206, "https://bare.example.org", _tagged("sub/x")), (207, "https://bare.example.org/sub/x", _tagged("", "?"))]
    pages = ready(spark).createDataFrame(rows, "page_id long, url string, html string")
    judged = {r.page_id: r for r in urls.judge(pages, url_query.RULES).collect()}
    for i, target in enumerate(cases.values()):
        if target:
            assert judged[i].component == judged[100 + i].component, target
    assert judged[9].component == rows[9][1] and judged[10].component == rows[10][1]
    assert len({judged[i].component for i in range(200, 205)}) == 1
    assert judged[200].verdict == judged[201].verdict == judged[204].verdict == "block"
    assert judged[206].component == judged[207].component and judged[205].component == "no scheme"
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    cur = con.execute(url_query.ORACLE)
    names = [d[0] for d in cur.description]
    assert {r[names.index("page_id")]: tuple(r[names.index(c)] for c in ("rule", "verdict", "component")) for r in cur.fetchall()} \
        == {k: (r.rule, r.verdict, r.component) for k, r in judged.items()}


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=20) * (5 if i % 7 == 0 else 1)]) for i in range(300)]
    vectors += [(300, vectors[0][1]), (301, vectors[0][1]), (302, None), (303, [1.0, None]), (304, [float("nan")] * 20), (305, [float("inf")] * 20), (306, []), (307, [1.0, 2.0]), (0, vectors[0][1]), (None, vectors[3][1]),
                (400, vectors[5][1]), (401, [10 * x for x in vectors[0][1]]), (401, [11 * x for x in vectors[0][1]])]
    frame = ready(spark).createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.nearest(frame, lambda c: c % 50 == 0, 5).collect())
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in sound if i % 50 == 0}):
        own = min(v for i, v in sound if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in sound if i != q)[:5]
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.nearest(frame.limit(0), lambda c: c % 50 == 0).count() == 0
    empty = ready(spark).createDataFrame([(0, []), (1, []), (2, [])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.nearest(empty, lambda c: c == 0).orderBy("rank").collect()] == [(0, 1, 1, 0), (0, 2, 2, 0)]
    with pytest.raises(ValueError):
        topk.nearest(ready(spark).createDataFrame([(0, [3e30]), (1, [-3e30])], "vec_id long, embedding array<double>"), lambda c: c == 0)
