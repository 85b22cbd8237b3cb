import base64
import hashlib
import os
import random
import re

import pytest

from terragrid.llm import url_filter, warc
from terragrid.llm.queries import URL_RULES

PAGE = "page_id long, url string, html string, host string"
MAGIC = "WARC/1.1\r\n"


def pages(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        html = "".join(rng.choice(["<p>é", "\r\n\r\n", MAGIC, "Content-Length: 12\r\n", "x" * rng.randrange(80), MAGIC + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"]) for _ in range(rng.randrange(0, 12)))
        rows.append((i, f"http://h/{i}\n", html, "clash"))
    rows += [(100, None, None, ""), (101, "u", "", ""), (102, "u", "same", ""), (103, "u", "same", ""), (104, "u", "same", ""), (105, "u", "z" * 300_000, ""), (None, "u", "nobody's", "")]
    return rows


def want(rows, least=0):
    groups = {}
    for i, _, html, _ in rows:
        groups.setdefault(html or "", []).append(i)
    out = {}
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        ids = [x for x in groups[html or ""] if x is not None]
        keep = max(ids) if ids and len(groups[html or ""]) > 1 and len(raw) >= least else i
        out[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if keep == i else "revisit", None if keep == i else keep)
    return out


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_round_trip_with_magic_in_payloads_and_any_ranges(spark, split):
    rows = pages()
    df = spark.createDataFrame(rows, PAGE).repartition(2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if split == "700b" else cost)
        got = warc.round_trip(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert len(got) == len(rows)
    assert {r["page_id"]: tuple(r)[1:] for r in got} == want(rows)


def test_least_bytes_and_joins_instead_of_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = pages(2, 20)
    got = warc.round_trip(spark.createDataFrame(rows, PAGE), least_bytes=5).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in got} == want(rows, 5)


def test_records_are_whole_and_chains_end_at_damage(spark, tmp_path):
    rec = lambda i, body: f"{MAGIC}WARC-Type: resource\r\nWARC-Record-ID: <r{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((rec(1, "one") + rec(2, f"in {rec(9, 'payload')} out") + rec(3, "")).encode())
    (tmp_path / "b.warc").write_bytes((rec(4, "four") + "junk" + rec(5, "unreached")).encode())
    (tmp_path / "c.warc").write_bytes(b"")
    got = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.read_warc(spark, f"file://{tmp_path}").collect()}
    assert got == {"<r1>": "one", "<r2>": f"in {rec(9, 'payload')} out", "<r3>": "", "<r4>": "four"}


def test_archives_in_gzip_are_read(spark, tmp_path):
    import gzip

    rec = lambda i, body: f"{MAGIC}WARC-Type: resource\r\nWARC-Record-ID: <r{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(rec(i, f"body {i} {MAGIC}" * i)) for i in range(30)))  # a member for each record
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(rec(i, "x" * i) for i in range(100, 130))))
    got = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.read_warc(spark, f"file://{tmp_path}").collect()}
    assert got == {f"<r{i}>": f"body {i} {MAGIC}" * i for i in range(30)} | {f"<r{i}>": "x" * i for i in range(100, 130)}


def test_a_revisit_without_its_response_fails(spark, tmp_path, monkeypatch):
    rows = [(1, "u", "same", ""), (2, "u", "same", ""), (3, "u", "other", "")]
    df = spark.createDataFrame(rows, PAGE)
    real = warc.read_warc
    monkeypatch.setattr(warc, "read_warc", lambda *a, **k: real(*a, **k).where("record_id <> '<urn:page:2>'"))
    with pytest.raises(Exception, match="no response for the revisit of page 1"):
        warc.round_trip(df).collect()


def test_rows_that_share_identifier_and_payload_are_all_responses(spark):
    rows = [(5, "u", "p", ""), (5, "u", "p", ""), (4, "u", "p", ""), (None, "u", "p", ""), (None, None, None, None)]
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, PAGE)).collect())
    assert got == [("4", 1, "revisit", 5), ("5", 1, "response", None), ("5", 1, "response", None), ("None", 0, "response", None), ("None", 1, "revisit", 5)]


def test_warc_of_an_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    best = (None, None)
    for kind, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best[0] is None or len(rule) > len(best[0])):
            best = (rule, kind)
    return best


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme/en/", "http://A.Example.NET/en/1?x#y", "https://example.net", "http://x.net?q=/en/", "HTTP://ÉX.com/De/7", "http://m.example.com/de/5", "http://example.com/fr/", "ftp://org/fr/a://b", "http://a.org/fr", "http://notexample.net/en/x", "x://u@h.org:80/fr/;p", "http://net/", "http://example.net/en"]
    df = spark.createDataFrame([(i, u, "", "clash") for i, u in enumerate(urls)], PAGE)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_filter.filter_urls(df, labels, URL_RULES).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = plain_parts(urls[r["page_id"]])
        rule, kind = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, kind or "allow")
    assert url_filter.filter_urls(df.where("false"), labels, URL_RULES).count() == 0


def test_templates_learn_from_labels(spark):
    rows, marks = [], []
    for i in range(400):
        bad = i % 2 == 0
        rows.append((i, f"http://shop.example.org/{'deals/offer-%d' % i if bad else 'docs/%d/page.html' % i}", "", ""))
        if i % 4 < 2:
            marks.append((i, 1, int(bad)))
    for i in range(400, 460):  # names, not numbers: one wildcard once there are many
        rows.append((i, f"http://blog.example.org/user/{chr(97 + i % 26)}{chr(97 + i // 26)}nick", "", ""))
    marks += [(0, 1, 1), (None, 0, 1), (1, 1, None)]
    df, labels = spark.createDataFrame(rows, PAGE), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = url_filter.filter_urls(df, labels, []).collect()
    assert {(r["template"], r["verdict"]) for r in got if r["host"] == "shop.example.org"} == {("/deals/offer-*", "block"), ("/docs/*/page.html", "allow")}
    assert {(r["template"], r["verdict"]) for r in got if r["host"] == "blog.example.org"} == {("/user/*", "allow")}


def plain_tree(rows, bad):
    """(template, purity) of each (id, host, path): the tree from its definition, with dictionaries."""
    u = url_filter
    urls = {}
    for i, host, path in rows:
        segs = [s for s in re.sub(r"[0-9]+", "*", re.sub(r"[0-9a-fA-F]{8,}(?:-[0-9a-fA-F]{4,})*", "*", path)).split("/") if s]
        e = urls.setdefault((host, tuple(segs)), [0, 0, 0, ()])
        e[0] += 1
        e[1] += i in bad
        e[2] += bad.get(i, 0)
    for k in range(max((len(s) for _, s in urls), default=0)):
        kids = {}
        for (h, s), (n, _, _, t) in urls.items():
            if len(s) > k:
                at = kids.setdefault((h, t), {})
                at[s[k]] = at.get(s[k], 0) + n
        for (h, s), e in urls.items():
            if len(s) > k:
                c = kids[h, e[3]]
                wide = len(c) >= u.MANY_CHILDREN and max(c.values()) < u.TOP_SHARE * sum(c.values())
                e[3] += ("*" if wide else s[k],)
    sums, leaves = {}, {}
    for (h, _), (_, m, b, t) in urls.items():
        marks = (*("/" + x for x in t), "end")
        leaves.setdefault((h, marks), [0, 0])
        for at in (leaves[h, marks], *(sums.setdefault((h, marks[:k]), [0, 0]) for k in range(len(marks) + 1))):
            at[0] += m
            at[1] += b
    merged, pools = {}, {}
    for (h, node), (m, b) in sums.items():
        if node:
            pm, pb = sums[h, node[:-1]]
            om, ob = pm - m, pb - b
            p = (ob + b + 1) / (om + m + 2)
            error = (p * (1 - p) * (1 / max(m, 1) + 1 / max(om, 1))) ** 0.5
            merged[h, node] = m == 0 or om == 0 or abs(b / max(m, 1) - ob / max(om, 1)) <= u.SIMILAR_Z * error
            if merged[h, node]:
                pool = pools.setdefault((h, node[:-1]), [0, 0])
                pool[0] += m
                pool[1] += b
    all_m, all_b = (sum(x[j] for x in leaves.values()) for j in (0, 1))
    out = {}
    for (h, s), (_, _, _, t) in urls.items():
        marks = (*("/" + x for x in t), "end")
        top = max((k for k in range(1, len(marks) + 1) if not merged[h, marks[:k]]), default=0)
        m, b = pools.get((h, marks[:top]), leaves[h, marks]) if top < len(marks) else leaves[h, marks]
        hm, hb = sums[h, ()]
        rate = (hb + u.PRIOR * all_b / (all_m + 1)) / (hm + u.PRIOR)
        out[h, s] = ("".join("/" + x for x in t), (b + u.PRIOR * rate) / (m + u.PRIOR))
    return out


def test_template_tree_equals_a_plain_one(spark):
    rng = random.Random(12)
    name = lambda n: "".join(rng.choice("ghijkl") for _ in range(n))
    rows = []
    for i in range(900):
        kind = rng.randrange(6)
        path = [f"/user/{name(4)}/post/{name(5)}", f"/a/b/c/{rng.choice('pq')}/{name(1)}", f"/shop/{rng.choice(['deals', 'docs', 'faq'])}/{i}", "/" + "/".join("x" * rng.randrange(1, 3) for _ in range(rng.randrange(0, 30))), "/one" * 25 + f"/{name(4)}", ""][kind]
        rows.append((i, rng.choice(["big.org", "big.org", "b.net", ""]), path))
    bad = {i: int("deals" in p or (p.startswith("/a/b/c/p") and rng.random() < 0.8) or rng.random() < 0.1) for i, _, p in rows if rng.random() < 0.7}
    df = spark.createDataFrame([(i, f"http://{h}{p}", "", "") for i, h, p in rows], PAGE)
    labels = spark.createDataFrame([(i, 1, v) for i, v in bad.items()], "doc_id long, quality int, toxic int")
    want_ = plain_tree(rows, bad)
    got = url_filter.filter_urls(df, labels, []).collect()
    paths = {i: (h, tuple(s for s in re.sub("[0-9]+", "*", p).split("/") if s)) for i, h, p in rows}
    assert len(got) == len(rows)
    for r in got:
        template, purity = want_[paths[r["page_id"]]]
        assert r["template"] == template and r["purity"] == pytest.approx(purity) and r["verdict"] == ("block" if purity >= url_filter.REJECT else "allow")


def test_plans_do_not_grow_with_the_depth(spark):
    exchanges = []
    for depth in (4, 8, 16):
        rows = [(i, "http://h.org/" + "/".join(f"{chr(97 + i % 5)}{k}" if k % 2 else chr(97 + i % 7) for k in range(depth)), "", "") for i in range(100)]
        got = url_filter.filter_urls(spark.createDataFrame(rows, PAGE), spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int"), [])
        exchanges.append(got._jdf.queryExecution().executedPlan().toString().count("Exchange"))
    assert exchanges[0] == exchanges[1] == exchanges[2]


def test_deep_paths_and_repeated_rows(spark):
    deep = "http://d.org/" + "/".join(f"s{chr(97 + i)}" for i in range(20))
    df = spark.createDataFrame([(1, deep, "", ""), (1, deep, "", ""), (2, "http://d.org//a///b", "", "")], PAGE)
    got = url_filter.filter_urls(df, spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int"), []).collect()
    assert [r["page_id"] for r in got].count(1) == 2
    assert {r["template"].count("/") for r in got if r["page_id"] == 1} == {20}
    assert os.path.basename(next(r["template"] for r in got if r["page_id"] == 2)) == "b"
