from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import duckdb

from runledger.llm import secrets, urls

from .helpers import EDGES, frame, prose


def brute_base(text):
    text, out = text or "", []
    words = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def secret_texts():
    rnd = random.Random(3)
    bits = ["password", "PassWd", "api_key", "APIKEY", "token", ":", "=", " ", '"', "'", "abcdef", "x=y", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "é🙂", "\n", "secret", "deadbeef", "K7", "."]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 60))) for _ in range(400)]


def test_base_spans(spark):
    docs = [(k, t) for k, t in enumerate(secret_texts())] + [(1000, "password=" * 3000)] + EDGES
    got = secrets.scan(frame(spark, docs)).select("doc_id", secrets.written("base").alias("b"), secrets.written("spans").alias("s")).collect()
    want = sorted(((d, ",".join(brute_base(t))) for d, t in docs), key=repr)
    assert sorted(((r.doc_id, r.b) for r in got), key=repr) == want
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in got)
    assert secrets.scan(frame(spark, [])).count() == 0


def brute_entropy(s, least, w=20):
    hits = []
    for i in range(len(s) - w + 1):
        n = Counter(s[i:i + w])
        if -sum(c / w * math.log2(c / w) for c in n.values()) >= least - 1e-9:
            hits.append(i)
    return (hits[0], hits[-1] + w) if hits else None


def test_entropy_windows(spark):
    rnd = random.Random(9)
    keys = ["".join(rnd.choice(string.ascii_letters[:n] + string.digits[:n]) for _ in range(rnd.randint(20, 50))) for n in (1, 3, 5, 8, 10, 26) for _ in range(15)]
    df = spark.createDataFrame([(k,) for k in keys], "s string")
    for least in (3.0, 3.7):
        got = {r.s: r.w for r in df.select("s", secrets.entropy_window(df.s, least).alias("w")).collect()}
        for k in keys:
            assert (None if got[k].first < 0 else (got[k].first, got[k].last)) == brute_entropy(k, least), k


def test_entropy_spans_and_allow_list(spark):
    key = "aZ3kQ9xW7bT1mN5vC8rY2dFgHj"
    docs = [(1, f"é see {key} here"), (2, "id 123e4567-e89b-12d3-a456-426614174000 end"), (3, "Averyveryverylongcompoundwordwithoutdigits"),
            (4, f"example{key}"), (5, f"token: {key}"), (6, f"{key}\n{key}"), (7, "12345678901234567890123"), (8, prose(1, 200))]
    got = {r.doc_id: r.s for r in secrets.scan(frame(spark, docs)).select("doc_id", secrets.written("spans").alias("s")).collect()}
    assert got[1] == f"entropy:6:{6 + len(key)}" and got[5].startswith("assign:") and "entropy" not in got[5]
    assert got[6].count("entropy") == 2 and not any(got[k] for k in (2, 3, 4, 7, 8))


def test_entropy_of_all_classes_and_allow_list_by_part(spark):
    rnd, key = random.Random(11), "aZ3kQ9xW7bT1mN5vC8rY2dFgHj"
    made = lambda letters, n: "".join(rnd.sample(letters, n))
    shapes = [made("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24) + "7A", made(string.ascii_lowercase + string.digits, 28) + "q7", made(string.ascii_uppercase + string.digits, 28) + "Q7",
              made(string.ascii_letters, 30), made(string.ascii_lowercase, 24), "-".join(made(string.ascii_lowercase + "234567", 10) for _ in range(4))]
    blob = key + "A" * 9 + key[::-1]
    docs = [(k, f"é see {x} here") for k, x in enumerate(shapes)] + [(10 + k, f"see home/{x}-word end") for k, x in enumerate(shapes[:4])]
    docs += [(20, f"examples/{key}"), (21, f"{key}-sample-{key}"), (22, blob), (23, "example" + key), (24, "x/123e4567-e89b-12d3-a456-426614174000"),
             (25, "A" * 60 + "b1"), (26, "12345678/90123456-7890123"), (27, "home/user/some-plain-words/of-a-path"), (28, "x" * 5000 + "Sample1")]
    got = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.s.split(",") if x] for r in secrets.scan(frame(spark, docs)).select("doc_id", secrets.written("spans").alias("s")).collect()}
    text = dict(docs)
    for k, x in enumerate(shapes):
        assert len(got[k]) == 1 and got[k][0][0] >= 6 and got[k][0][1] - got[k][0][0] >= 20, (x, got[k])
        if k < 4:
            at = text[10 + k].index(x)
            assert len(got[10 + k]) == 1 and got[10 + k][0][0] < at + 7 and got[10 + k][0][1] > at + 19, (x, got[10 + k])
    assert got[20] == [(9, 9 + len(key))] or got[20] == [(8, 9 + len(key))]
    assert len(got[21]) == 2 and text[21][got[21][0][0]:got[21][0][1]].startswith(key)
    assert len(got[22]) == 2 and got[22][0][0] == 0 and got[22][1][1] == len(blob)
    assert not any(got[k] for k in range(23, 29)), got


PAGES = [(1, "http://Sub.EXAMPLE.net/en/1?x"), (2, "https://a.net/de/"), (3, "x://net/"), (4, "http://a.net"), (5, "http://example.com/de/x#y"), (6, "http://b.example.com/en/"),
         (7, "http://b.example.com/de/1"), (8, "http://b.example.com/de/2"), (9, "http://a.org/fr/z"), (10, "http://a.org/de/"), (11, None), (12, "no scheme"), (13, "http://"),
         (14, "http://notexample.com/de/"), (15, "http://x.com?u=http://y.net/"), (16, ""), (16, "http://É.net/É/q"), (17, "http://example.net/english/"), (None, "http://a..net//en/"), (18, "http://" + "a." * 3000 + "net/" + "b/" * 3000)]


def brute_pages(pages):
    rows = []
    for page, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rows.append((page, host, path, *(max(fit)[1:] if fit else (None, None))))
    n, blocked = Counter(r[1] for r in rows), Counter(r[1] for r in rows if r[4] == "block")
    return sorted([(*r[:4], r[4] or ("block" if r[1] and 2 * blocked[r[1]] > n[r[1]] else "allow")) for r in rows], key=repr)


def test_url_verdicts(spark, monkeypatch):
    df = spark.createDataFrame([(p, u, "h", "k", "l") for p, u in PAGES], "page_id long, url string, html string, keys string, listed string")
    want = brute_pages(PAGES)
    for limit in (16 << 20, 1):  # one block, several
        monkeypatch.setattr(urls, "BLOCK_BYTES", limit)
        assert sorted([tuple(r) for r in urls.judge(df).collect()], key=repr) == want
    assert urls.judge(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", PAGES)
    assert sorted(con.execute(urls.CHECK).fetchall(), key=repr) == want


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    levels = urls.cascades(universe, universe.where("xxhash64(key) % 3 = 0"))
    assert len(levels[0]) > 2
    asked = universe.selectExpr("array(key) AS k", "xxhash64(key) % 3 = 0 AS want")
    assert urls.is_listed(asked, "k", levels, "got").where("(size(got) > 0) <> want").count() == 0
