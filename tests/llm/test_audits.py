"""URL rules, source divergence and vector codes against plain versions of their definitions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import codes, common, divergence, urlrules


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_verdict(url, hosts, patterns):
    url = url or ""
    found = re.search(r"://([^/?#]*)([^?#]*)", url)
    host, path = (small(found[1]), found[2]) if found else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p) for v, h, p in hosts if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        best = max(fits)
        return host, path, best[3], "block" if best[2] else "allow", None
    matching = []
    for pattern in patterns:
        text, regex = small(pattern.removeprefix("@@")), ""
        if text.startswith("||"):
            text, regex = text[2:], r"\A[^/?#]*?://(?:[^/?#]*[.])?"
        elif text.startswith("|"):
            text, regex = text[1:], r"\A"
        end = text.endswith("|")
        for c in text[:-1] if end else text:
            regex += {"*": ".*", "^": r"(?:[^a-z0-9]|\A|\Z)"}.get(c, re.escape(c))
        if re.search("(?s)" + regex + (r"\Z" if end else ""), small(url)):
            matching.append((pattern.startswith("@@"), len(pattern), pattern))
    if not matching:
        return host, path, None, "allow", None
    best = max(matching)
    return host, path, None, "allow" if best[0] else "block", best[2]


URLS = [
    None, "", "no scheme", "://", "http://", "http://a.net", "http://a.net/", "HTTP://A.NET/x", "http://net/", "http://xnet/", "https://en.example.net/en/1", "https://example.net/EN/1",
    "http://example.com/de/a?b=/en/#c", "http://example.com/de", "http://x.org/fr/", "http://x.org?u=http://a.net/", "http://x.org#/fr/", "http://user@b.net:80/", "http://a.b..net/",
    "http://casino.com/", "http://a.casino-x.com/", "http://mycasino.com/", "http://x.com/adult?education", "http://x.com/adult-education/", "http://x.com/q?u=://ads.y.com", "http://ads.x.com/",
    "http://a.ads.com/", "http://bads.com/", "http://x.com/wp-login.php", "http://x.com/wp-login.php?x", "http://x.com/click-track?a=1&id=2", "http://click-track.x.com/?q&id=2",
    "http://x.com/free-a-download-b.exe", "http://x.com/a.b(c)+$1|2\\3{4}[5]", "http://ü.com/ÄÖ casino\nwarez", "http://Kasino.com/pills", "ftp://q.z/" + "a." * 5000 + "/spam/",
]


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_urls(spark, monkeypatch, limit):
    """Broadcast and shuffled rule tables, patterns without tokens, repeated and NULL rules, repeated rows and NULL ids."""
    wide = common.bounded
    monkeypatch.setattr(urlrules, "bounded", lambda df: wide(df, limit))
    hosts = urlrules.HOST_RULES + [("block", "Example.com", "/de/"), ("allow", "example.com", "/de/"), ("block", "b..net", ""), ("other", "com", "/")]
    patterns = urlrules.PATTERNS + ["*$1|2\\3{*[5]|", "^", "ß", "|ftp:", "(c)", "lu", "^spam^", "@@"]
    spark_hosts = spark.createDataFrame(hosts + [(None, None, None), ("block", None, "/")], "verdict string, host string, path string")
    spark_patterns = spark.createDataFrame([(p,) for p in patterns + [None, ""]], "pattern string")
    rows = [(i if i % 5 else None, u) for i, u in enumerate(URLS + URLS[:12])]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, verdict string")
    got = urlrules.judge(pages, spark_hosts, spark_patterns).select("page_id", "host", "path", "rule", "verdict", "pattern").collect()
    want = [(i, *plain_verdict(u, [(v, small(h), p) for v, h, p in hosts if v != "other"], [p for p in patterns if p != "@@"])) for i, u in rows]
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r[1:]) + (r[0] or -1,)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_index_takes_the_rarest_token(spark):
    urls = spark.createDataFrame([("http://a.b/common/rare",), ("http://a.b/common",), ("http://c.d/common/x",)], "low string")
    rules = urlrules.compiled(spark.createDataFrame([("^common^rare^",), ("^common^absent^",), ("common",), ("*common*",)], "pattern string"))
    found = {r["pattern"]: r["token"] for r in urlrules.indexed(rules, urls).collect()}
    assert found == {"^common^rare^": "rare", "^common^absent^": "absent", "common": "", "*common*": ""}


def test_urls_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urlrules.judge(pages, *urlrules.rule_tables(spark)).collect() == []
    some = spark.createDataFrame([(1, "http://casino.net/")], "page_id long, url string")
    none = [d.limit(0) for d in urlrules.rule_tables(spark)]
    assert [tuple(r) for r in urlrules.judge(some, *none).collect()] == [(1, "casino.net", "/", None, "allow", None)]


def plain_audit(rows, least, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, counts = Counter(), defaultdict(Counter)
        for _, source, text in (r for r in rows if r[0] == lang):
            words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small(text))
            docs.update(set(words))
            counts[source].update(words)
        kept = [t for t, n in docs.items() if n >= least]
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        q, p = share(whole), {s: share(c) for s, c in counts.items()}
        for s in p:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in p if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])]
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("de", "Über", "x", "日本", "naïve") for b in "abcdefgh"]
    rows = []
    for i in range(160):
        text = rnd.choice([" ", "-", "1", "\n\n", "_"]).join(rnd.choices(words, k=rnd.randint(0, 40)))
        rows.append((rnd.choice(["en", "en", "en", "de", None, ""]), rnd.choice(["a", "b", "c", "é", None]), text))
    copy = rows[5][2] + " ax bx"
    return rows + [(rnd.choice(["en", "de"]), rnd.choice("ab"), copy) for _ in range(40)] + [("fr", "only", "once"), ("fr", "z", None), ("it", None, None), ("en", "empty", ""), ("en", "İ", "İSTANBUL K K ^ a" * 400)]


@pytest.mark.parametrize("seed, block, cells, table", [(1, 1 << 16, 1 << 20, 1 << 19), (2, 7, 12, 5), (3, 3, 3, 1)])
def test_divergence(spark, monkeypatch, seed, block, cells, table):
    """Also with many blocks, tiles of few sources and tables that are passed on often."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "TABLE", table)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, source string, text string, item string, n int")
    got = sorted(tuple(r) for r in divergence.audit(docs, least=12, top=5).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows, 12, 5)


def test_divergence_collapses_copies(spark):
    docs = spark.createDataFrame([("en", "a", "x y"), ("en", "a", "x y"), ("en", "b", "x y"), ("de", "a", "x y"), ("en", "a", "z")], "lang string, source string, text string")
    found = sorted((r["lang"], r["text"], sorted(map(tuple, r["copies"]))) for r in divergence.collapsed(docs).collect())
    assert found == [("de", "x y", [("a", 1)]), ("en", "x y", [("a", 2), ("b", 1)]), ("en", "z", [("a", 1)])]


def test_divergence_of_little(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty).collect() == []
    one = spark.createDataFrame([(None, None, None)], "lang string, source string, text string")
    assert divergence.audit(one).collect() == []


def plain_codes(rows, parts=16, entries=64, rounds=2):
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dims = next(len(v) for _, _, v in whole if v)
    whole = [r for r in whole if len(r[2]) == dims]
    w = dims // parts
    cut = lambda v: [v[j * w:(j + 1) * w] for j in range(parts)]
    books = [[list(cut(v)[j]) for _, _, v in whole[:entries]] for j in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for j in range(parts):
            groups = defaultdict(list)
            for _, _, v in whole:
                groups[near(cut(v)[j], books[j])[1]].append(cut(v)[j])
            for k, members in groups.items():
                books[j][k] = [sum(c) // len(c) for c in zip(*members)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, label, v in whole:
        found = [near(x, book) for x, book in zip(cut(v), books)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    total = Counter()
    for _, label, _, e in out:
        total[label] += e
    return sorted(((i, c, e, total[label], sha) for i, label, c, e in out), key=str)


@pytest.mark.parametrize("seed, n, dims, leaves, block", [(1, 150, 32, 1 << 12, 1 << 16), (2, 90, 16, 3, 11), (3, 20, 48, 1, 1)])
def test_codes(spark, monkeypatch, seed, n, dims, leaves, block):
    """Few different values, so that parts tie and share prefixes; NULLs, odd lengths, repeated ids, stretches of a leaf."""
    monkeypatch.setattr(codes, "LEAVES", leaves)
    monkeypatch.setattr(codes, "BLOCK", block)
    rnd = random.Random(seed)
    rows = [(rnd.choice([i, i, i, 7, None]), [rnd.randint(-3, 3) / 256 - 0.001 for _ in range(dims)], rnd.choice([1, 2, None])) for i in range(n)]
    rows += [rows[0]] * 5 + [(900, None, 1), (-5, [], 1), (901, [0.5] * (dims - 1), 2), (-9, [None] + [0.0] * (dims - 1), 1), (-8, [float("nan")] * dims, 1), (-7, [float("-inf")] * dims, 3)]
    table = spark.createDataFrame([(i, v, label, "clash") for i, v, label in rows], "vec_id long, embedding array<double>, label int, code string")
    got = sorted((tuple(r) for r in codes.compress(table).collect()), key=str)
    assert got == plain_codes(rows)


def test_trie_equals_the_full_distance_table():
    rnd = np.random.default_rng(5)
    parts, entries = rnd.integers(-4, 5, (500, 4)), rnd.integers(-4, 5, (9, 4))
    distinct, weight, place = codes.leaves(parts)
    assert weight.sum() == 500 and (distinct[place] == parts).all() and len(np.unique(parts, axis=0)) == len(distinct)
    full = ((distinct[:, None, :] - entries[None]) ** 2).sum(axis=2)
    nearest, distance = codes.walk(distinct, entries)
    assert (nearest == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_codes_of_little(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, 1), (2, [], None)], schema)).collect() == []
    one = codes.compress(spark.createDataFrame([(3, [0.25] * 16, None)], schema)).collect()
    assert [tuple(r)[:4] for r in one] == [(3, "00" * 16, 0, 0)]
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(3, [0.25] * 17, None)], schema))
