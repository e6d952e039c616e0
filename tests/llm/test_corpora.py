"""Mixing, archives, wrappers, training order, pipeline."""

import base64
import hashlib
import random
import tempfile

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import mixing, training, warc, wrapper
from quire.llm.queries import tokenizer_path

from conftest import DATA


def water(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = dict(zip(names, [3.0, 1.0, 2.0] * len(names)))
    left, targets, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > 2 * sizes[s]}
        if not over:
            targets.update({s: rate * weight[s] for s in free})
            break
        for s in over:
            targets[s] = 2.0 * sizes[s]
            left -= targets[s]
        free -= over
    return targets


def test_mix(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 80)), rnd.choice(["a", "a", "a", "B", "é", None, "tiny" if i < 3 else "z"]), i) for i in range(300)]
    rows += [(5000, "one two", "alone", 1), (5001, None, "a", 1), (5002, "", "none", 1), rows[7], rows[7], (None, "n n n", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    got = mixing.mix(df, block=16).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = water(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, mixing.mix(df.repartition(7), block=16).collect())) == sorted(map(str, got))
    times = {r.doc_id: r.n for r in mixing.mixed_documents(df, block=16).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert max(times.values()) <= 6 and times[5001] == 1 and mixing.mixed_documents(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0 and {r.taken for r in mixing.mix(df.where("text is null")).collect()} == {0}


def test_schedule_prefixes_follow_the_targets(spark):
    targets = spark.createDataFrame([("a", 6000.0), ("b", 3000.0), ("c", 1000.0)], "source string, target double")
    rows = mixing.schedule(targets, 10, 10000, chunk=64).orderBy("slot").collect()
    counts = {"a": 0, "b": 0, "c": 0}
    for i, r in enumerate(rows, 1):
        assert r["rank"] == counts[r.source]
        counts[r.source] += 1
        assert all(abs(counts[s] - i * p) < 5 for s, p in (("a", 0.6), ("b", 0.3), ("c", 0.1)))
    assert counts == {"a": 600, "b": 300, "c": 100}


def test_archives(spark):
    rows = [(1, "http://B.org/x?q=1", "<p>a"), (2, "http://a.org/", "<p>a"), (9, "https://a.org:8080/z", "<p>a"), (3, None, None), (4, "http://a.org/\r\nX: y", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n\r\n"),
            (6, "http://a.org/", "\x00" * 70000), (6, "http://a.org/", "\x00" * 70000), (None, "v", "<p>a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit("clash"))
    got = warc.capture_history(df, records_per_file=2).collect()
    assert len(got) == len(rows)
    largest = {}
    for p, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if p is None else p)
    for r in got:
        html = next(h or "" for p, _, h in rows if p == r.page_id)
        first = largest[html]
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
    keys = [(r.urlkey, r.timestamp) for r in got]
    assert keys == sorted(keys) and "org,b)/x?q=1" in {k for k, _ in keys}
    assert warc.capture_history(df.limit(0)).count() == 0
    none = warc.capture_history(df, least_bytes=4).collect()
    assert {r.record_type for r in none if r.payload_bytes < 4} == {"response"}


def test_loser_tree_merges():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted([(str(rnd.randrange(9)), "t", rnd.randrange(5), f"a{i}", j) for j in range(rnd.randint(0, 9))], key=warc._order) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted([x for r in runs for x in r], key=warc._order)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li>menu</ul></nav><div class="cookie-notice">We use cookies</div>%s
<aside>side</aside><form><label>mail</label><input></form><!-- <p>no</p> --><footer>&copy; all</footer></body></html>"""


@pytest.mark.parametrize("body,want", [
    ("<article><h1>T &amp; x</h1><p>a\n  b<br>c<p><b>d<p>e&nbsp;f</article>", "T & x\na b c\nd\ne f"),
    ("<main><p>one<div class=ad>buy</div><p>two<section class='comments'><p>hi</section></main>", "one\ntwo"),
    ("<div id=content><p>plain <i>in</i>line</p></div>", "plain inline"),
    ("<article><p>1 < 2 & 3</p><ul><li>x<li>y</ul><table><tr><td>u<td>v</table></article>", "1 < 2 & 3\nx\ny\nu\nv"),
    ("", ""),
])
def test_page_text(body, want):
    assert wrapper.main_text(wrapper.parse(PAGE % body)[1], set()) == want


def test_template_blocks_go(spark):
    rows = [(i, f"http://h.org/{i}", f"<div><p>Every page says this</p><p>text of {i} only</p><p>Call us now</p></div>") for i in range(30)]
    rows += [(100, "http://k.org/", "<p>Every page says this"), (101, None, None), (102, "x", ""), (103, "http://k.org/", "<p>" + "long " * 100000), (103, "http://k.org/", "<b>unclosed <p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    for small in (4 << 20, 0):
        got = {}
        for r in wrapper.extract(df, small=small).collect():
            got.setdefault(r.page_id, []).append(r.text)
            assert r.n_chars == len(r.text)
        assert all(got[i] == [f"text of {i} only"] for i in range(30))
        assert got[100] == ["Every page says this"] and got[101] == got[102] == [""] and sorted(map(len, got[103])) == [11, 499999]
    assert wrapper.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("body,want", [
    ("<article><div style='overflow:hidden'><p>a</div><p class=hidden-xs>b<p aria-hidden=false>c<p data-style='display:none'>d</article>", "a\nb\nc\nd"),
    ("<article><p hidden>a<p hidden=until-found>b<div style='color:red; display : none'>c</div><p>d</article>", "b\nd"),
    ("<article><div class=entry-header><h1>T</h1></div><div class=header><h2>U</h2></div><h2 id=related-work>R</h2><h2 id=search>S</h2><p class=notice>p</article>",
     "T\nU\nR\nS\np"),
    ("<div class='content has-sidebar'><h1>T</h1><p>p</div><div class='site-footer'>f</div><div class='ad-2'>buy</div><div id=comments><p>hi</div>", "T\np"),
    ("<div class='page search'><h1>T</h1><p>the text of the page</div><div class='sidebar'><p>s</div>", "T\nthe text of the page"),
    ("<div class=modal><article><p>the text of the page</p><div class=share>tell</div></article></div><div>x</div>", "the text of the page"),
])
def test_rules_drop_nothing_else(body, want):
    assert wrapper.main_text(wrapper.parse(PAGE % body)[1], set()) == want


def _tree(rnd, width, depth=2):
    """Leaves, chains and nested blocks with few texts, so that many matchings tie."""
    out = []
    for _ in range(rnd.randint(width // 2, width)):
        kind = rnd.random()
        if kind < 0.4 or not depth:
            out.append(f"<p>{rnd.choice('abcdefgh')}</p>")
        elif kind < 0.6:
            out.append(f"<ul><li>{rnd.choice('abc')}</li></ul>")
        else:
            out.append(f"<div>{_tree(rnd, 3, depth - 1)}</div>")
    return "".join(out)


def _best(a, b):
    """Textbook matching: (equal leaves, nodes) of two child lists."""
    best = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, c in enumerate(a):
        for j, d in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j])
            if c.label == d.label:
                e, n = _best(c.children, d.children) if c.text is None else (int(c.text == d.text), 0)
                best[i + 1][j + 1] = max(best[i + 1][j + 1], (best[i][j][0] + e, best[i][j][1] + n + 1))
    return best[-1][-1]


@pytest.mark.parametrize("width", [4, 12, 60, 120])
def test_matching_is_the_best_at_every_size(width):
    for seed in range(4):
        rnd = random.Random(seed)
        a, b = (wrapper.parse(_tree(rnd, width))[0] for _ in range(2))
        pairs = []
        wrapper.align(a, b, pairs)
        assert sum(x.text == y.text for x, y in pairs) == _best(a.children, b.children)[0]
        for side in (0, 1):
            order = [p[side].order for p in pairs]
            assert len(set(order)) == len(order)
        by_order = sorted(pairs, key=lambda p: p[0].order)
        assert [p[1].order for p in by_order] == sorted(p[1].order for p in pairs)


@pytest.mark.parametrize("before", [3, 25, 70])
def test_notice_in_long_lists_is_found(spark, before):
    def page(i):
        rnd = random.Random(i)
        words = [f"<p>text {i} {k}</p>" for k in range(before + 20)]
        return "<article>" + "<h2>x</h2>" * 9 * (i % 2) + "".join(words[:before + rnd.randint(0, 4)]) + "<p>Call us now</p>" + "".join(words[before + 4:]) + "</article>"
    df = spark.createDataFrame([(i, f"http://h.org/{i}", page(i)) for i in range(30)], "page_id long, url string, html string")
    assert not [r.page_id for r in wrapper.extract(df).collect() if "Call us now" in r.text or f"text {r.page_id} 0" not in r.text]


@pytest.mark.parametrize("small", [4 << 20, 0])
def test_template_is_found_over_all_pages_of_a_host(spark, small):
    rows = [(i, f"http://small.org/{i}", f"<p>Call us now</p><p>own text of {i}</p>") for i in range(8)]
    rows += [(100 + i, f"http://odd.org/{i}", "" if i < 3 else f"<p>Call us now</p><p>own text of {100 + i}</p>") for i in range(40)]
    rows += [(200 + i, f"http://most.org/{i}", ("<p>Call us now</p>" if i % 10 < 7 else "") + f"<p>own text of {200 + i}</p>") for i in range(40)]
    rows += [(300 + i, f"http://two.org/{i}", f"<p>{('Call us now', 'Call us today')[i % 2]}</p><p>own text of {300 + i}</p>") for i in range(40)]
    rows += [(400 + i, f"http://types.org/{i}", f"<div class=news><p>own text of {400 + i}</p></div>" if i % 5 else
              f"<div class=goods><p>own text of {400 + i}</p><p>Call us now</p></div>") for i in range(60)]
    rows += [(500 + i, f"http://copies.org/{i}", f"<div class=ad>{i}</div><p>Call us now</p><p>own text of 500</p>") for i in range(30)]
    rows += [(600 + i, f"http://few.org/{i}", f"<p>Call us now</p><p>own text of {600 + i}</p>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.extract(df, small=small).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        if i >= 500:
            assert got[i].startswith("Call us now\nown text of ")
        else:
            assert got[i] == (f"own text of {i}" if html else "")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation(n):
    numbers = np.arange(n)
    slots = training.permute(numbers, n, 7)
    assert sorted(slots.tolist()) == numbers.tolist() and (training.permute(slots, n, 7, back=True) == numbers).all()
    assert n < 100 or (slots != training.permute(numbers, n, 8)).any()


def test_training_shards(spark):
    folder = tempfile.mkdtemp(prefix="quire-docs-")
    texts = [(1, "hello world " * 50), (2, None), (3, ""), (4, "ünïcode \x00 \n\n x" * 30), (4, "ünïcode \x00 \n\n x" * 30)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/d")
    docs = spark.read.parquet(f"{folder}/d")
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    layout = training.write_shards(docs, f"{folder}/shards", ranks, public_tokenizers.PATTERN, length=16, per_shard=4, key=3)
    rows = sorted(training.read_shards(spark, layout).collect(), key=lambda r: r.number)
    encoder, stream = training.Encoder(ranks, public_tokenizers.PATTERN), []
    for r in docs.collect():
        stream += encoder.ids(r.text) + [50256] if r.text else []
    stream += [50256] * (-len(stream) % 16)
    assert np.frombuffer(b"".join(bytes(r.ids) for r in rows), dtype="<u2").tolist() == stream
    assert sorted(r.slot for r in rows) == list(range(layout["sequences"])) and all((r.shard, r.offset) == training.locate(layout, r.slot) for r in rows)
    assert {r.slot for r in training.read_shards(spark, layout, first=6).collect()} == set(range(6, layout["sequences"]))
    assert training.read_layout(spark, f"{folder}/shards") == layout
    # several shards in a task, columns with the names of the results, rows that lie in no file
    named = spark.createDataFrame([(i, f"text number {i} of some words", 1, 2) for i in range(60)], "shard int, text string, task int, slot int").repartition(3)
    wide = training.write_shards(named, f"{folder}/wide", ranks, public_tokenizers.PATTERN, length=8, per_shard=4, tasks=3)
    assert sorted(r.slot for r in training.read_shards(spark, wide).collect()) == list(range(wide["sequences"])) and wide["sequences"] > 48
    # against the library
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    odd = [t for _, t in texts if t] + ["It's 12345 ½ ² Ⅻ days\u2028 later\x1c!", "漢字 かな 한국어 \U0001f600", "a_b  c\t\n d"]
    assert [encoder.ids(t) for t in odd] == [library.encode_ordinary(t) for t in odd]
    nothing = training.write_shards(docs.where("text is null"), f"{folder}/none", ranks, public_tokenizers.PATTERN)
    assert training.read_shards(spark, nothing).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base = [" ".join(word() for _ in range(60)) for _ in range(40)]
    passage = " ".join(word() for _ in range(55))
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x") for i, t in enumerate(base)]
    rows += [(100, base[0], "en", "s0", 1, "x"), (101, base[1] + " more", "en", "s1", 1, "x"), (102, "short", "en", "s0", 1, "x"), (103, None, None, None, None, None),
             (104, base[2] + " " + " ".join(word() for _ in range(200)), "en", "s1", 1, "x"), (None, base[3], "en", "s1", 1, "x"), rows[5]]
    rows += [(110 + i, " ".join(word() for _ in range(80)) + " " + passage, "en", "s2", 1, "x") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs = P.quality_rules(spark, docs, DATA)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"] and not {102, 103} & {r.doc_id for r in docs.collect()}
    docs = P.stored(P.near_duplicates(spark, docs, DATA), "t")
    ids = [r.doc_id for r in docs.collect()]
    assert not {100, 101} & set(ids) and {*range(40), 104, 110, 111, 112} <= set(ids) and ids.count(5) == 1
    docs = P.stored(P.substring_dedup(spark, docs, DATA), "t")
    texts = {r.doc_id: r for r in docs.collect()}
    assert passage in texts[110].text and passage not in texts[111].text and base[2] not in texts[104].text
    assert all(texts[i].text == base[i] and texts[i].n_chars == len(base[i]) for i in range(40)) and texts[104].kept == "x"
    mixed = P.stored(P.mixing_weights(spark, docs, DATA), "t")
    assert mixed.columns == docs.columns and mixed.count() > docs.count()
    out = P.piece_encoding(spark, mixed, DATA)
    assert out.count() == mixed.count() and out.where("n_tokens > 0").count() == out.count()
