"""Alignment of element texts with page boxes (A-1..A-18, A-22).

Work is done on distinct texts of a document, so repeated ones are matched once; matches meet their rows on (doc_id, tkey), the hash of the text, never on
the text. A page is one row with its boxes as an array. Pages that hold a text are found where both meet (``pagesearch``). Scoring and box picking are array
expressions on the (target, page) row. The search and the last, rare tier leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from quire.functions import boxes as B
from quire.functions.arrays import inline_rows, let
from quire.functions.text import form_words, normalize_for_match, strip, token_share, words
from quire.operators.pagesearch import Pages, searched
from quire.operators.similarity import Sought
from quire.session import by_key, stored

MIN_PAGE_SCORE = 0.20
OVERLAP_WEIGHT = 0.55
MATCH = "struct<page_number:int,pdf_rects:array<array<double>>,pdf_locations:array<struct<page:int,bbox:array<double>>>,match_confidence:string>"


def _words(norm: Column) -> Column:
    return let(normalize_for_match(norm), form_words)


def _streamed(boxes: Column) -> Column:
    """Give each box its place in the page's text stream (one separator between boxes)."""
    def step(acc: Column, b: Column) -> Column:
        stop = acc["cursor"] + F.length(b["norm"])
        placed = F.struct(b["block_index"].alias("block_index"), b["bbox"].alias("bbox"), b["text"].alias("text"), b["norm"].alias("norm"),
                          b["column"].alias("column"), b["is_heading"].alias("is_heading"), b["is_bullet"].alias("is_bullet"),
                          b["n_words"].alias("n_words"), acc["cursor"].alias("start"), stop.alias("stop"))
        return F.struct((stop + 1).alias("cursor"), F.concat(acc["out"], F.array(placed)).alias("out"))

    none = F.array().cast("array<struct<block_index:int,bbox:array<double>,text:string,norm:string,column:string,is_heading:boolean,"
                          "is_bullet:boolean,n_words:int,start:int,stop:int>>")
    return F.aggregate(boxes, F.struct(F.lit(0).alias("cursor"), none.alias("out")), step, lambda acc: acc["out"])


def _stream_text(boxes: Column) -> Column:
    return F.array_join(F.transform(boxes, lambda b: b["norm"]), " ")


def index_pages(pages: DataFrame) -> DataFrame:
    """A-1 in page form: kept boxes with flags and stream offsets; ``body`` leaves out headings.

    Input rows are pages as read by ``load_pages``.
    """
    sound = F.filter("boxes", lambda b: (b["norm"] != "") & b["bbox"].isNotNull())
    # Stepwise, so that each text is normalised and counted once.
    normed = F.transform(sound, lambda b: F.struct(b.alias("b"), normalize_for_match(b["text"]).alias("m")))
    counted = F.transform(normed, lambda x: x.withField("n", form_words(x["m"])))
    kept = F.filter(counted, lambda x: ~B.metadata_box(x["b"]["text"], x["m"], x["n"]))
    flagged = F.transform(kept, lambda x: F.struct(
        x["b"]["block_index"].alias("block_index"), x["b"]["bbox"].alias("bbox"), x["b"]["text"].alias("text"), x["b"]["norm"].alias("norm"),
        B.page_column(F.get(x["b"]["bbox"], F.lit(0)), F.get(x["b"]["bbox"], F.lit(2))).alias("column"),
        B.heading_box(x["b"]["text"], x["m"], x["n"]).alias("is_heading"),
        B.is_bullet_box(x["b"]["text"]).alias("is_bullet"), _words(x["b"]["norm"]).alias("n_words")))
    return _with_texts(pages.select("doc_id", "page_number", _streamed(flagged).alias("boxes")))


def _with_texts(placed: DataFrame) -> DataFrame:
    body = placed.withColumn("body", _streamed(F.filter("boxes", lambda b: ~b["is_heading"])))
    return body.withColumns({"stream": _stream_text(F.col("boxes")), "body_text": _stream_text(F.col("body"))})


def kept_pages(pages: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """Indexed pages, written once as their boxes: the body and both texts repeat these and are made again where they are read."""
    return _with_texts(keep(pages.select("doc_id", "page_number", "boxes"), "pages"))


def text_key(t: Column | str = "t") -> Column:
    return F.unhex(F.md5(t))


def targets_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct comparable texts per document, with their key."""
    rows = texts.select("doc_id", normalize_for_match(F.col(text)).alias("t")).where(F.col("t") != "")
    return rows.withColumn("tkey", text_key()).dropDuplicates(["doc_id", "tkey"])


def _keyed(targets: DataFrame) -> DataFrame:
    return targets if "tkey" in targets.columns else targets.withColumn("tkey", text_key())


def _best_pages(pages: list, texts: list) -> Iterator[tuple]:
    """(tkey, text, page, score) for each text of a document, page and score NULL when no page scores enough."""
    index = Pages([p[0] for p in pages], [p[2] for p in pages])
    for _, tkey, t in texts:
        page, score = None, None
        if t and pages:
            needles = [(1.0, t)] + ([(0.92, t[:220]), (0.88, t[-220:])] if len(t) > 50 else [])
            for worth, needle in needles[:1] if len(t) <= 220 else needles:
                place = next(index.holding(needle), None)
                if place is not None:
                    page, score = index.numbers[place], worth
                    break
            else:
                found = index.overlapping(t, MIN_PAGE_SCORE / OVERLAP_WEIGHT)
                if found and found[1] * OVERLAP_WEIGHT >= MIN_PAGE_SCORE:
                    page, score = index.numbers[found[0]], found[1] * OVERLAP_WEIGHT
        yield tkey, t, page, score


def best_page(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """A-3: the targets with best_page and page_score; both NULL when no page scores enough.

    A page that contains the text, or of a long one its first or last 220 characters, goes before token overlap, and the first of equal pages wins.
    """
    every = _keyed(targets)
    streams = pages.select("doc_id", F.col("page_number").cast("long").alias("number"), F.lit(None).cast("binary").alias("tkey"), F.col("stream").alias("text")).where(F.col("text") != "")
    sought = every.select("doc_id", F.lit(None).cast("long").alias("number"), "tkey", F.col("t").alias("text"))
    doc, number = (next(f.dataType.simpleString() for f in df.schema if f.name == c) for df, c in ((every, "doc_id"), (pages, "page_number")))

    def ask(doc_id, own: list, texts: list) -> Iterator[tuple]:
        return ((doc_id, *row) for row in _best_pages(own, texts))

    found = searched(streams, sought, ask, f"doc_id {doc}, tkey binary, t string, best_page {number}, page_score double")
    others = [c for c in every.columns if c not in ("doc_id", "tkey", "t")]
    return found if not others else every.join(found.drop("t").dropDuplicates(["doc_id", "tkey"]), ["doc_id", "tkey"], "left")


def _paged(pages: DataFrame, columns: tuple[str, ...], max_boxes: int | None) -> DataFrame:
    """(doc_id, ps): the pages of a document in order, each number once; texts and next boxes are made here, behind the shuffle."""
    made = ("body_text", "next1", "next2")
    grouped = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", *[c for c in columns if c not in made]))).alias("ps"))
    once = let(F.col("ps"), lambda ps: F.filter(ps, lambda p, i: F.coalesce(F.get(ps, i - 1)["page_number"] != p["page_number"], F.lit(True))))

    def page(ps: Column, p: Column, i: Column) -> Column:
        def after(k: int) -> Column:
            # the page so many numbers on is the next one or, for the second, the one behind it
            rivals = [F.get(ps, i + j) for j in range(1, k + 1)]
            return F.coalesce(*[F.when(q["page_number"] == p["page_number"] + k, _slim(F.slice(q["body"], 1, max_boxes), q["page_number"])) for q in rivals])

        extra = {"body_text": lambda: _stream_text(p["body"]), "next1": lambda: after(1), "next2": lambda: after(2)}
        return F.struct(p["page_number"].alias("page_number"), *[(extra[c]() if c in made else p[c]).alias(c) for c in columns])

    return grouped.select("doc_id", let(once, lambda ps: F.transform(ps, lambda p, i: page(ps, p, i))).alias("ps"))


def candidate_pages(located: DataFrame, pages: DataFrame, *columns: str, back: int = 1, fwd: int = 2, headed: bool = False, max_boxes: int = 8) -> DataFrame:
    """A-4: target rows with each page to search, and the named columns of it.

    A located text is looked for around its page, a text without a page on all pages of its document; with ``headed`` only on pages whose body
    contains the text's ``head``. ``next1`` and ``next2`` are the first ``max_boxes`` body boxes of the next two pages, for texts that run on (A-13).
    The pages and the texts of a document meet in one row and are paired there, so each moves once, whatever the number of pages a text is looked for on.
    """
    names = [c for c in located.columns if c != "doc_id"]
    texts = located.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("ts"))
    met = by_key(texts).join(_paged(pages, columns, max_boxes), "doc_id")

    def rows(t: Column) -> Column:
        def wanted(p: Column) -> Column:
            near = t["best_page"].isNull() | p["page_number"].between(t["best_page"] - back, t["best_page"] + fwd)
            return near & F.contains(p["body_text"], t["head"]) if headed else near

        return F.transform(F.filter("ps", wanted), lambda p: F.struct(*[t[c].alias(c) for c in names], *[p[c].alias(c) for c in ("page_number", *columns)]))

    return inline_rows(met, F.flatten(F.transform("ts", rows)), "doc_id", key="page_number").select(*located.columns, "page_number", *columns)


def _summary(picked: Column, target_words: Column) -> Column:
    """A-22: rectangles, locations, page and confidence of the picked boxes."""
    return let(B.dedupe_locations(picked), lambda places: F.struct(
        B.primary_page(places).cast("int").alias("page_number"), B.dedupe_rects(F.transform(picked, lambda b: b["bbox"])).alias("pdf_rects"),
        places.alias("pdf_locations"), B.confidence(_total(picked), target_words).alias("match_confidence")))


def _total(boxes: Column) -> Column:
    return F.aggregate(boxes, F.lit(0), lambda n, b: n + b["n_words"])


def _slim(boxes: Column, page: Column) -> Column:
    return F.transform(boxes, lambda b: F.struct(page.cast("int").alias("page"), b["bbox"].alias("bbox"), b["norm"].alias("norm"), b["n_words"].alias("n_words")))


def _boxes_starting(body: Column, text: Column, needle: Column) -> Column:
    """Boxes in which an occurrence of ``needle`` begins, with its first and last place.

    An occurrence that begins in a box lies inside the box plus the needle's length.
    """
    def look(b: Column, i: Column, sought: Column) -> Column:
        size = F.length(sought)
        window = F.substring(text, b["start"] + 1, b["stop"] - b["start"] + size - 1)

        def places(w: Column) -> Column:
            first, back = F.position(sought, w), F.position(F.reverse(sought), F.reverse(w))
            return F.struct(i.alias("i"), first.alias("hit"), (b["start"] + first).alias("first"),
                            (b["start"] + F.length(w) - back - size + 2).alias("last"))

        return let(window, places)

    found = let(needle, lambda sought: F.transform(body, lambda b, i: look(b, i, sought)))
    return F.filter(found, lambda x: x["hit"] > 0)


def _best_row(df: DataFrame, rated: Column, *keep: str) -> DataFrame:
    """Rows with the fields of the greatest struct in ``rated``; rows without one drop out.

    The generator is a border for the optimizer, which would otherwise copy the whole
    rating into a filter.
    """
    return inline_rows(df, F.filter(F.array(F.array_max(rated)), lambda x: x.isNotNull()), *keep, key="score")


def head_tail_match(candidates: DataFrame) -> DataFrame:
    """A-11 on candidate rows: the best run of boxes from a head hit to a tail hit."""
    t, body, text = F.col("t"), F.col("body"), F.col("body_text")
    head, tail = F.col("head"), F.right(t, B.tail_length(F.length(t)))
    ready = candidates.where((B.tail_length(F.length(t)) > 0) & F.contains(text, tail) & F.contains(text, head)).withColumns(
        {"heads": _boxes_starting(body, text, head), "tails": _boxes_starting(body, text, tail)})

    def rate(h: Column, e: Column) -> Column:
        run = F.slice(body, h["i"] + 1, e["i"] - h["i"] + 1)
        joined = F.substring(text, F.get(body, h["i"])["start"] + 1, F.get(body, e["i"])["stop"] - F.get(body, h["i"])["start"])
        score = let(joined, lambda c: B.text_match_score(t, c)) + let(_total(run), lambda n: B.ratio_size_score(
            n, F.col("target_words"), e["i"] - h["i"] + 1))
        return F.struct(score.alias("score"), (-h["i"]).alias("a"), (-e["i"]).alias("b"))

    pairs = F.flatten(F.transform("heads", lambda h: F.transform(
        F.filter("tails", lambda e: (e["i"] > h["i"]) | ((e["i"] == h["i"]) & (e["last"] >= h["first"]))), lambda e: rate(h, e))))
    best = _best_row(ready, pairs, "doc_id", "tkey", "t", "page_number", "body", "target_words")
    run = F.slice(body, 1 - F.col("a"), F.col("a") - F.col("b") + 1)
    return best.select("doc_id", "tkey", "t", "page_number", "score", _summary(_slim(run, F.col("page_number")), F.col("target_words")).alias("match"))


def _until(boxes: Column, already: Column, goal: Column) -> Column:
    """The shortest prefix of ``boxes`` that lifts ``already`` to ``goal`` words; all of them if none does."""
    sums = F.aggregate(boxes, F.array().cast("array<int>"), lambda acc, b: F.concat(
        acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), already) + b["n_words"])))
    enough = let(sums, lambda s: F.size(F.filter(s, lambda n: n < goal)) + 1)
    return F.slice(boxes, F.lit(1), F.least(enough, F.size(boxes)))


def head_only_match(candidates: DataFrame, max_boxes: int = 8) -> DataFrame:
    """A-12 with A-13: boxes from a head hit on, until enough words are collected."""
    t, body, text = F.col("t"), F.col("body"), F.col("body_text")
    goal, full = F.col("target_words") * 0.8, F.col("target_words") * 0.85
    nothing = F.array().cast("array<struct<page:int,bbox:array<double>,norm:string,n_words:int>>")
    limit = F.coalesce(F.col("best_page") + 2, F.lit((1 << 31) - 1))
    following = F.concat(*[F.when(F.col("page_number") + k <= limit, F.coalesce(f"next{k}", nothing)).otherwise(nothing) for k in (1, 2)])
    ready = candidates.where(F.contains(text, F.col("head"))).withColumns({
        "heads": _boxes_starting(body, text, F.col("head")), "following": following, "slim": _slim(body, F.col("page_number"))})

    def collect(h: Column) -> Column:
        own = _until(F.slice("slim", h["i"] + 1, F.lit(max_boxes)), F.lit(0), goal)
        return let(own, lambda o: let(_total(o), lambda n: F.when(
            (F.col("target_words") > 0) & (n < full), F.concat(o, _until(F.col("following"), n, full))).otherwise(o)))

    def rate(run: Column, h: Column) -> Column:
        joined = F.array_join(F.transform(run, lambda b: b["norm"]), " ")
        score = let(joined, lambda c: B.text_match_score(t, c)) + let(_total(run), lambda n: B.ratio_size_score(
            n, F.col("target_words"), F.size(run)))
        return F.struct(score.alias("score"), (-h["i"]).alias("a"), run.alias("run"))

    rated = F.transform("heads", lambda h: let(collect(h), lambda run: rate(run, h)))
    best = _best_row(ready, rated, "doc_id", "tkey", "t", "page_number", "target_words")
    return best.select("doc_id", "tkey", "t", "page_number", "score", _summary(F.col("run"), F.col("target_words")).alias("match"))


def _best_of_pages(matches: DataFrame) -> DataFrame:
    """The match with the best confidence, on the earliest page."""
    rank = F.struct(B.confidence_rank(F.col("match.match_confidence")), -F.col("page_number"))
    return matches.groupBy("doc_id", "tkey").agg(F.max_by("match", rank).alias("match"))


WINDOW = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
WINDOW_BOXES = 4
MIN_RATIO = 0.35
#: Characters that are counted apart for the bound; all others count as one.
COUNTED = ["e", "t", "a", "o", "i", "n", "s", "r", "h", "l", "d", "c", "u", "m", "p", "f", "g", " ", "0123456789"]


@F.pandas_udf(WINDOW)
def best_window(targets: pd.Series, norms: pd.Series, windows: pd.Series, floors: pd.Series) -> pd.DataFrame:
    """A-14 on one page: the most similar of the given runs of boxes, the earliest on ties; none (score -1) if all are below ``floor`` or the least ratio of all.

    Runs come with an upper bound of their ratio and are compared best bound first, until the bounds fall below the best ratio.
    """
    rows = []
    for target, boxes, runs, floor in zip(targets, norms, windows, floors):
        best, place, found = max(floor, MIN_RATIO), (len(boxes), 0), False
        sought = Sought(target)
        for run in sorted(runs, key=lambda r: (-r["bound"], r["first"], r["last"])):
            at = (run["first"], run["last"])
            if run["bound"] < best:
                break
            if run["bound"] == best and at > place:
                continue
            text = ""
            for norm in boxes[run["first"]:run["last"] + 1]:
                text = f"{text} {norm}".strip()
            ratio = sought.ratio(text, best)
            if ratio > best or (ratio == best and at < place):
                best, place, found = ratio, at, True
        rows.append((best, *place) if found else (-1.0, -1, -1))
    return pd.DataFrame(rows, columns=["score", "first", "last"])


def _profile(text: Column) -> Column:
    """How often a text has each of the counted characters, and all others together."""
    def without(c: str) -> Column:
        return F.replace(text, F.lit(c), F.lit("")) if len(c) == 1 else F.regexp_replace(text, f"[{c}]", "")

    counts = [F.length(text) - F.length(without(c)) for c in COUNTED]
    rest = F.length(text)
    for c in counts:
        rest = rest - c
    return F.array(*counts, rest)


def _windows(body: Column) -> Column:
    """All runs of one to ``WINDOW_BOXES`` boxes with their length and profile: the sums of their boxes', and a blank between two.

    Each box is counted once; its ``norm`` is trimmed and not empty, so joining loses nothing.
    """
    def run(sized: Column, i: Column, k: Column) -> Column:
        part = F.slice(sized, i + 1, k + 1)
        blanks = F.array(*[k if c == " " else F.lit(0) for c in COUNTED], F.lit(0))
        return F.struct(
            i.alias("first"), (i + k).alias("last"), F.aggregate(part, k, lambda n, b: n + b["n"]).alias("n"),
            F.aggregate(part, blanks, lambda acc, b: F.zip_with(acc, b["profile"], lambda x, y: x + y)).alias("profile"))

    def all_runs(sized: Column) -> Column:
        return F.flatten(F.transform(sized, lambda _, i: F.transform(
            F.sequence(F.lit(0), F.least(F.lit(WINDOW_BOXES - 1), F.size(sized) - 1 - i)), lambda k: run(sized, i, k))))

    return let(F.transform(body, lambda b: let(b["norm"], lambda x: F.struct(F.length(x).alias("n"), _profile(x).alias("profile")))), all_runs)


def _bounded(windows: Column, length: Column, profile: Column) -> Column:
    """Runs that can reach the least ratio, with the bound: no more characters match than both texts have of each kind."""
    def rate(w: Column) -> Column:
        shared = F.aggregate(F.zip_with(w["profile"], profile, lambda a, b: F.least(a, b)), F.lit(0), lambda n, x: n + x)
        return F.struct(w["first"].alias("first"), w["last"].alias("last"), (shared * 2.0 / (w["n"] + length)).alias("bound"))

    return F.filter(F.transform(windows, rate), lambda w: w["bound"] >= MIN_RATIO)


def window_candidates(located: DataFrame, pages: DataFrame, back: int = 1, fwd: int = 2) -> DataFrame:
    """(doc_id, tkey, page_number, windows): the runs on each page to search that the bound lets through; no text is moved."""
    # read by both joins, written once
    narrow = stored(pages.select("doc_id", "page_number", "body").where(F.size("body") > 0).select("doc_id", "page_number", _windows(F.col("body")).alias("windows")), "page-windows")
    sought = located.select("doc_id", "tkey", "best_page", F.length("t").alias("n"), _profile(F.col("t")).alias("profile"))
    near = sought.where(F.col("best_page").isNotNull()).withColumn("page_number", F.explode(F.sequence(F.col("best_page") - back, F.col("best_page") + fwd)))
    lost = sought.where(F.col("best_page").isNull())
    rows = near.join(narrow, ["doc_id", "page_number"]).unionByName(lost.join(narrow, "doc_id"))
    return inline_rows(rows, F.filter(F.array(F.struct("page_number", _bounded(F.col("windows"), F.col("n"), F.col("profile")).alias("windows"))), lambda x: F.size(x["windows"]) > 0),
                       "doc_id", "tkey", key="page_number")


def best_windows(located: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, tkey, page_number, score, first, last): the most similar run of each page that can still hold a text's best.

    Filter and verify: bounds are computed in the JVM; the run with the greatest bound of each text is compared first, and then only those whose bound
    is not below its ratio.
    """
    candidates = stored(window_candidates(located, pages), "windows")
    texts = located.select("doc_id", "tkey", "t")
    bodies = pages.select("doc_id", "page_number", F.transform("body", lambda b: b["norm"]).alias("norms"))
    spark = located.sparkSession
    # comparing costs far more than the size of the rows tells, so they are spread by number, not by bytes
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def compared(rows: DataFrame, name: str) -> DataFrame:
        whole = rows.join(texts, ["doc_id", "tkey"]).join(bodies, ["doc_id", "page_number"]).repartition(tasks, "doc_id", "tkey", "page_number")
        return stored(whole.select("doc_id", "tkey", "page_number", best_window("t", "norms", "windows", "floor").alias("w")).select("doc_id", "tkey", "page_number", "w.*"), name)

    top = F.array_max(F.transform("windows", lambda w: F.struct(w["bound"].alias("bound"), (-w["first"]).alias("a"), (-w["last"]).alias("b"))))
    seeds = candidates.groupBy("doc_id", "tkey").agg(F.max(F.struct(top.alias("top"), (-F.col("page_number")).alias("rev"))).alias("s")).select(
        "doc_id", "tkey", (-F.col("s.rev")).alias("page_number"), F.lit(-1.0).alias("floor"),
        F.array(F.struct((-F.col("s.top.a")).alias("first"), (-F.col("s.top.b")).alias("last"), F.col("s.top.bound").alias("bound"))).alias("windows"))
    reached = compared(seeds, "seed-windows")
    floors = reached.select("doc_id", "tkey", F.col("page_number").alias("_page"), F.col("score").alias("floor"), F.col("first").alias("_first"), F.col("last").alias("_last"))
    still = F.expr("filter(windows, w -> w.bound >= floor AND NOT (page_number = _page AND w.first = _first AND w.last = _last))")
    able = candidates.join(floors, ["doc_id", "tkey"]).withColumn("windows", still).where(F.size("windows") > 0).drop("_page", "_first", "_last")
    return reached.unionByName(compared(stored(able, "open-windows"), "compared-windows").where("score >= 0"))


def fuzzy_window_match(located: DataFrame, pages: DataFrame) -> DataFrame:
    """A-14: similarity of box runs around the estimated page, for texts no anchor found."""
    place = F.struct("score", -F.col("page_number"), -F.col("first"), -F.col("last"))
    best = best_windows(located, pages).where(F.col("score") >= MIN_RATIO).groupBy("doc_id", "tkey").agg(
        F.max_by(F.struct("page_number", "first", "last"), place).alias("w")).select("doc_id", "tkey", "w.*")
    run = F.slice("body", F.col("first") + 1, F.col("last") - F.col("first") + 1)
    whole = best.join(located.select("doc_id", "tkey", "t", "target_words"), ["doc_id", "tkey"]).join(pages.select("doc_id", "page_number", "body"), ["doc_id", "page_number"])
    return whole.select("doc_id", "tkey", "t", _at_most_medium(_summary(_slim(run, F.col("page_number")), F.col("target_words"))).alias("match"))


def _at_most_medium(match: Column) -> Column:
    return match.withField("match_confidence", F.when(match["match_confidence"] == "high", "medium").otherwise(match["match_confidence"]))


def match_bullet_boxes(located: DataFrame, pages: DataFrame) -> DataFrame:
    """Last resort of A-16: one bullet box or two neighbouring ones."""
    bullets = pages.withColumn("bullets", F.filter("boxes", lambda b: b["is_bullet"])).where(F.size("bullets") > 0)
    rows = candidate_pages(located, bullets, "bullets")
    t = F.col("t")

    def rate(i: Column, n: int) -> Column:
        joined = F.array_join(F.transform(F.slice("bullets", i + 1, F.lit(n)), lambda b: b["norm"]), " ")
        score = let(joined, lambda j: F.greatest(B.text_match_score(t, j), token_share(
            F.array_distinct(words(t)), F.array_distinct(words(j))) * 0.85))
        return F.struct(score.alias("score"), (-i).alias("a"), F.lit(-n).alias("b"))

    single = F.transform("bullets", lambda _, i: rate(i, 1))
    double = F.transform(F.slice("bullets", F.lit(2), F.size("bullets")), lambda _, i: rate(i, 2))
    best = _best_row(rows, F.concat(single, double), "doc_id", "tkey", "page_number", "bullets", "target_words").where(F.col("score") >= 0.35)
    run = F.slice("bullets", 1 - F.col("a"), -F.col("b"))
    picked = best.select("doc_id", "tkey", F.struct(F.col("score"), -F.col("page_number")).alias("rank"), _summary(_slim(run, F.col("page_number")), F.col("target_words")).alias("match"))
    return picked.groupBy("doc_id", "tkey").agg(F.max_by("match", "rank").alias("match")).withColumn("match", _at_most_medium(F.col("match")))


def locate(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets with their page estimate, word count and head anchor."""
    head = F.substring(F.col("t"), F.lit(1), B.head_length(F.length("t")))
    return best_page(targets, pages).select("doc_id", "tkey", "t", "best_page", F.size(words(F.col("t"))).alias("target_words"), head.alias("head"))


def match_targets(targets: DataFrame, pages: DataFrame, *, max_boxes: int = 8, bullets: bool = False, kept: bool = False) -> DataFrame:
    """A-15 (or A-16 with ``bullets``): (doc_id, tkey, match) through the tiers, cheapest first.

    Each tier sees only what the tiers before it left over. Pages are read by every tier, so they are written first unless they are ``kept`` already.
    """
    pages = pages if kept else kept_pages(pages)
    located = stored(locate(targets, pages), "located")
    keys = ["doc_id", "tkey"]
    # The tiers are written out once; every later tier anti-joins the finished ones.
    anchored = stored(_best_of_pages(head_tail_match(candidate_pages(located, pages, "body", "body_text", headed=True))), "head-tail")
    open_ = located.join(by_key(anchored.select(*keys)), keys, "left_anti")
    near = candidate_pages(open_, pages, "body", "body_text", "next1", "next2", headed=True, max_boxes=max_boxes)
    headed = stored(_best_of_pages(head_only_match(near, max_boxes)), "head-only")
    done = anchored.unionByName(headed)
    fuzzy = fuzzy_window_match(located.join(done.select(*keys), keys, "left_anti"), pages).drop("t")
    if not bullets:
        return done.unionByName(fuzzy)
    done = stored(done.unionByName(fuzzy), "matched")
    return done.unionByName(match_bullet_boxes(located.join(done.select(*keys), keys, "left_anti"), pages))


def no_match() -> Column:
    return F.struct(F.lit(None).cast("int").alias("page_number"), F.array().cast("array<array<double>>").alias("pdf_rects"),
                    F.array().cast("array<struct<page:int,bbox:array<double>>>").alias("pdf_locations"), F.lit("low").alias("match_confidence")).cast(MATCH)


def match_paragraphs(elements: DataFrame, pages: DataFrame, text: str = "text", *, kept: bool = False) -> DataFrame:
    """A-15: every element row with its ``match``; ``kept`` pages are written already."""
    keyed = elements.withColumn("tkey", text_key(normalize_for_match(F.col(text))))
    found = match_targets(targets_of(elements, text), pages, kept=kept)
    return keyed.join(found, ["doc_id", "tkey"], "left").withColumn("match", F.coalesce("match", no_match())).drop("tkey")


def match_bullet_lists(elements: DataFrame, pages: DataFrame, *, kept: bool = False) -> DataFrame:
    """A-17: (doc_id, element_index, match) for lists; the weakest item sets the confidence."""
    items = elements.select("doc_id", "element_index", F.posexplode("items").alias("item", "text")).withColumn("tkey", text_key(normalize_for_match(F.col("text")))).where(
        F.regexp_replace("text", r"(?U)\s", "") != "")
    found = match_targets(targets_of(items), pages, max_boxes=4, bullets=True, kept=kept)
    rows = items.join(found, ["doc_id", "tkey"], "left").withColumn("match", F.coalesce("match", no_match()))
    gathered = rows.groupBy("doc_id", "element_index").agg(
        F.sort_array(F.collect_list(F.struct("item", "match"))).alias("ms"), F.min(B.confidence_rank(F.col("match.match_confidence"))).alias("weakest"))
    rects = B.dedupe_rects(F.flatten(F.transform("ms", lambda m: m["match"]["pdf_rects"])))
    places = B.dedupe_locations(F.flatten(F.transform("ms", lambda m: m["match"]["pdf_locations"])))
    merged = gathered.select("doc_id", "element_index", rects.alias("rects"), places.alias("places"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("weakest")).alias("conf"))
    match = F.struct(B.primary_page(F.col("places")).cast("int").alias("page_number"), F.col("rects").alias("pdf_rects"), F.col("places").alias("pdf_locations"), F.col("conf").alias("match_confidence"))
    return merged.select("doc_id", "element_index", F.when(F.size("rects") > 0, match.cast(MATCH)).otherwise(no_match()).alias("match"))


HEADING_SCORE, HEADING_LIMIT = 0.72, 0.75


def _heading_pairs(boxes: list, titles: list) -> Iterator[tuple[int, int]]:
    """(title, box) that can still reach the limit with a nearness bonus.

    Such a score needs one of: the box contains the title or, of a long one, its first or last 180 characters; the title contains the box;
    the box has all tokens of the title.
    """
    index, pairs = Pages([], [b[2] for b in boxes]), set()
    for k, (_, _, t, _) in enumerate(titles):
        for needle in (t, t[:180], t[-180:]) if len(t) > 180 else (t,):
            pairs.update((k, i) for i in index.holding(needle))
        tokens = dict.fromkeys(t.split())
        if tokens:
            held = min((index.postings.get(x, []) for x in tokens), key=len)
            pairs.update((k, i) for i in held if all(x in index.tokens[i] for x in tokens))
    if any(len(text) > 60 for text in index.texts):
        within = Pages([], [t[2] for t in titles])
        for i, text in enumerate(index.texts):
            if len(text) > 60:
                pairs.update((k, i) for k in within.holding(text))
    return iter(sorted(pairs))


def heading_candidates(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, tkey, page, block, bbox, score): heading boxes that can still reach the limit with a nearness bonus, one row each."""
    rows = inline_rows(pages, F.transform(F.filter("boxes", lambda b: b["is_heading"]), lambda b: F.struct(
        F.col("page_number").alias("page"), b["block_index"].alias("block"), b["bbox"].alias("bbox"), b["norm"].alias("text"))), "doc_id", key="page")
    # a box takes the part of a page in the search
    number = (F.col("page").cast("long") * (1 << 31) + F.col("block")).alias("number")
    boxes = rows.select("doc_id", number, F.lit(None).cast("binary").alias("tkey"), "text", "bbox").where("text <> ''")
    titles = targets_of(headings).select("doc_id", F.lit(None).cast("long").alias("number"), "tkey", F.col("t").alias("text"), F.lit(None).cast("array<double>").alias("bbox"))
    doc = next(f.dataType.simpleString() for f in titles.schema if f.name == "doc_id")

    def ask(doc_id, own: list, asked: list) -> Iterator[tuple]:
        for k, i in _heading_pairs(own, asked) if own else ():
            (at, _, text, bbox), (_, tkey, t, _) = own[i], asked[k]
            yield doc_id, tkey, t, at >> 31, at & ((1 << 31) - 1), bbox, text

    met = searched(boxes, titles, ask, f"doc_id {doc}, tkey binary, t string, page int, block int, bbox array<double>, text string")
    t = F.col("t")
    roman = F.nullif(F.regexp_extract("t", B.ROMAN_PREFIX, 1), F.lit(""))
    fits = roman.isNull() | (F.regexp_extract("text", B.ROMAN_PREFIX, 1) == roman)
    return met.where(fits).select("doc_id", "tkey", "page", "block", "bbox", B.text_match_score(t, F.col("text")).alias("score")).where(F.col("score") >= HEADING_SCORE)


HEADING_RESULT = "doc_id long, element_index int, page_number int, bbox array<double>"


def pick_headings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A-18: headings in reading order take the best unused box on the last page or later.

    Rows are candidates in the order of (doc_id, element_index, page, block) and stream through; the state is one heading's best so far, the last page and
    the boxes used there, so neither a document nor a heading's candidates are held in memory.
    """
    doc, last, used, heading, best = None, None, set(), None, None

    def settle(out: list) -> None:
        nonlocal last, used
        if best is not None and best[0] >= HEADING_LIMIT:
            _, page, block, bbox = best
            used = (used if last == page else set()) | {block}
            last = page
            out.append((doc, heading, page, [float(v) for v in bbox]))

    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            if (row.doc_id, row.element_index) != (doc, heading):
                settle(out)
                if row.doc_id != doc:
                    last, used = None, set()
                doc, heading, best = row.doc_id, row.element_index, None
            if last is not None and (row.page < last or (row.page == last and row.block in used)):
                continue
            score = row.score + (0.0 if last is None else {0: 0.03, 1: 0.02}.get(row.page - last, 0.0))
            if best is None or score > best[0]:
                best = (score, int(row.page), row.block, row.bbox)
        yield pd.DataFrame(out, columns=["doc_id", "element_index", "page_number", "bbox"])
    out = []
    settle(out)
    yield pd.DataFrame(out, columns=["doc_id", "element_index", "page_number", "bbox"])


def match_headings(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """A-18: (doc_id, element_index, match) for heading rows.

    Sequential by nature: one sorted stream of narrow candidate rows per document.
    """
    # read twice below
    headings = stored(headings.select("doc_id", "element_index", "text"), "headings")
    keyed = headings.select("doc_id", "element_index", text_key(normalize_for_match(F.col("text"))).alias("tkey"))
    ordered = by_key(keyed).join(by_key(heading_candidates(headings, pages)), ["doc_id", "tkey"]).select("doc_id", "element_index", "page", "block", "bbox", "score")
    picked = ordered.repartition("doc_id").sortWithinPartitions("doc_id", "element_index", "page", "block").mapInPandas(pick_headings, HEADING_RESULT)
    match = F.struct(F.col("page_number"), F.array("bbox").alias("pdf_rects"), F.array(F.struct(F.col("page_number").alias("page"), F.col("bbox"))).alias("pdf_locations"),
                     F.lit("high").alias("match_confidence"))
    return picked.select("doc_id", "element_index", match.cast(MATCH).alias("match"))


def align_elements(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Attach positions to all elements of a corpus, by element type."""
    # read by all three, written once
    pages = kept_pages(pages)
    paragraphs = match_paragraphs(elements.where(F.col("type") == "paragraph"), pages, kept=True).select("doc_id", "element_index", "match")
    lists = match_bullet_lists(elements.where(F.col("type") == "bullet_list"), pages, kept=True)
    headings = match_headings(elements.where(F.col("type") == "heading"), pages)
    found = paragraphs.unionByName(lists).unionByName(headings)
    return elements.join(found, ["doc_id", "element_index"], "left").withColumn("match", F.coalesce("match", no_match())).select(
        *elements.columns, "match.*")
