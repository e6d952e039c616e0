"""Pieces, languages, quality statistics, word hashes."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from quire.llm import langid, pieces, quality
from quire.llm.words import Hasher, grams

from conftest import DATA

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "   a", "\n", "a\n\nb", "▁", "▁▁ a", "日本語テキスト 🙂🙃 é", "\x00\x01\x7f", "a" * 500, " " * 40, "<s> </s> <unk> <0x41>", "�﻿", "tab\tx y　z", "trail   ", "12 345"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library(library):
    with open(MODEL, "rb") as f:
        model = pieces.Pieces(f.read())
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice(" ab▁é🙂\n<0x>s/▁1") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    for t in texts:
        want = library.encode(t)
        assert model.ids(t) == want and model.decode(want) == library.decode(want)
        proto = library.encode(t, return_type="proto")
        assert model.spans(t) == [(p.id, p.begin, p.end) for p in proto.pieces]
        slow = pieces.Pieces.__new__(pieces.Pieces)
        slow.__dict__.update(model.__dict__, bulk=None, cache={})
        assert slow.ids(t) == want
    for _ in range(3000):
        ids = [rnd.randrange(32000) if rnd.random() < 0.5 else rnd.randrange(259) for _ in range(rnd.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_character_map_takes_the_longest_prefix():
    """Against the library's own rule set, with the place of every normalised character."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = proto.ModelProto()
    spec.ParseFromString(normalizer.serialized_model_proto())
    model = pieces.Pieces.__new__(pieces.Pieces)
    model.map = pieces.CharMap(spec.normalizer_spec.precompiled_charsmap)
    rules = spec.normalizer_spec
    model.dummy, model.squeeze, model.users = rules.add_dummy_prefix, rules.remove_extra_whitespaces, None
    assert model.map.units
    for t in ["ﬁn ①② ｶﾞ Å", "éà", "㌔  x", "plain", "한국", "​x", " a  b ", ""]:
        made, places = model.normalise(t)
        assert made == normalizer.normalize(t)
        assert places == sorted(places) and len(places) == len(made) + 1 and places[-1] <= len(t.encode())


def test_round_trip_rows(spark, library):
    import hashlib

    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(ODD + [None])], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in pieces.round_trip(df, MODEL).collect()}
    for i, t in enumerate(ODD + [None]):
        ids = library.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode(df.limit(0), MODEL).columns == ["doc_id", "n_tokens", "ids", "begins", "ends"]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = langid.learn(docs.where(~held).select("text", "lang"))
    got = langid.identify(docs.where(held), model).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !!", "x"), (4, "the " * 20000, "x")], "doc_id long, text string, score string")
    assert [(r.doc_id, r.lang_pred) for r in langid.identify(odd, model).orderBy("doc_id").collect()] == [(1, "und"), (2, "und"), (3, "und"), (4, "en")]


def test_language_of_number_characters(spark):
    """Number characters are no letters; an ordinal indicator is one."""
    model = {"langs": ["a"], "words": {"ª": [-1.0]}, "grams": {}}
    texts = spark.createDataFrame([(t,) for t in ("½ ²", "Ⅻ ①②", "٣ _", "ª")], "text string")
    assert [r.lang_pred for r in langid.identify(texts.coalesce(1), model).collect()] == ["und", "und", "und", "a"]


def test_language_counts_equal_plain_ones(spark):
    """Word and n-gram log frequencies, and predictions, against a plain version."""
    rows = [("Der Hund, der Ⅻ 12 läuft_schnell", "de"), ("the dog the end½", "en"), ("der the", "de"), ("", "en"), (None, "en"), ("x", None)]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    letters = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    for i, lang in enumerate(model["langs"]):
        found = [w for t, l in rows if t and l == lang for w in letters(t)]
        for word in set(found):
            assert math.isclose(model["words"][word][i], math.log(found.count(word) / len(found)))
        for k in range(1, 5):
            pieces_of = [f"<{w}>"[j:j + k] for w in found for j in range(len(w) + 3 - k)]
            for piece in set(pieces_of):
                assert math.isclose(model["grams"][piece][i], math.log(pieces_of.count(piece) / len(pieces_of)))
    text = "the hund xq"
    sums = [sum(langid.word_scores(model, w)[i] for w in letters(text)) / 3 for i in range(2)]
    best = max(range(2), key=lambda i: sums[i])
    got = langid.identify(spark.createDataFrame([(text,)], "text string"), model).first()
    assert got["lang_pred"] == model["langs"][best] and math.isclose(got["score"], 1 / sum(math.exp(s - sums[best]) for s in sums))


def test_language_without_examples(spark):
    none = spark.createDataFrame([(None, "en"), ("words", None)], "text string, lang string")
    model = langid.learn(none)
    assert langid.identify(none, model).select("lang_pred").distinct().collect()[0][0] == "und"


def test_unknown_words_back_off():
    model = {"langs": ["a", "b"], "words": {"xy": [-1.0, -5.0]}, "grams": {"<q": [-9.0, -2.0], "z": [-1.0, -3.0]}}
    assert langid.word_scores(model, "xy") == [-1.0, -5.0]
    assert langid.word_scores(model, "qz") == [-10.0, -5.0]  # "<q", then "z", the closing mark is unknown


def statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    twice = {x for x in windows if windows.count(x) > 1}
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_statistics(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n ", "a b c d e f g h", "a b c d e f g h i a b c d e f g h", "x\nx\n\n x\nx", "é|& ü<>\n%", "a " * 300]
    texts += [rnd.choice(" \n").join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in quality.statistics(df, ["doc_id"]).collect()}
    assert got == {i: statistics(t) for i, t in enumerate(texts)}


def test_quality_rules_learn_and_keep(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows = [(i, " ".join(word() + (rnd.choice("#%$") if i % 4 == 0 else "") for _ in range(40)), "n", 1) for i in range(400)] + [(None, None, "n", 1), (900, "", "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string, kept int")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 400, 2)] + [(5, None), (None, 0), (12345, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert all(got[i].kept == (i % 4 != 0) and not got[i].base_failed for i in range(400))
    assert got[None].base_failed and got[900].base_failed and got[1].extra == "n"
    unlabelled = quality.judged(docs, labels.limit(0)).collect()
    assert sum(r.kept for r in unlabelled) == 400
    assert quality.judged(docs.limit(0), labels).count() == 0


def test_word_hashes_depend_on_words_alone():
    texts = ["a b", None, "b a\x0bc", "", "ÄB ab", "x" * 3_000_000, " a "]
    seen = {}
    for row, limits, hashes, begin, end, data, _ in Hasher().slices(pa.array(texts)):
        for a, b, h in zip(begin, end, hashes):
            assert seen.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen) == 6
    assert [len(r[2]) for r in Hasher(lower=True).slices(pa.array(["AB ab"]))] == [2] and len({*next(Hasher(lower=True).slices(pa.array(["AB ab"])))[2].tolist()}) == 1
    assert len(grams(np.arange(4, dtype=np.uint64), 5)) == 0
