"""Texts and tables made to be hard: crafted media, texts without blanks, headings with ids, long pages, repeated labels."""

import random
import struct
import time

import pytest

P = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from graphloom.llm import html_text, media, quality, secrets, token_count  # noqa: E402


def seconds(work, *args):
    began = time.perf_counter()
    work(*args)
    return time.perf_counter() - began


# media
END = b"PK\x05\x06" + bytes(18)
PAGE = b"OggS\0\0" + bytes(20) + b"\0"


@pytest.mark.parametrize("unit", [b"PK\x03\x04", b"PK\x03\x04" + END, PAGE])
def test_repeated_signatures_take_time_in_proportion(unit):
    small, large = (unit * (n // len(unit)) for n in (1 << 20, 1 << 22))
    assert seconds(media.sniff, large) < 12 * seconds(media.sniff, small) + 0.5


def test_many_archives_and_page_chains():
    directory = b"PK\x01\x02" + bytes(42)
    archive = b"PK\x03\x04" + b"abc" + directory + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(directory), 7, 0)
    last = b"OggS\0\x04" + bytes(20) + b"\0"
    data = archive * 50 + b"--" + PAGE * 3 + last + b"--" + PAGE
    found = media.sniff(data)
    assert [x for x in found if x[0] == "application/zip"] == [("application/zip", i * len(archive), len(archive)) for i in range(50)]
    at = 50 * len(archive) + 2
    assert [x for x in found if x[0] == "application/ogg"] == [("application/ogg", at + i * len(PAGE), (3 - i) * len(PAGE) + len(last)) for i in range(4)], "the last page has no end"


# pages
@pytest.mark.parametrize(("page", "text"), [
    ('<article><h1>t</h1><h2 id="search-results">Found</h2><h2 id="related-work">Work</h2></article>', "t\nFound\nWork"), ('<article><p class="share-price">Share price rose</p></article>', "Share price rose"), ('<article><section id="notice-period">Notice</section></article>', "Notice"),
    ('<div class="post-with-banner"><p>Real text</p></div>', "Real text"), ('<article>a<div class="ad">buy</div><div class="comments-area">me</div><p role="search">s</p></article>', "a"), ('<div class="site-footer">x</div><p>the text of a page</p><div id="cookieBanner">no</div>', "the text of a page"),
    ('<div class="comments"><p>nearly all of the text of a page</p></div><p>x</p>', "nearly all of the text of a page\nx"), ('<article>kept</article><div class="comments"><p>nearly all of the text of a page</p></div>', "kept"), ('<nav><p>much more text than there is in all of the rest</p></nav><p>x</p>', "x"), ('<div aria-label="Share">s</div><div aria-label="Share prices of the day">t</div>', "t"),
])
def test_marks_are_whole_names(page, text):
    assert html_text.main_text(html_text.page_lines(page), None) == text


@pytest.mark.parametrize("bits", [1, 64, 1 << 27])
def test_alignment_in_bounded_memory(monkeypatch, bits):
    monkeypatch.setattr(html_text, "TABLE_BITS", bits)
    rng = random.Random(bits)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = [x for x, k in zip(a, html_text.common_lines(a, b), strict=True) if k]
        rest = iter(b)
        assert len(kept) == best[-1][-1] and all(x in rest for x in kept)


def test_alignment_of_long_pages():
    rng = random.Random(6)
    a = [rng.randrange(1 << 40) for _ in range(60_000)]
    b = a[:20_000] + [rng.randrange(1 << 40) for _ in range(9_000)] + a[45_000:]
    assert sum(html_text.common_lines(a, b)) == 35_000


# tokens
@pytest.fixture(scope="module")
def tokenizer():
    path = P.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return token_count.TokenCounter(f.read()), Tokenizer.from_file(path)


def test_every_chunk_end_equals_the_library(tokenizer):
    counter, library = tokenizer
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rng, pieces = random.Random(10), ["a", "b", "th", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "23", "!", "...", "é", "漢", "字", "。", " ", "don't", "xxxxx", "中" * 90, "\n\n", "a" * 130, "-" * 100, " " * 80]
    for _ in range(2500):
        pool = pieces if rng.random() < 0.5 else rng.sample(pieces, rng.choice([1, 2, 3]))
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))
        chunk = rng.choice([1, 2, 3, 7, 40])
        assert counter.prefixes(text, chunk) == [*(count(text[:end]) for end in range(chunk, len(text), chunk)), count(text)], (text, chunk)


@pytest.mark.parametrize("unit", ["漢字仮名", "a", "!", "\n", " ", "ab1", "'"])
def test_texts_without_blanks_take_time_in_proportion(tokenizer, unit):
    counter, library = tokenizer
    text = unit * (200_000 // len(unit))
    counter.count(text)
    assert seconds(counter.count, text * 4) < 10 * seconds(counter.count, text) + 0.5
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_states_stay_bounded(tokenizer):
    counter, _ = tokenizer
    fst = counter.fst
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)).encode()
    whole = fst.running(word, [1500, 3000])
    limit, fst.max_states = fst.max_states, 50
    try:
        fst.reset()
        assert fst.running(word, [1500, 3000]) == whole and len(fst.states) <= 60
    finally:
        fst.max_states = limit
        fst.reset()


# quality
def test_a_repeated_label_is_one_row(spark, monkeypatch):
    rows = [(i, f"word{i} and more of it", 10) for i in range(40)] + [(7, "word7 and more of it", 10)] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(7, 1)] * 50, "doc_id long, quality int")
    seen = []
    fit = quality.FactorisationMachine.fit
    monkeypatch.setattr(quality.FactorisationMachine, "fit", lambda self, r, y: seen.append(len(r)) or fit(self, r, y))
    quality.train(docs, labels, max_train=500)
    assert seen and seen[0] <= 40


# secrets
def test_the_expression_is_the_model(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    words = secrets.word_list(P.path("byte_bpe_50k.json"))
    findings = secrets.labelled_findings(spark, 600)
    names = list(secrets.features(words))
    rows = findings.withColumns(secrets.features(words)).select("label", "candidate", *names).coalesce(1).cache()
    given = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=5, maxDepth=4, seed=5, featureSubsetStrategy="sqrt").fit(given)
    score = secrets.forest(findings, words, trees=5, depth=4)
    both = [(r.score, float(r.probability[1])) for r in model.transform(given).withColumn("score", score).select("score", "probability").collect()]
    assert len(both) == 600 and max(abs(a - b) for a, b in both) < 1e-9
    assert secrets.default_forest(spark, tuple(words)) is secrets.default_forest(spark, tuple(words))
    rows.unpersist()


def test_pages_of_the_query_keep_their_articles(spark, small):
    got = html_text.op6_html_extraction(spark, small).where(F.col("n_chars") == 0).count()
    assert got < spark.read.parquet(f"{small}/pages.parquet").count() / 10
