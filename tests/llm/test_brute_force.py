"""Operators that SQL can't express, against plain versions of their definitions over whole small tables."""

import html
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.llm import html as pages_
from terrazzo.llm import licenses, queries
from terrazzo.llm.common import table
from terrazzo.llm.html import extract, extract_pages
from terrazzo.llm.langid import fit_language_model, identify_language
from terrazzo.llm.licenses import license_scan
from terrazzo.llm.quality import LineField, _forward_backward, fit_quality_model, line_features, quality_scores
from terrazzo.llm.secrets import secret_scan
from terrazzo.llm.tokens import TokenCounter

SF = "/root/testdata/sf0.001"
ALL = queries.queries()


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_by_plain_trees(spark):
    """The whole query against context trees in dicts."""
    docs = table(spark, SF, "documents").toPandas()
    trees: dict = {}
    for i, text, lang in docs[["doc_id", "text", "lang"]].values:
        if text is not None and lang is not None and not held(i):
            t, tree = b"\n\n\n" + text.encode(), trees.setdefault(lang, {})
            for p in range(3, len(t)):
                for k in range(4):
                    seen = tree.setdefault(t[p - k : p], {})
                    seen[t[p]] = seen.get(t[p], 0) + 1
    known: dict = {}

    def bits(lang, context, byte):
        key = lang, context, byte
        if key not in known:
            seen = trees[lang].get(context)
            cost = 0.0 if context else 8.0
            if seen:
                total = sum(seen.values()) + len(seen)
                if byte in seen:
                    known[key] = -math.log2(seen[byte] / total)
                    return known[key]
                cost -= math.log2(len(seen) / total)
            known[key] = cost + (bits(lang, context[1:], byte) if context else 0.0)
        return known[key]

    got = {r.doc_id: r for r in ALL["op1_langid"](spark, SF).collect()}
    for i, text in docs[["doc_id", "text"]].values:
        if text is None or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        t = b"\n\n\n" + text.encode()
        total = {lang: sum(bits(lang, t[p - 3 : p], t[p]) for p in range(3, len(t))) for lang in sorted(trees)}
        best = min(total, key=total.get)
        assert got[i].lang_pred == best and got[i].held_out == held(i)
        assert got[i].score == pytest.approx(1 / sum(2.0 ** -min(v - total[best], 1000.0) for v in total.values()), abs=1e-6)


def test_language_edge_cases(spark):
    schema = "doc_id long, text string, lang string, lettered int, p int"
    docs = spark.createDataFrame([(i, "same words here", lang, 1, 2) for i, lang in enumerate(["en", "de"] * 20)] + [(50, None, "en", 1, 2), (51, "", None, 1, 2)], schema)
    model = fit_language_model(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(docs, model).collect()}
    assert abs(got[0][1] - 0.5) < 0.3 and got[50] == got[51] == ("und", 0.0)
    assert identify_language(spark.createDataFrame([], schema), model).count() == 0
    assert sum(len(t.cost[3]) for t in fit_language_model(docs, max_grams=8).trees) <= 8


def plain_marginals(good, trans):
    """Each line's probability of label 1, by all labellings."""
    n, total, mine = len(good), 0.0, np.zeros(len(good))
    for labels in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(g for g, y in zip(good, labels, strict=True) if y) + sum(trans[a][b] for a, b in itertools.pairwise(labels)))
        total += w
        mine += w * np.array(labels)
    return mine / total


def test_quality_by_enumeration():
    rng = np.random.default_rng(1)
    for counts in ([1, 5, 3], [8, 1, 1, 7]):
        good, trans = rng.normal(size=sum(counts)), rng.normal(size=(2, 2))
        got, _ = _forward_backward(np.column_stack([np.zeros(sum(counts)), good]), trans, np.array(counts))
        at = 0
        for n in counts:
            assert got[at : at + n, 1] == pytest.approx(plain_marginals(good[at : at + n], trans))
            at += n


def test_quality_by_plain_chains(spark):
    """The whole query against chains worked off text by text, line by line."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = fit_quality_model(docs, labels)
    texts = dict(docs.select("doc_id", "text").toPandas().values)
    for r in quality_scores(docs, model).collect():
        features, size, _ = line_features([(texts[r.doc_id] or "").encode()])
        emit = [np.array([1.0, math.exp(g)]) for g in features @ model.weights]
        step = np.exp(model.trans)
        forward, backward = [emit[0] / emit[0].sum()], [np.ones(2)]
        for e in emit[1:]:
            a = (forward[-1] @ step) * e
            forward.append(a / a.sum())
        for e in emit[:0:-1]:
            b = step @ (e * backward[-1])
            backward.append(b / b.sum())
        both = [a * b for a, b in zip(forward, backward[::-1], strict=True)]
        raw = sum(s * m[1] / m.sum() for s, m in zip(size, both, strict=True)) / size.sum()
        p = min(max(raw, 1e-6), 1 - 1e-6)
        want = 1 / (1 + math.exp(-(model.scale * math.log(p / (1 - p)) + model.shift)))
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id)


def test_quality_bounds(spark):
    """The sample is bounded by lines; repeated labels and rows, ties and an empty table have defined results."""
    good, bad = "Some plain words stand here.\n" * 4, "BUY!!! $$$\n" * 4
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(7, "another row under this id\n" * 90), (100, "x\n" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2 + [(7, 0), (100, 1)], "doc_id long, quality int")
    model = fit_quality_model(docs, labels, max_lines=150)
    assert isinstance(model, LineField) and fit_quality_model(docs, labels, max_lines=0) is None
    scores = [r.score for r in quality_scores(docs, model).collect()]
    assert len(scores) == 62 and len({round(s, 9) for s in scores}) <= 4
    assert quality_scores(docs.limit(0), model).count() == 0


def plain_article(page):
    """What stands between the article's tags, cut at headings and paragraphs."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)[1]
    parts = (re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", p) for p in re.split(r"</?(?:h1|p)>", body))
    return "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


def test_pages_whole(spark):
    rows = table(spark, SF, "pages").toPandas()
    want = {i: plain_article(h) for i, h in rows[["page_id", "html"]].values}
    assert {r.page_id: r.text for r in ALL["op10_html"](spark, SF).collect()} == want


def test_pages_come_by_their_ratios(monkeypatch, spark):
    """With ratios turned upside down nearly every page's text is another."""
    rows = [r.html for r in table(spark, SF, "pages").collect()]
    plain, ratios = [extract(h) for h in rows], pages_.ratios
    monkeypatch.setattr(pages_, "ratios", lambda blocks: 1 / (ratios(blocks) + 1e-3))
    assert sum(a != extract(h) for a, h in zip(plain, rows, strict=True)) > 0.9 * len(rows)


def test_pages_awkward(spark):
    import time

    words = " ".join(f"Sentence {k} of the text, with words, commas and an end." for k in range(6))
    body = f"<h1>Title</h1><p>{words}</p><p>{words}</p>"
    nav = "<ul class=menu>" + "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(8)) + "</ul>"
    text = f"Title\n{words}\n{words}"
    for name in ("content", "notice-board", "search-results-explained", "header-less"):
        assert extract(f"<html><body>{nav}<div class='{name}'>{body}</div><div class='site-footer'>Some firm</div></body></html>") == text
    said = f"<p class='notice-board'>{words}</p>"
    assert extract(f"<html><body>{nav}<article>{body}{said}</article></body></html>") == f"{text}\n{words}"
    assert extract(f"<html><body>{nav}<article>{body}<p class=advert>{words}</p></article></body></html>") == text
    assert extract(f"<html><body>{nav}<article>{body}</article><div class='comments-list'><p>{words}</p></div></body></html>") == text
    began = time.perf_counter()
    deep = [extract("<div>x" * n + "</p></b></section>" * n) for n in (10_000, 100_000)]
    assert time.perf_counter() - began < 60 and len(deep[1]) > 5 * len(deep[0])
    schema = "page_id long, url string, html string, text int, n_chars string"
    rows = [(1, "u", f"<article>{body}</article>", 1, "n"), (1, "u", f"<article>{body}</article>", 1, "n"), (2, None, None, 1, "n"), (3, "v", "", 1, "n"), (None, "w", "<div" * 2000, 1, "n")]
    got = [(r.page_id, r.n_chars, r.text) for r in extract_pages(spark.createDataFrame(rows, schema)).collect()]
    assert got.count((1, len(text), text)) == 2 and (2, 0, "") in got and (3, 0, "") in got and len(got) == 5
    assert extract_pages(spark.createDataFrame([], schema)).count() == 0


def test_secrets_ownership(spark):
    """Live values of few owners against values of many owners, and of many repositories of one owner."""
    text = lambda v: f"token = {v} end"
    live, wide, deep = "Zx9Kq2Lm8Rt5Wv3Ny7Bp4", "Ab3De6Gh9Jk2Mn5Pq8St1", "Qw8Er5Ty2Ui9Op6As3Df0"
    rows = [(1, text(live), "en", "s1"), (2, text(live), "en", "s1"), (3, text(live), "de", "s2")]
    rows += [(10 + i, text(wide), "en", f"s{i}") for i in range(4)] + [(20 + i, text(deep), f"l{i}", "s9") for i in range(6)]
    rows += [(20, text(deep), "l0", "s9"), (30, None, None, None), (31, text("password1"), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"row": F.lit("x"), "value": F.lit(1)})
    got = {r.doc_id: (r.spans, r.n_live, r.n_copied, r.n_owners, r.n_repositories) for r in secret_scan(docs).collect()}
    assert all(got[i] == ("assign:0:29,live:0:29", 1, 0, 2, 2) for i in (1, 2, 3))
    assert all(got[i] == ("assign:0:29", 0, 1, 4, 4) for i in range(10, 14)) and all(got[i] == ("assign:0:29", 0, 1, 1, 6) for i in range(20, 26))
    assert got[30] == ("", 0, 0, 0, 0) and got[31] == ("assign:0:17", 0, 0, 1, 1)
    assert secret_scan(docs).count() == len(rows)


def test_licenses_of_several_lines(spark):
    """Whole licence files, commented ones and wrapped headers; every template holds a cue."""
    assert all(re.search(licenses.CUE, t) for _, t in licenses.TEMPLATES)
    full = dict(licenses.FULL)
    starred = "\n".join(f" * {x}" for x in full["BSD-3-Clause"].split("\n"))
    words = full["Apache-2.0"].split()
    wrapped = "/*\n" + "\n".join(" * " + " ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + "\n */\n\n" + "int x = 3;\n" * 50
    short = "# Redistribution and use in source and binary\n# forms, with or without modification, are\n# permitted provided that the following\n# conditions are met:\n\n" + "x = 1\n" * 60
    files = [("/p/LICENSE", full["MIT"].replace("(c)", "(c) 2021 Some Body")), ("/p/a/x.py", "code"), ("/q/COPYING.txt", starred), ("/q/b/c.c", None), ("/r/z.c", wrapped), ("/r/w.py", short), ("/s/t", "no word of it"), ("/s/t", "no word of it")]
    docs = spark.createDataFrame([(k, t, p, 1) for k, (p, t) in enumerate(files)], "doc_id long, text string, path string, unit int").withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    got = {r.doc_id: (r.license, r.origin) for r in license_scan(docs, F.col("path")).collect()}
    assert got[0] == ("MIT", "file") and got[1] == ("MIT", "inherited") and got[2] == ("BSD-3-Clause", "file") and got[3] == ("BSD-3-Clause", "inherited")
    assert got[4] == ("Apache-2.0", "header") and got[5] == ("BSD-3-Clause", "header") and got[6] == got[7] == (None, "none")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_chunks_of_any_vocabulary(name):
    """Chunks of a few characters give the counts of the whole texts, unbroken texts among them."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path(name), np.random.default_rng(9)
    parts = [*"ab cdE'st  \n\t.,!12é²٣ß中文😀́ _", " the", " hello", "don't", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 250))) for _ in range(300)] + ["a" * 300 + " b" * 40 + "\n" * 50, "中文😀" * 60, " " * 100 + "z", ""]
    if name.endswith(".json"):
        library = Tokenizer.from_file(path)
        want = [len(library.encode(t, add_special_tokens=False)) for t in texts]
    else:
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    for chunk, overlap in ((7, 2), (16, 4), (64, 8)):
        assert TokenCounter(path, chunk, overlap).count(texts) == want
