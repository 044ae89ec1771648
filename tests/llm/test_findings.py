"""What the reviews found missing, one test or more for each finding."""

from itertools import combinations

import numpy as np
import pytest

from terrazzo.llm import simhash
from terrazzo.llm.decontam import drop_contaminated
from terrazzo.llm.exact_dedup import drop_exact
from terrazzo.llm.html import extract
from terrazzo.llm.simhash import drop_near


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_pipeline_stages_act_by_row(spark, monkeypatch, broadcast):
    monkeypatch.setattr("terrazzo.llm.common.BROADCAST_BYTES", broadcast)
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    tidy = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    # Copies under null ids, and a copy under an id that another text keeps.
    exact = make([(None, "a b"), (None, "a b"), (1, "a b"), (2, "c d"), (2, "a b"), (None, "e f"), (None, "e f"), (None, "ef"), (3, ""), (3, None)])
    assert tidy(drop_exact(exact)) == [(0, "e f"), (1, "a b"), (2, "c d"), (3, "")]
    # Texts of one word list have one fingerprint; case makes them different texts.
    near = make([(None, "some words here now"), (None, "Some words here now"), (4, "other texts are there"), (4, "Other texts are there"), (4, "other texts are there")])
    assert [i for i, _ in tidy(drop_near(near))] == [0, 4]
    # A passage under a null id, and a clean row under the id of a contaminated one.
    leaks = make([(None, f"x {item}"), (None, "clean"), (5, item), (5, "clean too")])
    assert tidy(drop_contaminated(leaks, bench)) == [(0, "clean"), (5, "clean too")]


def test_html_names_only_weigh():
    body = "".join(f"<p>Sentence {k} of the article, with words, commas and a full stop at its end.</p>" for k in range(8))
    text = "\n".join(f"Sentence {k} of the article, with words, commas and a full stop at its end." for k in range(8))
    nav = "<nav><ul>" + "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(6)) + "</ul></nav>"
    page = lambda x: f"<html><body>{nav}{x}<footer>Some firm</footer></body></html>"
    for around in ("class='elementor-widget wide'", "class='content no-sidebar'", "id=discussion"):
        assert extract(page(f"<div {around}><article><h1>Title</h1>{body}</article></div>")) == f"Title\n{text}"
    assert extract(page(f"<article><h2 id=comments>Title</h2>{body}</article>")) == f"Title\n{text}"
    # A path without text of its own goes, though it stands in the article and has no name.
    links = "<div><ul>" + "".join(f"<li><a href=/{k}>More {k}</a></li>" for k in range(6)) + "</ul></div>"
    assert extract(page(f"<article><h1>Title</h1>{body}{links}</article>")) == f"Title\n{text}"
    assert extract(page(f"<article><h1>Title</h1>{body}<div class=ad>Buy this now.</div>{body}</article>")) == f"Title\n{text}\n{text}"


def near_prints(n, bits, places=64):
    """So many signed fingerprints, each one base with some of its bits turned."""
    rng, found = np.random.default_rng(5), set()
    base = int(rng.integers(0, 1 << 63))
    while len(found) < n:
        found.add(base ^ sum(1 << int(b) for b in rng.choice(places, bits, replace=False)))
    return np.array(sorted(found), np.uint64).view(np.int64).tolist()


def test_simhash_large_group_of_near_copies(spark, monkeypatch):
    """Links grow with the members of a group, not with their pairs."""
    links, components = [], simhash.min_label_components
    monkeypatch.setattr(simhash, "min_label_components", lambda e: links.append(e.count()) or components(e))
    prints = near_prints(1200, 4)
    got = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in prints], "fp long")).collect()
    assert sorted(r.fp for r in got) == sorted(prints) and len({r.root for r in got}) == 1
    # The first pass has the ends of cells and their members' links to them, 140 a fingerprint at most; the second verifies the rest.
    assert len(links) == 2 and links[0] <= 140 * len(prints) and links[1] < len(prints)


def test_simhash_crowded_to_the_last(spark):
    """Members that no grid parts are linked by points, each edge a link of theirs, and none is lost."""
    prints = near_prints(60, 5, 14)
    close = {(a, b) for a, b in combinations(prints, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert 60 < len(close) < 60 * 59 // 2
    members = spark.createDataFrame([(0, v, v) for v in prints], "cell long, fp long, root long")
    want = {(r.node, r.root) for r in simhash.min_label_components(spark.createDataFrame(sorted(close), "a long, b long")).collect()}
    for found in (simhash.mixed_links(members, 4, crowd=0), simhash.point_links(members.select("fp", "root"), 4)):
        edges = {(min(r.a, r.b), max(r.a, r.b)) for r in found.collect()}
        assert edges <= close
        assert {(r.node, r.root) for r in simhash.min_label_components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()} == want


def test_pipeline_near_dedup_of_a_large_group(spark, monkeypatch):
    links, components = [], simhash.min_label_components
    monkeypatch.setattr(simhash, "min_label_components", lambda e: links.append(e.count()) or components(e))
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.selectExpr("doc_id", "cast(text as long) as fp"))
    rows = [(7 + k, str(v)) for k, v in enumerate(near_prints(600, 4))]
    assert [r.doc_id for r in drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [7]
    assert links[1] < len(rows)
