"""The operators over whole small tables, against brute force, the library, SQL and held-out rows."""

import hashlib
import re
import zlib

import corpus_pipeline
import duckdb
import pytest
import xxhash

from terrazzo.llm import queries
from terrazzo.llm.common import table
from terrazzo.llm.quality import fit_quality_model

SF, SF10 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ALL = queries.queries()


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def read(spark, name, sf=SF):
    return table(spark, sf, name).toPandas()


def simhash(text):
    """The fingerprint by its definition, one shingle and one bit at a time."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(ids, prints):
    """The least id reachable from each, by comparing all pairs."""
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_language_held_out(spark):
    lang = dict(read(spark, "documents", SF10)[["doc_id", "lang"]].values)
    rows = ALL["op1_langid"](spark, SF10).collect()
    assert {r.doc_id for r in rows} == set(lang) and all(r.held_out == held(r.doc_id) for r in rows)
    judged = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(judged) > 100 and sum(judged) / len(judged) > 0.98


def test_quality_held_out(spark):
    quality = dict(read(spark, "labels", SF10)[["doc_id", "quality"]].values)
    rows = ALL["op5_quality"](spark, SF10).collect()
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3) for r in rows)
    judged = [(quality[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in quality]
    good, bad = ([s for q, s, _ in judged if q == k] for k in (1, 0))
    ordered = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert ordered > 0.97 and sum(q == p for q, _, p in judged) / len(judged) > 0.95


def test_simhash_whole(spark):
    docs = read(spark, "documents")
    prints = {i: simhash(t) for i, t in docs[["doc_id", "text"]].values}
    root = groups(list(prints), prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in ALL["op2_simhash"](spark, SF).collect()}
    assert got == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def test_tokens_whole(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t or "", add_special_tokens=False)) for i, t in read(spark, "documents")[["doc_id", "text"]].values}
    got = ALL["op3_token_counts"](spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_secrets_whole(spark):
    kinds = {
        "assign": (r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        "access": ("AKIA[A-Z0-9]+", 0, 20),
        "hex": ("[0-9a-f]+", 0, 24),
    }
    want = {}
    for i, text in read(spark, "documents", SF10)[["doc_id", "text"]].values:
        spans = [(m.start(), n, m.end(), kind) for n, (kind, (p, g, least)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if len(m[g]) >= least]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        want[i] = (*(sum(s[3] == k for s in spans) for k in kinds), hashlib.sha256(joined.encode()).hexdigest())
    assert sum(sum(w[:3]) for w in want.values())
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in ALL["op7_secrets"](spark, SF10).collect()} == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = ALL[name](spark, SF)
    want = db.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    tidy = lambda rows: sorted(tuple("" if v is None else str(v) for v in r) for r in rows)
    assert tidy(map(tuple, got.collect())) == tidy(want.select(*got.columns).fetchall())


def test_pipeline(spark):
    """Each stage's brute-force version in turn: scores one by one, all pairs of fingerprints, and SQL for the rest."""
    docs = read(spark, "documents")
    model = fit_quality_model(table(spark, SF, "documents"), table(spark, SF, "labels"))
    documents = docs[[model.score([(t or "").encode()])[0] >= 0.3 for t in docs["text"]]]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")

    def sql(name):
        db.register("documents", documents)
        return db.sql(queries.oracle_sql()[name]).df()

    exact = sql("op6_exact_dedup")
    documents = documents[documents["doc_id"].isin(exact[exact["kept"]]["doc_id"])]
    prints = {i: simhash(t) for i, t in documents[["doc_id", "text"]].values}
    root = groups(list(prints), prints)
    documents = documents[[root[i] == i for i in documents["doc_id"]]]
    documents = documents[~documents["doc_id"].isin(sql("op8_decontam")["doc_id"])]
    want = {tuple(r) for r in sql("op4_mixing")[["doc_id", "n_tokens", "copies"]].values.tolist()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(want) < len(docs) and len(got) == len(want)
    assert {(r.doc_id, r.n_tokens, r.copies) for r in got} == want
    text = dict(docs[["doc_id", "text"]].values)
    assert all(r.text == text[r.doc_id] for r in got)
