"""Secrets in texts, and how widely each is copied across the corpus."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, join_groups, table

KINDS = ("assign", "access", "hex", "key", "live")
#: The patterns of the three base kinds and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Candidates beyond the base kinds: private key blocks and tokens with well-known prefixes.
KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----|\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your|xxxx|test|0{6}|1{6}|123456", re.I)
#: A candidate with more owners than this, or in more repositories, is a widely copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
LEAST_ENTROPY = 2.5


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of all base and key spans, by start and then kind; code points, end exclusive."""
    found = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    found += [(m.start(), m.end(), "key", m[0]) for m in KEY.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    """Whether a value could be in use: long and random enough, and no placeholder."""
    return len(value) >= 16 and entropy(value) >= LEAST_ENTROPY and not PLACEHOLDER.search(value)


SCAN = "struct<n_assign: long, n_access: long, n_hex: long, base_sha256: string, found: array<struct<s: long, e: long, kind: string, value: string, live: boolean>>>"


def scan(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts.to_pylist():
        found = find(text or "")
        kinds = Counter(x[2] for x in found)
        base = ",".join(f"{k}:{s}:{e}" for s, e, k, _ in found if k in LEAST)
        rows.append(
            {
                **{f"n_{k}": kinds[k] for k in LEAST},
                "base_sha256": hashlib.sha256(base.encode()).hexdigest(),
                "found": [
                    {"s": s, "e": e, "kind": k, "value": hashlib.sha256(v.encode()).hexdigest(), "live": k == "key" or looks_live(v)}
                    for s, e, k, v in found
                ],
            }
        )
    item = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("live", pa.bool_())])
    kind = pa.struct([(f"n_{k}", pa.int64()) for k in LEAST] + [("base_sha256", pa.string()), ("found", pa.list_(item))])
    return pa.array(rows, kind)


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, n_rows, n_repositories, n_owners) over the whole corpus, for ``candidates(row, value, repository, owner)``.

    n_rows counts the rows that hold the value, however often, n_repositories and n_owners its distinct repositories and
    owners. Aggregation runs in levels with map-side combination, so that a value that a third of all rows hold is one row a
    task after the first. Null owners and repositories count as one each.
    """
    known = F.struct("owner"), F.struct("repository")
    each = candidates.groupBy("value", "repository", "owner", "row").agg(F.lit(1).alias("one"))
    places = each.groupBy("value", "repository", "owner").agg(F.count("*").alias("n"))
    return places.groupBy("value").agg(
        F.sum("n").alias("n_rows"), F.count_distinct(known[1]).alias("n_repositories"), F.count_distinct(known[0]).alias("n_owners")
    )


def secret_scan(
    docs: DataFrame, owner: Column | None = None, repository: Column | None = None,
    max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, and of the
    candidate in most places n_owners and n_repositories (0 without any).

    Base spans are those of the three patterns. The hash of each candidate's value (group 2 of an assignment, else
    the span) is counted by distinct repositories and owners over the corpus. A value of more than ``max_owners`` owners,
    or in more than ``max_repositories`` repositories, be they of one owner, is a widely copied example and counts in
    n_copied. Of the others, one that looks live gets a further span ``live``, over the place of its own span: it
    belongs to its owners. Key blocks and well-known token prefixes give ``key`` spans, and look live.
    The owner is the source by default, the repository its part in one language.

    Null texts count as empty. Repeated rows are returned each, and count each in what they own. Values leave the
    executors as hashes alone. An empty table gives an empty result. Columns other than doc_id, text, source and lang are
    not read, whatever their names.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    scanner = F.arrow_udf(scan, SCAN)
    rows = checkpoint(
        docs.select("doc_id", owner.alias("owner"), repository.alias("repository"), scanner(F.col("text")).alias("r"))
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", "owner", "repository", "r.*")
    )
    each = checkpoint(
        rows.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("c"))
        .select("row", "repository", "owner", "c.s", "c.e", "c.live", "c.value")
    )
    counted = each.groupBy("value").agg(F.count("*").alias("__n")).join(ownership(each), "value")
    judged = join_groups(each, checkpoint(counted), "value", each.count())
    copied = (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories)
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when(~copied & F.col("live"), F.struct("s", "e"))).alias("added"),
        F.count(F.when(copied, 1)).alias("n_copied"), F.max("n_owners").alias("n_owners"), F.max("n_repositories").alias("n_repositories"),
    )
    order = F.array(*map(F.lit, KINDS))
    span = lambda s, e, k: F.struct(s.alias("s"), F.array_position(order, k).alias("k"), e.alias("e"), k.alias("kind"))
    base = F.transform("found", lambda x: span(x["s"], x["e"], x["kind"]))
    live = F.transform(F.coalesce("added", F.array().cast("array<struct<s: long, e: long>>")), lambda x: span(x["s"], x["e"], F.lit("live")))
    spans = F.array_sort(F.concat(base, F.array_distinct(live)))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(per_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",").alias("spans"),
        F.size(live).cast("long").alias("n_live"), count("n_copied"), count("n_owners"), count("n_repositories"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
