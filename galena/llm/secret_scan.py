"""Secret scanning with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm._common import checkpointed, small_batches

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_CHARS, ACCESS_CHARS = 8, 16
KINDS = ("assign", "access", "hex", "live")

#: A further candidate: a run of credential characters with letters and digits.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Least bits of entropy a character for a candidate to look live.
LIVE_ENTROPY = 3.0
#: A value of at most this many owners, in at most so many of their repositories and used at
#: most so often, is theirs; any other is a copied example.
LIVE_OWNERS, LIVE_REPOS, LIVE_USES = 1, 3, 20
_assign, _access, _hex, _candidate = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX), re.compile(CANDIDATE)
_HINTS = ("passw", "secret", "token", "api")


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in (value.count(x) for x in set(value))) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, value)`` of the base kinds; ends are exclusive."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(*m.span(), "assign", m[2]) for m in _assign.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(*m.span(), "access", m[0]) for m in _access.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    out += [(*m.span(), "hex", m[0]) for m in _hex.finditer(text)]
    return out


def candidate_spans(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Runs with letters and digits and enough entropy that no base span touches."""
    out = []
    for m in _candidate.finditer(text):
        value = m[0]
        if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)) or entropy(value) < LIVE_ENTROPY:
            continue
        if all(m.end() <= a or m.start() >= b for a, b, _, _ in base):
            out.append((*m.span(), "live", value))
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _scan(batches):
    for batch in batches:
        found = []
        for text in batch.column("body"):
            text = text.as_py()
            base = base_spans(text)
            found.append([{"start": a, "end": b, "kind": k, "value": hashlib.sha256(v.encode()).hexdigest(), "entropy": entropy(v)} for a, b, k, v in base + candidate_spans(text, base)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("entropy", pa.float64())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "doc_id", "repo", "owner")), pa.array(found, kind)], names=["rid", "doc_id", "repo", "owner", "found"])


def ownership(uses: DataFrame) -> DataFrame:
    """``value, n_repos, n_owners, n_uses`` of the hashes in ``uses`` over the whole corpus.

    Rows without a repository, or an owner, have one unnamed one together. Uses are first
    combined by value, repository and owner, so a value that a third of all rows hold meets
    its counts already reduced.
    """
    once = uses.groupBy("value", "repo", "owner").agg(F.count(F.lit(1)).alias("uses"))
    distinct = lambda c: F.count_distinct(c) + F.max(F.col(c).isNull().cast("long"))
    return once.groupBy("value").agg(distinct("repo").alias("n_repos"), distinct("owner").alias("n_owners"), F.sum("uses").alias("n_uses"))


def judged(values: DataFrame, live_owners: int = LIVE_OWNERS, live_repos: int = LIVE_REPOS, live_uses: int = LIVE_USES) -> DataFrame:
    """``ownership`` with ``owned``: whether the value looks like its owner's own."""
    return values.withColumn("owned", (F.col("n_owners") <= live_owners) & (F.col("n_repos") <= live_repos) & (F.col("n_uses") <= live_uses))


def scanned_uses(docs: DataFrame, id_col: str, text_col: str, repo_col: str | Column, owner_col: str | Column) -> tuple[DataFrame, DataFrame]:
    """``rid, doc_id, found`` of each row, written once, and a row for each value's use."""
    small_batches(docs.sparkSession)
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).cast("long").alias("doc_id"),
        column(repo_col).cast("string").alias("repo"),
        column(owner_col).cast("string").alias("owner"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"),
    )
    span = "struct<start:long,end:long,kind:string,value:string,entropy:double>"
    scanned = checkpointed(rows.mapInArrow(_scan, f"rid long, doc_id long, repo string, owner string, found array<{span}>"))
    return scanned, scanned.select("rid", "repo", "owner", F.explode("found").alias("s")).select("rid", "repo", "owner", "s.*")


def secret_values(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | Column = "source", owner_col: str | Column = "source", **limits: int) -> DataFrame:
    """A row for each value, base or candidate, over the whole corpus: ``value`` (SHA-256 of
    the credential), ``entropy``, ``n_repos, n_owners, n_uses, owned``.

    Null texts have none; null repositories and owners count as one unnamed one each; an
    empty table gives no rows.
    """
    _, uses = scanned_uses(docs, id_col, text_col, repo_col, owner_col)
    entropies = uses.groupBy("value").agg(F.max("entropy").alias("entropy"))
    return entropies.join(judged(ownership(uses), **limits), "value")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | Column = "source", owner_col: str | Column = "source", **limits: int) -> DataFrame:
    """Find secrets in every text and tell copied examples from live-looking credentials.

    Base spans (assignments, access keys, long hexadecimal runs) are always reported. Other
    runs that look like credentials are candidates. The hashes of all values, base and
    candidate, are counted over the corpus by distinct repositories and owners. A value of
    enough entropy within ``live_owners``, ``live_repos`` and ``live_uses`` is live-looking,
    any other a widely copied example. Candidates that are live-looking are added as spans of
    kind ``live``. ``secret_values`` gives the counts by value.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example,
    most_repos, most_owners, most_uses``, one row per input row; ``n_live`` and ``n_example``
    count all reported spans by verdict, the last three are the largest counts of a reported
    value, 0 without one. A null or empty text has no spans; rows with a null repository or
    owner share one unnamed one; repeated rows are reported each and count as uses of one
    repository; an empty table gives no rows; other columns are not read.
    """
    scanned, uses = scanned_uses(docs, id_col, text_col, repo_col, owner_col)
    verdicts = checkpointed(judged(ownership(uses), **limits))  # as an input of its own, its join can split a hot value
    told = uses.join(verdicts, "value").withColumn("live", F.col("owned") & (F.col("entropy") >= LIVE_ENTROPY)).where((F.col("kind") != "live") | F.col("live"))
    most = [F.max(f"n_{c}").alias(f"most_{c}") for c in ("repos", "owners", "uses")]
    by_row = told.groupBy("rid").agg(F.collect_list(F.struct("start", "end", "kind", "live")).alias("spans"), *most)

    def finish(batches):
        for batch in batches:
            out = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")}
            for spans in batch.column("spans").to_pylist():
                spans = spans or []
                base = [(s["start"], s["end"], s["kind"]) for s in spans if s["kind"] != "live"]
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(k == kind for _, _, k in base))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written([(s["start"], s["end"], s["kind"]) for s in spans]))
                out["n_live"].append(sum(s["live"] for s in spans))
                out["n_example"].append(sum(not s["live"] for s in spans))
            made = {c: pa.array(v, pa.string() if c in ("base_sha256", "spans") else pa.int64()) for c, v in out.items()}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | made | {c: batch.column(c) for c in ("most_repos", "most_owners", "most_uses")})

    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("most_repos", "most_owners", "most_uses")]
    joined = scanned.select("rid", "doc_id").join(by_row, "rid", "left").select("doc_id", "spans", *counts)
    longs = "most_repos long, most_owners long, most_uses long"
    return joined.mapInArrow(finish, f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_live long, n_example long, {longs}")
