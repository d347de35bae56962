"""Secret scan with corpus-wide ownership frequency.

One pass over the texts finds candidates: three fixed kinds, and long mixed tokens (``generic``). Hashes
of the candidates are counted by distinct repositories and owners. A value that ``WIDE_OWNERS`` owners hold, or two
owners in ``WIDE_REPOS`` repositories together, is a widely copied example. One that a single owner holds, in however
many repositories, is owner-specific. Generic candidates become spans only if they are no examples; spans of the fixed
kinds always stay.

Defined results: a null text is empty and has no spans; a null repository or owner counts as one
repository or owner of its own, other than an empty one; a repository is told apart by its owner too; repeated rows are reported one by one and do not raise distinct counts;
an empty table gives an empty result. Positions are code points, ends exclusive. Secrets themselves
never leave the task that reads the text, only their hashes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

# Fixed patterns, with the least length of what must be long, and their order in reports.
KINDS = ("assign", "access", "hex", "generic")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
HEX_LONG = re.compile(r"[0-9a-f]{32,}")
GENERIC = re.compile(r"[A-Za-z0-9+/_-]{24,}")
ANY = r"(?i)password|passwd|secret|token|api_?key|AKIA|[A-Za-z0-9+/_-]{24,}"
#: Bits per character from which a value looks random.
ENTROPY = 3.0
#: A value held by so many distinct owners is a copied example; or by two in so many repositories.
WIDE_OWNERS, WIDE_REPOS = 3, 5
#: Parts into which the holders of one value are dealt where they meet its counts.
SALTS = 16

SPAN = "struct<kind:string,start:int,end:int,hash:string,random:boolean>"
ROW = f"doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, cands array<{SPAN}>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of the fixed kinds, in report order."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    # runs of hexadecimal digits are maximal, so asking for 32 at once finds the same runs
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX_LONG.finditer(text)]
    return sorted(out, key=lambda x: x[:2])


def generic_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens with both cases and digits, of high entropy, outside the base spans."""
    out = []
    for m in GENERIC.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and v.lower() != v and v.upper() != v and entropy(v) >= ENTROPY + 0.5 and not any(b[0] < m.end() and m.start() < b[2] for b in base):
            out.append((m.start(), 3, m.end(), v))
    return out


def told(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = hashlib.sha256(b"").hexdigest()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("random", pa.bool_())])
    for b in batches:
        n = b.num_rows
        counts, sha, cands = [[0] * n for _ in range(3)], [none] * n, [[]] * n
        for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(b.column("text"), ANY), False)).to_pylist():
            text = b.column("text")[i].as_py()
            base = base_spans(text)
            both = sorted(base + generic_spans(text, base), key=lambda x: x[:2])
            for k in range(3):
                counts[k][i] = sum(x[1] == k for x in base)
            sha[i] = hashlib.sha256(told(base).encode()).hexdigest()
            cands[i] = [{"kind": KINDS[k], "start": a, "end": e, "hash": hashlib.blake2b(v.encode(), digest_size=16).hexdigest(), "random": entropy(v) >= ENTROPY and any(c.isdigit() for c in v)} for a, k, e, v in both]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("repo"), b.column("owner"), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha), pa.array(cands, pa.list_(kind))], ["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "cands"])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: object = "source", owner: object = "source", wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """Spans of secrets in every document. ``repo`` and ``owner`` are columns (names or expressions).

    ``n_live``: spans whose value looks random and is no copied example; ``n_example``: spans of copied examples.
    ``live``: the live-looking spans, as in ``spans``. ``most_owners``, ``most_repos``: the widest spread of its values.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), column(repo).cast("string").alias("repo"), column(owner).cast("string").alias("owner")).where("doc_id is not null")
    # equal rows have equal candidates, so (id, key) names the rows that share a result
    found = stage(rows.mapInArrow(_scan, ROW).withColumn("key", F.when(F.size("cands") > 0, F.xxhash64("cands"))), "secrets")
    cand = found.where("key is not null").select("doc_id", "key", "repo", "owner", F.explode("cands").alias("c"))
    # distinct holders first, owner by owner: however many rows hold a value, it has a row for each owner here
    held = cand.select("c.hash", F.struct("owner").alias("owner"), F.struct("repo").alias("repo")).distinct()
    spread = held.groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    several = spread.where("repos > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = cand.select("doc_id", "key", "c.*").distinct().withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    judged = mine.join(several, ["hash", "salt"], "left").fillna(1, ["owners", "repos"])
    wide = (F.col("owners") >= wide_owners) | ((F.col("owners") >= 2) & (F.col("repos") >= wide_repos))
    judged = judged.withColumns({"live": ~wide & F.col("random"), "example": wide}).where((F.col("kind") != "generic") | ~wide)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", order.alias("order"), F.format_string("%s:%d:%d", "kind", "start", "end").alias("told"), "live")
    by_doc = judged.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(span)).alias("s"), F.count_if("live").alias("n_live"), F.count_if("example").alias("n_example"), F.max("owners").alias("most_owners"), F.max("repos").alias("most_repos"))
    joined = found.join(by_doc, ["doc_id", "key"], "left")
    text = lambda a: F.coalesce(F.array_join(F.transform(a, lambda x: x.told), ","), F.lit(""))
    return joined.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text(F.col("s")).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"), text(F.filter("s", lambda x: x.live)).alias("live"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("most_owners", "most_repos")])
