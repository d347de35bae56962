"""Topics: greedy bounded clustering in arrival order, capped-mass centroids, labels."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Defaults
from ..functions import text, vectors

ASSIGNED = "vault string, atom string, topic string, mass double, skipped boolean"


def topic_id(model: str, atom: str, n: int = 0) -> str:
    """Deterministic UUID (version 8) of a topic that an atom founds."""
    raw = bytearray(hashlib.sha256(f"{model}:{atom}{f':{n}' if n else ''}".encode()).digest()[:16])
    raw[6], raw[8] = (raw[6] & 0x0F) | 0x80, (raw[8] & 0x3F) | 0x80
    return str(uuid.UUID(bytes=bytes(raw)))


class Fold:
    """The topics of one vault so far."""

    def __init__(self, vault: str | None, model: str, d: Defaults):
        self.vault, self.model, self.d = vault, model, d
        self.names: list[str] = []
        # for each topic: mass and weighted sum of each (site, session), and their capped sum
        self.cells: list[dict[tuple, list]] = []
        self.sums: list[np.ndarray] = []

    def add(self, own: list) -> list[tuple]:
        """Take in a record, given by its activity windows; its rows of ``ASSIGNED``."""
        d, atom, v = self.d, own[0].atom, np.asarray(own[0].vector, np.float64)
        length = np.sqrt((v**2).sum())
        if not np.isfinite(v).all() or length < 1e-12:
            return []
        v = v / length
        scores = []
        for k, total in enumerate(self.sums):
            size = np.sqrt((total**2).sum())
            if size >= 1e-12:
                scores.append((-float(total @ v) / size, self.names[k], k))
        best = [(-s, k) for s, _, k in sorted(scores)[:2]]
        if best and best[0][0] >= d.topic_admission:
            if len(best) == 2 and best[0][0] - best[1][0] < d.topic_margin and best[1][0] >= d.runner_up_admission:
                e = np.exp([d.softmax_factor * s for s, _ in best])
                share = [(best[0][1], float(e[0] / e.sum())), (best[1][1], float(e[1] / e.sum()))]
            else:
                share = [(best[0][1], 1.0)]
        elif len(self.names) < d.max_topics:
            self.names.append(topic_id(self.model, atom))
            self.cells.append({})
            self.sums.append(np.zeros(len(v)))
            share = [(len(self.names) - 1, 1.0)]
        else:
            return [(self.vault, atom, None, 0.0, True)]
        for k, mass in share:
            for r in own:
                cell = self.cells[k].setdefault((r.site, r.session), [0.0, np.zeros(len(v))])
                before = cell[1] * (min(cell[0], 1.0) / cell[0]) if cell[0] else cell[1]
                cell[0] += r.mass * mass
                cell[1] = cell[1] + r.mass * mass * v
                self.sums[k] = self.sums[k] - before + cell[1] * (min(cell[0], 1.0) / cell[0])
        return [(self.vault, atom, self.names[k], mass, False) for k, mass in share]


def assign(rows: DataFrame, model: str, d: Defaults = DEFAULTS) -> DataFrame:
    """Soft topics of every record, in the order (first_seen, atom) of its vault.

    rows: (vault, atom, first_seen, site, session, mass, vector), one for each activity window of a record. Each record is compared with the
    centroids so far and joins the best, is shared between two close ones, founds a topic, or is skipped when the vault
    is full. The result depends on the order by definition, so a vault is one sequential fold. Vaults are dealt out and
    sorted by Spark and read in batches; a task holds a batch, ``max_topics`` centroids and the sums of their (site, session) cells."""
    names = ["vault", "atom", "topic", "mass", "skipped"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, held = None, []
        for b in batches:
            out: list[tuple] = []
            for r in b.itertuples(index=False):
                if held and (r.vault, r.first_seen, r.atom) != (held[0].vault, held[0].first_seen, held[0].atom):
                    out += fold.add(held)
                    held = []
                if fold is None or fold.vault != r.vault:
                    fold = Fold(r.vault, model, d)
                held.append(r)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(fold.add(held), columns=names)

    order = ["vault", "first_seen", "atom", "site", "session"]
    return rows.select(*order, "mass", "vector").repartition("vault").sortWithinPartitions(*order).mapInPandas(run, ASSIGNED)


def centroids(membership: DataFrame, activity: DataFrame, embedded: DataFrame) -> DataFrame:
    """(topic, centroid): per (topic, site, session) the weighted sum of vectors, scaled to a mass of at most 1; their sum, of unit length.

    membership (atom, topic, mass), activity (atom, site, session, mass), embedded (atom, vector)."""
    weights = membership.select("atom", "topic", F.col("mass").alias("w")).join(activity.select("atom", "site", "session", F.col("mass").alias("m")), "atom")
    rows = weights.join(embedded.select("atom", vectors.normalize("vector").alias("v")).where("v is not null"), "atom")
    cells = rows.select("topic", "site", "session", (F.col("w") * F.col("m")).alias("w"), F.posexplode("v").alias("i", "x"))
    each = cells.groupBy("topic", "site", "session", "i").agg(F.sum("w").alias("mass"), F.sum(F.col("w") * F.col("x")).alias("s"))
    scale = F.when(F.col("mass") > 0, F.least(F.col("mass"), F.lit(1.0)) / F.col("mass")).otherwise(F.lit(0.0))
    summed = each.groupBy("topic", "i").agg(F.sum(F.col("s") * scale).alias("s"))
    whole = summed.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p.s).alias("raw"))
    return whole.select("topic", vectors.normalize("raw").alias("centroid")).where("centroid is not null")


def members_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(topic, site, session, mass_delta): change of group masses between two memberships, for incremental upkeep."""
    keys = ["topic", "site", "session"]
    both = after.select(*keys, F.col("mass").alias("d")).unionByName(before.select(*keys, (-F.col("mass")).alias("d")))
    return both.groupBy(*keys).agg(F.sum("d").alias("mass_delta")).where(F.abs("mass_delta") > 0)


def labels(members: DataFrame, centroid: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """(topic, label): text of the member closest to the centroid, ties by atom.

    members (topic, atom, vector, effective_text, confirmed, excluded); excluded members and confirmed texts that say
    nothing do not count; a topic without any is 'Research'."""
    usable = members.where(~F.col("excluded") & (~F.col("confirmed") | text.groupable("effective_text", F.lit(None).cast("string"))))
    scored = usable.join(centroid, "topic").withColumn("cos", vectors.cosine("vector", "centroid"))
    best = scored.groupBy("topic").agg(F.min_by("effective_text", F.struct(-F.col("cos"), "atom")).alias("label"))
    topics = members.select("topic").distinct().join(best, "topic", "left")
    return topics.select("topic", F.substring(F.coalesce("label", F.lit("Research")), 1, d.label_chars).alias("label"))


def top_topic(membership: DataFrame) -> DataFrame:
    """(atom, topic): each record's topic of the greatest mass, ties by topic."""
    return membership.groupBy("atom").agg(F.min_by("topic", F.struct(-F.col("mass"), "topic")).alias("topic"))


def active(tables: dict[str, DataFrame], model: str) -> dict[str, DataFrame]:
    """Vectors, topics and memberships of one model; those of others go."""
    return {name: df.where(F.col("model") == model) if "model" in df.columns else df for name, df in tables.items()}
