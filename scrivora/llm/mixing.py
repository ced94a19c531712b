"""Mixing sources to target shares by apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivora.session import materialize

#: Targets are read by the driver: more sources than this are refused.
MAX_TARGETS = 100_000
BLOCK_TOKENS = 256
#: Tokens a shard holds, all sources together; bounds the rows that are ordered in one task.
SHARD_TOKENS = 32_000_000
#: Shards whose quotas one task deals with.
GROUP_SHARDS = 1024


def token_count(text: Column) -> Column:
    """Tokens of a text: runs of letters or digits, and every other single character that is not white space."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[\p{L}\p{N}]+", "a"), r"(?U)\s+", "")), F.lit(0)).cast("long")


def vocabulary_token_count(path: str, pattern: str):
    """A column function that counts the tokens of a byte-level BPE, given its rank file and its splitting pattern."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        coder = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(coder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients weight / (2 j + 1), at most ``caps`` each; ties go to the earlier entry.

    All quotients above a threshold are granted at once (the threshold is found by bisection), the few left singly.
    """
    weights = np.maximum(np.nan_to_num(np.asarray(weights, float)), 0)
    caps = np.full(len(weights), seats, np.int64) if caps is None else np.asarray(caps, np.int64)
    caps = np.where(weights > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(weights), np.int64)

    def granted(threshold: float) -> np.ndarray:
        return np.minimum(caps, np.minimum((weights / threshold + 1) / 2, 4e18).astype(np.int64))

    high = 2 * weights.max()
    low = high
    while granted(low).sum() < seats:
        low /= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if granted(middle).sum() >= seats else (low, middle)
    out = granted(high)
    heap = [(-weights[i] / (2 * out[i] + 1), i) for i in np.flatnonzero(out < caps)]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def allot(tokens: np.ndarray, wanted: int, rounds: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(quota, target) of the members of a source, which hold ``tokens`` each: blocks by Sainte-Laguë, and tokens.

    The targets are the quotas in tokens, at most ``rounds`` times what a member holds. What is missing to ``wanted``, or too much
    (less than a block a member), is carried from member to member until it is used up, so that the targets add up to ``wanted`` exactly, or
    to ``rounds`` times all tokens if that is less.
    """
    tokens = np.asarray(tokens, np.int64)
    room = tokens * rounds
    wanted = int(min(wanted, room.sum()))
    quota = sainte_lague(tokens, -(-wanted // block), -(-room // block))
    target = np.minimum(quota * block, room)
    rest = wanted - int(target.sum())
    free = room - target if rest > 0 else target
    moved = np.minimum(free, np.maximum(0, abs(rest) - (np.cumsum(free) - free)))
    return quota, target + (moved if rest > 0 else -moved)


class SourceMix:
    """A selection of documents in which each source has its target share of all tokens.

    1. Tokens are counted per row and summed per source, before and after the shuffle.
    2. Seats of ``block_tokens`` tokens are apportioned to the sources by Sainte-Laguë. A source wants the tokens of its share; the
       difference between these and its seats is less than a few blocks and is carried along. A source is used as few times as its
       share needs, and at most ``max_repeats`` times. What a short source cannot fill is left open, not given to others.
    3. Documents fall by a seeded hash into shards of about ``SHARD_TOKENS`` tokens, so a source that holds a third of all rows is
       spread over all shards. The blocks of a source are apportioned in the same way to groups of ``GROUP_SHARDS`` shards and then, group by
       group, to shards, so no task sees more than that many rows of a source.
    4. In a shard the documents of a source stand in seeded order on one line of tokens. Its target is filled by
       whole rounds over all of them and then from the front, up to the document in which the target ends.

    So a source is selected to at least its need, or is used up ``max_repeats`` times; and a document is used twice only if its
    source holds less than its need. The fate of a source is read off what was selected.

    Defined cases: null and empty texts have 0 tokens and are not selected; rows with a null source or one
    without target count in the total only; a target without documents, or a null or negative share, gets nothing; a
    ``max_repeats`` that is null or below 1 counts as 1; rows that come twice are rows of their own; empty tables give shares of 0; other columns are ignored.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, size=token_count, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS, seed: int = 42):
        self.spark, self.block, self.seed = docs.sparkSession, block_tokens, seed
        sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size(F.col(text_col).cast("string")).alias("tokens"))
        self.sized = materialize(sized, "sized")
        named = targets.select(F.col("source"), F.coalesce(F.greatest(F.col("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce(F.greatest("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats"))
        self.total = int(self.sized.agg(F.sum("tokens")).head()[0] or 0)
        have = self.sized.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("have"))
        plan = named.join(have, "source", "left").fillna(0, ["have"]).limit(MAX_TARGETS + 1).toPandas().sort_values("source", ignore_index=True)
        if len(plan) > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} targets")
        self.shards = max(1, -(-self.total // SHARD_TOKENS))
        seats = round(self.total * float(plan["target_share"].sum()) / block_tokens) if len(plan) else 0
        plan["seats"] = sainte_lague(plan["target_share"].to_numpy(), seats)
        plan["need"] = plan["target_share"].astype(float) * float(self.total)
        # Seats in tokens, and what is carried to reach the need.
        plan["carried"] = np.ceil(plan["need"]).astype("int64") - plan["seats"] * block_tokens
        self.plan = plan

    def quotas(self) -> DataFrame:
        """(source, shard, held, quota, target): the tokens of each source in each shard, the blocks taken from it, and the tokens
        that these make with what is carried."""
        held = self._placed().groupBy("source", "shard").agg(F.sum("tokens").alias("held")).withColumn("part", F.floor(F.col("shard") / GROUP_SHARDS).cast("long"))
        held = materialize(held, "held")
        wanted = F.col("seats") * F.lit(self.block) + F.col("carried")
        rounds = F.least("max_repeats", F.greatest(F.lit(1), F.ceil(wanted / F.greatest("have", F.lit(1)))).cast("long"))
        plan = F.broadcast(self._plan_frame().select("source", wanted.alias("wanted"), rounds.alias("rounds")))
        parts = self._allotted(held.groupBy("source", "part").agg(F.sum("held").alias("held")).join(plan, "source"), ["source"], ["part"])
        # One row per source and group of shards.
        whole = parts.select("source", "part", F.col("target").alias("wanted"), "rounds")
        return self._allotted(held.join(whole, ["source", "part"]), ["source", "part"], ["shard"]).select("source", "shard", "held", "quota", "target")

    def _allotted(self, rows: DataFrame, of: list[str], member: list[str]) -> DataFrame:
        """``rows`` (held, wanted and rounds per member) with quota and target."""
        block, names = self.block, [*of, *member]
        kinds = {n: rows.schema[n].dataType.simpleString() for n in names}

        def share(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(member, ignore_index=True)
            quota, target = allot(pdf["held"].to_numpy(), int(pdf["wanted"].iloc[0]), int(pdf["rounds"].iloc[0]), block)
            return pdf[[*names, "held", "rounds"]].assign(quota=quota, target=target)

        schema = ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", held long, rounds long, quota long, target long"
        return rows.groupBy(*of).applyInPandas(share, schema)

    def _plan_frame(self) -> DataFrame:
        whole = {c: "int64" for c in ("have", "seats", "carried", "max_repeats")}
        plan = self.plan.astype(whole)[["source", "target_share", "max_repeats", "have", "seats", "carried", "need"]]
        return self.spark.createDataFrame(plan, "source string, target_share double, max_repeats long, have long, seats long, carried long, need double")

    def _placed(self) -> DataFrame:
        chance = F.xxhash64("doc_id", F.lit(self.seed))
        known = self.sized.where((F.col("tokens") > 0) & F.col("source").isNotNull())
        return known.withColumn("chance", chance).withColumn("shard", F.pmod("chance", F.lit(self.shards)))

    def selection(self) -> DataFrame:
        """(doc_id, source, shard, block, tokens, copies) of the selected rows."""
        order = Window.partitionBy("source", "shard").orderBy("chance", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        quotas = self.quotas().where(F.col("target") > 0)
        placed = self._placed().join(F.broadcast(self._plan_frame().select("source")), "source", "left_semi")
        lined = placed.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
        filled = lined.join(quotas, ["source", "shard"])
        copies = F.expr("target div held") + F.when(F.col("before") < F.col("target") % F.col("held"), 1).otherwise(0)
        block = F.floor(F.col("before") / F.lit(self.block)).cast("long").alias("block")
        return filled.withColumn("copies", copies.cast("int")).where(F.col("copies") > 0).select("doc_id", "source", "shard", block, "tokens", "copies")

    def report(self) -> DataFrame:
        """One row per target: source, target_share, max_repeats, need, have, seats, selected tokens, reached_share (of all
        tokens), most_copies, and ``fate``, all of which is read off the selection: ``short`` if less than the need was selected,
        ``enough`` if no document was used twice, else ``repeat``."""
        chosen = self.selection().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("selected"), F.max("copies").alias("most_copies"))
        full = self._plan_frame().join(chosen, "source", "left").fillna(0, ["selected", "most_copies"])
        fate = F.when(F.col("selected") < F.col("need"), "short").when(F.col("most_copies") <= 1, "enough").otherwise("repeat")
        return full.select("source", "target_share", "max_repeats", "need", "have", "seats", "selected", F.round(F.col("selected") / F.lit(float(max(1, self.total))), 6).alias("reached_share"), "most_copies", fate.alias("fate"))
