"""Mixing sources to target weights by temperature.

Every source gets a weight proportional to its share of tokens to the power of an exponent between 0
(all alike) and 1 (as they are).  The exponent is searched by nested intervals until a target entropy or
a limit on repetition is met.  The weights become whole and part epochs of each source; which documents
come once more in a part epoch follows from a permutation of the source in blocks, filled up to the
budget.  All of it is DataFrame operations: the search reads a table with one row per source, as many
points of the interval in one job as it has parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: Parts an interval is cut into, and how often.
PARTS, ROUNDS = 32, 6
# Fixed value: a token is a word, a run of other characters than ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def token_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("bucket").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))


def whole_of(totals: DataFrame) -> float:
    return float(totals.agg(F.sum("tokens")).first()[0] or 1)


def search_exponent(totals: DataFrame, entropy_share: float | None, repetitions: float | None) -> float:
    """The smallest exponent whose weights repeat no source more than ``repetitions`` times as often as
    the largest, or the one whose entropy is ``entropy_share`` of the greatest possible; of both, the larger.

    Both measures fall as the exponent grows, so an interval that holds the answer can be cut again and again.
    """
    shares = totals.filter("tokens > 0").select(F.log(F.col("tokens") / F.lit(whole_of(totals))).alias("log_share"))

    def search(passes: Column) -> float:
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            points = [low + (high - low) * i / PARTS for i in range(PARTS + 1)]
            power = F.exp(F.col("x") * F.col("log_share"))
            measured = (shares.select("log_share", F.explode(F.array(*[F.lit(p) for p in points])).alias("x")).groupBy("x").agg(
                F.sum(power).alias("z"), F.sum(power * F.col("log_share")).alias("zl"), F.count("*").alias("sources"),
                (F.max("log_share") - F.min("log_share")).alias("spread"))
                .select("x", (F.log("z") - F.col("x") * F.col("zl") / F.col("z")).alias("entropy"), F.log("sources").alias("most"),
                        F.exp((1 - F.col("x")) * F.col("spread")).alias("epochs")))
            good = measured.agg(F.min(F.when(passes, F.col("x")))).first()[0]
            if good is None or good == low:
                return 1.0 if good is None else low
            at = points.index(good)
            low, high = points[at - 1], points[at]
        return high

    found = []
    if entropy_share is not None:
        found.append(search(F.col("entropy") <= entropy_share * F.col("most")))
    if repetitions is not None:
        found.append(search(F.col("epochs") <= repetitions))
    return max(found, default=1.0)


def mix_sources(docs: DataFrame, repetitions: float | None = 4.0, entropy_share: float | None = None, budget_tokens: int | None = None, seed: int = 17,
                id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The columns of ``docs`` with ``n_tokens``, ``weight`` and ``epochs`` of the source, ``copies`` of the
    document and its ``position`` in tokens in the source's permutation (columns of these names are replaced).

    ``copies`` is how often the document comes in the mixture: the whole epochs of its source, and one
    more if the part epoch reaches it.  ``budget_tokens`` is the size of the mixture; by default it is
    the least for which the largest source, and so every document, comes once.  A null source is a source
    of its own; documents without tokens come as often as the whole epochs; null ids and equal rows are
    permuted like others; an empty table gives no rows.
    """
    results = ["n_tokens", "weight", "epochs", "copies", "position"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in results]).alias("row")
    bucket = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_column}`").cast("string")), F.lit(""))
    u = F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"), F.lit(seed))  # rows that share an id part by their texts
    plain = docs.select(row, bucket.alias("bucket"), u.alias("u"), token_count(text_column).alias("n_tokens"))
    totals = stage(source_totals(plain), "sources")
    exponent = search_exponent(totals, entropy_share, repetitions)
    share = F.col("tokens") / F.lit(whole_of(totals))
    powers = totals.withColumn("power", F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent))).otherwise(0.0))
    z, least = powers.agg(F.sum("power"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("power")))).first()
    z, least = z or 1.0, least or 0.0
    budget = float(budget_tokens) if budget_tokens is not None else least * z
    weights = powers.select(
        "bucket", "tokens", (F.col("power") / F.lit(z)).alias("weight"),
        F.when(F.col("tokens") > 0, F.round(F.lit(budget) * F.col("power") / F.lit(z) / F.col("tokens"), 9)).otherwise(1.0).alias("epochs"),
        F.ceil(F.sqrt("documents")).alias("blocks"))
    weights = stage(weights, "weights")
    # as many blocks as documents in a block, so that neither level of the running sum gets large
    block = F.floor((F.col("u") / F.lit(2.0**64) + 0.5) * F.col("blocks"))
    blocked = plain.join(weights, "bucket").withColumn("block", block)
    before = (blocked.groupBy("bucket", "block").agg(F.sum("n_tokens").alias("held"))
              .withColumn("before", F.sum("held").over(Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
              .select("bucket", "block", F.coalesce("before", F.lit(0)).alias("before")))
    order = Window.partitionBy("bucket", "block").orderBy("u", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = (blocked.withColumn("inside", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(before, ["bucket", "block"])
              .withColumn("position", F.col("before") + F.col("inside")))
    part = F.col("epochs") - F.floor("epochs")
    copies = F.floor("epochs") + F.when((F.col("n_tokens") > 0) & (F.col("position") < part * F.col("tokens")), 1).otherwise(0)
    placed = placed.withColumn("copies", copies.cast("long"))
    return placed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in results], *results)
