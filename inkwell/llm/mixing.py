"""Mixing sources to target weights that change over training.

A schedule gives each source a weight at knots of training time t in [0, 1], linear between
them; a source's share at t is its weight over the sum of weights at the knots' ends (weights
are normalised at each knot, so shares are linear between knots and add up to 1). With a
budget of T tokens, source s has demanded D_s(t) = T * integral of its share from 0 to t. Its
documents, in hashed order, offer tokens cumulatively; the document that starts at c is due
when D_s(t) = c, which is a quadratic in t on each segment and is solved in closed form. A
source that runs out starts another epoch. Documents due at t < 1 are emitted, with position t.

The cumulative sums never put a source on one task: rows are summed by (source, hash bucket), and
the small table of bucket sums gives each bucket's first and last position. So a row is sent,
once, to the part of the order (a range of positions) that its bucket lies in, or to the few parts
that its bucket touches; there the rows of a bucket are summed in order, and each part keeps its
own. Whole rows are shuffled that one time if the table of buckets is small enough to broadcast
(its size is
measured first), else once more to join it. The number of parts follows from the size of the input.
By default T is the least budget at which every document is used at least once.

Defined results: a null source is a source of its own (it matches the schedule's key None); a
document without tokens is due where its predecessor's last token is, and all of a source without
any tokens at position 0, once, if the schedule has no weights of its own or gives it one; rows are
in the order of the hashes of id and text, so null ids, repeated ids and ties have a place, and equal
rows get different places; texts may be null (no tokens); a column named epoch or position (any case)
is replaced if whole rows are carried; other columns keep their names; an empty table gives no
rows. A source without weight at all knots is not emitted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import numbered, place, without

PART_BYTES = 128 << 20
# Of scripts that don't separate words each character counts.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
WORD = rf"[{UNSPACED}]|[^ \t\n\r{UNSPACED}]+"


def word_count(text: Column) -> Column:
    """White-space separated words, and characters of unspaced scripts: the default measure of demand.

    The pattern with those scripts is slow; texts without any character from U+0E00 on, for which
    the short pattern says the same, are spared it.
    """
    count = F.when(text.rlike(r"[\x{0E00}-\x{10FFFF}]"), F.regexp_count(text, F.lit(WORD)))
    return F.coalesce(count.otherwise(F.regexp_count(text, F.lit(r"[^ \t\n\r]+"))), F.lit(0)).cast("long")


def parts_for(docs: DataFrame) -> int:
    """Parts of about PART_BYTES as the optimizer estimates the input (rows that come from files), at
    least as many as shuffles have."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // PART_BYTES)) if size < 1 << 60 else least


def due(demand: Column, shares: list[Column], knots: list[float]) -> Column:
    """The t at which the integral of a share, linear between its values at the knots, is demand.

    1 where all of the schedule isn't enough.
    """
    out = F.lit(1.0)
    before = F.lit(0.0)
    parts = []
    for k in range(len(knots) - 1):
        h = knots[k + 1] - knots[k]
        a, b = shares[k], shares[k + 1]
        area = (a + b) * (h / 2)
        q = demand - before
        slope = (b - a) / h
        # The root in the form that stays exact for slopes near 0.
        root = F.sqrt(F.greatest(a * a + F.lit(2.0) * slope * q, F.lit(0.0)))
        t = F.lit(knots[k]) + F.when(q <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * q / (a + root))
        parts.append((before + area, t))
        before = before + area
    for upto, t in reversed(parts):
        out = F.when(demand < upto, F.least(t, F.lit(1.0))).otherwise(out)
    return out


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokens_col: str | None = None,
    schedule: dict[str | None, list[float]] | None = None,
    knots: tuple[float, ...] = (0.0, 1.0),
    tempers: tuple[float, ...] = (0.5, 1.0),
    budget: float | None = None,
    carry: bool = False,
    report: bool = True,
    parts: int | None = None,
) -> DataFrame:
    """All documents in the order of training: partitioned by range of position, and sorted.

    schedule: source -> weight at each knot. Without one, a source's weight at knot k is its
    token count to the power tempers[k]: small sources are favoured early, and the corpus is
    met as it is late. tokens_col: a column of token counts (as of prefix_counts); without it
    words are counted. carry: keep all columns of docs; report: add epoch and position to them.
    Without carry: doc_id, source, n_tokens, epoch, position.
    """
    if len(knots) < 2 or knots[0] != 0 or knots[-1] != 1 or list(knots) != sorted(set(knots)):
        raise ValueError("knots must rise from 0 to 1")
    n = len(knots)
    parts = parts or parts_for(docs)
    base = numbered(docs)
    kept = without(docs.columns, ("epoch", "position") if report else ()) if carry else []
    text = F.col(place(docs, text_col)).cast("string")
    source = F.col(place(docs, source_col)).cast("string")
    ident = F.col(place(docs, id_col))
    count = word_count(text) if tokens_col is None else F.coalesce(F.col(place(docs, tokens_col)).cast("long"), F.lit(0))
    whole = F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    # Some buckets a part and source: about one in eight touches a boundary and is sent twice.
    bits = min(24, max(6, (8 * parts - 1).bit_length()))
    rows = base.select(
        *(F.col(f"c{i}") for i in kept),
        ident.alias("doc_id"),
        # A source as a key that is never null: '' for null, else s and the name.
        F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("s"),
        count.alias("n"),
        F.md5(whole).alias("h"),
    ).withColumn("b", F.shiftright(F.conv(F.substring("h", 1, 6), 16, 10).cast("int"), 24 - bits))

    # Tokens of each source and bucket, whatever the corpus, from what they need of the input.
    sums = stored(rows.select("s", "b", "n").groupBy("s", "b").agg(F.sum("n").alias("bucket")))
    by_source = Window.partitionBy("s")
    # Stored, so that its size is known when the join with whole rows is planned.
    offsets = stored(sums.select("s", "b", "bucket", (F.sum("bucket").over(by_source.orderBy("b")) - F.col("bucket")).alias("before")))
    supply = sums.groupBy("s").agg(F.sum("bucket").cast("double").alias("supply"))
    # One row a source from here on: windows over all of them are small.
    everything = Window.partitionBy(F.lit(0))
    weights = [_weight(k, schedule, tempers) for k in range(n)]
    shares = supply.select("s", F.col("supply").alias("a"), *(w.alias(f"v{k}") for k, w in enumerate(weights)))
    live = F.col("a") > 0
    totals = [F.sum(F.when(live, F.col(f"v{k}"))).over(everything) for k in range(n)]
    shares = shares.select(
        "s", "a", F.greatest(*(F.col(f"v{k}") for k in range(n))).alias("most"),
        *(F.coalesce(F.when(live, F.col(f"v{k}")) / t, F.lit(0.0)).alias(f"w{k}") for k, t in enumerate(totals)),
    )
    mean = sum(
        ((F.col(f"w{k}") + F.col(f"w{k + 1}")) * ((knots[k + 1] - knots[k]) / 2) for k in range(n - 1)),
        F.lit(0.0),
    )
    shares = shares.withColumn("mean", mean)
    need = F.max(F.when(F.col("mean") > 0, F.col("a") / F.col("mean"))).over(everything)
    shares = shares.withColumn("budget", F.lit(float(budget)) if budget else need)
    if schedule is None:
        shares = shares.where((F.col("mean") > 0) | ~live)
    else:
        shares = shares.where((F.col("mean") > 0) | (~live & (F.col("most") > 0)))

    put = rows.join(offsets, ["s", "b"]).join(shares, "s")
    demand = F.col("budget") * F.col("mean")
    due_at = lambda first: due((first + F.col("epoch") * F.col("a")) / F.col("budget"), [F.col(f"w{k}") for k in range(n)], list(knots))
    last_epoch = lambda first: F.when(live, F.ceil((demand - first) / F.col("a")).cast("int") - 1).otherwise(0)
    at_part = lambda position: F.least(F.floor(position * parts), F.lit(parts - 1)).cast("int")
    # Of the bucket: epochs in which its first token is due, and the parts from its first to its last.
    start = F.least(F.col("before").cast("double"), F.greatest(F.col("a") - 1, F.lit(0.0)))
    put = put.withColumn("last", last_epoch(start)).where("last >= 0")
    put = put.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("last"))))
    put = put.withColumn("lo", F.when(live, at_part(due_at(start))).otherwise(0))
    put = put.withColumn("hi", F.when(live, F.greatest(at_part(due_at(F.col("before") + F.col("bucket"))), "lo")).otherwise(0))
    put = put.withColumn("part", F.explode(F.sequence("lo", "hi"))).repartitionById(parts, "part")
    in_bucket = Window.partitionBy("part", "s", "b", "epoch").orderBy("h", "n").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("n").over(in_bucket), F.lit(0))
    # A document without tokens is where the last token before it is.
    first = F.when(F.col("n") > 0, first).otherwise(F.least(first, F.greatest(F.col("a") - 1, F.lit(0.0))))
    put = put.withColumn("first", first.cast("double"))
    put = put.where(F.col("epoch") <= last_epoch(F.col("first")))
    put = put.withColumn("position", F.when(live, due_at(F.col("first"))).otherwise(0.0))
    put = put.where(F.greatest("lo", F.least("hi", at_part(F.col("position")))) == F.col("part"))
    put = put.sortWithinPartitions("position", "h", "n", "epoch")
    if carry:
        names = [docs.columns[i] for i in kept]
        more = ["epoch", "position"] if report else []
        return put.select(*(F.col(f"c{i}") for i in kept), *more).toDF(*names, *more)
    return put.select("doc_id", F.when(F.col("s") != "", F.substring("s", 2, 1 << 30)).alias("source"), F.col("n").alias("n_tokens"), "epoch", "position")


def _weight(k: int, schedule, tempers) -> Column:
    if schedule is None:
        return F.pow(F.col("supply"), F.lit(float(tempers[k])))
    out = F.lit(0.0)
    for source, values in schedule.items():
        is_it = F.col("s") == F.lit("" if source is None else "s" + source)
        out = F.when(is_it, F.lit(float(values[k]))).otherwise(out)
    return out


def oracle(knots=(0.0, 1.0), tempers=(0.5, 1.0)) -> str:
    """mix_sources with its defaults over `documents`, for two knots, in SQL."""
    assert tuple(knots) == (0.0, 1.0) and not math.isnan(sum(tempers))
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS h
  FROM documents),
a AS (SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS a FROM d GROUP BY source),
c0 AS (
  SELECT d.*, a.a, sum(n_tokens) OVER (PARTITION BY d.source ORDER BY h, n_tokens
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS c
  FROM d JOIN a ON a.source IS NOT DISTINCT FROM d.source),
c AS (SELECT * REPLACE (CASE WHEN n_tokens > 0 THEN c ELSE least(c, greatest(a - 1, 0)) END AS c) FROM c0),
w AS (
  SELECT source, pow(a, {tempers[0]}) / (SELECT sum(pow(a, {tempers[0]})) FROM a WHERE a > 0) AS w0,
         pow(a, {tempers[1]}) / (SELECT sum(pow(a, {tempers[1]})) FROM a WHERE a > 0) AS w1 FROM a WHERE a > 0),
b AS (SELECT max(a.a / ((w0 + w1) / 2)) AS t FROM w JOIN a ON a.source IS NOT DISTINCT FROM w.source),
e AS (
  SELECT doc_id, c.source, n_tokens, c, a, w0, w1, t,
         unnest(range(CAST(ceil((t * (w0 + w1) / 2 - c) / a) AS BIGINT))) AS epoch
  FROM c JOIN w ON w.source IS NOT DISTINCT FROM c.source CROSS JOIN b),
q AS (SELECT *, (c + epoch * a) / t AS q FROM e)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch,
       round(CASE WHEN q <= 0 THEN 0 ELSE 2 * q / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * q)) END, 6) AS position
FROM q
UNION ALL
SELECT doc_id, source, 0, 0, 0.0 FROM c WHERE a = 0"""
