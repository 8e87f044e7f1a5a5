"""Profiles, growth curves, feedback and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions import lexicon as L


def seed_table(spark) -> DataFrame:
    """(term, dimension): the seed terms."""
    return spark.createDataFrame([(t, d) for d, terms in L.SEEDS.items() for t in terms], "term string, dimension string")


def assessment(lists: DataFrame) -> DataFrame:
    """One row: passages, tokens, distinct terms, diversity, and lengths (mean, median, least, most)."""
    sizes = lists.agg(
        F.count(F.lit(1)).alias("passages"),
        F.sum(F.size("words")).cast("long").alias("tokens"),
        F.avg(F.size("words")).alias("mean_length"),
        F.min(F.size("words")).alias("shortest"),
        F.max(F.size("words")).alias("longest"),
    )
    terms = lists.select(F.explode("words").alias("term")).agg(F.count_distinct("term").alias("terms"))
    return sizes.crossJoin(terms).withColumn("diversity", F.col("terms") / F.col("tokens"))


def presence(lists: DataFrame) -> DataFrame:
    """(dimension, uses, found, share, gap): use of each dimension's seed terms; a gap below a tenth of them."""
    seeds = seed_table(lists.sparkSession)
    words = lists.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    joined = F.broadcast(seeds).join(words, "term", "left")  # the seed terms alone
    out = joined.groupBy("dimension").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("uses"), F.count("n").alias("found"), F.count(F.lit(1)).alias("size"))
    return out.withColumn("share", F.col("found") / F.col("size")).withColumn("gap", F.col("share") < 0.1)


def warmth(found: DataFrame) -> DataFrame:
    """One row: uses of feeling and relating seeds over uses of the four sober dimensions, of ``presence``."""
    uses = lambda dims: F.coalesce(F.sum(F.when(F.col("dimension").isin(list(dims)), F.col("uses"))), F.lit(0))
    warm, sober = uses(("IC", "CR")), uses(("KO", "TE", "SF", "DE"))
    return found.agg(F.when(sober > 0, warm / sober).otherwise(0.0).alias("warmth"))


def upper_median(lists: DataFrame) -> DataFrame:
    """One row: the length at half of all passages, the upper one of two; by counts of lengths, not by sorting passages."""
    counts = lists.groupBy(F.size("words").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.withColumn("upto", F.sum("n").over(Window.orderBy("length"))).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    return ahead.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("length").alias("median_length"))


def calibrated_d(diversity: Column, passages: Column, mean_length: Column) -> Column:
    """6, moved by diversity, size and length of passages, within 5 to 8."""
    d = F.lit(6.0) + F.when(diversity > 0.3, 0.5).when(diversity < 0.1, -0.5).otherwise(0.0)
    d = d + F.when(passages > 1000, 0.5).when(passages < 20, -0.5).otherwise(0.0) + F.when(mean_length > 500, 0.25).when(mean_length < 50, -0.25).otherwise(0.0)
    return F.greatest(F.lit(5.0), F.least(F.lit(8.0), d))


def growth_fit(points: DataFrame, n: str, r: str) -> DataFrame:
    """One row: slope and intercept of r over ln(n), and R squared; null below three points."""
    x, y = F.log(F.col(n)), F.col(r)
    enough = F.count(F.lit(1)) >= 3
    return points.agg(F.when(enough, F.regr_slope(y, x)).alias("slope"), F.when(enough, F.regr_intercept(y, x)).alias("intercept"), F.when(enough, F.regr_r2(y, x)).alias("r2"))


def feedback(events: DataFrame, key: str, order: list[str], helpful: str, now: Column | None = None, idle_days: float = 7.0) -> DataFrame:
    """(key, hits, weight): a weight that helpful uses raise by a tenth (3 at most) and others lower by 15 % (0.1 at least).

    The fold is bounded both ways, so order matters, but steps x -> min(high, max(low, a x)) compose:
    a day's uses of a key become one step, and the days are folded.  ``order`` starts with the time of
    use.  With ``now``, a key that was not used for ``idle_days`` loses five percent.
    """
    day = F.to_date(F.col(order[0]).cast("timestamp"))
    uses = F.array_sort(F.collect_list(F.struct(*order, F.col(helpful).alias("helpful"))))
    kind = "struct<a:double,low:double,high:double>"
    struct = lambda a, low, high: F.struct(a.alias("a"), low.alias("low"), high.alias("high")).cast(kind)
    raised = lambda s: struct(s["a"] * 1.1, F.least(F.lit(3.0), s["low"] * 1.1), F.least(F.lit(3.0), s["high"] * 1.1))
    lowered = lambda s: struct(s["a"] * 0.85, F.greatest(F.lit(0.1), s["low"] * 0.85), F.greatest(F.lit(0.1), s["high"] * 0.85))
    step = F.aggregate(uses, struct(F.lit(1.0), F.lit(0.0), F.lit(1e300)), lambda s, u: F.when(u["helpful"], raised(s)).otherwise(lowered(s)))
    days = events.groupBy(key, day.alias("day")).agg(F.count(F.lit(1)).alias("n"), step.alias("step"), F.max(order[0]).alias("last"))
    fold = F.aggregate(F.array_sort(F.collect_list(F.struct("day", "step"))), F.lit(1.0), lambda w, d: F.least(d["step"]["high"], F.greatest(d["step"]["low"], w * d["step"]["a"])))
    out = days.groupBy(key).agg(F.sum("n").alias("hits"), fold.alias("weight"), F.max("last").alias("last"))
    if now is not None:
        idle = F.unix_micros(F.col("last").cast("timestamp")) < F.unix_micros(now.cast("timestamp")) - int(idle_days * 86_400e6)
        out = out.withColumn("weight", F.when(idle, F.greatest(F.lit(0.1), F.col("weight") * 0.95)).otherwise(F.col("weight")))
    return out.select(key, "hits", "weight")


def usage_rate(events: DataFrame, key: str, ts: str, alarm: float = 50.0, since: Column | None = None) -> DataFrame:
    """(key, hits, per_day, alarm): uses per day over spans of an hour and more.

    Uses before ``since`` are the baseline: they count as hits, but neither they nor their time in the rate.
    """
    at = F.col(ts).cast("timestamp")
    inside = F.lit(True) if since is None else at >= since
    own = F.when(inside, at)
    span = (F.unix_micros(F.max(own)) - F.unix_micros(F.min(own))) / 86_400e6
    out = events.groupBy(key).agg(F.count(F.lit(1)).alias("hits"), F.count(own).alias("observed"), span.alias("days"))
    out = out.where((F.col("days") >= 1 / 24) & (F.col("observed") > 0))
    return out.select(key, "hits", (F.col("observed") / F.col("days")).alias("per_day")).withColumn("alarm", F.col("per_day") >= alarm)


def docket(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, item): lines that are open check boxes, or list items under a heading of open work.

    Headings are carried down inside a text's own lines; no rows are gathered.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<line:int,item:string>>").alias("found"))
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("text"), i.alias("line")))

    def step(acc: Column, x: Column) -> Column:
        heading = x["text"].rlike(r"^#+[ \t]")
        now = F.when(heading, x["text"].rlike(r"(?i)\b(open|todo|docket|next)\b")).otherwise(acc["open"])
        box = x["text"].rlike(r"^[ \t]*[-*][ \t]+\[ \]")
        item = x["text"].rlike(r"^[ \t]*[-*][ \t]+(?!\[[xX]\])")
        hit = box | (now & item & ~heading)
        entry = F.array(F.struct(x["line"].alias("line"), F.trim(x["text"]).alias("item"))).cast("array<struct<line:int,item:string>>")
        return F.struct(now.alias("open"), F.when(hit, F.concat(acc["found"], entry)).otherwise(acc["found"]).alias("found"))

    found = docs.select(F.col(id_col).alias("id"), F.explode(F.aggregate(numbered, start, step, lambda acc: acc["found"])).alias("e"))
    return found.select("id", "e.line", "e.item")


def deltas(snapshots: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Snapshots with the change of each column since the one before."""
    w = Window.orderBy(order)
    return snapshots.select("*", *((F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in columns))


def emergence(members: DataFrame, key: str, operations: str, dominant: str, known: list[str] | None = None, previous: list[str] | None = None) -> DataFrame:
    """(key, novelty, meta, self_reference, mutation, phase) of groups of passages by their operations."""
    ops = members.select(key, F.col(dominant).alias("dominant"), F.explode(operations).alias("op"))
    is_self = F.col("op").isin(list(L.SELF_OPERATIONS))
    distinct = lambda keep: F.count_distinct(F.when(keep, F.col("op")))
    uses = F.count(F.lit(1))
    out = ops.groupBy(key).agg(
        (distinct(~F.col("op").isin(known or [])) / F.count_distinct("op")).alias("novelty"),
        (F.sum((F.col("dominant") == "AI").cast("int")) / uses).alias("meta"),
        (F.sum(is_self.cast("int")) / uses).alias("self_reference"),
        (F.lit(0.0) if previous is None else distinct(~F.col("op").isin(previous)) / F.count_distinct("op")).alias("mutation"),
    )
    second = (F.col("novelty") > 0) & (F.col("meta") > 0.1)
    return out.withColumn("phase", F.when(second & (F.col("mutation") > 0.2), 3).when(second, 2).when(F.col("novelty") > 0, 1).otherwise(0))


def collective(members: DataFrame, key: str, operations: str, known: list[str] | None = None) -> DataFrame:
    """One row: different new operations of all groups over the sum of each group's; 1 without members, below 1 if groups share."""
    ops = members.select(F.col(key).alias("key"), F.explode(operations).alias("op")).where(~F.col("op").isin(known or [])).distinct()
    counted = ops.agg(F.count_distinct("op").alias("novel"), F.count(F.lit(1)).alias("uses")).crossJoin(members.agg(F.count(F.lit(1)).alias("rows")))
    return counted.select("novel", F.when(F.col("rows") == 0, 1.0).otherwise(F.col("novel") / F.greatest(F.col("uses"), F.lit(1))).alias("collective"))


def fingerprint(members: DataFrame, chain: str, top: int = 8) -> DataFrame:
    """(chain, n, share): the most used chains, ties by chain."""
    total = members.agg(F.count(F.lit(1)).alias("total"))
    counts = members.where(F.col(chain) != "").groupBy(chain).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), chain).limit(top).crossJoin(F.broadcast(total)).select(chain, "n", (F.col("n") / F.col("total")).alias("share"))


def effective_dimension(rows: DataFrame, vector: str, share: float = 0.9) -> tuple[int, list[float]]:
    """The least number of principal directions that explain ``share`` of the variance, and all shares.

    Each task sums x and x x', the sums are added place by place; as many numbers as the dimension
    squared reach the driver, whatever the number of tasks.
    """
    import numpy as np
    import pyarrow as pa

    def sums(batches):
        total = outer = None
        n = 0
        for batch in batches:
            column = batch.column(0).drop_null()
            if len(column):
                x = np.stack([np.asarray(v.as_py(), float) for v in column])
                total = x.sum(0) if total is None else total + x.sum(0)
                outer = x.T @ x if outer is None else outer + x.T @ x
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pylist([{"sums": [float(n), *total.tolist(), *outer.ravel().tolist()]}])

    parts = rows.select(vector).mapInArrow(sums, "sums array<double>").select(F.posexplode("sums").alias("pos", "x"))
    added = np.array([r.x for r in sorted(parts.groupBy("pos").agg(F.sum("x").alias("x")).collect(), key=lambda r: r.pos)])
    if not len(added):
        return 0, []
    d = int(len(added) ** 0.5)  # 1 + d + d * d numbers
    mean = added[1 : d + 1] / added[0]
    spread = added[d + 1 :].reshape(d, d) / added[0] - np.outer(mean, mean)
    values = np.clip(np.linalg.eigvalsh(spread)[::-1], 0, None)
    shares = np.cumsum(values) / max(values.sum(), 1e-300)
    return int(np.searchsorted(shares, share - 1e-12) + 1), shares.tolist()


def dimension_shares(rows: DataFrame, vector: str, width: int = 8) -> DataFrame:
    """(place, share, entropy): mean magnitudes of the first entries, normalised, and their entropy."""
    means = rows.agg(*(F.avg(F.abs(F.col(vector)[k].cast("double"))).alias(f"m{k}") for k in range(width)))
    total = sum((F.col(f"m{k}") for k in range(1, width)), F.col("m0"))
    shares = means.select(F.posexplode(F.array(*(F.when(total > 0, F.col(f"m{k}") / total).otherwise(0.0) for k in range(width)))).alias("place", "share"))
    entropy = shares.agg((-F.sum(F.when(F.col("share") > 0, F.col("share") * F.log2("share")).otherwise(0.0))).alias("entropy"))
    return shares.crossJoin(F.broadcast(entropy))


def seed_weights(presence_rows: DataFrame, uses: DataFrame, misread: DataFrame | None = None) -> DataFrame:
    """(term, weight) of the seed terms: 3 in a gap, 2.5 if misread, 1.5 if used, else 2."""
    seeds = seed_table(presence_rows.sparkSession)
    wrong = misread.select("term", F.lit(True).alias("misread")) if misread is not None else seeds.select("term", F.lit(True).alias("misread")).limit(0)
    joined = seeds.join(presence_rows.select("dimension", "gap"), "dimension").join(uses.select("term", F.col("cf").alias("used")), "term", "left").join(wrong, "term", "left")
    weight = F.when(F.col("gap"), 3.0).when(F.col("misread"), 2.5).when(F.col("used") > 0, 1.5).otherwise(2.0)
    return joined.select("term", "dimension", weight.alias("weight"))


def load_bearing(weights: DataFrame, key: str, top: int = 5) -> DataFrame:
    """The used keys of most weight, ties by key."""
    return weights.where("hits > 0").orderBy(F.desc(F.round("weight", 3)), key).limit(top).select(key, F.round("weight", 3).alias("weight"), "hits")
