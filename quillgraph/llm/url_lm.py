"""Operator 8, URL filters: rules, then a ratio of character language models.

Rules decide first: a rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest wins.
For urls without a rule two variable-order Markov models of characters (Witten-Bell interpolation of orders 0 to ORDER), one of
accepted and one of rejected urls, give a log-likelihood difference by character; at or over a threshold the url is allowed. The
models are fitted on every distinct labelled url (by default: those that the rules decide) but one in HOLD, which is held out; all that
are held out set the threshold where the two error rates meet.

Models are tables: counts of characters after each context, summed by Spark, and from them the log ratio of each run of ORDER + 1
characters that occurs. Ratios of the most frequent runs are broadcast (base.hot_level bounds them), the others meet their urls in a
shuffle. Ratios are whole multiples of 1 / UNIT, so that their sums, and with them verdicts, don't depend on an order.

Edge cases: a null url or one without "://" has an empty host and path and score 0; a class without urls leaves uniform models, all
scores 0 and all such urls allowed; ties allow; repeated rows are judged alike; an empty table gives an empty table; only the named
columns are read. The list of rules is a parameter that is sent to every task: at most MOST_RULES.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import hot_level, let, saved, ship, shuffle_width, whole, with_long

ORDER, HOLD, MOST_RULES = 5, 4, 100_000
UNIT = 2**32
#: Fixed values of the contract: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Rules:
    """Rules by host; the longest that fits."""

    def __init__(self, rules):
        if len(rules) > MOST_RULES:
            raise ValueError(f"over {MOST_RULES} rules")
        self.by_host: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for h, p, verdict in rules:
            self.by_host[h].append((p, verdict))
        for own in self.by_host.values():
            own.sort(key=lambda x: (-len(x[0]), x))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict)."""
        found, at = None, 0
        while at >= 0:
            suffix = host[at:]
            for p, verdict in self.by_host.get(suffix, ()):
                if path.startswith(p):
                    if found is None or len(suffix) + len(p) > len(found[0]):
                        found = suffix + p, verdict
                    break
            at = host.find(".", at) + 1 or -1
        return found


class Markov:
    """Witten-Bell interpolated model of characters, in memory: what log_ratios() gives for large tables."""

    def __init__(self, texts: list[str], order: int = ORDER):
        self.order = order
        counts: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for t in texts:
            t = "\x02" * order + t + "\x03"
            for i in range(order, len(t)):
                for k in range(order + 1):
                    counts[t[i - k : i]][t[i]] += 1
        self.counts = {c: dict(n) for c, n in counts.items()}
        self.totals = {c: sum(n.values()) for c, n in self.counts.items()}
        self._memory: dict[tuple[str, str], float] = {}

    def _probability(self, context: str, c: str) -> float:
        if (context, c) in self._memory:
            return self._memory[context, c]
        shorter = self._probability(context[1:], c) if context else 1 / 0x10000
        n = self.counts.get(context)
        p = shorter if n is None else (n.get(c, 0) + len(n) * shorter) / (self.totals[context] + len(n))
        if len(self._memory) < 500_000:
            self._memory[context, c] = p
        return p

    def log_likelihood(self, text: str) -> float:
        t = "\x02" * self.order + text + "\x03"
        return sum(math.log(self._probability(t[i - self.order : i], t[i])) for i in range(self.order, len(t)))


class Ratio:
    """The two models and the threshold, in memory."""

    def __init__(self, good: list[str], bad: list[str], order: int = ORDER):
        held = lambda x, want: [t for i, t in enumerate(x) if (i % HOLD == 0) is want or len(x) < HOLD]
        both = bool(good) and bool(bad)
        self.good, self.bad = Markov(held(good, False) if both else [], order), Markov(held(bad, False) if both else [], order)
        self.threshold = 0.0
        if both:
            g, b = sorted(map(self.score, held(good, True))), sorted(map(self.score, held(bad, True)))
            self.threshold = self._meet(g, b)

    @staticmethod
    def _meet(good: list[float], bad: list[float]) -> float:
        """Where the share of good below equals the share of bad at or above; in the middle of a gap."""
        values = sorted({*good, *bad})
        cuts = [(x + y) / 2 for x, y in zip(values, values[1:], strict=False)] or [0.0]
        errors = [(abs(sum(x < c for x in good) / len(good) - sum(x >= c for x in bad) / len(bad)), sum(x < c for x in good) / len(good) + sum(x >= c for x in bad) / len(bad), c) for c in cuts]
        least = min(e[1] for e in errors)
        return min(e for e in errors if e[1] <= least + 0.02)[2]

    def score(self, text: str) -> float:
        return (self.good.log_likelihood(text) - self.bad.log_likelihood(text)) / (len(text) + 1) if text else 0.0


def labelled(urls: DataFrame, verdict: Column, url: str) -> DataFrame:
    """(t, v): host and path of all distinct urls that have a verdict."""
    text = F.concat(host(F.col(url)), path(F.col(url)))
    return urls.where(F.col(url).isNotNull()).select(text.alias("t"), verdict.alias("v")).where("v is not null").distinct()


def rule_verdict(host: Column, path: Column, rules=RULES) -> Column:
    """The verdict of the longest rule that fits, null if none does; for short lists of rules."""
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        out = F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.lit(verdict)).otherwise(out)
    return out


def _ruled(rules: Rules):
    def run(frames):
        for pdf in frames:
            hits = [rules.match(h, p) or (None, None) for h, p in zip(pdf["host"], pdf["path"], strict=True)]
            yield pdf.assign(rule=[h[0] for h in hits], told=[h[1] for h in hits])

    return run


def _runs(text: Column) -> Column:
    """The runs of ORDER + 1 characters that end at each character of a text and at its end."""
    padded = F.concat(F.lit("\x02" * ORDER), text, F.lit("\x03"))
    return let(F.split(padded, ""), lambda chars: F.transform(F.sequence(F.lit(1), F.size(chars) - ORDER), lambda i: F.array_join(F.slice(chars, i, ORDER + 1), "")))


def _folds(spark, training) -> DataFrame | None:
    """(t, v, fit, held) of a table (t, v), by hash, or of two lists, by place; null if a class has no texts. A class of under HOLD texts,
    or of one fold, is both."""
    if isinstance(training, DataFrame):
        rows = training.select("t", "v", (F.pmod(F.xxhash64("t"), F.lit(HOLD)) == 0).alias("held"))
    else:
        rows = spark.createDataFrame([(t, v, i % HOLD == 0) for v, own in zip(("allow", "block"), training, strict=True) for i, t in enumerate(own)], "t string, v string, held boolean")
    sizes = {v: (n, held) for v, n, held in rows.where(F.col("v").isin("allow", "block")).groupBy("v").agg(F.count("*"), F.count_if("held")).collect()}
    if len(sizes) < 2:
        return None
    both = F.col("v").isin(*(v for v, (n, held) in sizes.items() if n < HOLD or held in (0, n)))
    return rows.select("t", "v", (~F.col("held") | both).alias("fit"), (F.col("held") | both).alias("held"))


def log_ratios(runs: DataFrame) -> DataFrame:
    """(g, n, q) of runs (g, n, good, bad: how often it is judged, fitted as accepted and as rejected): q / UNIT is the log ratio of its last
    character after those before it."""
    parts = runs.select("good", "bad", F.posexplode(F.array(*(F.right("g", F.lit(k + 1)) for k in range(ORDER + 1)))).alias("k", "s"))
    sums = parts.groupBy("k", "s").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).withColumn("context", F.expr("substring(s, 1, k)"))
    # the characters after a context: as many rows as there are characters at most
    after = Window.partitionBy("k", "context")
    counts = {f"{a}_{x}": w for x in ("good", "bad") for a, w in (("total", F.sum(x).over(after)), ("kinds", F.count_if(F.col(x) > 0).over(after)))}
    stats = saved(sums.withColumns(counts), "url-counts")
    at = None
    for k in range(ORDER + 1):
        own = stats.where(F.col("k") == k)
        if at is None:
            own = own.withColumns({"p_good": F.lit(1 / 0x10000), "p_bad": F.lit(1 / 0x10000)})
        else:
            own = own.withColumn("shorter", F.right("s", F.lit(k))).join(at, "shorter")
        # a context that was never seen says nothing
        p = {x: F.when(F.col(f"total_{x}") == 0, F.col(f"p_{x}")).otherwise((F.col(x) + F.col(f"kinds_{x}") * F.col(f"p_{x}")) / (F.col(f"total_{x}") + F.col(f"kinds_{x}"))) for x in ("good", "bad")}
        at = own.select(F.col("s").alias("shorter"), p["good"].alias("p_good"), p["bad"].alias("p_bad"))
    q = F.round((F.log("p_good") - F.log("p_bad")) * UNIT).cast("long")
    return runs.select("g", "n").join(at.select(F.col("shorter").alias("g"), q.alias("q")), "g")


def scored(items: DataFrame) -> DataFrame:
    """(rid, score) of items (rid, t, v, fit, held), where fit is true or false for training texts and null for others."""
    weight = lambda v: F.count_if(F.coalesce(F.col("fit") & (F.col("v") == v), F.lit(False)))
    asked = F.coalesce(F.col("held"), F.lit(True))
    runs = saved(items.select("v", "fit", asked.alias("asked"), F.explode(_runs(F.col("t"))).alias("g")).groupBy("g").agg(F.count_if("asked").alias("n"), weight("allow").alias("good"), weight("block").alias("bad")), "url-runs")
    ratios = saved(log_ratios(runs).where("n > 0").select("g", "n", "q"), "url-ratios")
    total = ratios.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > hot_level(total)
    places = items.where(asked & (F.col("t") != "")).select("rid", F.explode(_runs(F.col("t"))).alias("g"))
    # the hot runs are few by their level
    near = places.join(F.broadcast(ratios.where(hot).select("g", "q")), "g", "left")
    far = near.where("q is null").drop("q").join(ratios.where(~hot).select("g", "q"), "g")
    sums = [x.groupBy("rid").agg(F.sum("q").alias("q"), F.count("*").alias("k")) for x in (near.where("q is not null"), far)]
    return sums[0].union(sums[1]).groupBy("rid").agg((F.sum("q") / UNIT / F.sum("k")).alias("score"))


def threshold(held: DataFrame) -> float:
    """Where the share of accepted urls below equals the share of rejected ones at or above, in the middle of a gap, over all rows (score, v);
    only cuts whose errors are within 0.02 of the least count. Scores are summed up in ranges, so no task sees them all."""
    values = held.groupBy("score").agg(F.count_if(F.col("v") == "allow").alias("good"), F.count_if(F.col("v") == "block").alias("bad"))
    values = saved(values.repartitionByRange(shuffle_width(held.sparkSession), "score").withColumn("part", F.spark_partition_id()), "url-scores")
    # one row for each range
    parts, earlier, every = values.groupBy("part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.min("score").alias("least")), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part")
    parts = parts.select("part", F.coalesce(F.sum("g").over(earlier), F.lit(0)).alias("g"), F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b"), F.lead("least").over(every).alias("following"))
    good, bad = values.agg(F.sum("good"), F.sum("bad")).first()
    inside = Window.partitionBy("part").orderBy("score")
    rows = values.withColumns({"up_good": F.sum("good").over(inside), "up_bad": F.sum("bad").over(inside), "next": F.lead("score").over(inside)}).join(F.broadcast(parts), "part")
    rows = rows.withColumn("next", F.coalesce("next", "following")).where("next is not null")
    missed, passed = (F.col("up_good") + F.col("g")) / good, 1 - (F.col("up_bad") + F.col("b")) / bad
    cuts = saved(rows.select(F.abs(missed - passed).alias("apart"), (missed + passed).alias("errors"), ((F.col("score") + F.col("next")) / 2).alias("cut")), "url-cuts")
    least = cuts.agg(F.min("errors")).first()[0]
    if least is None:
        return 0.0
    return cuts.where(F.col("errors") <= least + 0.02).agg(F.min(F.struct("apart", "errors", "cut")).alias("best")).first()["best"]["cut"]


def apply(pages: DataFrame, id: str = "page_id", url: str = "url", rules=RULES, training: DataFrame | tuple[list[str], list[str]] | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row. training: host-and-path texts, as a table (t, v) with v allow or block or as lists
    of accepted and of rejected ones."""
    spark = pages.sparkSession
    ship(spark)
    u = F.col("url")
    source = pages.select(whole(id).alias("id"), F.col(f"`{url}`").cast("string").alias("url"))
    ruled = source.select("id", host(u).alias("host"), path(u).alias("path")).mapInPandas(_ruled(Rules(rules)), "id string, host string, path string, rule string, told string")
    rows = saved(ruled.withColumn("t", F.concat("host", "path")), "url-rows")
    folds = _folds(spark, rows.where("told is not null").select("t", F.col("told").alias("v")).distinct() if training is None else training)
    if folds is None:
        judged, cut = rows.withColumn("score", F.lit(0.0)), 0.0
    else:
        none = {"v": F.lit(None).cast("string"), "fit": F.lit(None).cast("boolean"), "held": F.lit(None).cast("boolean")}
        items = rows.withColumns(none).unionByName(folds, allowMissingColumns=True).withColumn("rid", F.monotonically_increasing_id())
        items = saved(items, "url-items")
        scores = saved(scored(items), "url-sums")
        # a text without characters has no runs
        judged = items.join(scores, "rid", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        cut = threshold(judged.where("held").select("score", "v"))
        judged = judged.where("fit is null")
    verdict = F.coalesce("told", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return with_long(judged.select("id", "host", "path", "rule", verdict.alias("verdict"), "score")).withColumnRenamed("id", id)
