"""URLs judged by rules, and where none fits by two character models. DataFrame functions only.

A rule allows or blocks a host, all its subdomains, and paths that start like its own. URLs that a rule
decides teach two variable-order Markov models, of accepted and of rejected URLs: the probability of a
character after its last ``order`` characters, smoothed with that after one character fewer, and so on
down to no context at all (Witten and Bell: a context gives as many parts to the shorter one as
different characters were seen after it),

    p(c | h) = (n(h c) + t(h) * p(c | h without its first character)) / (n(h) + t(h)).

A URL's score is the difference of its two log-likelihoods over its number of characters. The URLs that
rules decide are dealt to two halves by a digest, and each half is scored by the models of the other one;
the threshold is where both classes' scores are equally many standard deviations away from their means.
A URL that no rule fits has the mean of both halves' scores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.llm.names import all_but, fresh, quoted
from corpus_spark.llm.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters of context.
ORDER = 4
START, END = "\x02", "\x03"
# Scores are rounded, because sums depend on the order of their rows in the last digits.
DIGITS = 6
# Counts of each class in each half.
_KINDS = [f"{action}_{half}" for half in (0, 1) for action in ("allow", "block")]


@dataclass(frozen=True)
class Rule:
    action: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


# The rules asked for.
RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)://(.*)", 1))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty where there is no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(pattern, action) of the longest rule that fits, of equally long ones the first; null where none does."""
    found = F.lit(None).cast("struct<pattern:string,action:string>")
    for rule in sorted(rules, key=lambda rule: len(rule.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.action).alias("action"))).otherwise(found)
    return found


def half_of(url: Column) -> Column:
    """0 or 1, by the first digit of the URL's MD5."""
    return (F.instr(F.lit("13579bdf"), F.left(F.md5(url), F.lit(1))) > 0).cast("int")


def grams(url: Column, order: int) -> Column:
    """Each character of the URL in lower case, and its end, with the ``order`` characters before it.

    The characters are looked up by place in one array, so the time is linear in the URL.
    """
    characters = F.concat(
        F.array_repeat(F.lit(START), order), F.regexp_extract_all(F.translate(url, UPPER, LOWER), F.lit("(?s)."), F.lit(0)), F.array(F.lit(END))
    )
    # A list of one, so that the characters are taken apart once.
    each = F.transform(
        F.array(characters),
        lambda c: F.transform(
            F.sequence(F.lit(0), F.size(c) - order - 1), lambda i: F.concat(*[F.get(c, i + step) for step in range(order + 1)])
        ),
    )
    return F.get(each, F.lit(0))


def probabilities(counts: DataFrame, order: int) -> DataFrame:
    """(gram, and for each kind the smoothed probability of its last character after the others).

    ``counts`` has every gram that is asked for, with its number in each kind.
    """
    found = None
    for size in range(1, order + 2):
        own = counts.groupBy(F.right("gram", F.lit(size)).alias("gram")).agg(*[F.sum(kind).alias(kind) for kind in _KINDS])
        # A context has no more rows than there are different characters.
        context = Window.partitionBy(F.left("gram", F.lit(size - 1)))
        own = own.select(
            "gram", *_KINDS, F.count(F.lit(1)).over(context).alias("letters"),
            *[each for kind in _KINDS for each in (F.sum(kind).over(context).alias(f"{kind}_n"), F.count_if(F.col(kind) > 0).over(context).alias(f"{kind}_t"))],
        )
        if found is None:
            shorter = {kind: 1 / F.col("letters") for kind in _KINDS}
        else:
            own = own.withColumn("rest", F.right("gram", F.lit(size - 1))).join(found, "rest", "left")
            shorter = {kind: F.col(f"{kind}_p") for kind in _KINDS}
        p = {
            kind: F.when(F.col(f"{kind}_n") > 0, (F.col(kind) + F.col(f"{kind}_t") * shorter[kind]) / (F.col(f"{kind}_n") + F.col(f"{kind}_t")))
            .otherwise(shorter[kind]) for kind in _KINDS
        }
        found = own.select(F.col("gram").alias("rest"), *[p[kind].alias(f"{kind}_p") for kind in _KINDS])
    return found.withColumnRenamed("rest", "gram")


def scored_urls(urls: DataFrame, order: int) -> DataFrame:
    """(key, half_0, half_1): the score of each URL by the models of either half.

    The models grow with the URLs: every gram of every URL is a row. A gram that most URLs share is one
    row of the models, and Spark splits its rows on the other side. What Spark would take for as
    small as the file it is made of (the grams of all URLs, the counts of a level) is on the left of left joins, which find
    every row, so only models may be broadcast, by the size they have when they are made.
    """
    placed = urls.select("key", "half", "action", F.explode(grams(F.coalesce("url", F.lit("")), order)).alias("gram"))
    counts = placed.groupBy("gram").agg(*[
        F.count_if((F.col("half") == int(kind[-1])) & (F.col("action") == kind[:-2])).alias(kind) for kind in _KINDS
    ])
    models = probabilities(written(counts, "url-grams"), order)
    ratios = models.select("gram", *[F.log(F.col(f"allow_{half}_p") / F.col(f"block_{half}_p")).alias(f"ratio_{half}") for half in (0, 1)])
    scored = placed.select("key", "gram").join(ratios, "gram", "left").groupBy("key")
    return scored.agg(*[F.round(F.avg(f"ratio_{half}"), DIGITS).alias(f"half_{half}") for half in (0, 1)])


def threshold(scored: DataFrame) -> float | None:
    """Where the scores of both classes, each by the models of the other half, are equally many standard
    deviations away from their means; None where a half lacks a class. Nine numbers come to the driver."""
    crossed = F.when(F.col("half") == 0, F.col("half_1")).otherwise(F.col("half_0"))
    parts = [
        each for action in ("allow", "block") for own in [F.when(F.col("action") == action, crossed)]
        for each in (F.avg(own).alias(f"{action}_mean"), F.stddev_pop(own).alias(f"{action}_spread"))
    ]
    kinds = [F.count_if((F.col("half") == int(kind[-1])) & (F.col("action") == kind[:-2])).alias(kind) for kind in _KINDS]
    row = scored.agg(*parts, *kinds).first()
    if not all(row[kind] for kind in _KINDS):
        return None
    spread = row.allow_spread + row.block_spread
    if spread == 0:
        return round((row.allow_mean + row.block_mean) / 2, DIGITS)
    return round((row.allow_mean * row.block_spread + row.block_mean * row.allow_spread) / spread, DIGITS)


def judge(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, order: int = ORDER) -> DataFrame:
    """The frame with ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and ``score``.

    The longest rule that fits decides; its pattern is ``rule``. Where none fits the score does: block
    below the threshold. A score is positive where a URL looks more like the accepted ones, and of a
    URL that a rule decides it comes from URLs other than it. A null URL, or one without ``://``, has an
    empty host and path; it is judged like any other, null as empty. Where the rules leave one of the halves without
    accepted or rejected URLs nothing can be learnt, and what no rule fits is allowed. Equal URLs are
    judged, and counted in the models, once; repeated rows come out repeated. An empty table gives an empty
    table. Columns already named as the new ones are replaced, others pass through, and the column of the URLs may not
    have such a name. Rules are a parameter: each adds an expression. Runs jobs when called.
    """
    new = ("host", "path", "rule", "verdict", "score")
    if url.lower() in new:
        raise ValueError(f"column {url} is read, so it cannot be written too")
    value = F.col("url")
    urls = df.select(quoted(url).alias("url")).distinct().withColumns({"host": host_of(value), "path": path_of(value)})
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("fit", fit).select(
        F.monotonically_increasing_id().alias("key"), "url", "host", "path", F.col("fit.pattern").alias("rule"), F.col("fit.action").alias("action"),
        F.coalesce(half_of(value), F.lit(0)).alias("half"),
    )
    # Keys are facts once they are written.
    urls = written(urls, "urls")
    scored = written(scored_urls(urls, order).join(urls.select("key", "half", "action").hint("merge"), "key"), "scored-urls")
    limit = threshold(scored)
    score = (
        F.when(F.col("action").isNull(), (F.col("half_0") + F.col("half_1")) / 2)
        .when(F.col("half") == 0, F.col("half_1")).otherwise(F.col("half_0"))
    )
    learnt = F.lit("allow") if limit is None else F.when(F.round(score, DIGITS) >= limit, "allow").otherwise("block")
    judged = urls.join(scored.drop("half", "action").hint("merge"), "key").select(
        F.col("url").alias(fresh(df, "of_url", *new)), "host", "path", "rule", F.coalesce("action", learnt).alias("verdict"),
        (F.lit(0.0) if limit is None else score).alias("score"),
    )
    of = judged.columns[0]
    kept = df.select(*all_but(df, *new))
    return kept.join(judged, quoted(url).eqNullSafe(quoted(of)), "left").drop(of)


def allowed(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, order: int = ORDER) -> DataFrame:
    """The rows whose URL is allowed, with the columns they came with; rows are what they were, repeated ones too."""
    renamed = df.select(F.struct(*all_but(df)).alias("row"), quoted(url).alias("url"))
    kept = judge(renamed, "url", rules, order).filter("verdict = 'allow'")
    return kept.select(*[F.col("row").getField(name).alias(name) for name in df.columns])
