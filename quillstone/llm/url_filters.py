"""URL filters: pattern rules indexed by their rarest literal token; a URL's tokens fetch the rules that are tried on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import Stage, broadcast_if_small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Token of rules that have no literal one; every URL has it.
ANY = ""
#: Rules of the index that are sent to all executors; more are joined by a shuffle.
MOST_SENT = 200_000

#: Fixed rules on hosts (and their subdomains) and the starts of paths: action, host, path.
HOST_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Patterns for the rest: what a training corpus does without. `||` is the start of a label of the host, `|` an end of the
#: URL, `*` any characters, `^` any character but a-z, 0-9 or %, or an end. `@@` before a pattern allows.
PATTERNS = [
    # gambling
    "^casino^", "^casinos^", "^bets^", "^betting^", "^poker^", "^slots^", "^jackpot^", "^roulette^", "^lottery^",
    # drugs
    "^pills^", "^viagra^", "^cialis^", "^pharmacy^cheap^", "^steroids^",
    # adult
    "^adult^", "^porn^", "^xxx^", "^sex^", "^escort^", "^escorts^", "^nsfw^",
    # spam, scams and stolen goods
    "^spam^", "^payday^loan^", "^replica^watches^", "^warez^", "^torrent^", "^keygen^", "^cracked^", "^essay^writing^service^",
    # adverts and trackers
    "||ad.", "||ads.", "^ads^track^", "^adserver^", "^doubleclick^", "||tracking.", "^popunder^", "^affiliate^redirect^", "/banner/*/click^", "^clickid=",
    # pages of accounts and machines
    "/wp-login.php", "/wp-admin/", "/cart/checkout^", "/login?*return", "/cgi-bin/", "^xmlrpc.php",
    # files that are no pages
    ".exe|", ".zip|", ".apk|", ".iso|", ".torrent|",
    # reports on these subjects
    "@@^addiction^", "@@^prevention^", "@@^education^", "@@/encyclopedia/",
]


def lower(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def url_host(url: Column) -> Column:
    """What is between the first :// and the next /, ? or #, in lower case; "" for null or without ://."""
    return F.coalesce(lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What is between the host and ?, # or the end; "" for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and %."""
    return F.regexp_extract_all(text, F.lit("([a-z0-9%]+)"), F.lit(1))


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9%/\-])", r"\\$1")


def host_rules(rules: DataFrame) -> DataFrame:
    """(rule, kind, action, length, regex, literals) of rows (action, host, path): the regex is for the host and path put together.

    A literal is a label of the host (it ends at a dot or the path) or a part of the path between slashes and the like;
    the path's last run of letters can go on in a URL, so it is none."""
    host = lower(F.col("host"))
    path = F.coalesce("path", F.lit(""))
    return rules.select(
        F.concat("host", path).alias("rule"), F.lit("host").alias("kind"), "action", (F.length("host") + F.length(path)).alias("length"),
        F.concat(F.lit(r"^(?:[^/?#]*\.)?"), _escaped(host), F.lit(r"(?=/|\z)"), _escaped(path)).alias("regex"),
        tokens(lower(F.regexp_replace(F.concat(host, F.when(path == "", "/").otherwise(path)), "[A-Za-z0-9%]+$", ""))).alias("literals"),
    )


def pattern_rules(rules: DataFrame) -> DataFrame:
    """(rule, kind, action, length, regex, literals) of rows (pattern), for the whole URL in lower case.

    A literal is a run with a sign on both sides that can't stand for a part of a longer run, such as . or ^."""
    body = lower(F.regexp_replace("pattern", "^@@", ""))
    regex = _escaped(body)
    for sign, meaning in ((r"^\\\|\\\|", r"^(?s:.*?)://(?:[^/?#]*\\.)?"), (r"^\\\|", "^"), (r"\\\|$", r"\\z"), (r"\\\*", "(?s:.*)"), (r"\\\^", r"(?:^|[^a-z0-9%]|\\z)")):
        regex = F.regexp_replace(regex, sign, meaning)
    whole = F.concat(F.when(body.startswith("||"), ".").otherwise(F.when(body.startswith("|"), ".").otherwise("*")), F.regexp_replace(body, r"^\|+|\|$", ""), F.when(body.endswith("|"), ".").otherwise("*"))
    literal = F.regexp_extract_all(whole, F.lit(r"(?<![a-z0-9%*])([a-z0-9%]+)(?![a-z0-9%*])"), F.lit(1))
    return rules.select(
        F.col("pattern").alias("rule"), F.lit("pattern").alias("kind"), F.when(F.col("pattern").startswith("@@"), "allow").otherwise("block").alias("action"),
        F.length("pattern").alias("length"), regex.alias("regex"), literal.alias("literals"),
    )


def indexed(rules: DataFrame, urls: DataFrame, stage: Stage) -> DataFrame:
    """The rules under one token each: the one of their literals that the fewest URLs have (ties: the first in order), counted over all of ``urls``."""
    rules = stage.cut(rules.distinct(), "rules")
    own = rules.select("rule", "kind", "action", F.explode_outer("literals").alias("token")).distinct()
    named = own.select("token").where("token is not null").distinct()
    held = urls.select(F.explode(F.array_distinct("tokens")).alias("token"))
    counts = held.join(broadcast_if_small(named, named.count(), MOST_SENT), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(counts, "token", "left").groupBy("rule", "kind", "action").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    found = rules.drop("literals").join(rarest, ["rule", "kind", "action"]).withColumn("token", F.coalesce("token", F.lit(ANY)))
    return stage.cut(found, "index")


def url_filter(spark: SparkSession, pages: DataFrame, hosts: DataFrame, patterns: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (the host rule that decides, or null), verdict, pattern (the one that decides, or null).

    A host rule (action, host, path) fits its host and all subdomains, if the URL's path starts with its own; the longest
    wins, then the longest host, then "allow". Where none fits, the patterns judge: one that allows wins over one that
    blocks, then the longest, then the first in order. Without any, the verdict is ``default``.

    Each rule is under its rarest literal token, so a URL meets the few rules whose token it has, and only those run their
    regular expressions. Rules without a literal token are tried on every URL. The index is sent to the executors while
    its counted size allows it. What fits is reduced per URL before it is shuffled; a URL on a third of all rows is a
    skewed side of the last join, which adaptive execution splits.

    A null URL or one without :// has an empty host and path and is judged by the patterns (a null one as ""). Texts of
    any length are read whole. Null ids, repeated rows and repeated rules are kept; null or empty patterns, hosts
    and actions are no rules. An empty table gives no rows. Other columns are ignored.
    """
    stage = Stage(spark, "url-filter")
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("_url"))
    subject = lower(F.col("_url"))
    urls = rows.select("_url", tokens(subject).alias("tokens"))
    rules = host_rules(hosts.where("host <> '' and action <> ''")).unionByName(pattern_rules(patterns.where("pattern not in ('', '@@')")))
    index = indexed(rules, urls, stage)
    met = urls.select("_url", F.explode(F.array_distinct(F.concat("tokens", F.array(F.lit(ANY))))).alias("token"))
    met = met.join(broadcast_if_small(index, index.count(), MOST_SENT), "token")
    text = F.when(F.col("kind") == "host", F.concat(url_host(F.col("_url")), url_path(F.col("_url")))).otherwise(subject)
    fits = met.where(F.rlike(text, F.col("regex")))
    host_order = F.struct((-F.col("length")).alias("length"), (-F.instr("rule", "/")).alias("host"), "action", "rule")
    pattern_order = F.struct("action", (-F.col("length")).alias("length"), "rule")
    best = fits.groupBy("_url").agg(
        F.min(F.when(F.col("kind") == "host", host_order)).alias("h"), F.min(F.when(F.col("kind") == "pattern", pattern_order)).alias("p")
    )
    best = best.select("_url", F.col("h.rule").alias("rule"), F.col("h.action").alias("_h"), F.when(F.col("h").isNull(), F.col("p.rule")).alias("pattern"), F.col("p.action").alias("_p"))
    verdict = F.coalesce("_h", "_p", F.lit(default))
    return rows.join(best, "_url", "left").select(F.col("_id").alias(id_col), url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"), "rule", verdict.alias("verdict"), "pattern")


def stated_rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The fixed rules above as tables."""
    rules = [F.struct(F.lit(action).alias("action"), F.lit(host).alias("host"), F.lit(path).alias("path")) for action, host, path in HOST_RULES]
    one = spark.range(1)
    return one.select(F.inline(F.array(*rules))), one.select(F.explode(F.array(*map(F.lit, PATTERNS))).alias("pattern"))
