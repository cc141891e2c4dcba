"""URL filter: explicit rules first, then logistic regression on hashed character n-grams.

Everything is DataFrame expressions.  The model is trained on a small table of
labelled URLs, a parameter; its weights are an array literal of fixed length,
so scoring is a projection without a shuffle.

Defined cases: a null url, or one without `://`, has an empty host and an
empty path, fits no rule and is judged by the method like any other (no n-gram
gives the intercept alone); repeated rows give repeated results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.common import lower_ascii, table

# Verdict, host, path prefix.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# Words of the default labelled table.  Of the first kind each makes a URL one to block, of the second none does.
UNWANTED = """casino poker roulette jackpot betting slots gambling lottery pills viagra pharmacy steroids cialis adult porn webcam escort hentai
warez cracked keygen torrent serials payday loans replica counterfeit spyware malware phishing adserver popunder clickbait doorway spam
cheap discount bonus winner tracker banner clicks""".split()
WANTED = """library museum university school hospital council parliament garden weather journal newspaper history science physics biology geography
recipes cooking kitchen travel railway airport football chess music orchestra theatre cinema painting photography software hardware manual
handbook tutorial reference dictionary research report minutes agenda budget calendar archive catalogue press contact privacy terms
annual election astronomy forest river mountain bicycle gardening parents teachers students engineering architecture""".split()
#: What stands beside such words in hosts and paths of either kind.
NEUTRAL = "home online best top free daily world city group center store portal info page site my the big new local".split()
TOP = "test example invalid localhost".split()


def invented(n: int) -> list[str]:
    """Names without meaning, made of syllables by a fixed rule: a host that says nothing is not one to block."""
    start, end = "ba cor del fi gran hol jen kal lu mor nes pel quin ros sil tor ur vel wim zan".split(), "bek dal fen gar lin mont nor per rick son tam vik wold yer zim".split()
    return [start[i % len(start)] + (start[(7 * i + 3) % len(start)] if i % 3 else "") + end[(5 * i + i // 20) % len(end)] for i in range(n)]


def labelled_urls() -> list[tuple[str, int]]:
    """The default labelled table (url, 1 to block): words of both kinds in hosts and in paths, alone, below neutral names and beside neutral words, with the same shapes for both kinds."""
    names, out = invented(120), []
    for label, words in ((1, UNWANTED), (0, WANTED)):
        for i, w in enumerate(words):
            near, name, top = NEUTRAL[i % len(NEUTRAL)], names[i % len(names)], TOP[i % len(TOP)]
            other = words[(i + 5) % len(words)]
            out += [
                (f"http://www.{w}.{top}/", label), (f"https://{w}-{other}.{top}/{near}/{i}", label), (f"http://{near}{w}.{top}/index.html", label),
                (f"http://{name}.{top}/{w}", label), (f"https://{name}.{top}/{near}/{w}-{other}/", label), (f"http://www.{name}.{top}/{near}-{w}.html", label),
            ]
    # Neither host nor path says anything: most of the web, and not to be blocked.
    out += [(f"http://{sub}{name}.{TOP[i % len(TOP)]}/{NEUTRAL[i % len(NEUTRAL)]}/{i}", 0) for i, name in enumerate(names) for sub in ("", "www.")]
    return out + [(f"http://{name}.{TOP[i % len(TOP)]}/", 0) for i, name in enumerate(names)]


#: The default labelled table.
LABELLED = labelled_urls()


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def grams(part: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of a part between marks; none of an empty part."""
    s = F.concat(F.lit("^"), part, F.lit("$"))

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - n + 1))
        return F.when((F.length(part) > 0) & (F.length(s) >= n), F.transform(places, lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    each = [of(n) for n in sizes]
    return F.concat(*each)


def buckets(host: Column, path: Column, size: int) -> Column:
    """Hashed n-grams of host and path, each once; what a word says is the same in both.  Give columns, not expressions: they are read for every n-gram."""
    return F.array_distinct(F.transform(F.concat(grams(host), grams(path)), lambda g: F.pmod(F.xxhash64(g), F.lit(size)).cast("int")))


def fit(spark: SparkSession, labelled=LABELLED, size: int = 16384, ridge: float = 0.001) -> tuple[list[float], float]:
    """Weights and intercept; the labelled table is small and stays in one partition, so the fit is the same each time."""
    rows = spark.createDataFrame(labelled, "url string, label int").coalesce(1)
    parts = rows.select(F.col("label").cast("double").alias("label"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    words = parts.select("label", buckets(F.col("host"), F.col("path"), size).cast("array<string>").alias("words"))
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], "words", "features").setBinary(True)
    model = LogisticRegression(maxIter=40, regParam=ridge, standardization=False).fit(counter.transform(words))
    return [float(x) for x in model.coefficients], float(model.intercept)


def probability(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    """Probability that a URL is one to block."""
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # a constant, folded once
    z = F.aggregate(buckets(host, path, len(weights)), F.lit(intercept), lambda acc, b: acc + F.get(w, b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path joined) and its verdict, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labelled=LABELLED, rules=RULES, threshold: float = 0.5, size: int = 16384) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page (page_id, url)."""
    weights, intercept = fit(pages.sparkSession, labelled, size)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.withColumn("score", probability(F.col("host"), F.col("path"), weights, intercept))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
