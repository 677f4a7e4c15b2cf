"""URL verdicts: host and path rules, then logistic regression on hashed character n-grams. DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 8192  # hashed features
GRAM = 4  # characters of an n-gram
STEPS = 60  # of gradient descent
RATE = 200.0
DECAY = 0.0005
FALSE = 0.005  # share of held-out rows to allow that may be blocked

# (verdict, host, path)
RULES = (
    ("block", "com", "en/"),
    ("allow", "example.com", "en/7"),
    ("allow", "net", "de/"),
    ("block", "example.net", "de/8"),
    ("block", "org", "es/"),
)

# words that the labelled table is put together from: of urls to block and to allow
BLOCKED = (
    "casino jackpot poker slots betting bet bets bonus lottery winner win prize viagra pills pharmacy meds cheap discount coupons replica watches payday loans loan credit cash adult dating porn cams xxx videos"
    " spam farm linkfarm track tracker adserver banner promo affiliate popunder click ads free deals offers clearance giveaway crypto doubler miracle weightloss"
).split()
ALLOWED = (
    "library museum archive university school science journal physics history poetry garden recipes kitchen weather forecast council public health guide manual docs"
    " software travel notes hiking trails astronomy music classical football league calendar encyclopedia news world article research river town district gallery"
).split()
# parts of names that say nothing, for most rows to allow: of the training rows, and others for the held-out rows
PARTS = (
    "ba be bi bo bu ca ce co cu da de di do du fa fe fi fo ga ge go ha he hi ho ja jo ka ke ki ko la le li lo lu ma me mi mo mu na ne ni no nu pa pe pi po ra re ri ro ru sa se si so su ta te ti to tu va ve vi vo wa we wi"
    " za zo ar er ir or ur an en in on un al el il ol as es is os at et it th sh ch st nd nt ng ly ed tion ment ung schaft keit eau ique cion dad able ness ing"
).split()
OTHER_PARTS = (
    "bra cru dro fle gli plo spa tri ska ster wald burg heim feld dorf stein ville mont bois pont fleur sierra monte campo agua luz tierra north south west east land field wood brook ford ton ham bury holm berg lund"
).split()


def labelled_urls(first: int = 0, last: int = 2400, parts: list[str] = PARTS) -> list[tuple[str, int]]:
    """(url, 1 to block): the labelled table, row by row by a rule. One in four is to block, one is of words to allow, two of made-up names.

    Subdomains, endings, languages, numbers and forms of path are alike in both kinds. Other `parts` make other rows.
    """
    out = []
    for i in range(first, last):
        h = hashlib.sha256(f"{parts[0]} {i}".encode()).digest()
        if i % 4 < 2:
            words = (BLOCKED, ALLOWED)[i % 4]
            a, b, c = (words[h[k] % len(words)] for k in range(3))
        else:
            a, b, c = ("".join(parts[h[6 * k + j] % len(parts)] for j in range(2 + h[6 * k + 5] % 2)) for k in range(3))
        n, language = h[20] * 256 + h[21], ("en", "de", "fr", "es")[h[25] % 4]
        host = ("", "www.", "blog.", "m.", "news.")[h[24] % 5] + (f"{a}-{b}", f"{a}{b}", a, f"{a}.{b}")[h[23] % 4] + ("", "", ".example")[h[27] % 3]
        path = (f"/{language}/{n}", f"/{c}/{n}.html", f"/{language}/{n}/", f"/{c}-{b}.html", "/", f"/{n}/{c}", f"/{language}/{c}")[h[26] % 7]
        out.append((f"https://{host}.{('com', 'net', 'org', 'info', 'test')[h[22] % 5]}{path}", int(i % 4 == 0)))
    return out


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no :// gives ''."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def buckets(host: Column, path: Column) -> Column:
    """The hashed n-grams of '^host/path$', as bucket numbers; repeats stay."""
    text = F.concat(F.lit("^"), host, F.lit("\u0001"), F.translate(path, "0123456789", "0000000000"), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - GRAM + 1)), lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(GRAM))), F.lit(SIZE)).cast("int"))


def _sum(over: Column | str, of) -> Column:
    return F.aggregate(over, F.lit(0.0), lambda s, x: s + of(x))


def train(spark: SparkSession, labelled: list[tuple[str, int]] | None = None) -> list[float]:
    """SIZE weights and the bias: gradient descent on the mean log loss, as one fold over the small labelled table.

    The table is the argument (None: labelled_urls()) and has some thousand rows: its rows' features and, turned round, the
    rows of each feature are two arrays of one row. Url features count once each, and a row has length 1. No rows: zero weights.
    """
    labelled = labelled_urls() if labelled is None else labelled
    if not labelled:
        return [0.0] * (SIZE + 1)
    rows = spark.createDataFrame([(i, u, float(y)) for i, (u, y) in enumerate(labelled)], "i int, url string, y double").coalesce(1)  # small, whatever the input: nothing to deal out
    own = F.array_distinct(buckets(host_of(F.col("url")), path_of(F.col("url"))))
    rows = rows.select("i", "y", own.alias("own"), F.array_append(own, F.lit(SIZE)).alias("ks")).withColumn("scale", 1 / F.sqrt(F.size("ks")))
    held = rows.agg(F.sort_array(F.collect_list(F.struct("i", "y", "ks", "scale"))).alias("m"))
    turned = spark.range(0, SIZE, 1, 1).select(F.col("id").cast("int").alias("k")).join(rows.select(F.explode("own").alias("k"), "i"), "k", "left").groupBy("k").agg(F.sort_array(F.collect_list("i")).alias("at"))
    turned = turned.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "at"))), lambda r: r["at"]).alias("t"))
    turned = turned.select(F.array_append("t", F.sequence(F.lit(0), F.lit(len(labelled) - 1))).alias("t"))  # the bias is in every row

    def step(w: Column, _: Column) -> Column:
        off = F.transform("m", lambda r: (1 / (1 + F.exp(-r["scale"] * _sum(r["ks"], lambda k: F.get(w, k)))) - r["y"]) * r["scale"])
        # the errors are computed once a step: as the only element of an array they can be named
        return F.flatten(F.transform(F.array(off), lambda e: F.zip_with(w, "t", lambda a, at: a * (1 - DECAY) - RATE / len(labelled) * _sum(at, lambda i: F.get(e, i)))))

    fold = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.array_repeat(F.lit(0.0), SIZE + 1), step)
    return list(held.crossJoin(turned).select(fold.alias("w")).first().w)  # one row each; SIZE + 1 numbers, whatever the input


def score_of(host: Column, path: Column, weights: list[float]) -> Column:
    """The model's probability that a url is to be blocked."""
    w = F.split(F.lit(",".join(map(repr, map(float, weights[:SIZE])))), ",").cast("array<double>")
    own = F.array_distinct(buckets(host, path))
    z = F.aggregate(own, F.lit(float(weights[SIZE])), lambda s, k: s + F.element_at(w, k + 1)) / F.sqrt(F.size(own) + F.lit(1.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def held_out_cut(spark: SparkSession, weights: list[float], held: list[tuple[str, int]] | None = None) -> float:
    """The least score to block: of held-out urls to allow, whose names have other parts than the model's, FALSE reach it. None: 0.5."""
    held = labelled_urls(0, 2000, OTHER_PARTS) if held is None else held
    allowed = spark.createDataFrame([(u,) for u, y in held if not y], "url string")
    cut = allowed.select(score_of(host_of(F.col("url")), path_of(F.col("url")), weights).alias("score")).agg(F.percentile("score", F.lit(1 - FALSE)).alias("cut")).first().cut
    return 0.5 if cut is None else cut


def judge(pages: DataFrame, weights: list[float], cut: float = 0.5, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): one row per row of pages, in one pass without a shuffle.

    A rule fits its host and all subdomains where the path, without its leading slash, starts with the rule's. The
    longest host and path together wins (then the longer host). Null and odd urls have empty host and path, fit no rule
    and get the model's verdict: block from a score of `cut`. Other columns, nulls and repeats do no harm.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rest = F.when(F.col("path").startswith("/"), F.expr("substring(path, 2)")).otherwise(F.col("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):  # later, longer ones go first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & rest.startswith(p)
        rule, verdict = F.when(fits, f"{h}/{p}").otherwise(rule), F.when(fits, v).otherwise(verdict)
    parts = parts.withColumn("rule", rule).withColumn("_v", verdict)
    score = score_of(F.col("host"), F.col("path"), weights)
    return parts.withColumn("score", score).select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(F.col("score") >= cut, "block").otherwise("allow")).alias("verdict"), "score")
