"""URL verdicts: longest fitting host-and-path rule, else logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halfseen.llm.common import query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES = (3, 4, 5)              # lengths of the n-grams
FEATURES = 1 << 16             # hash range

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
         ("block", "net", "/fr/")]

#: The small labelled table of the default model: names of sites that are commonly blocked (gambling, adult, drugs, link spam, advertising,
#: loans, piracy, malware) and of ordinary ones, by kind. Hosts of the test pages stand in it nowhere, but common words that they are made of do.
BLOCKED = """
casino online-casino casino-royal vegas-casino royal-slots slots poker poker-room texas-holdem roulette blackjack jackpot bingo-bonus betting bets-online
sports-bets bet-now lottery-win winbig adult adults-only adult-video adult-chat xxx xxx-video porn pornhd porn-tube sexcam sex-chat livecams escort hookup
nude-pics hot-singles pills pills-online pharma buy-pills cheap-meds cheap-viagra viagra cialis generic-rx steroids diet-pills weight-loss-miracle
spam spammer spam-mail link-farm linkfarm backlinks buy-backlinks seo-links seo-spam article-spinner ads adserver ad-server ads-network ad-click clickads
banner-ads popunder pixel-tracker tracker tracking click-tracker affiliate-clicks payday-loans cheap-loans fast-cash easy-money free-money free-prizes
free-gift get-rich crypto-doubler warez crack crack-keygen serials torrent free-torrent free-movies-hd stream-rip malware virus-download phishing
replica-watches cheap-handbags fake-id cheap-followers
"""
ALLOWED = """
library university college school academy museum gallery theatre orchestra council city-hall parliament ministry embassy court police hospital clinic
dentist pharmacy-guild red-cross charity church temple news daily-times gazette herald tribune journal weather radio television podcast magazine
encyclopedia dictionary history geography physics chemistry biology mathematics astronomy geology botany philosophy economics statistics linguistics
garden gardening recipes kitchen bakery restaurant brewery winery hotel travel railway airport ferry bus-lines maps hiking climbing cycling rowing football
tennis swimming chess stamps photography painting pottery knitting carpentry plumbing electricians builders architects engineers lawyers accountants
insurance bank post-office job-board real-estate farmers fishery forestry veterinary zoo aquarium national-park climate energy solar recycling water-works
software docs forum developers open-data hosting mail calendar notes translate spelling typing teaching homework kindergarten alumni scholarships
"""
PREFIXES, ENDS = ("", "www.", "m.", "blog."), ("com", "org", "net")
PATHS = ("/en/12", "/de/7310.html", "/fr/31/", "/es/900?page=2", "/en/4821#top", "/")


def default_table(spark: SparkSession, part: int | None = None, without: bool = True) -> DataFrame:
    """Every name under three prefixes; ends and paths take turns, so that they tell nothing about the label.

    part: leave out the fifth of the names with this number, or with without=False give only it.
    """
    rows = [(f"http://{PREFIXES[(k + j) % 4]}{name}.example.{ENDS[(k + j) % 3]}{PATHS[(2 * k + j) % 6]}", label)
            for label, names in ((1, BLOCKED), (0, ALLOWED)) for k, name in enumerate(names.split()) for j in range(3)
            if part is None or (k % 5 == part) != without]
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    """Behind the first :// up to /, ? or #, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def grams(text: Column, mark: str) -> Column:
    """Character n-grams of text between ^ and $, marked by where they come from; linear in the length.

    The text is cut into its characters once, and a gram joins neighbours by their index.
    """
    def of(chars: Column, n: int) -> Column:
        at = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(n)]))

    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    return F.get(F.transform(F.array(chars), lambda c: F.concat(*[of(c, n) for n in SIZES])), F.lit(0))


def hashed(df: DataFrame, host: str, path: str, features: int) -> DataFrame:
    both = df.withColumn("grams", F.concat(grams(F.col(host), "h:"), grams(F.col(path), "p:")))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True).transform(both).drop("grams")


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits; of equally long ones the longer host, then block."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_verdicts(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id",
                 url_col: str = "url", features: int = FEATURES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict and the model's probability to block.

    `labelled` (url, label 0/1; a small table) trains the model; rows without url or label
    are left out. Without any the model blocks nothing. Null urls and urls without ://
    have empty host and path, no rule fits them, and the model judges the empty text.
    Repeated rows are judged alike, ids are not used. A url of any length is judged whole,
    in time linear in it. Other columns are not read; an empty table gives no rows. Judging
    is column expressions and a linear model of fixed size.
    """
    spark = pages.sparkSession
    labelled = default_table(spark) if labelled is None else labelled
    known = labelled.where("url is not null and label in (0, 1)").select(
        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("u")).select(id_col, host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    if known.isEmpty():
        judged = rows.withColumn("p_block", F.lit(0.0))
    else:
        model = LogisticRegression(regParam=0.01, maxIter=100).fit(hashed(known, "host", "path", features))
        scored = model.transform(hashed(rows, "host", "path", features))
        probability = vector_to_array("probability")
        judged = scored.withColumn("p_block", F.when(F.size(probability) > 1, probability[1]).otherwise(F.lit(0.0)))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    return judged.select(id_col, "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


@query("op4_url_filter")
def op4_url_filter(spark, d):
    return url_verdicts(table(spark, d, "pages"))
