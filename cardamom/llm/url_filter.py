"""URL filter: domain and path rules first, then logistic regression on hashed character n-grams.

The model sees signed-free hashed counts of the 3- to 5-grams of the host and of the path (kept apart by a
prefix), scaled to unit length. It is fitted with Spark ML on a small labelled table of URLs; scoring stays in
the JVM.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_ascii, read

# The rules of the query, host and path apart.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

# A small labelled table of URLs, 1 for unwanted.
BLOCKED_URLS = [
    "http://casino-win.test/en/1", "https://www.best-casino.test/play", "http://casino-online.test/bonus/77",
    "http://free-bets.test/en/10", "https://m.free-bets.test/odds", "http://bets-today.test/de/5",
    "http://cheap-pills.test/fr/9", "https://www.cheap-pills.test/order.html", "http://pills-online.test/buy/3",
    "http://poker-room.test/join", "https://slots-jackpot.test/spin", "http://win-lottery.test/claim",
    "https://adult-cams.test/live", "http://hot-singles.test/chat", "http://xxx-video.test/watch/12",
    "http://payday-loan.test/apply", "https://fast-loans.test/cash", "http://replica-watches.test/sale",
    "http://cheap-viagra.test/pharmacy", "https://weight-loss-pills.test/offer", "http://free-money.test/win-big",
    "http://click-here-now.test/prize", "https://crypto-doubler.test/deposit", "http://cracked-software.test/serial",
    "http://torrent-free.test/download/keygen", "https://casino-bonus.test/free-spins", "http://bet-win-cash.test/tips",
    "http://free-casino.test/es/4", "https://sex-dating.test/profile/8", "http://escort-city.test/book",
]
KEPT_URLS = [
    "http://news-daily.test/en/1", "https://www.city-library.test/catalog", "http://blog.gardener.test/2024/spring",
    "http://docs.python-guide.test/tutorial.html", "https://m.weather.test/fr/today", "http://www.university.test/research/papers",
    "https://recipes.kitchen.test/de/5", "http://history-museum.test/visit", "https://forum.builders.test/thread/77",
    "http://wiki.science.test/page/physics", "https://www.townhall.test/en/minutes", "http://blog.travel-notes.test/es/9",
    "http://the-paper.test/opinion/4", "https://m.sports-report.test/league", "http://lectures.test/fr/3",
    "https://open-data.test/tables/12", "http://www.orchestra.test/season", "https://health-service.test/advice",
    "http://thesis.archive.test/en/8", "https://stories.test/chapter/10", "http://maps.region.test/road",
    "https://parliament.test/debate/55", "http://www.school.test/class/7", "https://astronomy.test/en/moon",
    "http://blog.bakery.test/en/1837/", "https://railway.test/timetable/1291", "http://m.cinema.test/program/7424.html",
    "https://www.bookshop.test/novels?page=2", "http://botany.test/en/42", "https://letters.test/editor/3#top",
]

N_GRAMS = (3, 4, 5)
N_FEATURES = 1 << 15


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://``, A-Z lower-cased; path up to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return fold_ascii(host), path


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in reversed(ranked):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(text: Column, mark: str) -> Column:
    padded = F.concat(F.lit("^"), text, F.lit("$"))

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) - (n - 1))
        marked = F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(padded, i, F.lit(n))))
        return F.when(F.length(padded) >= n, marked).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of_length, N_GRAMS))


def url_grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each with the mark of its part; hashed later."""
    return F.concat(_grams(host, "h:"), _grams(path, "p:"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [(u, 1.0) for u in BLOCKED_URLS] + [(u, 0.0) for u in KEPT_URLS]
    return spark.createDataFrame(rows, "url string, label double").coalesce(1)


def fit_url_model(labelled: DataFrame, reg: float = 1e-3, iterations: int = 50) -> PipelineModel:
    """Fit on (url, label), a small table; rows with a null url or label are left out."""
    host, path = split_url(F.col("url"))
    rows = labelled.dropna(subset=["url", "label"]).select(url_grams(host, path).alias("_grams"), F.col("label").cast("double").alias("_label"))
    stages = [
        HashingTF(inputCol="_grams", outputCol="_counts", numFeatures=N_FEATURES),
        Normalizer(inputCol="_counts", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", rawPredictionCol="_raw", probabilityCol="_probability",
                           predictionCol="_prediction", regParam=reg, maxIter=iterations, standardization=False),
    ]
    return Pipeline(stages=stages).fit(rows)


def filter_urls(df: DataFrame, model: PipelineModel, rules=tuple(RULES), url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` (the model's, for every row).

    A null url or one without ``://`` has empty host and path, no rule, and the model's verdict on empty text.
    Repeated rows are judged alike; an empty table gives an empty result; long urls are judged whole. Columns of
    df with those names are replaced; other columns stay.
    """
    names = ["host", "path", "rule", "verdict", "block_score"]
    kept = [c for c in df.columns if c.lower() not in names]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(url).alias("_url"))
    host, path = split_url(F.col("_url"))
    parts = packed.select("_row", host.alias("_host"), path.alias("_path"))
    parts = parts.withColumn("_grams", url_grams(F.col("_host"), F.col("_path")))
    scored = model.transform(parts).withColumn("_score", F.get(vector_to_array("_probability"), 1))
    scored = scored.withColumn("_rule", match_rules(F.col("_host"), F.col("_path"), list(rules)))
    return scored.select(
        *[F.col("_row").getField(c).alias(c) for c in kept],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("_score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        F.col("_score").alias("block_score"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_url_model(labelled_urls(spark))
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, model).select("page_id", "host", "path", "rule", "verdict", F.round("block_score", 6).alias("block_score"))
