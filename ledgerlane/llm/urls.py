"""URL filter: fixed rules first, then logistic regression on hashed character n-grams.

The regression is trained on a small labelled table of URLs. Host and path are hashed apart, so the
same letters weigh differently in either. Host, path and rule are Spark expressions; the score of a
batch of URLs is one Arrow-batched function over two string columns.

Defined cases: a NULL URL or one without ``://`` has an empty host and path, fits no rule and gets
the method's verdict on empty strings; a URL may be of any length; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import mix, table

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
"""Host, slash and path of each rule with its verdict. Fixed values."""

GRAMS = (3, 4, 5)
WEIGHTS = 1 << 14
STEPS = 400
RATE = 2.0
DECAY = 1e-3
BLOCK_AT = 0.5

LABELLED = pd.DataFrame(
    [
        ("https://online-pharmacy-deals.test/buy/pills", 1),
        ("https://discount-pharmacy.example/order/tablets", 1),
        ("https://pills-without-prescription.invalid/shop/discount", 1),
        ("https://diet-pills-discount.test/order/now", 1),
        ("https://viagra-discount-shop.example/buy", 1),
        ("https://buy-viagra-online.invalid/pharmacy", 1),
        ("https://tablets-cheap-online.test/pharmacy/order", 1),
        ("https://replica-watches-discount.example/buy/cheap", 1),
        ("https://cheap-replica-bags.invalid/shop/replica", 1),
        ("https://cheap-followers-buy.test/order/followers", 1),
        ("https://royal-casino-slots.test/bonus", 1),
        ("https://online-casino-bonus.example/slots/jackpot", 1),
        ("https://vegas-slots-jackpot.invalid/casino/spin", 1),
        ("https://poker-jackpot-online.test/bonus/bet", 1),
        ("https://sports-betting-bonus.example/bet/now", 1),
        ("https://live-poker-betting.invalid/casino", 1),
        ("https://lucky-roulette-casino.test/jackpot", 1),
        ("https://free-spins-slots.example/bonus/casino", 1),
        ("https://lottery-winner-jackpot.invalid/win/prize", 1),
        ("https://bet-and-win-prize.test/betting/bonus", 1),
        ("https://adult-cams-live.test/xxx/cams", 1),
        ("https://xxx-adult-videos.example/porn", 1),
        ("https://free-porn-videos.invalid/xxx/adult", 1),
        ("https://hot-cams-xxx.test/adult/live", 1),
        ("https://sexy-adult-dating.example/cams", 1),
        ("https://porn-tube-adult.invalid/videos/xxx", 1),
        ("https://malware-download-free.test/install/setup.exe", 1),
        ("https://free-keygen-crack.example/download/keygen.exe", 1),
        ("https://crack-serial-keygen.invalid/download/crack", 1),
        ("https://warez-download-crack.test/serial", 1),
        ("https://trojan-installer.example/setup.exe", 1),
        ("https://free-antivirus-scan.invalid/download/installer.exe", 1),
        ("https://account-verify-login.test/verify/password", 1),
        ("https://secure-login-verify.example/account/confirm", 1),
        ("https://bank-account-confirm.invalid/login/verify", 1),
        ("https://password-confirm-login.test/verify/account", 1),
        ("https://payday-loans-fast.test/apply/cash", 1),
        ("https://fast-cash-loans.example/payday/apply", 1),
        ("https://instant-payday-cash.invalid/loans/apply", 1),
        ("https://easy-money-fast-cash.test/win/money", 1),
        ("https://backlinks-seo-cheap.example/buy/backlinks", 1),
        ("https://buy-backlinks-fast.invalid/seo/links", 1),
        ("https://free-prize-winner.test/win/claim", 1),
        ("https://claim-free-iphone.example/prize/win", 1),
        ("https://www.citylibrary.test/about/opening-hours", 0),
        ("https://public-library.example/catalogue/books", 0),
        ("https://university-library.invalid/research/articles", 0),
        ("https://www.university.test/research/history", 0),
        ("https://state-university.example/students/courses", 0),
        ("https://primary-school.invalid/news/calendar", 0),
        ("https://music-school.test/lessons/piano", 0),
        ("https://high-school.example/teachers/calendar", 0),
        ("https://art-museum.invalid/exhibitions/paintings", 0),
        ("https://history-museum.test/collections/history", 0),
        ("https://science-museum.example/visit/opening-hours", 0),
        ("https://natural-history.invalid/articles/birds", 0),
        ("https://city-news.test/articles/local", 0),
        ("https://local-newspaper.example/politics/council", 0),
        ("https://morning-news.invalid/weather/forecast", 0),
        ("https://weather-service.test/forecast/rain", 0),
        ("https://mountain-weather.example/forecast/snow", 0),
        ("https://garden-notes.invalid/plants/roses", 0),
        ("https://rose-gardening.test/articles/plants", 0),
        ("https://home-cooking.example/recipes/soup", 0),
        ("https://family-recipes.invalid/baking/bread", 0),
        ("https://bread-bakery.test/about/history", 0),
        ("https://village-bakery.example/contact", 0),
        ("https://hiking-trails.invalid/maps/mountain", 0),
        ("https://mountain-club.test/hiking/routes", 0),
        ("https://cycling-club.example/routes/calendar", 0),
        ("https://football-club.invalid/teams/results", 0),
        ("https://chess-club.test/lessons/openings", 0),
        ("https://city-orchestra.example/concerts/calendar", 0),
        ("https://jazz-concerts.invalid/music/reviews", 0),
        ("https://book-reviews.test/articles/novels", 0),
        ("https://film-reviews.example/articles/cinema", 0),
        ("https://software-docs.invalid/guide/tutorial", 0),
        ("https://python-tutorial.test/guide/lists", 0),
        ("https://math-notes.example/lessons/algebra", 0),
        ("https://physics-notes.invalid/lectures/optics", 0),
        ("https://research-institute.test/publications/articles", 0),
        ("https://city-hospital.example/departments/contact", 0),
        ("https://dental-clinic.invalid/about/contact", 0),
        ("https://animal-shelter.test/dogs/adoption", 0),
        ("https://train-timetable.example/stations/routes", 0),
        ("https://travel-notes.invalid/articles/mountain", 0),
        ("https://town-council.test/meetings/calendar", 0),
        ("https://farmers-market.example/about/opening-hours", 0),
    ],
    columns=["url", "label"],
)
"""URLs with 1 for those to block. Each has a host of its own under a reserved name, both kinds under
the same ones; words are those of the trades at large and none is taken from given pages."""

_LATIN = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL column."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; NULL where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of host and path, each with its ends marked; a slot per hash."""
    found = []
    for kind, text in enumerate((host, path), start=1):
        octets = np.frombuffer(f"\x02{text}\x03".encode("utf-8", "surrogatepass"), dtype=np.uint8)
        octets = octets.astype(np.uint64)
        for n in GRAMS:
            count = len(octets) - n + 1
            if count <= 0:
                continue
            value = np.full(count, kind, dtype=np.uint64)
            for i in range(n):
                value = (value << np.uint64(8)) | octets[i : i + count]
            found.append(mix(value) & np.uint64(WEIGHTS - 1))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.empty(0, np.int64)


def split_url(url: str) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LATIN), slash + path


def train(labelled: pd.DataFrame = LABELLED) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent with weight decay; rows are scaled to unit length."""
    rows = [grams(*split_url(u)) for u in labelled["url"]]
    matrix = np.zeros((len(rows), WEIGHTS), dtype=np.float64)
    for x, slots in zip(matrix, rows):
        x[slots] = 1 / np.sqrt(max(1, len(slots)))
    labels = labelled["label"].to_numpy(dtype=np.float64)
    weights, bias = np.zeros(WEIGHTS), 0.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(matrix @ weights + bias))) - labels
        weights -= RATE * (matrix.T @ error / len(rows) + DECAY * weights)
        bias -= RATE * error.mean()
    return weights, bias


def score(host: Column, path: Column, model: tuple[np.ndarray, float]) -> Column:
    weights, bias = model[0].astype(np.float32), model[1]

    @F.pandas_udf("double")
    def judged(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        total = np.empty(len(hosts))
        for k, (one, two) in enumerate(zip(hosts, paths)):
            slots = grams(one, two)
            total[k] = weights[slots].sum(dtype=np.float64) / np.sqrt(max(1, len(slots))) + bias
        return pd.Series(1 / (1 + np.exp(-total)))

    return judged(host, path)


def judge(pages: DataFrame, rules=RULES, labelled: pd.DataFrame = LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("score") >= BLOCK_AT, "block").otherwise("allow")
    return (
        rows.withColumn("score", score(F.col("host"), F.col("path"), train(labelled)))
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, learned).alias("verdict"), "score")
    )


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return judge(table(spark, sf_dir, "pages"))
