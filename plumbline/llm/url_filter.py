"""URL filters: rules first, else logistic regression on hashed character n-grams.

Host and path are cut out and matched against the rules by Spark expressions.
A URL that no rule fits is judged by a model trained from a small labelled URL
table; host and path n-grams are hashed apart, so a word means what it means
in its place. The training table is a parameter of bounded size.

Defined cases: a null URL or one without ``://`` has an empty host and path,
fits no rule and is judged on no n-gram; repeated rows are judged each for
itself; an empty table gives an empty result, an empty labelled table a score
of a half everywhere, and nothing is blocked but by rule; other columns are not
looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import table

BUCKETS, SIZES = 1 << 16, (3, 4, 5)
#: A URL whose n-grams were never seen scores about 0.5 and is allowed: it takes evidence to block.
THRESHOLD = 0.56
#: Labelled URLs that a model is trained on at most.
LABELLED = 50_000

# The rules of the registered query, as (host, path start, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

# The labelled table, URLs to block and URLs to allow.
BLOCKED = """
http://www.best-casino.example/en/12 https://casino-royal.example/play http://online-casino-bonus.example/en/3 https://m.win-big.example/en/77
https://slots-win.example/ http://poker-win-cash.example/es/8 https://free-bets-now.example/en/9 http://sports-bets.example/fr/4 https://bets-live.example/de/31
http://cheap-meds.example/en/5 https://www.cheap-pills-online.example/en/14 http://pills-store.example/fr/2 https://buy-viagra-pills.example/es/6 http://cheap-watches.example/de/9
http://adult-video.example/en/1 https://www.adult-chat-x.example/de/22 http://xxx-adult.example/es/3 https://porn-x.example/fr/18 http://sexy-adult-cams.example/en/40
http://spam-mail.example/en/7 https://blog.link-farm.example/en/19 http://content-farm.example/fr/23 https://www.spam-links-farm.example/es/11 http://seo-spam.example/de/2
http://ads-server.example/en/6 https://track-click.example/en/28 http://ad-track-pixel.example/de/5 https://m.ads-popunder.example/fr/36 http://click-ads-track.example/es/15
http://free-money-win.example/en/90 https://loan-cash-fast.example/en/61 http://cheap-replica.example/fr/70 https://win-lottery-free.example/es/44 http://free-download-crack.example/de/73
""".split()
ALLOWED = """
http://www.library.example/en/12 https://university-press.example/read http://open-data-portal.example/en/3 https://m.weather.example/en/77
https://history-notes.example/ http://garden-club.example/es/8 https://city-council-news.example/en/9 http://school-sports.example/fr/4 https://theatre.example/de/31
http://medicine-journal.example/en/5 https://www.kitchen-recipes.example/en/14 http://thereader.example/fr/2 https://mathematics.example/es/6 http://hardware-review.example/de/9
http://video-lectures.example/en/1 https://www.music-archive.example/de/22 http://northern-lights.example/es/3 https://photography.example/fr/18 http://astronomy-today.example/en/40
http://mail-help.example/en/7 https://blog.farmers-market.example/en/19 http://contentment.example/fr/23 https://www.thethinker.example/es/11 http://search-docs.example/de/2
http://server-manual.example/en/6 https://tracks-and-trails.example/en/28 http://adventures.example/de/5 https://m.rethink.example/fr/36 http://thunder-weather.example/es/15
http://finance-faq.example/en/90 https://translation-guide.example/en/61 http://collection.example/fr/70 https://window-design.example/es/44 http://freedom-of-press.example/de/73
""".split()


def hostname(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pathname(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for of, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, of + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct n-grams of host and path."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        if len(text) > 2:
            for n in SIZES:
                found.update(zlib.crc32(f"{kind}{text[i : i + n]}".encode()) % BUCKETS for i in range(len(text) - n + 1))
    return np.fromiter(sorted(found), np.int64, len(found))


def split_url(url: str) -> tuple[str, str]:
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:].split("?", 1)[0].split("#", 1)[0]
    return rest[:cut].lower(), path


def train(labelled: list[tuple[str, int]], steps: int = 300, rate: float = 1.0, penalty: float = 1e-3) -> np.ndarray:
    """Weights of the buckets, the bias last; full-batch gradient descent on the (URL, 1 to block) table."""
    if not labelled:  # every URL then scores a half
        return np.zeros(BUCKETS + 1)
    rows = [features(*split_url(url)) for url, _ in labelled]
    y = np.array([label for _, label in labelled], float)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    bucket = np.concatenate(rows)
    # Each URL's n-grams share a weight of 1, so long URLs do not count for more.
    scale = 1 / np.sqrt(np.array([max(len(r), 1) for r in rows]))
    w = np.zeros(BUCKETS + 1)
    for _ in range(steps):
        z = np.bincount(row, w[bucket], len(rows)) * scale + w[-1]
        error = (1 / (1 + np.exp(-z)) - y) / len(rows)
        w[:-1] -= rate * (np.bincount(bucket, (error * scale)[row], BUCKETS) + penalty * w[:-1])
        w[-1] -= rate * error.sum()
    return w


def score(host: str, path: str, w: np.ndarray) -> float:
    at = features(host, path)
    return float(1 / (1 + np.exp(-(w[at].sum() / np.sqrt(max(len(at), 1)) + w[-1]))))


def held_out_scores(labelled: list[tuple[str, int]], folds: int = 5) -> list[tuple[float, int]]:
    """(score, label) of each URL by a model that saw no URL of its host."""
    fold = [zlib.crc32(split_url(url)[0].encode()) % folds for url, _ in labelled]
    found = []
    for k in sorted(set(fold)):
        w = train([row for row, f in zip(labelled, fold) if f != k])
        found += [(score(*split_url(url), w), label) for (url, label), f in zip(labelled, fold) if f == k]
    return found


def held_out(labelled: list[tuple[str, int]], threshold: float = THRESHOLD, folds: int = 5) -> dict[str, int]:
    """Counts of blocked and allowed URLs by label, each judged by a model that saw no URL of its host."""
    found = dict.fromkeys(("blocked", "missed", "blocked_wrongly", "allowed"), 0)
    for p, label in held_out_scores(labelled, folds):
        found[("blocked" if p >= threshold else "missed") if label else ("blocked_wrongly" if p >= threshold else "allowed")] += 1
    return found


def best_threshold(labelled: list[tuple[str, int]], precision: float = 0.95, folds: int = 5) -> tuple[float, float, float]:
    """(threshold, precision, recall) held out by host: the lowest threshold that reaches ``precision``; (1.01, 1, 0), which blocks nothing, if none does."""
    scores = sorted(held_out_scores(labelled, folds), reverse=True)
    total, right, best = sum(label for _, label in scores), 0, (1.01, 1.0, 0.0)
    for n, (p, label) in enumerate(scores, 1):
        right += label
        # URLs of one score stand or fall together.
        if (n == len(scores) or scores[n][0] < p) and right and right >= precision * n:
            best = (p, right / n, right / total)
    return best


def labelled_rows(df: DataFrame, url_col: str = "url", label_col: str = "label", limit: int = LABELLED) -> list[tuple[str, int]]:
    """The (URL, 1 to block) rows of a labelled table that train a model: all with a URL and a label of 0 or 1, each once; beyond ``limit`` those of the smallest hash."""
    rows = df.select(df[url_col].cast("string").alias("url"), df[label_col].cast("int").alias("label")).where("url IS NOT NULL AND label IN (0, 1)").distinct()
    return [(r.url, r.label) for r in rows.orderBy(F.xxhash64("url"), "url", "label").limit(limit).collect()]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), batch.column("rule").to_pylist())
            p = [score(h, q, w) if r is None else None for h, q, r in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, "p_block"])

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: list[tuple[str, int]], *, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """id, host, path, rule, verdict, p_block (null where a rule decides) of each row."""
    url = pages[url_col].cast("string")
    slim = pages.select(pages[id_col].alias("id"), hostname(url).alias("host"), pathname(url).alias("path"))
    rule, says = matched(F.col("host"), F.col("path"), rules)
    slim = slim.withColumns({"rule": rule, "says": says})
    shared = pages.sparkSession.sparkContext.broadcast(train(labelled))  # BUCKETS + 1 numbers
    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInArrow(_score(shared), f"id {kind}, host string, path string, rule string, says string, p_block double")
    verdict = F.coalesce("says", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "p_block")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = [(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED]
    return judge(table(spark, sf_dir, "pages"), RULES, labelled)
