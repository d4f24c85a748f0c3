"""URL filter: rules first, else a logistic regression on hashed character n-grams.

A url's host is what follows the first `://` up to `/`, `?`, `#` or the end, its path what
then follows up to `?`, `#` or the end. Rules fit a host with its subdomains and paths
that start with the rule's; the longest wins. Other urls are judged by a regression
over the 3- to 5-grams of host and path (kept apart), hashed to BUCKETS weights and
trained on a small table of labelled urls.

A null, or a url without `://`, has an empty host and path and is judged by the
regression's bias alone. Repeated rows get equal results; an empty table gives an empty
result; extra columns are not read. Without labelled urls everything is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walksieve.llm.common import documents, mixed, raw_texts

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A small labelled table: 1 is unwanted (gambling, pills, adult, advertising, link farms).
LABELLED = [(u, 1) for u in """
http://casino-royal.example.org/play http://best-casino.test/en/slots https://www.win-casino.invalid/bonus?x=1
https://free-bets-now.test/odds http://sports-bets.example.com/en/12 http://freebets.invalid/de/9.html https://bet-win.test/live
http://cheap-pills-shop.test/buy https://pills-online.invalid/en/3 http://cheap-meds.example.org/order http://viagra-cheap.test/
http://adult-videos.test/en/55 https://www.adult-chat.invalid/fr/1 http://xxx-adult.example.net/ https://porn-tube.test/x
http://ads-server.test/banner https://track-ads.example.com/pixel.gif http://click-track.invalid/en/8 http://ad-tracker.test/t?id=4
http://spam-links.test/farm https://link-farm.invalid/en/7 http://seo-spam.example.org/de/2.html http://spam-blog-farm.test/
https://payday-loans.test/apply http://replica-watches.invalid/en/6 http://lottery-win.test/es/4 http://jackpot-slots.example.net/fr/33
""".split()] + [(u, 0) for u in """
https://www.example.com/en/101 http://example.org/de/2231.html https://example.net/fr/412#top http://m.example.com/es/93/
https://blog.example.org/en/2044?page=2 http://www.example.net/en/77.html https://m.example.org/fr/8 http://blog.example.net/de/71
https://news.example.com/en/politics https://en.wiki.test/wiki/River http://library.test/books/81 https://docs.python.test/tutorial
https://university.test/de/studium http://museum.invalid/fr/expositions https://weather.test/es/madrid http://recipes.test/en/bread
https://city.test/en/council/minutes http://health.invalid/en/heart https://school.test/de/lehrplan http://science.test/articles/12
https://garden.test/en/roses http://history.invalid/es/roma https://music.test/fr/concerts http://maps.test/en/berlin
https://research.test/papers/2203 http://forum.invalid/en/thread/55 https://trains.test/de/fahrplan http://cinema.test/es/7
https://thenand.example.com/en/3121 http://inthere.example.org/es/77.html https://other.example.net/de/5 http://notion.example.com/fr/19#top
""".split()]


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str               # host, then the path with its slash

    @property
    def parts(self) -> tuple[str, str]:
        host, slash, rest = self.text.partition("/")
        return host, slash + rest


def with_parts(pages: DataFrame, *columns: str) -> DataFrame:
    """The named columns, with host and path of `url`."""
    first = F.expr("substr(url, instr(url, '://') + 3)")
    rest = F.when(F.col("url").contains("://"), first).otherwise(F.lit(""))
    cut = documents(pages, *columns, "url").withColumn("__rest", rest)
    return cut.select(*[F.col(f"`{c}`") for c in columns],
                      F.translate(F.regexp_extract("__rest", "^[^/?#]*", 0), _UPPER, _LOWER).alias("host"),
                      F.regexp_extract("__rest", "^[^/?#]*([^?#]*)", 1).alias("path"))


def longest_rule(rules: list[Rule], field):
    """The text or verdict of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        host, path = rule.parts
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(field(rule))).otherwise(out)
    return out


def grams(hosts: list[bytes], paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram; host and path have hashes of their own."""
    rows, found = [], []
    for salt, texts in enumerate((hosts, paths)):
        ends = np.cumsum([len(t) + 2 for t in texts])
        flat = np.frombuffer(b"".join(b"^" + t + b"$" for t in texts), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(texts)), np.diff(np.append(0, ends)))
        for n in GRAMS:
            if len(flat) < n:
                continue
            code = np.zeros(len(flat) - n + 1, dtype=np.uint64)
            for k in range(n):
                code = code * np.uint64(257) + flat[k:len(flat) - n + 1 + k]
            inside = row[:len(code)] == row[n - 1:]
            found.append((mixed(code[inside], 16 * salt + n) >> np.uint64(48)).astype(np.int64))
            rows.append(row[:len(code)][inside])
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


@dataclass
class Regression:
    weights: np.ndarray
    bias: float

    def chances(self, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
        """Chance that each url is unwanted."""
        row, bucket = grams(hosts, paths)
        n = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
        z = self.bias + np.bincount(row, self.weights[bucket], len(hosts)) / np.sqrt(n)
        return 1 / (1 + np.exp(-z))


def train(rows: list[tuple[str, str, int]], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> Regression:
    """Gradient descent on (host, path, label) rows."""
    model = Regression(np.zeros(BUCKETS), 0.0)
    if not rows:
        model.bias = -1.0
        return model
    hosts, paths = [r[0].encode() for r in rows], [r[1].encode() for r in rows]
    labels = np.array([r[2] for r in rows], dtype=float)
    row, bucket = grams(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(rows)), 1))
    for _ in range(steps):
        wrong = model.chances(hosts, paths) - labels
        slope = np.bincount(bucket, (wrong * scale)[row], BUCKETS) / len(rows)
        model.weights -= rate * (20 * slope + decay * model.weights)
        model.bias -= rate * wrong.mean()
    return model


def fit(labelled: DataFrame, most: int = 10_000) -> Regression:
    """A regression on a small table (url, unwanted); at most `most` rows by hash order."""
    rows = with_parts(labelled, "unwanted").where("unwanted IS NOT NULL").orderBy(F.xxhash64("host", "path"), "host", "path", "unwanted").limit(most)
    return train([(r["host"], r["path"], r["unwanted"]) for r in rows.collect()])


def judged(pages: DataFrame, rules: list[Rule], model: Regression) -> DataFrame:
    """page_id, host, path, rule, verdict, unwanted (the regression's chance)."""
    def apply(batches):
        for batch in batches:
            chance = model.chances(raw_texts(batch.column(1)), raw_texts(batch.column(2)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance)], names=["page_id", "host", "path", "unwanted"])

    parts = with_parts(pages, "page_id")
    kind = parts.schema["page_id"].dataType.simpleString()
    scored = parts.mapInArrow(apply, f"page_id {kind}, host string, path string, unwanted double")
    own = F.when(F.col("unwanted") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", longest_rule(rules, lambda r: r.text).alias("rule"),
                         F.coalesce(longest_rule(rules, lambda r: r.verdict), own).alias("verdict"), "unwanted")
