"""Operator 2, URL filters: host and path rules, and logistic regression on hashed character n-grams.

Rules decide where one fits: its host or a subdomain of it, and a path that
starts with the rule's; the longest rule wins. Elsewhere the model decides: the
3- to 5-grams of "^host$" and of the path, hashed to 2**BITS buckets each of
its own half, are scored by weights trained on a small labelled table.

Rows: a null url, or one without "://", has an empty host and path, fits no
rule and is allowed with score 0. Repeated rows each get a row. Any other
columns are left alone.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at
from .tables import small_batches, table

BITS = 16
BLOCK_FROM = 0.5

#: The rules (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Words of unwanted and of wanted sites, from which the labelled table is written.
UNWANTED_WORDS = (
    "adult", "porn", "xxx", "sex", "cams", "escort", "nude", "erotic", "hentai", "fetish", "milf", "hookup",
    "casino", "poker", "slots", "bets", "betting", "jackpot", "roulette", "lottery", "gambling", "bingo",
    "pills", "pharma", "viagra", "cialis", "meds", "steroids", "weightloss", "replica",
    "warez", "crack", "keygen", "cracked", "nulled", "serials", "hacks", "cheats", "torrent",
    "spam", "clickbait", "payday", "loans", "forex", "moneyfast", "getrich", "prizes", "giveaway", "farm", "seo",
)
WANTED_WORDS = (
    "news", "weather", "library", "museum", "university", "school", "college", "wiki", "docs", "guide", "manual", "archive",
    "kitchen", "recipes", "garden", "travel", "hotel", "rail", "transit", "maps", "atlas", "history", "science", "physics",
    "biology", "health", "clinic", "hospital", "sports", "football", "chess", "music", "concert", "cinema", "theatre", "books",
    "poetry", "painting", "design", "fashion", "market", "shop", "store", "bank", "insurance", "energy", "climate", "water",
    "city", "council", "county", "government", "court", "law", "tax", "jobs", "careers", "forum", "community", "photo",
    "video", "radio", "podcast", "software", "database", "compiler", "robotics", "astronomy", "geology", "farmers", "essex", "pharmacy", "alphabets", "drinking",
)
_JOINS = ("{a}", "{a}-{b}", "{a}{b}", "{b}-{a}", "free-{a}", "best-{a}", "cheap-{a}", "{a}-online", "my-{a}", "{a}24", "{a}-x")
_PLAIN_JOINS = ("{a}", "{a}-{b}", "{a}{b}", "the-{a}", "{a}-online", "my-{a}", "{a}24", "{a}-today", "free-{a}", "best-{a}", "new-{a}")
_SYLLABLES = ("an", "er", "in", "ti", "on", "ou", "re", "the", "al", "or", "es", "sh", "nd", "ma", "lo", "ve", "ku", "ber", "gen", "tion", "ra", "pi", "so", "wh", "ly", "ha")
_PLACES = (("", ""), ("www.", "/en/{n}"), ("blog.", "/de/{n}.html"), ("m.", "/fr/{n}/"), ("", "/es/{n}"), ("", "/posts/{n}"), ("www.", "/about/"))
_ENDS = ("com", "net", "org", "example.com", "example.net", "example.org", "info")


def labelled_urls(seed: int = 2, rounds: int = 6) -> list[tuple[str, int]]:
    """The small labelled table: hosts with paths, 1 for unwanted. Each word stands in `rounds` hosts, twice as many for the fewer unwanted words, joined as sites join them, beside as many hosts of drawn syllables, which are wanted."""
    rng, out = random.Random(seed), []
    for words, joins, label in ((UNWANTED_WORDS, _JOINS, 1), (WANTED_WORDS, _PLAIN_JOINS, 0)):
        for word in words:
            for _ in range(rounds * (2 if label else 1)):
                before, path = rng.choice(_PLACES)
                name = rng.choice(joins).format(a=word, b=rng.choice(words))
                out.append((f"{before}{name}.{rng.choice(_ENDS)}{path.format(n=rng.randint(1, 999))}", label))
    for _ in range(rounds * len(WANTED_WORDS)):
        before, path = rng.choice(_PLACES)
        name = "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(2, 4)))
        out.append((f"{before}{name}.{rng.choice(_ENDS)}{path.format(n=rng.randint(1, 999))}", 0))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    lowered = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.regexp_extract(url, pattern, 2)


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _buckets(texts: pa.Array, half: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- to 5-grams of bytes and the text of each."""
    data, offsets = at.text_bytes(texts)
    data, found, owners = data.astype(np.uint64), [], []
    for n in (3, 4, 5):
        if data.size < n:
            continue
        code = np.full(data.size - n + 1, n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | data[k : data.size - n + 1 + k]
        start = np.arange(code.size)
        text = np.searchsorted(offsets, start, "right") - 1
        whole = start + n <= offsets[text + 1]
        found.append((at.mixed(code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)[whole] + (half << bits))
        owners.append(text[whole])
    return (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def features(hosts: pa.Array, paths: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    marked = pa.compute.binary_join_element_wise("^", hosts, "$", "")
    parts = [_buckets(marked, 0, bits), _buckets(paths, 1, bits)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _scores(weights: np.ndarray, buckets: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    size = np.bincount(text, minlength=n)
    dot = np.bincount(text, weights[buckets], minlength=n) / np.sqrt(np.maximum(size, 1))
    return 1 / (1 + np.exp(-np.clip(dot + weights[-1], -30, 30)))


def fit(urls: list[str], labels: list[int], bits: int = BITS, steps: int = 800, rate: float = 20.0, decay: float = 5e-5) -> np.ndarray:
    """Full gradient steps over the labelled table, given as host and path in one text."""
    parts = [u.partition("/") for u in urls]
    buckets, text = features(pa.array([p[0] for p in parts]), pa.array([(p[1] + p[2]).partition("?")[0].partition("#")[0] for p in parts]), bits)
    size = np.sqrt(np.maximum(np.bincount(text, minlength=len(urls)), 1))
    y, weights = np.array(labels, float), np.zeros((2 << bits) + 1)
    for _ in range(steps):
        wrong = y - _scores(weights, buckets, text, len(urls))
        step = np.bincount(buckets, (wrong / size)[text], minlength=weights.size)
        step[-1] = wrong.sum()
        weights += rate * (step / len(urls) - decay * weights)
    return weights


def train(labelled: list[tuple[str, int]] | None = None) -> np.ndarray:
    """Weights fitted on a small labelled table of hosts with paths (1: unwanted)."""
    rows = labelled_urls() if labelled is None else labelled
    return fit([u for u, _ in rows], [y for _, y in rows])


def filter_urls(pages: DataFrame, weights: np.ndarray, rules: tuple = RULES, page_id: str = "page_id", url: str = "url", block_from: float = BLOCK_FROM) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every row."""
    spark = pages.sparkSession
    small_batches(spark, 10_000)
    sent = spark.sparkContext.broadcast(weights.astype(np.float32))
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            buckets, text = features(rows.column(1), rows.column(2))
            score = np.where(pa.compute.equal(rows.column(1), "").to_numpy(zero_copy_only=False), 0.0, _scores(sent.value, buckets, text, rows.num_rows))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score)], names=["page_id", "host", "path", "score"])

    scored = parts.mapInArrow(run, f"page_id {parts.schema['page_id'].dataType.simpleString()}, host string, path string, score double")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= block_from, "block").otherwise("allow")).alias("verdict"), "score")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), train())
