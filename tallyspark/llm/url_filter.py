"""URL filter: rules on hosts and paths first, then a logistic model on hashed character n-grams of both."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.blocks import U64, Block, blocks, map_batches, mix, sums
from tallyspark.llm.training import fit_logistic, sigmoid

BITS, SIZES = 15, (3, 4, 5)
#: A-Z count as a-z, and all digits are alike.
LETTERS = np.arange(256, dtype=np.uint64)
LETTERS[65:91] += U64(32)
LETTERS[48:58] = 48

#: The small table that the default model learns from: addresses to block and to allow.
BLOCKED = """
http://ads.example.com/banner/12 https://adserver.example.net/track/pixel https://ad-tracker.example.org/click/88
http://click-ads.example.com/en/1 https://ads-network.example.net/fr/20 https://tracking.example.com/t/55
http://track-visits.example.org/de/9 https://adult-video.example.com/en/7 http://xxx-adult.example.net/es/3
https://hot-adult-x.example.org/fr/100 https://adult-chat.example.com/de/11.html http://casino-royal.example.net/en/5
https://best-casino.example.com/win/9 http://online-casino-win.example.org/fr/2 https://win-big-casino.example.net/es/14
http://cheap-meds.example.com/pills/1 https://pills-online.example.org/en/31 http://cheap-blue-pills.example.net/de/8
https://buy-cheap-pills.example.com/es/77.html http://free-bets-now.example.org/en/6 https://bets-free.example.net/de/19
http://sports-bets.example.com/fr/40 https://free-bet-bonus.example.org/es/23 http://spam-site.example.net/en/12
https://link-farm.example.com/de/3 http://farm-of-spam.example.org/fr/17 https://spam-blog-farm.example.net/en/90
http://m.ads-track.example.net/en/3 https://blog.ads-visits.example.org/fr/24 http://seo-spam.example.com/es/21 https://win-free-prizes.example.org/en/66 http://cheap-watches.example.net/fr/13
""".split()
ALLOWED = """
http://www.library.example.org/en/1 https://blog.thorn.example.net/fr/22 https://news.example.com/de/2019/5
http://m.theater.example.com/en/7 https://museum.example.org/es/12.html http://thread.example.net/en/31
https://www.weather.example.com/fr/8 http://there.example.org/de/14 https://other.example.net/en/50
http://station.example.com/es/3 https://nation.example.org/en/99 http://tide.example.net/fr/18.html
https://blog.there.example.com/de/61 http://brother.example.org/en/2 https://m.thing.example.net/es/27
http://university.example.org/en/courses/4 https://docs.example.com/en/guide/10 http://recipes.example.net/fr/33
https://maps.example.com/de/5 http://history.example.org/es/81 https://motion.example.net/en/6
http://www.garden.example.com/fr/11 https://blog.river.example.org/de/29 http://thirst.example.net/en/44
https://theory.example.com/en/70.html http://nothing.example.org/fr/9 https://leather.example.net/es/16
http://action.example.com/de/37 https://the-times.example.org/en/15 http://math.example.net/fr/25
https://school.example.com/es/19 http://www.health.example.org/de/42 https://music.example.net/en/13
http://path.example.com/fr/55 https://tablet.example.org/en/64 http://notable.example.net/de/73
https://than.example.com/en/20 http://thrush.example.org/es/38 https://author.example.net/fr/47 http://m.earth.example.com/en/58
""".split()


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class Model:
    weights: np.ndarray
    shift: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty for null and where there is no `://`."""
    url = F.coalesce(url, F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, parts, 2)


def matched_rule(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """`value` of the longest rule that fits the host or a parent of it and the start of the path; of equally
    long ones a blocking one first; else null. The rules are few and stand in the plan."""
    out = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r.text), r.allow, r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def gram_ids(block: Block, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the n-grams of each text, with a mark at its start and end, and bounds by text."""
    size = np.diff(block.offsets)
    marked = np.repeat(np.arange(block.n), size)
    data = np.zeros(len(block.data) + 2 * block.n, np.uint64)  # 0 stands on both sides of every text
    data[np.arange(len(block.data)) + 2 * marked + 1] = LETTERS[block.data]
    bounds = block.offsets + 2 * np.arange(block.n + 1)
    owner = np.repeat(np.arange(block.n), np.diff(bounds))
    ids, places = [], []
    for n in SIZES:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n + 16 * seed, np.uint64)
        for k in range(n):
            h = h * U64(0x100000001B3) + data[k : k + m]
        at = np.flatnonzero(owner[:m] == owner[n - 1 :])
        ids.append((mix(h[at]) >> U64(64 - BITS)).astype(np.int64))
        places.append(at)
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    return (np.concatenate(ids) if ids else at)[order], np.searchsorted(at[order], bounds)


def margins(hosts: pa.Array, paths: pa.Array, model: Model) -> np.ndarray:
    out = np.full(len(hosts), model.shift)
    for seed, column in enumerate((hosts, paths)):
        for block in blocks(column):
            ids, bounds = gram_ids(block, seed)
            out[block.lo : block.lo + block.n] += sums(model.weights[ids], bounds) / np.sqrt(np.maximum(np.diff(bounds), 1))
    return out


def train(urls: DataFrame, rows: int = 10_000) -> Model:
    """Fit on a table (url, blocked) of at most `rows` rows; more is an error, for the table is to be small.
    Rows without a label are left out. With one label only, everything gets it."""
    host, path = host_and_path(F.col("url"))
    found = urls.where("blocked is not null").select(host.alias("host"), path.alias("path"), F.col("blocked").cast("int").alias("y"))
    found = found.orderBy("host", "path", "y").limit(rows + 1).toArrow()
    y = found.column("y").to_numpy().astype(float)
    if len(y) > rows:
        raise ValueError(f"more than {rows} labelled addresses")
    if len(np.unique(y)) < 2:
        return Model(np.zeros(1 << BITS), 20.0 if y.sum() else -20.0)
    x = np.zeros((len(y), 1 << BITS), np.float32)
    for seed, name in enumerate(("host", "path")):
        for block in blocks(found.column(name)):
            ids, bounds = gram_ids(block, seed)
            size = np.diff(bounds)
            np.add.at(x, (block.lo + np.repeat(np.arange(block.n), size), ids), np.repeat(1 / np.sqrt(np.maximum(size, 1)), size))
    used = np.flatnonzero(x.any(0))
    w, b = fit_logistic(x[:, used].astype(np.float64), y, np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())), penalty=2e-4, steps=500)
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return Model(weights, b)


def judge(pages: DataFrame, model: Model, rules: list[Rule], threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score (probability to block) of every row.

    The longest fitting rule decides, else the model; addresses without host and path are allowed. Repeated
    rows are judged one by one; other columns are not read; nothing is shuffled.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def score(batches):
        for batch in batches:
            host, path = batch.column("host"), batch.column("path")
            yield batch.append_column("score", pa.array(sigmoid(margins(host, path, model))))

    host, path = host_and_path(F.col("url"))
    parted = map_batches(pages.select("page_id", host.alias("host"), path.alias("path")), score,
                         f"page_id {kind}, host string, path string, score double")
    host, path = F.col("host"), F.col("path")
    by_model = F.when((F.col("score") >= threshold) & ((host != "") | (path != "")), "block").otherwise("allow")
    by_rule = matched_rule(host, path, rules, lambda r: "allow" if r.allow else "block")
    return parted.select("page_id", "host", "path", matched_rule(host, path, rules, lambda r: r.text).cast("string").alias("rule"),
                         F.coalesce(by_rule.cast("string"), by_model).alias("verdict"), "score")
