"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Rules (host suffix, path start, verdict): a rule fits its host and all subdomains if the
url's path starts with the rule's; the longest fitting rule wins.

All other urls get the verdict of boosted regression trees on the log-odds (logistic
loss, histogram splits), trained here from labelled urls.  Labels are a parameter (a table of
urls and labels).  Without one they are weak labels: urls that a rule decides (but not those that
a rule blocks for a part of a host only, which says nothing on the rest), and hosts with a
word of the categories below.  Words are no feature, so the trees cannot repeat the list:
what they learn of a category must show in the lexical features, and hosts of categories
that are not listed are found by them alone (tests leave whole categories out).

Features: lengths of url, host and path, depth, digit ratio, entropy of the bytes, counts of
parameters, labels, dashes (in the url, in the host) and other marks, and suffix statistics,
the smoothed share of blocked labelled urls with the same host suffix of one, two or three
labels.  Training urls get these statistics from other folds only: one half of the hosts from
the other folds of urls (a known host), the other half from the other folds of hosts (a new
host), so the trees learn to trust the statistics where there are any and to do without.

The statistics are counted over all labelled urls of the table, whatever its size, and are
joined to the urls by host; neither the counts nor the hosts pass through the driver.  Only
the trees are fitted on a sample of about ``SAMPLE_ROWS`` distinct labelled urls (by hash, so the
same in every run).  All features but the entropy are SQL expressions; entropy and trees
run on whole Arrow batches in numpy.

Nulls: a null url, or one without ``://``, has empty host and path; no rule fits and it is
scored as the empty url.  Null labels are none; of a url's conflicting labels the largest counts.
Repeated rows give a row each, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, cut, join_one, md5_long, ship

#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: host words (split at dots and dashes) of categories that blocklists are commonly kept for, and of plain hosts
BLOCK_WORDS = {
    "advertising": ("ad", "ads", "adserver", "advert", "adverts", "banner", "banners", "popup", "promo", "sponsor"),
    "tracking": ("click", "clicks", "pixel", "track", "tracker", "tracking", "beacon"),
    "gambling": ("bet", "bets", "betting", "bingo", "casino", "jackpot", "lottery", "poker", "slots"),
    "pharmacy": ("cialis", "meds", "pharmacy", "pill", "pills", "viagra"),
    "adult": ("adult", "cam", "escort", "porn", "sex", "xxx"),
    "spam": ("malware", "phish", "phishing", "spam", "scam", "warez"),
}
ALLOW_WORDS = ("blog", "docs", "edu", "gov", "library", "museum", "news", "wiki")

SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 40, 3, 0.2, 32, 20
PRIOR, FOLDS = 10.0, 5


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule; null if none fits."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last, longest one wins
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Name -> expression; the entropy and the suffix shares come on top."""
    url = F.coalesce(url, F.lit(""))
    marks = lambda c, chars: (F.length(c) - F.length(F.translate(c, chars, ""))).cast("double")
    query = F.regexp_extract(url, r"(?s)^[^?]*\?([^#]*)", 1)
    long = F.greatest(F.length(url), F.lit(1))
    return {
        "url_len": F.length(url).cast("double"), "host_len": F.length(host).cast("double"), "path_len": F.length(path).cast("double"),
        "depth": marks(path, "/"), "labels": marks(host, ".") + 1, "digits": marks(url, "0123456789") / long,
        "params": F.when(query != "", marks(query, "&") + 1).otherwise(F.lit(0.0)), "dashes": marks(url, "-"), "host_dashes": marks(host, "-"),
        "marks": marks(url, "@%~_=+"), "sld_len": F.coalesce(F.length(F.try_element_at(F.split(host, r"\."), F.lit(-2))), F.lit(0)).cast("double"),
    }


SHARES = ("s1", "s2", "s3")


def entropy(urls: pa.Array) -> np.ndarray:
    """Entropy in bits of each url's bytes."""
    raw = urls.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    size = np.diff(ends)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    key, n = np.unique(np.repeat(np.arange(len(raw)), size) * 256 + data, return_counts=True)
    p = n / size[key // 256]
    return -np.bincount(key // 256, p * np.log2(p), len(raw)) + 0.0


class Boosted:
    """Gradient-boosted trees, logistic loss, histogram splits; numpy only."""

    def __init__(self, edges: list[np.ndarray], start: float, trees: list[list[tuple]]):
        self.edges, self.start, self.trees = edges, start, trees

    @staticmethod
    def binned(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> "Boosted":
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        b = cls.binned(edges, x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        start = float(np.log(share / (1 - share)))
        f, out = np.full(len(y), start), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            nodes, todo = [], [(np.arange(len(y)), 0)]
            while todo:  # nodes in breadth-first order; (feature, bin, left, right) or (value,)
                at, level = todo.pop(0)
                G, H = g[at].sum(), h[at].sum()
                best = (1e-6, None)
                if level < depth and len(at) >= 2 * LEAST_LEAF:
                    for k, e in enumerate(edges):
                        if not len(e):
                            continue
                        m = len(e) + 1
                        gl, hl, nl = (np.cumsum(np.bincount(b[at, k], w, m))[:-1] for w in (g[at], h[at], None))
                        gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                        gain[(nl < LEAST_LEAF) | (len(at) - nl < LEAST_LEAF)] = -1
                        j = int(gain.argmax())
                        if gain[j] > best[0]:
                            best = (gain[j], (k, j))
                if best[1] is None:
                    value = rate * G / (H + 1)
                    f[at] += value
                    nodes.append((float(value),))
                else:
                    k, j = best[1]
                    left = b[at, k] <= j
                    nodes.append((k, j, len(nodes) + len(todo) + 1, len(nodes) + len(todo) + 2))
                    todo += [(at[left], level + 1), (at[~left], level + 1)]
            out.append(nodes)
        return cls(edges, start, out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of blocking."""
        b = self.binned(self.edges, x)
        f = np.full(len(x), self.start)
        for nodes in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH + 1):
                for i, node in enumerate(nodes):
                    if len(node) == 4:
                        on = at == i
                        at[on] = np.where(b[on, node[0]] <= node[1], node[2], node[3])
            value = np.array([n[0] if len(n) == 1 else 0.0 for n in nodes])
            f += value[at]
        return 1 / (1 + np.exp(-f))


class Model:
    """Trees over the lexical features, the entropy and three suffix shares."""

    def __init__(self, trees: Boosted | None):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> "Model":
        return cls(Boosted.fit(x, y) if len(y) else None)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.trees.predict(x) if self.trees is not None and len(x) else np.zeros(len(x))


def matrix(batch: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    """Feature rows of a batch with a column ``url``: the named columns, the entropy, the suffix shares."""
    url = batch.column("url")
    url = url.combine_chunks() if isinstance(url, pa.ChunkedArray) else url
    cols = {n: np.asarray(batch.column(n), float) for n in (*names, *SHARES)}
    return np.stack([*(cols[n] for n in names), entropy(url), *(cols[n] for n in SHARES)], axis=1)


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = host_path(F.col("url"))
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    return out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))


def weak_label(rules=RULES, block_words=BLOCK_WORDS, allow_words=ALLOW_WORDS) -> Column:
    """1 block, 0 allow, for urls that a rule or the words of their host decide; else null."""
    words = F.split(F.col("host"), r"[.\-]")
    # a rule that blocks a part of a host says nothing on the host's other urls: no label
    labels = {rule: int(verdict == "block") for rule, verdict in rules if verdict == "allow" or not rule.partition("/")[2]}
    by_rule = F.coalesce(*(F.when(F.col("rule") == rule, F.lit(y)) for rule, y in labels.items()), F.lit(None).cast("int"))
    has = lambda xs: F.arrays_overlap(words, F.array(*map(F.lit, xs))) if xs else F.lit(False)
    decided = F.col("rule").isNotNull() & by_rule.isNull()  # by a rule that is no label
    blocked = [w for group in block_words.values() for w in group]
    label = F.when(by_rule.isNotNull(), by_rule).when(has(blocked), 1).when(has(allow_words) & ~decided, 0)
    return F.when(F.col("url").isNotNull(), label)


def suffix_shares(rows: DataFrame) -> tuple[DataFrame, int]:
    """(host, n_rows, s1, s2, s3, v1, ..., t1_0, ...) for every host, and the number of labelled urls, from rows (host, label, fold).

    s1 to s3 are the smoothed shares of blocked urls among all labelled ones with the same
    suffix of one, two or three labels; t1_0 to t3_4 are those without the urls of one fold, v1 to
    v3 those without the host's fold of hosts.
    """
    folds = range(FOLDS)
    known = lambda f: (F.col("fold") == f) & F.col("label").isNotNull()
    n, y = [f"n{f}" for f in folds], [f"y{f}" for f in folds]
    hn, hy = [f"hn{f}" for f in folds], [f"hy{f}" for f in folds]
    hosts = rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(F.count_if(known(f)).alias(n[f]) for f in folds), *(F.coalesce(F.sum(F.when(known(f), F.col("label"))), F.lit(0)).alias(y[f]) for f in folds)
    )
    hosts = cut(hosts.withColumn("host_fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")))
    add = lambda names, but=None: sum((F.col(c) for k, c in enumerate(names) if k != but), F.lit(0))
    all_n, all_y = hosts.agg(F.sum(add(n)), F.sum(add(y))).head()
    prior = (all_y or 0) / max(1, all_n or 0)
    three = F.array(*(F.substring_index("host", ".", -k) for k in (1, 2, 3)))
    of_fold = lambda f, names: F.sum(F.when(F.col("host_fold") == f, add(names)).otherwise(0))
    counts = hosts.withColumn("suffix", F.explode(F.array_distinct(three))).groupBy("suffix").agg(
        *(F.sum(c).alias(c) for c in (*n, *y)), *(of_fold(f, n).alias(hn[f]) for f in folds), *(of_fold(f, y).alias(hy[f]) for f in folds)
    )
    share = lambda ys, ns, but=None: (add(ys, but) + PRIOR * prior) / (add(ns, but) + PRIOR)
    counts = counts.select("suffix", share(y, n).alias("s"), *(share(y, n, f).alias(f"t{f}") for f in folds), F.array(*(share(hy, hn, f) for f in folds)).alias("v"))
    both = hosts.select("host", "n_rows", "host_fold", F.posexplode(three).alias("k", "suffix")).join(counts, "suffix").withColumn("v", F.element_at("v", F.col("host_fold") + 1))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    shares = both.groupBy("host").agg(
        F.max("n_rows").alias("n_rows"), *(pick(k, "s").alias(f"s{k + 1}") for k in range(3)), *(pick(k, "v").alias(f"v{k + 1}") for k in range(3)),
        *(pick(k, f"t{f}").alias(f"t{k + 1}_{f}") for k in range(3) for f in folds),
    )
    return cut(shares), all_n or 0


def sample(rows: DataFrame, shares: DataFrame, n: int, most: int = SAMPLE_ROWS) -> tuple[pa.Table, list[str]]:
    """About ``most`` of the n labelled urls with their features and the suffix shares of the other folds."""
    turn = md5_long(F.concat(F.lit("url:"), "url"))
    known = rows.where(F.col("label").isNotNull()).select("url", "host", "path", "label", "fold", turn.alias("turn")).distinct()
    got = known.where(F.col("turn") / float(1 << 60) < most / max(1, n)).orderBy("turn", "url").limit(2 * most).join(shares, "host")
    new = F.pmod(F.xxhash64("host", F.lit("new")), F.lit(2)) == 0
    other = [F.when(new, F.col(f"v{k}")).otherwise(F.element_at(F.array(*(f"t{k}_{f}" for f in range(FOLDS))), F.col("fold") + 1)).alias(f"s{k}") for k in (1, 2, 3)]
    features = lexical(F.col("url"), F.col("host"), F.col("path"))
    got = got.select("turn", "url", "label", *(c.alias(name) for name, c in features.items()), *other).orderBy("turn", "url")
    return got.toArrow(), list(features)


def _score(model: Model, names: list[str]):
    kept = ["page_id", "url", "host", "path", "rule"]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(model.score(matrix(b, names)))], names=[*kept, "score"])

    return run


def judge(pages: DataFrame, *, labels: DataFrame | None = None, rules=RULES, block_words=BLOCK_WORDS, allow_words=ALLOW_WORDS, sample_rows: int = SAMPLE_ROWS, block_from: float = 0.5) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, score) for every page; score is the trees' probability of blocking.

    labels: (url, label), 1 to block and 0 to allow, joined to the pages by url; weak labels without it.
    """
    ship(pages.sparkSession)
    rows = parsed(pages, rules).withColumn("page_id", F.col("page_id").cast("long"))
    if labels is None:
        rows = rows.withColumn("label", weak_label(rules, block_words, allow_words))
    else:
        rows = rows.join(labels.where("label is not null").groupBy("url").agg(F.max("label").cast("int").alias("label")), "url", "left")
    # written once: plain columns keep the plans behind it small
    rows = cut(rows.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")))
    shares, n = suffix_shares(rows)
    known, names = sample(rows, shares, n, sample_rows)
    model = Model.fit(matrix(known, names), np.asarray(known.column("label"), float))
    features = lexical(F.col("url"), F.col("host"), F.col("path"))
    plain = join_one(rows, shares.select("host", "n_rows", *SHARES), ["host"], "n_rows").select("page_id", "url", "host", "path", "rule", *SHARES, *(c.alias(name) for name, c in features.items()))
    scored = plain.mapInArrow(_score(model, names), "page_id long, url string, host string, path string, rule string, score double")
    verdict = F.when(F.col("score") >= block_from, "block").otherwise("allow")
    for rule, by_rule in rules:
        verdict = F.when(F.col("rule") == rule, by_rule).otherwise(verdict)
    return scored.withColumn("verdict", verdict)
