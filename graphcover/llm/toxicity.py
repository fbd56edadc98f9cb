"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features are rates and logarithmic counts of a document's words (its length is none):
hits of a fixed lexicon and of a lexicon learned from labels, second-person words near a
hit, capitals, exclamation and other punctuation, symbols, and obfuscated spellings
(``1d10t``, ``i.d.i.o.t``). The learned lexicon has whole words and word beginnings
(``stem*``), so inflected forms count.

The model is fitted on at most ``MAX_LABELLED`` labelled rows, the only sample taken;
beyond it, those with the smallest hash of their id serve. Rows of equal text are one,
toxic if any of them is. The rows fall into ``FOLDS`` folds by hash of their text, at
every size alike: a row's learned-lexicon features come from the lexicon of the other
folds, and the isotonic curve is fitted to margins of trees grown without the row's
fold, so neither is fitted to rows that shaped its inputs. The lexicon and the trees of
all folds then serve. Scoring reads every word of every text, and its cost per word is a
dictionary lookup per distinct word of a chunk.

Defined results: null and empty texts score like a text without any hit; without
labels, or with one label value only, the score is that value's share (0.0 if none);
labels without a document, or null, teach nothing; a document labelled twice counts
as toxic if either says so; repeated rows score alike, in whatever order rows arrive;
equal gains split at the first feature and lowest cut; texts of any length are read
whole; only id and text are read, so other columns may have any name; empty tables give
empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcover.functions.scratch import materialize
from graphcover.llm.words import batched, chunks, split_words, text_column

MAX_LABELLED = 40_000
FOLDS = 5
#: Different terms a worker counts before it hands its counts on.
HELD_TERMS = 200_000
REJECT = 0.7
ODDS = 2.5
NEAR = 5

#: Common insults in four languages.
LEXICON = frozenset(
    "ass asshole bastard bitch clown creep crap cretin damn disgusting dumb dumbass fool fuck fucking garbage hate idiot idiots idiotic imbecile jerk "
    "liar loser losers lowlife moron morons moronic pathetic pig scum shit shut stupid sucks trash ugly useless vermin worthless "
    "abschaum arsch arschloch blöd depp dumm dummkopf fresse hurensohn idioten scheiße schwein trottel wichser "
    "abruti bâtard connard connasse crétin débile imbécile merde ordure putain salaud salope stupide "
    "basura bastardo cabrón escoria estúpido gilipollas idiota imbécil inútil mierda pendejo puta".split()
)
#: Second-person words in four languages.
SECOND = frozenset(
    "you your yours yourself u ur youre du dich dir dein deine deiner deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
#: Characters that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
STEMS = (4, 5, 6)
_EDGE = re.compile(r"^\W+|\W+$")
_MIXED = re.compile(r"[^\W\d_][\d@$!|*._-]+[^\W\d_]|[\d@$!|*]+[^\W\d_]{2}")

FEATURES = (
    "lexicon_rate", "lexicon_log", "learned_rate", "learned_log", "weight_rate", "weight_max", "near_second", "second_rate",
    "capital_rate", "bang_rate", "symbol_rate", "comma_rate", "obfuscated_rate", "obfuscated_hits",
)


def plain(token: str) -> tuple[str, bool]:
    """A token without its edges, folded; whether it spells letters with other signs."""
    core = _EDGE.sub("", token).lower()
    if core.isalpha() or not _MIXED.search(token):
        return core, False
    spelt = "".join(c for c in token.lower().translate(LEET) if c.isalpha())
    return spelt, True


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) >= k)]


@dataclass
class Model:
    learned: dict[str, float] = field(default_factory=dict)
    trees: list = field(default_factory=list)
    start: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] | None = None
    constant: float | None = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return calibrated(boosted(features(texts, self.learned), self.trees, self.start), self.steps)


def features(texts: pa.Array, learned: dict[str, float]) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in chunks(texts):
        words, offsets = split_words(texts.slice(a, b - a))
        coded = words.dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False)
        kinds = [_token(t, learned) for t in coded.dictionary.to_pylist()]
        table = np.array(kinds, float).reshape(-1, 8)
        hit = (table[:, 0] > 0) | (table[:, 1] > 0)
        n = np.diff(offsets)
        doc = np.repeat(np.arange(b - a), n)
        total = lambda v: np.bincount(doc, v, b - a)
        rows, size = out[a:b], np.maximum(n, 1)
        at = hit[ids]
        second = table[ids, 2]
        # second-person words at most NEAR words before or after a hit in the same document
        seen = np.concatenate(([0], np.cumsum(second)))
        places = np.flatnonzero(at)
        low = np.maximum(places - NEAR, offsets[doc[places]])
        high = np.minimum(places + NEAR + 1, offsets[doc[places] + 1])
        near = np.bincount(doc[places], seen[high] > seen[low], b - a)
        lexicon, hits, weight = total(table[ids, 0]), total(at.astype(float)), total(table[ids, 1])
        top = np.zeros(b - a)
        np.maximum.at(top, doc[places], table[ids[places], 1])
        capital, bang, symbol = total(table[ids, 3]), total(table[ids, 4]), total(table[ids, 5])
        comma = total(table[ids, 6])
        obfuscated, hidden = total((table[ids, 7] > 0).astype(float)), total((table[ids, 7] > 1).astype(float))
        rows[:] = np.column_stack(
            [
                100 * lexicon / size, np.log1p(lexicon), 100 * hits / size, np.log1p(hits), 100 * weight / size, top, np.log1p(near),
                100 * total(second) / size, capital / size, bang / size, symbol / size, comma / size, obfuscated / size, hidden,
            ]
        )
    return out


def _token(token: str, learned: dict[str, float]) -> tuple:
    word, odd = plain(token)
    weight = max((learned.get(t, 0.0) for t in terms_of(word)), default=0.0)
    known = word in LEXICON
    return (
        known, weight, word in SECOND, len(token) > 1 and token.isupper(), token.count("!"), sum(map(token.count, "#*$%&|<>")),
        token.count(",") + token.count(".") + token.count("?"), odd + (odd and (known or weight > 0)),
    )


# --- trees


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 3.0, l2: float = 1.0):
    """Logistic boosting with histogram splits; ties go to the first feature and the lowest cut."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])
    start = math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    margin, trees = np.full(len(y), start), []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node, tree = np.zeros(len(y), np.int64), {}
        for level in range(depth):
            first = 2**level - 1
            for at in range(first, 2 * first + 1):
                own = np.flatnonzero(node == at)
                best = _split(binned[own], g[own], h[own], cuts, bins, least, l2) if len(own) else None
                if best is None:
                    continue
                f, cut = best
                tree[at] = (f, float(cuts[f][cut]))
                right = binned[own, f] > cut
                node[own] = 2 * at + 1 + right
        value = np.zeros(2 ** (depth + 1) - 1)
        total, curve = np.bincount(node, g, len(value)), np.bincount(node, h, len(value))
        value = rate * total / (curve + l2)
        margin = margin + value[node]
        trees.append((tree, value))
    return trees, start


def _split(binned, g, h, cuts, bins, least, l2):
    gain, best = 1e-6, None
    for f, own in enumerate(cuts):
        if not len(own):
            continue
        gl = np.cumsum(np.bincount(binned[:, f], g, bins + 1))
        hl = np.cumsum(np.bincount(binned[:, f], h, bins + 1))
        nl = np.cumsum(np.bincount(binned[:, f], minlength=bins + 1))
        gt, ht, nt = gl[-1], hl[-1], nl[-1]
        gain_f = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
        gain_f[(nl < least) | (nt - nl < least)] = 0
        k = int(np.argmax(gain_f[: len(own)]))
        if gain_f[k] > gain:
            gain, best = gain_f[k], (f, k)
    return best


def boosted(x: np.ndarray, trees, start: float) -> np.ndarray:
    margin = np.full(len(x), start)
    for tree, value in trees:
        node = np.zeros(len(x), np.int64)
        for at in sorted(tree):
            f, cut = tree[at]
            own = node == at
            node[own] = 2 * at + 1 + (x[own, f] > cut)
        margin += value[node]
    return margin


# --- calibration


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the pooled blocks' mean margins and shares of positives."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order], y[order]):
        blocks.append([m, v, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def calibrated(margin: np.ndarray, steps) -> np.ndarray:
    """The curve at the margins; a thousandth of the plain sigmoid keeps the order inside a step."""
    return 0.999 * np.interp(margin, *steps) + 0.001 / (1 + np.exp(-margin))


# --- fitting


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """``text, toxic, fold`` of the different texts of at most ``limit`` labelled rows outside the held-out third."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(id_col)
        .agg(F.max(label_col).cast("double").alias("_toxic"))
        .orderBy(key, id_col)
        .limit(limit)
        .select(F.col(id_col).alias("_id"), "_toxic")
    )
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most `limit` rows of two numbers, so this side may be broadcast
    rows = slim.join(F.broadcast(chosen), "_id").groupBy("text").agg(F.max("_toxic").alias("toxic"))
    return rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))


def learn_lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Terms with their log odds of standing in a toxic row rather than another: one lexicon without each fold, then that of all.

    The terms are those of at most ``MAX_LABELLED`` rows, each in several toxic rows, so they fit the driver.
    """

    def count(batches):
        toxic, other = [Counter() for _ in range(FOLDS)], [Counter() for _ in range(FOLDS)]

        def counts():
            for k in range(FOLDS):
                terms = [t for t in toxic[k].keys() | other[k].keys() if t]
                columns = [pa.array(terms, pa.string()), pa.array([k] * len(terms), pa.int32()), *(pa.array([c[k][t] for t in terms], pa.int64()) for c in (toxic, other))]
                toxic[k].clear()
                other[k].clear()
                yield pa.RecordBatch.from_arrays(columns, ["term", "fold", "toxic", "other"])

        for batch in batches:
            texts = text_column(batch.column(0))
            label, fold = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in chunks(texts):
                words, offsets = split_words(texts.slice(a, b - a))
                coded = words.dictionary_encode()
                known = [terms_of(plain(t)[0]) for t in coded.dictionary.to_pylist()]
                ids = coded.indices.to_numpy(zero_copy_only=False)
                for i in range(b - a):
                    found = set()
                    for k in np.unique(ids[offsets[i] : offsets[i + 1]]).tolist():
                        found.update(known[k])
                    (toxic if label[a + i] > 0 else other)[fold[a + i]].update(found)
                if sum(map(len, toxic + other)) > HELD_TERMS:
                    yield from counts()
        yield from counts()

    own = {r["fold"]: (r["toxic"], r["n"] - r["toxic"]) for r in rows.groupBy("fold").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = (sum(x[k] for x in own.values()) for k in (0, 1))
    least = max(3, math.ceil(0.004 * n_toxic))
    counted = batched(rows.select("text", "toxic", "fold")).mapInArrow(count, "term string, fold int, toxic long, other long")
    part = lambda c, k: F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}")
    by_term = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), *(part(c, k) for k in range(FOLDS) for c in ("toxic", "other")))

    def odds(k: int | None):
        (t, o), (nt, no) = (own.get(k, (0, 0)), (n_toxic, n_other)) if k is not None else ((0, 0), (n_toxic, n_other))
        toxic, other = F.col("toxic") - (F.col(f"toxic{k}") if k is not None else 0), F.col("other") - (F.col(f"other{k}") if k is not None else 0)
        value = F.log((toxic + 0.5) / (nt - t + 1.0)) - F.log((other + 0.5) / (no - o + 1.0))
        return F.when((toxic >= least) & (value > ODDS), value)

    names = [*(f"odds{k}" for k in range(FOLDS)), "odds"]
    table = by_term.filter(F.col("toxic") >= least).select("term", *(odds(k).alias(n) for k, n in zip([*range(FOLDS), None], names)))
    terms = table.filter(F.coalesce(*names).isNotNull()).collect()
    return [{r["term"]: r[n] for r in terms if r[n] is not None} for n in names]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = MAX_LABELLED) -> Model:
    rows = materialize(training_rows(docs, labels, id_col, text_col, label_col, limit), "labelled")
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not toxic or toxic == n:
        return Model(constant=(toxic or 0.0) / max(n, 1))
    lexicons = learn_lexicons(rows)

    def measure(batches):
        for batch in batches:
            texts, fold = text_column(batch.column(0)), batch.column(2).to_numpy()
            x = np.zeros((len(texts), len(FEATURES)))
            for k in np.unique(fold):
                own = np.flatnonzero(fold == k)
                x[own] = features(texts.take(pa.array(own)), lexicons[k])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "toxic", "fold"])

    measured = batched(rows.select("text", "toxic", "fold")).mapInArrow(measure, "x array<double>, toxic double, fold int")
    table = measured.toArrow()
    x, y, fold = np.array(table["x"].to_pylist()), table["toxic"].to_numpy(), table["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the same trees in whatever order rows arrive
    x, y, fold = x[order], y[order], fold[order]
    margin = np.zeros(len(y))
    for k in np.unique(fold):
        grow = fold != k if (fold != k).any() else fold == k  # a single text has no other fold
        margin[fold == k] = boosted(x[fold == k], *fit_trees(x[grow], y[grow]))
    return Model(lexicons[-1], *fit_trees(x, y), fit_isotonic(margin, y), None)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` for every document."""
    slim = docs.select(id_col, text_col)
    kind = slim.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(text_column(batch.column(1))))], [id_col, "score"])

    return batched(slim).mapInArrow(run, f"`{id_col}` {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The documents with a score below ``reject``, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pc.less(pa.array(model.scores(text_column(batch.column(at)))), reject))

    return batched(docs).mapInArrow(run, docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
