"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities and counts of a fixed insult lexicon and of a lexicon learned from the
labelled sample (words and word stems with their log-odds), hits near second-person words, capitals,
punctuation and obfuscation rates, hits that appear only after undoing look-alike characters, and
length.  Language, source, ids and labels are never inputs.

Fitting takes labelled rows outside the held-out fifth, at most ``SAMPLE`` ids, chosen by a hash
of the id, with one text each (the smallest, if an id repeats); texts of over ``LONGEST`` characters are not
fitted on.  So the driver never holds more than the two bounds allow.  All texts are scored, whole.
The lexicon is learned across folds, so that a row's own label does not enter its
features; trees are fitted on these, and the calibration on out-of-fold predictions.
A score is 0.999 times its calibrated value and 0.001 times the trees' own, so that texts on one step of
the calibration keep their order.

Defined results: null text counts as empty; empty texts get the score their features give; labels that
are null are left out, several labels of one id count as their largest; without labels of both kinds
the score is constant; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.columns import fresh, map_in_arrow, named
from quarry.plans.scratch import ship

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 5000
#: Characters of a text that is fitted on, at most; longer ones are left out of the fit, never cut.
LONGEST = 200_000
HELD_OUT_OF = 5
FOLDS = 4
#: General insults in the corpus' languages.
INSULTS = frozenset(
    """
    idiot idiots moron morons stupid dumb loser losers trash garbage scum pathetic worthless disgusting clown clowns
    imbecile fool foolish ugly hate vermin filth filthy pig pigs bastard bitch crap shit fuck fucking asshole jerk
    dummkopf trottel blödmann arschloch abschaum widerlich wertlos dumm idioten versager schwein dreck
    imbécile crétin connard salaud ordure minable dégoûtant débile nul merde pourri
    idiota imbécil estúpido estúpida basura escoria patético inútil asqueroso payaso cabrón mierda
    """.split()
)
#: Words for the reader.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos usted ustedes tú tus vosotros".split())
#: Characters that stand for letters in disguised words.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
_TOKEN = re.compile(r"\w+")
#: Possessive, and only from the beginning of a run of letters: a long word is read once.
_DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0134578@$!*._-]++[^\W\d_]++)++")
_SIGNS = frozenset("0134578@$!*._-")
_BEFORE_LETTER = re.compile(r"[0134578@$!*._-](?=[^\W\d_])")
_LETTER = re.compile(r"[^\W\d_]")
_CAPITALS = re.compile(r"[A-Z]{3,}")
_WORD_SIGN = re.compile(r"\w")
STEMS = (5, 4)
FEATURES = (
    "log_words fixed_density fixed_hits word_density word_hits word_distinct word_odds word_best "
    "stem_density stem_hits stem_distinct stem_odds stem_best near_you near_you_rate you_rate disguised_rate "
    "disguised_hits capitals all_caps exclaim question symbols mean_length"
).split()


@dataclass
class Parsed:
    """What the features need of one text, whatever the lexicon."""

    lower: str
    length: int
    counts: Counter
    plain: list[float]
    undone: list[str]


def _disguised(text: str) -> list[str]:
    """Words with signs between letters.  Most texts have none, which the signs tell without reading the words."""
    for m in _BEFORE_LETTER.finditer(text):
        at = m.start() - 1
        while at >= 0 and text[at] in _SIGNS:
            at -= 1
        if at >= 0 and _LETTER.match(text, at):
            return _DISGUISED.findall(text)
    return []


def _all_caps(text: str) -> int:
    """Words of three or more capitals A-Z."""
    beside = lambda at: 0 <= at < len(text) and _WORD_SIGN.match(text, at)
    return sum(1 for m in _CAPITALS.finditer(text) if not beside(m.start() - 1) and not beside(m.end()))


def parse(text: str | None) -> Parsed:
    text = text or ""
    lower = text.lower()
    tokens = _TOKEN.findall(lower)
    n, chars = max(1, len(tokens)), max(1, len(text))
    disguised = _disguised(text)
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    capitals = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    symbols = int(np.count_nonzero((raw >= 33) & (raw <= 47) | (raw >= 58) & (raw <= 64) | (raw >= 91) & (raw <= 96) | (raw >= 123) & (raw <= 126)))
    all_caps = _all_caps(text) if capitals > 2 else 0
    plain = [
        len(disguised) / n, capitals / chars, all_caps / n, text.count("!") / chars, text.count("?") / chars, symbols / chars, chars / n,
    ]
    return Parsed(lower, len(tokens), Counter(tokens), plain, [d.lower().translate(LOOK_ALIKE) for d in disguised])


class Lexicon(dict):
    """Word -> (insult, second person, its odds, its best stem's odds), or None if it is none of these.

    Made from the odds of learned words and stems; words are looked up once and remembered, at most
    ``REMEMBERED`` of them.
    """

    REMEMBERED = 300_000

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems

    def __reduce__(self):
        return Lexicon, (self.words, self.stems)

    def __missing__(self, w: str):
        stem = max((self.stems.get(w[:k], 0.0) for k in STEMS), default=0.0) if len(w) > STEMS[-1] else 0.0
        found = (w in INSULTS, w in SECOND_PERSON, self.words.get(w), stem)
        if found == (False, False, None, 0.0):
            found = None
        if len(self) >= self.REMEMBERED:
            self.clear()
        self[w] = found
        return found


def learn_lexicon(parsed: list[Parsed], labels: np.ndarray, least: int = 3, odds: float = 1.5) -> Lexicon:
    """Words and stems that documents labelled 1 hold far more often than others (smoothed log-odds)."""
    n1 = max(1, int(labels.sum()))
    n0 = max(1, len(labels) - n1)
    word, stem = (Counter(), Counter()), (Counter(), Counter())
    for p, y in zip(parsed, labels):
        word[int(y)].update(p.counts.keys())
        stem[int(y)].update({w[:k] for w in p.counts for k in STEMS if len(w) > k})

    def pick(c, least):
        found = {}
        for w, hits in c[1].items():
            if hits >= least:
                value = math.log((hits + 0.2) / (c[0][w] + 0.5) * n0 / n1)
                if value >= odds:
                    found[w] = value
        return found

    return Lexicon(pick(word, least), pick(stem, least + 2))


def featurise(p: Parsed, lex: Lexicon) -> list[float]:
    n = max(1, p.length)
    fixed = words = stems = 0
    word_odds, stem_odds, word_n, stem_n, hit = 0.0, 0.0, 0, 0, set()
    word_best = stem_best = 0.0
    you = 0
    for w, c in p.counts.items():
        known = lex[w]
        if known is None:
            continue
        insult, second, v, stem = known
        if second:
            you += c
        if insult:
            fixed += c
            hit.add(w)
        if v is not None:
            words += c
            word_n += 1
            word_odds += v
            word_best = max(word_best, v)
            hit.add(w)
        if stem:
            stems += c
            stem_n += 1
            stem_odds += stem
            stem_best = max(stem_best, stem)
            hit.add(w)
    near = 0
    if hit and you:
        last_you = last_hit = -99
        for i, t in enumerate(_TOKEN.findall(p.lower)):
            if t in SECOND_PERSON:
                last_you = i
                near += i - last_hit <= 5
            elif t in hit:
                last_hit = i
                near += i - last_you <= 5
    undone = sum(w in INSULTS or w in lex.words for w in p.undone)
    return [
        math.log1p(p.length), fixed / n, fixed, words / n, words, word_n, word_odds, word_best, stems / n, stems, stem_n,
        stem_odds, stem_best, near, near / n, you / n, p.plain[0], undone, *p.plain[1:],
    ]


class BoostedTrees:
    """Logistic gradient boosting with histogram splits; trees are complete to ``depth``."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, leaf: float = 2.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.leaf, self.ridge = trees, depth, rate, bins, leaf, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        b = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)])
        rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = math.log(rate / (1 - rate))
        f = np.full(n, self.base)
        self.feature, self.cut, self.value = [], [], []
        flat = b + np.arange(d) * self.bins
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feats, cuts = [], []
            for level in range(self.depth):
                for k in range(1 << level):
                    rows = np.flatnonzero(node == k + (1 << level) - 1)
                    feat, cut = 0, self.bins
                    if len(rows):
                        at = flat[rows].ravel()
                        sg = np.bincount(at, np.repeat(g[rows], d), d * self.bins).reshape(d, self.bins).cumsum(1)
                        sh = np.bincount(at, np.repeat(h[rows], d), d * self.bins).reshape(d, self.bins).cumsum(1)
                        tg, th = sg[:, -1:], sh[:, -1:]
                        gain = sg**2 / (sh + self.ridge) + (tg - sg) ** 2 / (th - sh + self.ridge) - tg**2 / (th + self.ridge)
                        gain[(sh < self.leaf * 0.1) | (th - sh < self.leaf * 0.1)] = 0
                        best = int(gain.argmax())
                        if gain.flat[best] > 1e-9:
                            feat, cut = divmod(best, self.bins)
                    feats.append(feat)
                    cuts.append(cut)
                    node[rows] = 2 * node[rows] + 1 + (b[rows, feat] > cut)
            leaf = node - (1 << self.depth) + 1
            sg = np.bincount(leaf, g, 1 << self.depth)
            sh = np.bincount(leaf, h, 1 << self.depth)
            value = self.rate * sg / (sh + self.ridge)
            f += value[leaf]
            self.feature.append(feats)
            self.cut.append(cuts)
            self.value.append(value)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)])
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feats, cuts, value in zip(np.array(self.feature), np.array(self.cut), self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feats[node]] > cuts[node])
            f += value[node - (1 << self.depth) + 1]
        return 1 / (1 + np.exp(-f))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of scores
    for s, v in zip(score[order], y[order]):
        blocks.append([v, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: BoostedTrees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    constant: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.zeros(0)
        raw = self.trees.predict(np.array([featurise(parse(t), self.lexicon) for t in texts], float))
        # steps of the calibration keep the order of the trees' scores
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * raw, 0.0, 1.0)


def _family(text: str | None) -> int:
    """The least hash of three words in a row: equal for copies, and mostly for near copies."""
    w = (text or "").split()
    return min((zlib.crc32(" ".join(w[i : i + 3]).encode("utf-8")) for i in range(max(1, len(w) - 2))), default=0)


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """A model from labelled texts; see the module docstring."""
    if len(set(labels)) < 2:
        return Model(Lexicon({}, {}), None, None, float(labels[0]) if labels else 0.0)
    # copies would pass for evidence and leak between folds, so one of each family is used
    family = {(y, _family(t)): i for i, (t, y) in reversed(list(enumerate(zip(texts, labels))))}
    chosen = sorted(family.values())
    y = np.array([labels[i] for i in chosen], float)
    parsed = [parse(texts[i]) for i in chosen]
    for p in parsed:  # one copy of each word
        p.counts = {sys.intern(w): c for w, c in p.counts.items()}
    fold, folds, dealt = np.zeros(len(y), np.int64), min(FOLDS, len(y)), 0
    for v in (0, 1):  # each fold has its share of both labels, and no fold is all there is
        at = np.flatnonzero(y == v)
        fold[np.random.default_rng(11).permutation(at)] = (dealt + np.arange(len(at))) % folds
        dealt += len(at)
    x = np.zeros((len(y), len(FEATURES)))
    for k in range(folds):
        lex = learn_lexicon([p for p, f in zip(parsed, fold) if f != k], y[fold != k])
        for i in np.flatnonzero(fold == k):
            x[i] = featurise(parsed[i], lex)
    out = np.zeros(len(y))
    for k in range(folds):
        out[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k]).predict(x[fold == k])
    return Model(learn_lexicon(parsed, y), BoostedTrees().fit(x, y), isotonic(out, y), float(y.mean()))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; null ids count as text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % HELD_OUT_OF == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Fit on at most ``sample`` labelled ids outside the held-out fifth, on texts of at most ``longest`` characters."""
    known = labels.select(named(labels, id_col).alias("_id"), named(labels, label_col).cast("int").alias("_y"))
    known = known.filter(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # bounded, so it may be broadcast
    texts = docs.select(named(docs, id_col).alias("_id"), named(docs, text_col).alias("t"))
    fitted = texts.join(F.broadcast(chosen), "_id").filter(F.coalesce(F.length("t"), F.lit(0)) <= longest)
    rows = fitted.groupBy("_id", "_y").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: r["_id"])
    return fit([r["t"] for r in rows], [int(r["_y"] > 0) for r in rows])


def with_score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """docs' columns in ``keep`` (all, if None) and the score of each text."""
    spark = docs.sparkSession
    ship(spark)
    names = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField(score_col, T.DoubleType())])
    source = fresh("_text", [*names, score_col])
    bc = spark.sparkContext.broadcast(model)  # lexicon and trees of a bounded sample

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 200):
                part = batch.slice(a, 200)
                score = pa.array(bc.value.score(part.column(source).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], score], names=schema.names)

    return map_in_arrow(docs.select(*[named(docs, c) for c in names], named(docs, text_col).alias(source)), run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """The documents scored under the threshold, with their own columns."""
    score = fresh("_toxicity", docs.columns)
    scored = with_score(docs, train(docs, labels, **kw), score_col=score)
    return scored.filter(F.col(score) < threshold).drop(score)
