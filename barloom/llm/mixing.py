"""Document rates that bring the expected tokens of each domain to target weights.

1. A labelled table trains a classifier on all words and word endings and on the form of texts (repetition,
   capitals, symbols, length); it gives every document a posterior over the domains. Its counts and scores are joins and sums.
2. The expected tokens of domain k are the sum of rate * tokens * posterior_k over all documents.
   Projected gradient descent fits nonnegative rates by least squares against the
   targets. A step needs the residual of each domain, a handful of sums over all documents;
   each rate is a column expression of the residuals so far, stored every few steps.

All of it is DataFrame work; the driver sees sums and weights per domain only.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.sampling import hash_sample
from barloom.session import materialize

ENDING_CHARS = 3
#: Labelled documents that the classifier is fitted on, chosen by a hash of their ids.
FIT_DOCUMENTS = 20_000
#: A feature counts as if so many more documents had it, dealt over the domains as all documents are.
SHRINKAGE = 5.0
#: The chi-square of a feature's counts, per degree of freedom, at which half of its log lift is believed.
HALF_BELIEVED = 12.0
SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space other than a space, runs of small letters, digits and white space, and a word without the symbols around it.
#: Characters named one by one are the quickest to look up.
OTHER_SPACE = "[\t\n\u000b\f\r]"
PLAIN = "[abcdefghijklmnopqrstuvwxyz0123456789 \t\n\u000b\f\r]+"
_SIGNS = "".join(f"\\{x}" for x in SYMBOLS)
_INNER = f"[^ {_SIGNS}]+"
TRIMMED = f"{_INNER}(?:[{_SIGNS}]+{_INNER})*"
#: Marks in front of endings and of features of a text's form; words do not begin with them.
ENDING, FORM = "\u0001", "\u0002"
#: The evidence of words is divided by this power of their number: texts of few words count, noise of long ones does not add up.
LENGTH_POWER = 1.0
#: Penalty on the squared weights of the evidence.
PENALTY = 1e-8
#: Bytes of features that are broadcast; of larger tables Spark chooses how to join.
BROADCAST_BYTES = 256 << 20
MOST_DOMAINS = 100
STEPS = 64
STEPS_PER_TABLE = 8
TOLERANCE = 1e-4
#: A step that moves no domain by more than this share of its target ends the descent: the rates are at their bounds or at rest.
AT_REST = 1e-6

#: The JVM compiles no method beyond this many bytes; Spark then runs a plan without one large method.
METHOD_CONF, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"

log = logging.getLogger(__name__)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` under ``METHOD_CONF``, which is set back afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(METHOD_CONF)
    conf.set(METHOD_CONF, METHOD_BYTES)
    try:
        return materialize(df, name)
    finally:
        conf.set(METHOD_CONF, before)


def _measured(rows: DataFrame) -> DataFrame:
    """Adds to ``text`` its words in lower case and what its form is told by. Each step is a projection of its own, so
    that nothing is evaluated twice.

    What only tells words apart runs on their hashes. Higher-order functions and all below them are interpreted, so
    as little as possible is put there."""
    text, words, hashes, ordered = F.col("text"), F.col("words"), F.col("hashes"), F.col("ordered")
    # Most characters are plain; only the others are looked up by their Unicode class.
    rows = rows.withColumns({"lowered": F.regexp_replace(F.lower(text), OTHER_SPACE, " "), "others": F.regexp_replace(text, PLAIN, "")})
    rows = rows.withColumns(
        {
            "words": F.array_remove(F.split("lowered", " "), ""),
            "capitals": F.length(F.regexp_replace("others", r"[^\p{Lu}]+", "")),
            "symbols": F.length(F.regexp_replace("others", r"[\p{L}\p{N}\s]+", "")),
        }
    )
    rows = rows.withColumn("hashes", F.transform(words, lambda w: F.xxhash64(w)))
    rows = rows.withColumns({"n_tokens": F.size(hashes).cast("bigint"), "given": F.size(F.array_distinct(hashes)), "ordered": F.sort_array(hashes)})
    # In order, equal words are neighbours: the longest run of ones among the marks of "as the next one".
    marks = F.array_join(_with_next(ordered, lambda a, b: F.when(a == b, "1").otherwise("0")), "")
    again = F.size(F.array_remove(_with_next(hashes, lambda a, b: a == b), False))
    return rows.withColumns({"again": again, "most": F.length(F.array_max(F.split(marks, "0+"))) + 1})


def _with_next(items: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine`` of each item and the one after it."""
    pairs = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), pairs), F.slice(items, F.lit(2), pairs), combine)


def _form(told: Callable[[Column], Column]) -> Column:
    """How a text is built: classes of its length and of the shares of words that differ, of the most frequent word,
    of words that repeat the one before, of capitals and of symbols."""
    n, chars = F.col("n_tokens"), F.greatest(F.length("text"), F.lit(1))
    length = F.floor(F.log2(n + F.lit(1.0)) / 2)
    distinct = F.floor(F.col("given") * 20 / n)
    frequent = F.floor(F.log2(n / F.col("most")) * 2)
    repeats = F.ceil(F.sqrt(F.col("again") / n) * 8)
    # like a word, a kind of character is evidence where it occurs
    capitals = F.ceil(F.sqrt(F.col("capitals") / chars) * 12)
    symbols = F.ceil(F.sqrt(F.col("symbols") / chars) * 20)
    named = {"length": [length], "distinct": [length, distinct], "frequent": [length, frequent]}
    named |= {"repeats": [repeats], "capitals": [capitals], "symbols": [symbols]}
    classes = {
        name: told(F.concat(F.lit(FORM + name), *[y for x in parts for y in (F.lit(" "), x.cast("string"))])) for name, parts in named.items()
    }
    always = F.array(*[classes[name] for name in ("length", "distinct", "frequent", "repeats")])
    found = [F.when(F.col(name) > 0, F.array(classes[name])).otherwise(F.array()) for name in ("capitals", "symbols")]
    return F.when(n > 0, F.concat(always, *found)).otherwise(F.array(told(F.lit(f"{FORM}length 0"))))


def _code(feature: Column) -> Column:
    """64 bits that tell a feature."""
    ending = F.xxhash64(F.lit(ENDING), F.substring(feature, 2, ENDING_CHARS))
    return F.when(F.startswith(feature, F.lit(ENDING)), ending).otherwise(F.xxhash64(feature))


def _features(rows: DataFrame, *keys: str, hashed: bool = False) -> DataFrame:
    """(keys, feature): distinct words of a text in lower case without symbols around them, distinct endings behind a mark, and its form.

    ``n_tokens``, the number of words, can be one of the keys. Or (keys, code) with the code of each feature."""
    told, join = (F.xxhash64, F.xxhash64) if hashed else (lambda x: x, F.concat)
    words = F.regexp_extract_all("lowered", F.lit(TRIMMED), F.lit(0))
    words = F.transform(words, lambda w: told(w)) if hashed else words
    endings = F.transform("words", lambda w: join(F.lit(ENDING), F.substring(w, -ENDING_CHARS, ENDING_CHARS)))
    every = F.concat(F.array_distinct(words), F.array_distinct(endings), _form(told))
    # A column before it is exploded, by explode_outer: Spark then compiles the rest, and makes no filter that evaluates it again. No list is empty.
    every = _measured(rows).select(*keys, every.alias("every"))
    return every.select(*keys, F.explode_outer("every").alias("code" if hashed else "feature"))


def _lifts(n: Column, counts: list[Column], priors: list[float]) -> list[Column]:
    """Log lifts of the domains' shares among the documents that have a feature, the less the likelier they are chance."""
    squares = [(c - n * p) * (c - n * p) / (n * p) for c, p in zip(counts, priors)]
    chi = F.when(n > 0, sum(squares[1:], squares[0])).otherwise(0.0)
    belief = chi / (chi + HALF_BELIEVED * max(1, len(priors) - 1))
    return [F.log((c + SHRINKAGE * p) / (n + SHRINKAGE) / p) * belief for c, p in zip(counts, priors)]


def _evidence(told: DataFrame, keys: list[str], lifts: list[Column]) -> DataFrame:
    """(keys, w0 ..., f0 ...): the lifts of the words of a text, scaled for the number of them, and of its form.

    ``told`` has a row per feature of a text, with ``form`` where the feature is known."""
    told = told.select(*keys, F.coalesce("form", F.lit(True)).alias("form"), *[x.alias(f"l{k}") for k, x in enumerate(lifts)])
    sums = [
        F.coalesce(F.sum(F.when(F.col("form") == side, F.col(f"l{k}"))), F.lit(0.0)).alias(f"{name}{k}")
        for name, side in (("w", False), ("f", True))
        for k in range(len(lifts))
    ]
    found = F.count(F.when(~F.col("form"), F.col("l0"))).alias("found")
    scale = F.pow(1 + F.col("found"), -LENGTH_POWER)
    scaled = [(F.col(f"w{k}") * scale).alias(f"w{k}") for k in range(len(lifts))]
    return told.groupBy(*keys).agg(found, *sums).select(*keys, *scaled, *[f"f{k}" for k in range(len(lifts))])


class DomainClassifier:
    """``table`` has every feature of the sample with its code, whether it is of the form, and one log lift per domain.

    ``weights`` and ``biases`` turn the evidence of a text (w0 ..., f0 ...) into the domains' log odds.
    """

    def __init__(self, domains: list[str], priors: list[float], table: DataFrame, weights: list[list[float]], biases: list[float]):
        self.domains, self.priors, self.table, self.weights, self.biases = domains, priors, table, weights, biases
        size = F.sum(F.lit(8 * len(domains) + 72))
        self.small = (table.agg(size).first()[0] or 0) <= BROADCAST_BYTES

    def look_up(self, features: DataFrame) -> DataFrame:
        """Joins by the code; the features themselves are not sent."""
        lifts = self.table.drop("feature")
        return features.join(F.broadcast(lifts) if self.small else lifts, "code", "left")


def fit_domains(labelled: DataFrame, text_col: str = "text", domain_col: str = "domain", id_col: str = "doc_id") -> DomainClassifier:
    """Fits on about ``FIT_DOCUMENTS`` rows of ``labelled`` at most; null texts and domains are left out.

    The log lift of a feature is that of the domain's share among the documents that have it over
    its share among all, drawn towards 0 for rare features and for counts that chance explains. No feature is left out.
    A logistic regression weighs words against form; without evidence it gives the shares among all. It is fitted on evidence without the text's own
    counts, so what it learns holds for other texts. Equal texts of one domain count once, so copies are no evidence.
    """
    rows = labelled.select(
        F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"), F.col(domain_col).cast("string").alias("domain")
    ).where("text is not null and domain is not null")
    sample = hash_sample(rows, FIT_DOCUMENTS, "doc").withColumn("digest", F.md5("text"))
    sample = materialize(sample.dropDuplicates(["digest", "domain"]), "labelled-sample")
    sizes = sample.groupBy("domain").count().orderBy("domain").limit(MOST_DOMAINS + 1).collect()
    if not sizes or len(sizes) > MOST_DOMAINS:
        raise ValueError(f"labelled documents of 1 to {MOST_DOMAINS} domains are needed")
    domains, total = [r.domain for r in sizes], sum(r["count"] for r in sizes)
    ks = range(len(domains))
    priors = [r["count"] / total for r in sizes]
    having = [F.count(F.when(F.col("domain") == d, 1)).alias(f"c{k}") for k, d in enumerate(domains)]
    pairs = _stored(_features(sample, "digest", "domain"), "labelled-features")
    counts = pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *having)
    form = F.startswith("feature", F.lit(FORM)).alias("form")
    counts = materialize(counts.select("feature", _code(F.col("feature")).alias("code"), form, "n", *[f"c{k}" for k in ks]), "feature-counts")
    lifts = _lifts(F.col("n"), [F.col(f"c{k}") for k in ks], priors)
    table = materialize(counts.select("feature", "code", "form", *[x.alias(f"l{k}") for k, x in enumerate(lifts)]), "domain-features")
    model = DomainClassifier(domains, priors, table, [[0.0] * 2 * len(domains)], [0.0])
    if len(domains) == 1:
        return model
    own = counts.drop("feature")
    coded = pairs.select("digest", "domain", _code(F.col("feature")).alias("code"))
    told = coded.join(F.broadcast(own) if model.small else own, "code")
    others = [F.col(f"c{k}") - (F.col("domain") == d).cast("int") for k, d in enumerate(domains)]
    seen = _evidence(told, ["digest", "domain"], _lifts(F.col("n") - 1, others, priors))
    label = F.coalesce(*[F.when(F.col("domain") == d, float(k)) for k, d in enumerate(domains)])
    names = [f"{name}{k}" for name in "wf" for k in ks]
    points = VectorAssembler(inputCols=names, outputCol="features").transform(seen.withColumn("label", label))
    points = _stored(points.select("features", "label"), "evidence")
    model.biases = [math.log(p) for p in priors]
    held = {f"{side}BoundsOnIntercepts": Vectors.dense(model.biases) for side in ("lower", "upper")}
    fitted = LogisticRegression(family="multinomial", regParam=PENALTY, maxIter=200, **held).fit(points)
    model.weights = [[float(x) for x in row] for row in fitted.coefficientMatrix.toArray()]
    return model


def domain_posteriors(docs: DataFrame, model: DomainClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc, n_tokens, p0 ... pk) of every row."""
    ks = range(len(model.domains))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    keys = ["row", "doc", "n_tokens"]
    features = _features(rows, *keys, hashed=True)
    told = _evidence(model.look_up(features), keys, [F.col(f"l{k}") for k in ks])
    names = [f"{name}{k}" for name in "wf" for k in ks]
    logs = [sum((F.col(x) * w for x, w in zip(names, model.weights[k])), F.lit(model.biases[k])).alias(f"s{k}") for k in ks]
    summed = told.select(*keys, *logs)
    top = F.greatest(*[F.col(f"s{k}") for k in ks]) if len(model.domains) > 1 else F.col("s0")
    odds = [F.exp(F.col(f"s{k}") - top) for k in ks]
    total = sum(odds[1:], odds[0])
    return summed.select("row", "doc", "n_tokens", *[(odds[k] / total).alias(f"p{k}") for k in ks])


# --- rates -------------------------------------------------------------------------------------
def _sums(mass: DataFrame, rate: Column, size: int) -> list[float]:
    row = mass.agg(*[F.sum(rate * F.col("n_tokens") * F.col(f"p{k}")) for k in range(size)]).first()
    return [x or 0.0 for x in row]


def _largest_eigenvalue(m: list[list[float]]) -> float:
    v = [1.0 + 0.01 * i for i in range(len(m))]
    size = 0.0
    for _ in range(200):
        w = [sum(a * b for a, b in zip(row, v)) for row in m]
        size = math.sqrt(sum(x * x for x in w))
        if size == 0:
            return 0.0
        v = [x / size for x in w]
    return size


def fit_rates(
    mass: DataFrame, targets: list[float], start: float = 1.0, most: float | None = None, steps: int = STEPS
) -> tuple[DataFrame, list[float]]:
    """Adds ``rate`` to (n_tokens, p0 ... pk) and gives the expected tokens that the rates reach.

    Least squares of the relative residuals, each scaled by the domain's mass, under
    0 <= rate (<= ``most``). Gradients are taken per token, which is a gradient step in
    rate * sqrt(tokens). Ends when all targets are met within ``TOLERANCE``, when the sums come to rest or after ``steps``.
    """
    ks = range(len(targets))
    second = [F.sum(F.col("n_tokens") * F.col(f"p{a}") * F.col(f"p{b}")) for a in ks for b in ks]
    flat = [x or 0.0 for x in mass.agg(*second).first()]
    gram = [flat[a * len(targets) : (a + 1) * len(targets)] for a in ks]
    weight = [1 / gram[k][k] if gram[k][k] > 0 else 0.0 for k in ks]
    scaled = [[math.sqrt(weight[a] * weight[b]) * gram[a][b] for b in ks] for a in ks]
    top = _largest_eigenvalue(scaled)
    step = 1 / top if top else 0.0

    state, rate = mass.withColumn("rate", F.lit(float(start))), F.col("rate")
    reached = _sums(state, rate, len(targets))
    for i in range(1, steps + 1):
        off = [r - t for r, t in zip(reached, targets)]
        if all(abs(o) <= TOLERANCE * max(t, 1.0) for o, t in zip(off, targets)):
            break
        move = sum((F.col(f"p{k}") * (step * weight[k] * off[k]) for k in ks[1:]), F.col("p0") * (step * weight[0] * off[0]))
        rate = F.greatest(rate - move, F.lit(0.0))
        rate = F.least(rate, F.lit(float(most))) if most is not None else rate
        if i % STEPS_PER_TABLE == 0:
            state, rate = materialize(state.withColumn("rate", rate), "rates"), F.col("rate")
        before, reached = reached, _sums(state, rate, len(targets))
        if all(abs(r - b) <= AT_REST * max(t, 1.0) for r, b, t in zip(reached, before, targets)):
            break
    return state.withColumn("rate", rate), reached


def mix_documents(
    docs: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float],
    budget: float | None = None,
    anchor: tuple[str, float] | None = None,
    most: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(``id_col``, n_tokens, p_<domain> ..., rate, copies) of every row.

    ``labelled`` has (``id_col``, ``text_col``, domain). ``weights`` are the target shares of the domains' expected
    tokens; domains without one have target 0. The total is ``budget`` tokens, or so many that ``anchor``
    = (domain, factor) has factor times the tokens it has now, or else what there is. ``copies`` rounds the rate up
    or down by a hash of the id, so that its expectation is the rate. Null and empty texts have no tokens, the
    posteriors of a text of length 0 and a rate like others. What the rates reach is logged next to the targets. Rows without an id and repeated rows are rows of their own.
    An empty table gives an empty result; other columns are ignored.
    """
    total_weight = sum(weights.values())
    if not weights or min(weights.values()) < 0 or total_weight <= 0:
        raise ValueError("target weights are nonnegative and not all zero")
    model = fit_domains(labelled, text_col=text_col, id_col=id_col)
    unknown = set(weights) - set(model.domains)
    if unknown:
        raise ValueError(f"no labelled document is of {sorted(unknown)}")
    mass = _stored(domain_posteriors(docs, model, id_col, text_col), "posteriors")
    available = _sums(mass, F.lit(1.0), len(model.domains))
    shares = [weights.get(d, 0.0) / total_weight for d in model.domains]
    if budget is None and anchor is not None:
        at = model.domains.index(anchor[0])
        budget = anchor[1] * available[at] / shares[at]
    budget = sum(available) if budget is None else float(budget)
    start = min(budget / sum(available), most or math.inf) if sum(available) else 1.0
    targets = [s * budget for s in shares]
    fitted, reached = fit_rates(mass, targets, start, most)
    for domain, r, t in zip(model.domains, reached, targets):
        level = logging.INFO if abs(r - t) <= TOLERANCE * max(t, 1.0) else logging.WARNING
        log.log(level, "domain %s: expected tokens %.6g, target %.6g", domain, r, t)
    chance = F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) / float(1 << 30)
    return fitted.select(
        F.col("doc").alias(id_col),
        "n_tokens",
        *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(model.domains)],
        "rate",
        F.floor(F.col("rate") + chance).cast("bigint").alias("copies"),
    )


def apply_copies(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as its copies say; rows without an id stay once."""
    times = mixed.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_mixed")).agg(F.max("copies").alias("_copies"))
    joined = docs.join(times, docs[id_col] == times["_mixed"], "left")
    each = max(docs.columns, key=len) + "_"  # a name that docs has not
    repeated = F.explode(F.array_repeat(F.lit(0), F.coalesce(times["_copies"], F.lit(1)).cast("int"))).alias(each)
    return joined.select(*[docs[c] for c in docs.columns], repeated).drop(each)
