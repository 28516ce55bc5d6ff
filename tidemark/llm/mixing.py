"""Mixing documents to target weights by iterative proportional fitting.

Every document has a weight in tokens (runs of characters other than white space)
and belongs to a cell: source, language, topic. The token weights of the cells are
raked to the target shares of the three marginals, turn by turn, until all of them
hold. A cell's weight is its tokens times a factor of its source, one of its language
and one of its topic; their product times the token budget is the number of copies that
its documents are expected to have. A document's hash decides about the fraction, so a
run is repeatable and no exchange is needed to sample.

Sources may be as many as there are documents: the cells are a table of one row a
source (its cells by language and topic), a round is one aggregate over it, and the
driver sees the sums by language and topic only, the two closed vocabularies. Factors
of sources are a table that is joined back; no level is left out or put together with
others.

Targets that are not given follow the observed shares to the power ``temperature``
(below 1: large sources shrink, small ones grow). A fit whose marginals miss their
targets by more than ``tolerance`` after ``rounds`` rounds (targets that contradict the
cells) warns; sources then meet theirs and the others come as near as the rounds went.

A null source or language is the level ``(none)``. Null and empty texts have no
tokens: they have probability 0 and no copies. Levels without tokens are left out of the
fit and the other targets are scaled to 1; so are levels that given targets do not name,
which get 0. Repeated rows are drawn alike; very long texts are counted whole; an empty
table gives no rows. ``mix`` names its own columns and carries no others; ``sample`` returns
the documents' own columns, whatever their names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, text_or_empty

NONE = "(none)"


def share_of(text: Column, characters: str) -> Column:
    """Share of a text's characters that are among ``characters``."""
    n = F.length(text)
    return (n - F.length(F.translate(text, characters, ""))) / F.greatest(n, F.lit(1))


def form_of(text: Column) -> Column:
    """A coarse topic from the form of the text alone."""
    return (
        F.when(share_of(text, "|\t") >= 0.02, "list")
        .when(share_of(text, "%$#*&<>{}[]=") >= 0.05, "markup")
        .when(share_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") >= 0.3, "capitals")
        .when(share_of(text, "0123456789") >= 0.05, "figures")
        .otherwise("prose")
    )


def tempered(observed: dict[str, float], temperature: float) -> dict[str, float]:
    """Observed shares to a power, scaled to 1."""
    powered = {k: v**temperature for k, v in observed.items() if v > 0}
    whole = sum(powered.values())
    return {k: v / whole for k, v in powered.items()}


def scaled(target: dict[str, float], levels: set[str]) -> dict[str, float]:
    """A target over the levels that occur, scaled to 1; without any of them, nothing is asked."""
    known = {x: target.get(x, 0.0) for x in levels}
    whole = sum(known.values())
    return {x: v / whole for x, v in known.items()} if whole else {}


def source_table(rows: DataFrame, targets: dict[str, float] | None, temperature: float) -> DataFrame:
    """(source, tokens, target, cells) of every source with tokens; ``cells``: array of (lang, topic, n).

    ``target`` is not scaled: its sum over all sources stands for 1.
    """
    spark = rows.sparkSession
    cells = rows.where("n_tokens > 0").groupBy("source", "lang", "topic").agg(F.sum("n_tokens").cast("double").alias("n"))
    # At most languages x topics entries a source.
    sources = cells.groupBy("source").agg(F.sum("n").alias("tokens"), F.sort_array(F.collect_list(F.struct("lang", "topic", "n"))).alias("cells"))
    if targets is None:
        return sources.withColumn("target", F.pow("tokens", F.lit(temperature)))
    given = spark.createDataFrame(sorted(targets.items()), "source string, target double")
    return sources.join(given, "source", "left").withColumn("target", F.coalesce("target", F.lit(0.0)))


def looked_up(factors: dict, key: Column) -> Column:
    """A factor of a small closed vocabulary."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(factors.items()) for x in pair]), key), F.lit(0.0)) if factors else F.lit(1.0)


def source_factor(whole: float, factors: tuple[dict, dict]) -> Column:
    """The factor that brings a source to its target, given those of languages and topics."""
    reached = F.aggregate("cells", F.lit(0.0), lambda total, c: total + c["n"] * looked_up(factors[0], c["lang"]) * looked_up(factors[1], c["topic"]))
    return F.coalesce(F.try_divide(F.col("target") / F.lit(whole), F.nullif(reached, F.lit(0.0))), F.lit(0.0))


def rake(sources: DataFrame, targets: tuple[dict[str, float] | None, dict[str, float] | None], temperature: tuple[float, float], rounds: int = 40, tolerance: float = 1e-7) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
    """(source, factor), the factors of languages and those of topics; tokens times all three are shares that sum to 1."""
    whole = sources.agg(F.sum("target")).first()[0]
    if not whole:
        return sources.select("source", F.lit(0.0).alias("factor")), {}, {}
    by_pair = {(r[0], r[1]): r[2] for r in sources.select(F.explode("cells").alias("c")).groupBy("c.lang", "c.topic").agg(F.sum("c.n")).collect()}
    goals, factors = [], []
    for axis in (0, 1):
        observed: dict[str, float] = {}
        for pair, n in by_pair.items():
            observed[pair[axis]] = observed.get(pair[axis], 0.0) + n
        goals.append(scaled(targets[axis] if targets[axis] is not None else tempered(observed, temperature[axis]), set(observed)))
        factors.append(dict.fromkeys(observed, 1.0))
    for _ in range(rounds):
        raked = sources.select(source_factor(whole, tuple(factors)).alias("f"), F.explode("cells").alias("c"))
        held = raked.groupBy("c.lang", "c.topic").agg(F.sum(F.col("f") * F.col("c.n")).alias("n")).collect()
        # Sources hold now; how far are the other two, and what brings them there?
        sums = {(r["lang"], r["topic"]): r["n"] * factors[0][r["lang"]] * factors[1][r["topic"]] for r in held}
        worst = 0.0
        for axis in (0, 1):
            level_sums = dict.fromkeys(factors[axis], 0.0)
            for pair, n in sums.items():
                level_sums[pair[axis]] += n
            change = {x: goals[axis][x] / n if n else 0.0 for x, n in level_sums.items()} if goals[axis] else dict.fromkeys(level_sums, 1.0)
            worst = max([worst, *(abs(n - goals[axis][x]) for x, n in level_sums.items() if goals[axis])])
            factors[axis] = {x: f * change[x] for x, f in factors[axis].items()}
            sums = {pair: n * change[pair[axis]] for pair, n in sums.items()}
        if worst < tolerance:
            break
    else:
        warnings.warn(f"raking is {worst:.2g} away from its targets after {rounds} rounds", stacklevel=2)
    return sources.select("source", source_factor(whole, tuple(factors)).alias("factor")), factors[0], factors[1]


def with_probability(
    rows: DataFrame, slim: DataFrame, targets: tuple[dict[str, float] | None, dict[str, float] | None, dict[str, float] | None], temperature: tuple[float, float, float], budget: float
) -> DataFrame:
    """``rows`` with ``probability``: the expected copies of each; ``slim`` has the columns source, lang, topic and n_tokens of the same rows."""
    sources = materialize(source_table(slim, targets[0], temperature[0]))
    factors, langs, topics = rake(sources, targets[1:], temperature[1:])
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0.0))).first()[0]
    # Sources may be many: Spark broadcasts the factors where they are small and splits a hot source where not.
    joined = rows.join(materialize(factors), "source", "left")
    product = F.col("factor") * looked_up(langs, F.col("lang")) * looked_up(topics, F.col("topic"))
    return joined.withColumn("probability", F.when(F.col("n_tokens") > 0, F.coalesce(product * (budget * total), F.lit(0.0))).otherwise(0.0)).drop("factor")


def level(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(NONE))


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def copies(seed: int) -> Column:
    """The copies of a row: its probability rounded up or down by a hash of its id."""
    p = F.col("probability")
    draw = F.xxhash64("doc_id", F.lit(seed)).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))
    return (F.floor(p) + (draw < p - F.floor(p)).cast("long")).cast("int")


def described(docs: DataFrame, topic: Column | None) -> list[Column]:
    text = text_or_empty("text")
    return [F.col("doc_id"), level("source").alias("source"), level("lang").alias("lang"), (form_of(text) if topic is None else topic).alias("topic"), tokens(text).alias("n_tokens")]


def mix(
    docs: DataFrame,
    source_targets: dict[str, float] | None = None,
    lang_targets: dict[str, float] | None = None,
    topic_targets: dict[str, float] | None = None,
    temperature: tuple[float, float, float] = (0.7, 0.8, 0.9),
    budget: float = 0.8,
    topic: Column | None = None,
    seed: int = 11,
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and copies of every document.

    ``budget``: tokens to draw, as a share of all tokens. ``probability`` is the
    expected number of copies; above 1 a document is repeated.
    """
    rows = materialize(docs.select(*described(docs, topic)))
    met = with_probability(rows, rows, (source_targets, lang_targets, topic_targets), temperature, budget)
    return met.withColumn("copies", copies(seed)).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "copies")


def sample(
    docs: DataFrame,
    source_targets: dict[str, float] | None = None,
    lang_targets: dict[str, float] | None = None,
    topic_targets: dict[str, float] | None = None,
    temperature: tuple[float, float, float] = (0.7, 0.8, 0.9),
    budget: float = 1.0,
    topic: Column | None = None,
    seed: int = 11,
) -> DataFrame:
    """The documents with their own columns, each as often as it is drawn: not at all, once, or repeated.

    Texts are read once for what the fit needs of them, and written beside it, so that
    the draw reads numbers where it drops a document.
    """
    # The documents' own columns stay together, whatever their names.
    held = materialize(docs.select(F.struct(*docs.columns).alias("document"), *described(docs, topic)))
    met = with_probability(held, held, (source_targets, lang_targets, topic_targets), temperature, budget)
    drawn = met.withColumn("copies", copies(seed)).where("copies > 0")
    return drawn.select("document", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("document.*")
