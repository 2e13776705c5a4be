"""Ranking facts for questions: token overlap, TF-IDF cosine, and their mean.

Every token counts once, so a fact's vector is the idf of its distinct tokens.
Nothing is scored that cannot matter. Documents fall into blocks by size, so a
(token, block) has a bound on the score of any document whose rarest token in
common with the question it is. A few documents of the most promising blocks
are scored first; their k-th best score, or the expected document's own, is the
score to reach, and only blocks whose bound reaches it are read. What their
documents share is summed map-side, bounded again by each document's own size
and norm, and only what is left meets its document to be scored exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.functions import text
from attestra.session import cut_lineage, small_side

MODES = ("lexical", "vector", "hybrid")
BROADCAST_TOKENS = 400_000
#: Blocks of a question from which documents are scored first.
SEED_BLOCKS = 24
_ROOM = 1e-9  # what rounding may take from a bound
_DIGITS = 12  # scores are compared after rounding, so summation order cannot reorder ties


def prepared(rows: DataFrame, identifier: str, content: str, subject: Sequence[str] = ()) -> DataFrame:
    """(id, subject columns, distinct tokens)."""
    return rows.select(F.col(identifier).alias("id"), *subject, text.tokens(F.col(content)).alias("tokens"))


def index(documents: DataFrame) -> DataFrame:
    """The prepared corpus, spread by document and written once to the shared folder.

    Every score reads the tokens several times; tokenising text again each time
    would cost more than one write.
    """
    return cut_lineage(documents.repartition("id"))


def idf(documents: DataFrame) -> DataFrame:
    """Document frequency and idf = ln((1 + N) / (1 + df)) + 1 per token."""
    total = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    frequency = documents.select(F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("document_frequency")
    )
    weight = F.log((F.lit(1) + total) / (F.lit(1) + F.col("document_frequency"))) + 1
    return frequency.select("token", "document_frequency", weight.alias("idf"))


def token_weights(documents: DataFrame) -> DataFrame:
    """Squared idf per token, broadcast when the vocabulary was counted to be small."""
    return small_side(idf(documents).select("token", (F.col("idf") * F.col("idf")).alias("w")), BROADCAST_TOKENS)


def _bucket(size: Column) -> Column:
    """Half octaves of a document's token count: at most some sixty blocks, whatever the corpus."""
    return F.floor(2 * F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def norms(documents: DataFrame, weights: DataFrame) -> DataFrame:
    """``id, d_size, d_norm2, bucket`` of every document with tokens, written once."""
    each = documents.select("id", F.explode("tokens").alias("token")).join(weights, "token")
    summed = each.groupBy("id").agg(F.count(F.lit(1)).alias("d_size"), F.sum("w").alias("d_norm2"))
    return cut_lineage(summed.withColumn("bucket", _bucket(F.col("d_size"))))


def terms(questions: DataFrame, weights: DataFrame, subject: Sequence[str] = ()) -> DataFrame:
    """A question's tokens that the corpus has, rarest first, with what it and the tokens behind it can give: ``c`` tokens of weight ``cw``."""
    asked = questions.select(F.col("id").alias("question_id"), *subject, F.explode("tokens").alias("token")).join(weights, "token", "left")
    whole = Window.partitionBy("question_id")
    behind = whole.orderBy(F.col("w").desc_nulls_last(), "token").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sized = asked.select(
        "*", F.count(F.lit(1)).over(whole).alias("q_size"), F.sum(F.coalesce("w", F.lit(1.0))).over(whole).alias("q_norm2"),
        F.count("w").over(behind).alias("c"), F.sum("w").over(behind).alias("cw"),
    )
    return small_side(sized.filter("w IS NOT NULL"), BROADCAST_TOKENS)


def _scores(shared: Column, dot: Column, size: Column, norm2: Column) -> dict[str, Column]:
    lexical = shared / (size + F.col("q_size") - shared)
    vector = dot / (F.sqrt("q_norm2") * F.sqrt(norm2))
    return {"lexical": lexical, "vector": vector, "hybrid": 0.5 * lexical + 0.5 * vector}


def _postings(documents: DataFrame, subject: Sequence[str]) -> DataFrame:
    return documents.select("id", *subject, F.explode("tokens").alias("token"), _bucket(F.size("tokens")).alias("bucket"))


def blocks(documents: DataFrame, measured: DataFrame, asked: DataFrame, subject: Sequence[str] = ()) -> DataFrame:
    """Every (question, token) by block of documents that hold the token, with their count ``held`` and the bound ``most_<mode>`` of each score.

    A document of the block whose rarest shared token this is shares at most
    the tokens from here on, and no more than the block's largest size and norm.
    It has at least the block's least size and norm, and at least those of what
    it shares.
    """
    ends = [f(c).alias(f"{end}_{name}") for end, f in (("least", F.min), ("most", F.max)) for name, c in (("size", "d_size"), ("norm2", "d_norm2"))]
    every = measured.groupBy("bucket").agg(*ends).agg(F.collect_list(F.struct("bucket", "least_size", "least_norm2", "most_size", "most_norm2")).alias("all")).scalar()
    met = asked.withColumn("_b", F.explode(every)).select(*asked.columns, "_b.*")
    shared, dot = F.least("c", "most_size"), F.least("cw", "most_norm2")
    most = _scores(shared, dot, F.greatest("least_size", shared), F.greatest("least_norm2", dot))
    bounded = met.select("*", *[column.alias(f"most_{mode}") for mode, column in most.items()])
    keys = ["token", *subject]
    wanted = small_side(asked.select(*keys).distinct(), BROADCAST_TOKENS)
    held = _postings(documents, subject).join(wanted, keys, "left_semi").groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("held"))
    return cut_lineage(bounded.join(held, [*keys, "bucket"]))


def _reaches(bounds: dict[str, Column], least: dict[str, Column]) -> Column:
    """Can a score bounded so reach the least one, in any mode asked for? Rounding is left room."""
    able = F.lit(False)
    for mode, column in least.items():
        able = able | (bounds[mode] + _ROOM >= column)
    return able


def candidates(documents: DataFrame, measured: DataFrame, bounded: DataFrame, least: DataFrame, modes: Sequence[str], subject: Sequence[str] = ()) -> DataFrame:
    """``question_id, id`` of every pair sharing a token whose score can reach ``least`` (question_id and ``least_<mode>``; none counts as 0) in some mode."""
    wanted = {m: F.coalesce(f"least_{m}", F.lit(0.0)) for m in modes}
    judged = bounded.join(least, "question_id", "left").withColumn("_read", _reaches({m: F.col(f"most_{m}") for m in modes}, wanted))
    judged = small_side(judged, BROADCAST_TOKENS)
    # bounds fall along a question's tokens, so those not read are its last ones
    # and tokens whose block holds no document give nothing
    rest = small_side(judged.groupBy("question_id", "bucket").agg(
        F.max(F.when(~F.col("_read"), F.col("c"))).alias("_c"), F.max(F.when(~F.col("_read"), F.col("cw"))).alias("_cw"),
        *[F.first(c).alias(c) for c in ("q_size", "q_norm2", *(f"least_{m}" for m in modes))]), BROADCAST_TOKENS)
    read = judged.filter("_read").select("question_id", *subject, "token", "bucket", "w")
    met = _postings(documents, subject).join(read, ["token", "bucket", *subject]).groupBy("id", "question_id").agg(F.count(F.lit(1)).alias("_shared"), F.sum("w").alias("_dot"))
    known = met.join(measured, "id").join(rest, ["question_id", "bucket"])
    shared = F.least(F.col("_shared") + F.coalesce("_c", F.lit(0)), F.col("d_size"))
    dot = F.least(F.col("_dot") + F.coalesce("_cw", F.lit(0.0)), F.col("d_norm2"))
    return known.filter(_reaches(_scores(shared, dot, F.col("d_size"), F.col("d_norm2")), wanted)).select("question_id", "id")


def exact_scores(pairs: DataFrame, documents: DataFrame, measured: DataFrame, asked: DataFrame) -> DataFrame:
    """The scores of all modes of (question_id, id) pairs, from the document's own tokens."""
    weighed = small_side(asked.groupBy("question_id").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("_w"), F.first("q_size").alias("q_size"), F.first("q_norm2").alias("q_norm2")))
    met = pairs.join(documents.select("id", "tokens"), "id").join(measured, "id").join(weighed, "question_id")
    both = met.withColumn("_both", F.array_intersect("tokens", F.map_keys("_w")))
    dot = F.aggregate("_both", F.lit(0.0), lambda total, token: total + F.element_at("_w", token))
    made = _scores(F.size("_both"), dot, F.col("d_size"), F.col("d_norm2"))
    return both.filter(F.size("_both") > 0).select(
        "question_id", F.col("id").alias("document_id"), *[F.round(column, _DIGITS).alias(mode) for mode, column in made.items()])


def _score_to_reach(documents: DataFrame, measured: DataFrame, asked: DataFrame, bounded: DataFrame, mode: str, limit: int, subject: Sequence[str]) -> DataFrame:
    """Per question the ``limit``-th best score of some documents; none where there are fewer.

    They come from its most promising blocks, some hundreds at most of each, and
    those with the most in common so far are scored. Any documents would do: a
    better choice only raises the score to reach.
    """
    best = Window.partitionBy("question_id").orderBy(F.col(f"most_{mode}").desc(), F.col("c").desc(), "bucket")
    chosen = bounded.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= SEED_BLOCKS)
    every = F.greatest(F.lit(1), F.floor(F.col("held") / (100 * limit))).cast("long")
    chosen = small_side(chosen.select("question_id", *subject, "token", "bucket", "w", every.alias("_every")), BROADCAST_TOKENS)
    some = _postings(documents, subject).join(chosen, ["token", "bucket", *subject]).filter(F.pmod(F.xxhash64("id"), F.col("_every")) == 0)
    shared = some.groupBy("question_id", "id").agg(F.sum("w").alias("_dot"))
    most = Window.partitionBy("question_id").orderBy(F.col("_dot").desc(), "id")
    seeds = small_side(shared.withColumn("_n", F.row_number().over(most)).filter(F.col("_n") <= 8 * limit).select("question_id", "id"), BROADCAST_TOKENS)
    scored = _first(exact_scores(seeds, documents, measured, asked).select("question_id", "document_id", F.col(mode).alias("score")), ["question_id"], limit)
    return small_side(scored.filter(F.col("rank") == limit).select("question_id", F.col("score").alias(f"least_{mode}")))


def rank(
    documents: DataFrame, questions: DataFrame, mode: str, limit: int, subject: Sequence[str] = ()
) -> DataFrame:
    """Top documents per question by score, then id; short lists are filled with zero scores."""
    if mode not in MODES:
        raise ValueError(f"unknown retrieval mode: {mode}")
    keys = list(subject)
    documents = index(documents)
    weights = token_weights(documents)
    measured, asked = norms(documents, weights), terms(questions, weights, keys)
    bounded = blocks(documents, measured, asked, keys)
    least = _score_to_reach(documents, measured, asked, bounded, mode, limit, keys)
    pairs = candidates(documents, measured, bounded, least, [mode], keys)
    scored = exact_scores(pairs, documents, measured, asked).select("question_id", "document_id", F.col(mode).alias("score"))
    best = cut_lineage(_first(scored, ["question_id"], limit))
    filler = _zero_scores(documents, questions, best, limit, keys)
    return _first(best.select("question_id", "document_id", "score").unionByName(filler), ["question_id"], limit)


def _first(scored: DataFrame, keys: list[str], limit: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("document_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def _zero_scores(documents: DataFrame, questions: DataFrame, best: DataFrame, limit: int, subject: list[str]) -> DataFrame:
    """Zero-scored candidates for questions with fewer than ``limit`` matches.

    Such a question has matched fewer than ``limit`` documents, so the first
    ``2 * limit`` ids of its subject always hold enough unmatched ones.
    """
    found = best.groupBy("question_id").agg(F.count(F.lit(1)).alias("_found"))
    short = (
        questions.select(F.col("id").alias("question_id"), *subject).join(found, "question_id", "left")
        .filter(F.coalesce("_found", F.lit(0)) < limit)
    )
    if subject:
        order = Window.partitionBy(*subject).orderBy("id")
        heads = documents.select("id", *subject, F.row_number().over(order).alias("_n")).filter(F.col("_n") <= 2 * limit)
        candidates = short.join(heads, subject).select("question_id", F.col("id").alias("document_id"))
    else:
        heads = documents.select("id").orderBy("id").limit(2 * limit).agg(F.collect_list("id").alias("ids")).scalar()
        candidates = short.select("question_id", F.explode(heads).alias("document_id"))
    return candidates.join(best, ["question_id", "document_id"], "left_anti").withColumn("score", F.lit(0.0))


def expected_ranks(documents: DataFrame, cases: DataFrame, subject: Sequence[str]) -> DataFrame:
    """Per case and mode: the expected document's rank among its subject's candidates.

    ``cases`` holds id, subject columns, tokens, expected_id. The rank is one
    plus the candidates that beat the expected one, so nothing is sorted, and
    only documents that can reach the expected one's score are looked at. A
    missing expected document has a NULL rank.
    """
    subject = list(subject)
    documents = index(documents)
    weights = token_weights(documents)
    measured, asked = norms(documents, weights), terms(cases, weights, subject)
    targets = small_side(cases.select(F.col("id").alias("question_id"), *subject, "expected_id"))
    population = documents.select("id", *subject).join(targets, subject).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_if(F.col("id") < F.col("expected_id")).alias("_ids_before"),
        F.max(F.col("id") == F.col("expected_id")).alias("_present"),
    )
    answers = documents.join(targets.select(*subject, F.col("expected_id").alias("id"), "question_id"), ["id", *subject]).select("question_id", "id")
    least = small_side(exact_scores(answers, documents, measured, asked).select("question_id", *[F.col(m).alias(f"least_{m}") for m in MODES]))
    pairs = candidates(documents, measured, blocks(documents, measured, asked, subject), least, MODES, subject)
    marks = targets.select("question_id", "expected_id").join(least, "question_id", "left")
    compared = exact_scores(pairs, documents, measured, asked).join(small_side(marks), "question_id")
    beats = lambda m: (F.col(m) > F.coalesce(f"least_{m}", F.lit(0.0))) | (
        (F.col(m) == F.coalesce(f"least_{m}", F.lit(0.0))) & (F.col("document_id") < F.col("expected_id"))
    )
    counted = compared.groupBy("question_id").agg(
        *[F.count_if(beats(m)).alias(f"_better_{m}") for m in MODES],
        F.count_if(F.col("document_id") < F.col("expected_id")).alias("_matched_before"),
        F.max(F.coalesce("least_lexical", F.lit(0.0))).alias("_lexical"),
    )
    joined = cases.select(F.col("id").alias("question_id")).join(population, "question_id", "left").join(counted, "question_id", "left")
    unmatched = F.coalesce("_lexical", F.lit(0.0)) == 0
    # an expected document that shares nothing is beaten by all that share something; for it every such pair is a candidate
    zeros_before = F.when(unmatched, F.coalesce("_ids_before", F.lit(0)) - F.coalesce("_matched_before", F.lit(0))).otherwise(F.lit(0))
    ranks = F.array(*[
        F.struct(
            F.lit(m).alias("mode"),
            F.when(F.coalesce("_present", F.lit(False)), 1 + F.coalesce(f"_better_{m}", F.lit(0)) + zeros_before).alias("rank"),
        )
        for m in MODES
    ])
    return joined.select("question_id", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.inline(ranks))


def metrics(ranks: DataFrame) -> DataFrame:
    """Top-1 accuracy, recall at three, mean reciprocal rank and single-candidate count per mode."""
    share = lambda condition: F.avg(F.coalesce(condition, F.lit(False)).cast("double"))
    return ranks.groupBy("mode").agg(
        F.count(F.lit(1)).alias("query_count"),
        share(F.col("rank") == 1).alias("top1_accuracy"), share(F.col("rank") <= 3).alias("recall_at_3"),
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mean_reciprocal_rank"),
        F.count_if(F.col("candidate_count") == 1).alias("single_candidate_count"),
    )


def decision(mode_metrics: DataFrame, minimum_gain: float) -> DataFrame:
    """Is the best alternative's top-1 gain over token overlap material?"""
    of = lambda m: F.max(F.when(F.col("mode") == m, F.col("top1_accuracy")))
    gain = F.greatest(of("vector"), of("hybrid")) - of("lexical")
    return mode_metrics.agg(
        gain.alias("best_alternative_top1_gain"),
        F.when(gain >= minimum_gain, "EVALUATE_VECTOR_FOR_PRODUCTION")
        .otherwise("RETAIN_LEXICAL_NO_EXTERNAL_VECTOR_INFRASTRUCTURE").alias("decision"),
    )


def label_leakage(question: Column, labels: Sequence[Column]) -> Column:
    """Does a question name its own expected id or subject?"""
    leaks = F.lit(False)
    for label in labels:
        leaks = leaks | F.contains(F.lower(question), F.lower(label.cast("string")))
    return leaks
