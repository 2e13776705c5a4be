from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from attestra.operators import evaluation, retrieval

RNG = random.Random(3)
WORDS = [f"w{i}" for i in range(40)]
CORPUS = {i: " ".join(RNG.choices(WORDS, k=RNG.randint(0, 12))) for i in range(60)}
QUESTIONS = {0: "w1 w2 w3 unseen", 1: "nothing matches here", 2: CORPUS[7], 3: ""}
SUBJECT = {i: "hot" if i % 3 else "cold" for i in CORPUS}


def tokens(text):
    return set(re.findall("[a-z0-9]+", text.lower()))


def brute_force(mode):
    n = len(CORPUS)
    bags = {i: tokens(t) for i, t in CORPUS.items()}
    df = {}
    for bag in bags.values():
        for token in bag:
            df[token] = df.get(token, 0) + 1
    weight = lambda token: math.log((1 + n) / (1 + df[token])) + 1 if token in df else 1.0
    norm = lambda bag: math.sqrt(sum(weight(x) ** 2 for x in bag))
    out = {}
    for q, text in QUESTIONS.items():
        asked = tokens(text)
        for i, bag in bags.items():
            lexical = len(asked & bag) / max(1, len(asked | bag))
            size = norm(asked) * norm(bag)
            vector = sum(weight(x) ** 2 for x in asked & bag) / size if size else 0.0
            out[q, i] = {"lexical": lexical, "vector": vector, "hybrid": 0.5 * lexical + 0.5 * vector}[mode]
    return out


def prepared(spark, rows, *extra):
    return retrieval.prepared(spark.createDataFrame(rows, "i long, t string, s string"), "i", "t", extra)


def corpus(spark, *extra):
    return prepared(spark, [(i, t, SUBJECT[i]) for i, t in CORPUS.items()], *extra)


@pytest.mark.parametrize("mode", retrieval.MODES)
@pytest.mark.parametrize("limit", [3, 50])
def test_rank_equals_brute_force_with_zero_fill(spark, mode, limit):
    scores = brute_force(mode)
    asked = prepared(spark, [(q, t, "") for q, t in QUESTIONS.items()])
    got = {}
    for r in retrieval.rank(corpus(spark), asked, mode, limit).collect():
        got.setdefault(r.question_id, {})[r.rank] = (r.document_id, r.score)
    for q in QUESTIONS:
        wanted = sorted(((i, s) for (x, i), s in scores.items() if x == q), key=lambda p: (-round(p[1], 12), p[0]))[:limit]
        assert [got[q][k + 1][0] for k in range(len(wanted))] == [i for i, _ in wanted]
        assert [got[q][k + 1][1] for k in range(len(wanted))] == pytest.approx([s for _, s in wanted], abs=1e-11)


def test_expected_ranks_equal_brute_force(spark):
    cases = [(q, t, SUBJECT[e], e) for (q, t), e in zip(QUESTIONS.items(), (5, 8, 7, 20))] + [(9, "w1", "cold", 999)]
    asked = retrieval.prepared(spark.createDataFrame(cases, "i long, t string, s string, expected_id long"), "i", "t", ["s", "expected_id"])
    got = {(r.question_id, r.mode): r for r in retrieval.expected_ranks(corpus(spark, "s"), asked, ["s"]).collect()}
    for mode in retrieval.MODES:
        scores = brute_force(mode)
        for q, _, subject, expected in cases[:-1]:
            ids = [i for i in CORPUS if SUBJECT[i] == subject]
            order = sorted(ids, key=lambda i: (-round(scores[q, i], 12), i))
            assert got[q, mode].rank == order.index(expected) + 1 and got[q, mode].candidate_count == len(ids)
        assert got[9, mode].rank is None


def test_metrics_and_decision(spark):
    rows = [("lexical", 1, 2), ("lexical", 4, 2), ("vector", 1, 2), ("vector", 1, 1), ("hybrid", 2, 2), ("hybrid", None, 2)]
    ranks = spark.createDataFrame(rows, "mode string, rank long, candidate_count long")
    got = {r.mode: r for r in retrieval.metrics(ranks).collect()}
    assert (got["lexical"].top1_accuracy, got["lexical"].recall_at_3, got["lexical"].mean_reciprocal_rank) == (0.5, 0.5, 0.625)
    assert got["vector"].single_candidate_count == 1 and got["hybrid"].mean_reciprocal_rank == 0.25
    decision = retrieval.decision(retrieval.metrics(ranks), 0.05).first()
    assert decision.best_alternative_top1_gain == 0.5 and decision.decision == "EVALUATE_VECTOR_FOR_PRODUCTION"


def test_nothing_out_of_nothing_is_one(spark):
    flags = "exact boolean, replay_equal boolean, unsupported boolean, security_case boolean, non_inference_ok boolean, expected_refused boolean, refused_clean boolean"
    row = evaluation.outcome_rates(spark.createDataFrame([(True, True, False, False, True, False, False)], flags)).first()
    assert row.security_case_pass_rate == 1.0 and row.forbidden_request_refusal_rate == 1.0 and row.unsupported_assertion_rate == 0.0


def test_split_leakage(spark):
    cases = spark.createDataFrame([("A", "g1", ["P1", "P2"]), ("B", "g2", ["P2"])], "split string, g string, keys array<string>")
    keys = evaluation.partition_keys(cases, {"group": F.array("g"), "subject": F.col("keys")})
    assert [(r.dimension, r.key) for r in evaluation.split_leakage(keys).collect()] == [("subject", "P2")]


@pytest.mark.parametrize("mode", retrieval.MODES)
def test_few_pairs_are_candidates(spark, mode):
    """Most documents are never paired with a question, and the ranks are those of a full comparison."""
    rng = random.Random(9)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(4000)]
    held = {i: rng.choices(common, k=8) + rng.choices(rare, k=rng.choice((6, 40, 160))) for i in range(3000)}
    asked = {q: sorted(rng.sample(held[q * 50], len(held[q * 50]) * 3 // 4)) for q in range(40)}
    docs = retrieval.index(prepared(spark, [(i, " ".join(t), "") for i, t in held.items()]))
    questions = prepared(spark, [(q, " ".join(t), "") for q, t in asked.items()])
    weights = retrieval.token_weights(docs)
    measured, terms = retrieval.norms(docs, weights), retrieval.terms(questions, weights)
    bounded = retrieval.blocks(docs, measured, terms)
    least = retrieval._score_to_reach(docs, measured, terms, bounded, mode, 1, [])
    pairs = retrieval.candidates(docs, measured, bounded, least, [mode])
    sharing = sum(bool(set(t) & set(d)) for t in asked.values() for d in held.values())
    assert sharing > 0.8 * len(asked) * len(held) and pairs.count() < 0.05 * len(asked) * len(held)
    assert {r.question_id: r.document_id for r in retrieval.rank(docs, questions, mode, 1).collect()} == {q: q * 50 for q in asked}
