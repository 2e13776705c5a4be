from __future__ import annotations

import random

import public_tokenizers

from attestra.llm import op10_token_counts as op
from attestra.llm.pretokens import byte_pretokens, tokenizer
from tests.llm.fixtures import ODD, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def counted(rows):
    return sorted(((i, len((t or "").encode()), len(tokenizer(PATH).encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)


def made(frame):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in frame.collect()), key=str)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert made(op.token_counts(docs, PATH, 100_000)) == counted([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_awkward_rows(spark):
    rows = ODD + [(20, "a  <|endoftext|>  b<|endoftext|><|endoftext|>", "en", "a"), (21, "tab\t\t x  \n\n y  z\u0085", "en", "a"), (22, "漢字 かな ́", "ja", "a")]
    docs = documents(spark, rows)
    assert made(op.token_counts(docs, PATH)) == counted([(i, t) for i, t, *_ in rows])
    assert op.token_counts(docs.limit(0), PATH).count() == 0


def test_latin_split_is_the_librarys():
    encoder, rng = tokenizer(PATH), random.Random(4)
    alphabet = [chr(c) for c in range(0x180)] + ["'s", "'re", " ", "\n", "  ", "\t "]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert [i for p in byte_pretokens(text, PATH) for i in encoder.encode(p, add_special_tokens=False).ids] == encoder.encode(text, add_special_tokens=False).ids, text
