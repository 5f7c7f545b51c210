"""What a worker process keeps between tasks."""

from __future__ import annotations

import collections

from tests.llm.test_operators import BYTES
from tidemark.llm import encoding, packing


def test_encoders_are_let_go():
    encoder = encoding.byte_encoder(BYTES)
    assert encoding.byte_encoder(BYTES) is encoder
    encoding.forget()
    assert encoding.byte_encoder(BYTES) is not encoder


def test_packing_with_a_small_memo_gives_the_same_ids(spark):
    df = spark.createDataFrame([(i, f"word{i % 7} and w{i} again " * (i % 50)) for i in range(300)], "doc_id long, text string")
    got = [collections.Counter(map(str, packing.pack_documents(df, BYTES, **x).collect())) for x in ({}, {"memo": 5, "characters": 100})]
    assert got[0] == got[1]
