"""Best-fit packing: certificates, the exchange, and tokenizers of other kinds."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import packing


def check(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in places.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= capacity
    return len(places)


def test_rounding_loss_of_certified_partitions_is_won_back(spark):
    """Pieces of a third: partitions meet their bounds, and still lose what rounding up costs each."""
    items = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(33).cast("long").alias("length"))
    rows = packing.pack(items, capacity=100, partition_pieces=50).collect()
    assert len(rows) == 3000 and check(rows, 100) == 1000


def test_certified_partitions_stay(spark):
    items = spark.range(2000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(60)) + 30).alias("length"))
    rows = packing.pack(items, capacity=100, partition_pieces=100).collect()
    sizes = np.array([r["length"] for r in rows])
    used = check(rows, 100)
    bound = packing.lower_bound(np.bincount(sizes, minlength=101), 100)
    assert bound <= used <= packing.best_fit_decreasing(sizes, 100)[2] * 1.02
    assert all(r["partition_bound"] <= r["partition_sequences"] for r in rows)


def test_other_tokenizers_are_encoded_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"Ab": 1, "c": 2, "?": 0}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "t.json"))
    encode = packing.WordEncoder(str(tmp_path / "t.json"))
    assert not encode.by_words and encode("Ab c x") == np.array([1, 2, 0], "<u4").tobytes()


def test_the_public_tokenizer_is_known_and_changes_are_noticed(tmp_path, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    assert packing.splits_words(path)
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"]["normalizers"].pop()
    (tmp_path / "t.json").write_text(json.dumps(told))
    assert not packing.splits_words(str(tmp_path / "t.json"))
    monkeypatch.setattr(packing, "CACHE_BYTES", 2000)
    encode = packing.WordEncoder(path)
    for k in range(200):
        text = f"word{k} again{k} {'long' * 500}"
        assert encode(text) == np.array(encode.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert 0 <= encode.room and len(encode.known) < 12
