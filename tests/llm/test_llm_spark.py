"""Operators and queries on Spark, against brute force, and on hard inputs."""

import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docspark.llm import chat, decontamination, language_id, ngram_join, packing, quality_classifier, quality_rules, queries, sharding, toxicity, url_filter

LONG = "word and more of it. " * 20_000
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven"
HARD = [
    (1, "A plain document with some words in it."), (2, None), (3, ""), (4, "   \n\t"), (5, LONG), (6, "same text here for all of us now"), (7, "same text here for all of us now"), (7, "same text here for all of us now"),
    (None, "no id at all"), (None, None), (8, "日本語 ٣ ½ \x00 \ud83d\ude00"), (9, "###"), (10, BASE), (11, BASE.replace("omega", "OMEGA!")), (12, BASE + " eight"),
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "en" if i != 3 else None, None, "x", True) for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string, kept boolean")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, score string, kept boolean")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(1, 12)] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_one_row_for_each_document(hard, empty, labels):
    model = quality_classifier.fit(hard, labels)
    words = toxicity.fit(hard, labels)
    lang = language_id.fit(hard)
    for run in (quality_rules.quality_rules, lambda d: quality_classifier.score(d, model), lambda d: toxicity.score(d, words), lambda d: language_id.identify(d, lang), ngram_join.ngram_join, lambda d: sharding.kd_shards(d, n_shards=3)):
        assert sorted(str(r["doc_id"]) for r in run(hard).collect()) == sorted(str(i) for i, _ in HARD)
        assert run(empty).count() == 0
    assert quality_classifier.score(hard, None).filter("score = 0.5").count() == len(HARD)
    assert language_id.fit(empty).languages == [] and toxicity.fit(empty, labels).words.size == 0
    for keep in (lambda d: language_id.accepted(d, lang), lambda d: quality_classifier.accepted(d, model)):
        assert keep(hard).columns == hard.columns and keep(empty).count() == 0


def test_join_on_hard_rows(hard, spark):
    got = {}
    for r in ngram_join.ngram_join(hard).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert {r["class_id"] for r in got[7]} == {6} and got[6][0]["n_copies"] == 3 and got[6][0]["n_links"] == 0 and got[6][0]["n_linked_docs"] == 2
    assert got[10][0]["class_id"] == got[11][0]["class_id"] == got[12][0]["class_id"] == 10 and got[11][0]["n_links"] == 2
    assert got[2][0]["class_id"] == 2 and got[3][0]["class_id"] == 2  # null counts as empty
    assert got[4][0]["class_id"] == 4 and all(r["class_id"] is None for r in got[None])
    kept = ngram_join.one_of_each(hard)
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["1", "2", "4", "5", "6", "None", "None", "8", "9", "10"]) and kept.columns == hard.columns


def test_large_groups_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(0, 100, 2)] + ["lonely text of its own with a few words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    links = [sum(len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(docs).collect()}
    assert [got[k]["n_links"] for k in range(len(texts))] == links
    assert {got[k]["class_id"] for k in range(50)} == {0} and got[50]["class_id"] == 50


def test_join_against_all_pairs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    words = {r["doc_id"]: re.findall(r"[^\W_]+", r["text"].lower()) for r in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    text = {r["doc_id"]: r["text"] for r in rows}
    links = {i: set() for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if text[a] != text[b] and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a].add(text[b])
            links[b].add(text[a])
    for r in queries.op5_ngram_join(spark, data).collect():
        assert r["n_links"] == len(links[r["doc_id"]])


def test_components(spark):
    pairs = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = dict(tuple(r) for r in ngram_join.components(spark.createDataFrame([(max(p), min(p)) for p in pairs], "node long, root long")).collect())
    assert {got[k] for k in range(1, 41)} == {1} and {got[k] for k in (100, 101, 103)} == {100} and 200 not in got


def test_shards(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = queries.op3_kd_sharding(spark, data).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
        assert r["size"] == len(text[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert len(rows) == len(text) and set(by) <= set(range(24))
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in x) - total / 24) <= 2 * largest for x in by.values())
    copies = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("s").alias("source"))
    sizes = [r["count"] for r in sharding.kd_shards(copies, n_shards=24).groupBy("shard").count().collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 8
    assert sharding.kd_shards(copies, target_bytes=21 * 1000).select("shard").distinct().count() == 5


def test_decontamination(spark, data, hard, empty):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    want = {(d["doc_id"], i["item_id"]) for i in items.collect() for d in docs.collect() if plain(i["text"]) in plain(d["text"])}
    got = decontamination.contaminated(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items, block_items=7).collect()} == want
    assert decontamination.clean(docs, items).count() == docs.count() - len({d for d, _ in want})
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "word and more"), (None, "alpha beta gamma delta epsilon zeta eta")], "item_id long, text string")
    assert {r["doc_id"] for r in decontamination.contaminated(hard, odd).collect()} >= {10, 11, 12}
    assert decontamination.contaminated(empty, items).count() == 0 and decontamination.clean(hard, items.limit(0)).count() == len(HARD)
    asked = spark.createDataFrame([(1, "What is the capital of the far country over there?", "The capital is a town by the sea")], "item_id long, question string, answer string")
    texts = spark.createDataFrame([(1, "Intro. What is the capital of the far country over there? The capital is a town by the sea. Outro."), (2, "Something else about the capital of a country.")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontamination.contaminated(texts, asked).collect()] == [1]


def test_rotation(spark, data, same_as_oracle):
    same_as_oracle(queries.op6_perspective_rotation, queries.ORACLE_SQL["op6_perspective_rotation"])
    turns = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "Ann", "Hi"), (1, 2, "Bob", "Yo"), (1, 3, None, None), (1, 3, None, None), (None, 0, "Zed", "x"), (2, 0, "system", "alone")], "conv_id long, turn long, role string, text string")
    rows = chat.rotate(turns.withColumn("segment", F.lit("clash"))).collect()
    assert len(rows) == 5 * 3 + 1
    for r in rows:
        learned = r["segment"][r["mask_start"] : r["mask_end"]]
        assert (r["role"] == "assistant") == (r["speaker"] == r["perspective"]) and (learned != "") == (r["role"] == "assistant")
        if learned:
            assert learned.endswith("<|end|>") and len(learned) - 7 == r["learned_chars"]
    text = "".join(r["segment"] for r in sorted((r for r in rows if r["perspective"] == "Bob" and r["turn"] < 3), key=lambda r: r["turn"]))
    assert text == "<|system|>\nBe kind.<|end|>\n<|user name=Ann|>\nHi<|end|>\n<|assistant|>\nYo<|end|>\n"
    assert chat.rotate(turns.limit(0)).count() == 0


def test_url_query(spark, same_as_oracle):
    same_as_oracle(queries.op7_url_filter, queries.ORACLE_SQL["op7_url_filter"])
    pages = spark.createDataFrame([(1, None), (1, None), (None, "http://a.com/en/x")], "page_id long, url string").withColumn("rule", F.lit(1))
    rows = url_filter.filter_urls(pages, url_filter.UrlFilter()).collect()
    assert sorted(r["verdict"] for r in rows) == ["allow", "allow", "block"]
    assert url_filter.filter_urls(pages.limit(0), url_filter.UrlFilter()).count() == 0


def test_rules_query(spark, data, same_as_oracle):
    if "op1_quality_rules" in queries.ORACLE_SQL:
        same_as_oracle(queries.op1_quality_rules, queries.ORACLE_SQL["op1_quality_rules"])


def test_packing(spark, data, hard, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    import numpy as np

    for docs, n_docs in ((spark.read.parquet(f"{data}/documents.parquet"), None), (hard, len(HARD))):
        rows = packing.packed_documents(docs, public.path("word_bpe_49k.json")).collect()
        text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        assert sum(r["piece"] == 0 for r in rows) == (n_docs or len(text))
        for r in rows:
            ids = [*tokenizer.encode(text[r["doc_id"]], add_special_tokens=False).ids, 0]
            if r["doc_id"] is not None:
                own = ids[r["start"] : r["start"] + r["length"]]
                assert r["start"] == 2048 * r["piece"] and len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        seqs = {}
        for r in rows:
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in seqs.values():
            at = 0
            for o, n in sorted(places):
                assert o == at
                at += n
            assert at <= 2048
        assert len(seqs) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.packed_documents(empty, public.path("word_bpe_49k.json")).count() == 0


def test_exchange_between_partitions(spark):
    import numpy as np

    items = spark.range(3000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(99)) + 1).alias("length"))
    rows = packing.pack(items, capacity=100, partition_pieces=150).collect()
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == 3000
    for places in fill.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 100
    # no worse than without exchange, and near the bound though partitions are tiny
    counts = np.bincount([r["length"] for r in rows], minlength=101)
    alone = packing.pack(items, capacity=100, partition_pieces=3000).select("sequence_id").distinct().count()
    first = sum(packing.best_fit_decreasing(np.array(sizes), 100)[2] for sizes in np.array_split([r["length"] for r in rows], 20))
    assert packing.lower_bound(counts, 100) <= alone <= len(fill) <= first
    assert len(fill) <= 1.03 * packing.lower_bound(counts, 100) and alone <= 1.005 * packing.lower_bound(counts, 100)


@pytest.mark.parametrize(("name", "mod", "fold"), [("op2_quality_classifier", 5, 0), ("op8_language_id", 3, 1), ("op10_toxicity", 3, 1)])
def test_classifier_queries(spark, name, mod, fold):
    data = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, data).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == fold) and 0 <= r["score"] <= 1
        want = docs[r["doc_id"]]["lang"] if "lang" in name else labels.get(r["doc_id"]) and labels[r["doc_id"]]["quality" if "quality" in name else "toxic"]
        if r["held_out"] and want is not None:
            total += 1
            right += want == (r["lang_pred"] if "lang" in name else r["predicted"])
    assert right / total > 0.93


def groups_of(text):
    """The least id of each document's group, by comparing all pairs of word 5-grams."""
    words = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in text.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {t} for (i, w), t in zip(words.items(), text.values(), strict=True)}
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            low[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_pipeline_against_plain_stages(spark, data):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        text = {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "language_id":
            model = language_id.fit(now)
            want = {i for i, t in text.items() if not language_id.predict(model, [t])[2][0]}
        elif name == "quality_classifier":
            model = quality_classifier.fit(now, labels)
            want = {i for i, t in text.items() if quality_classifier.scores_of(model, [t])[0] >= 0.3}
        elif name == "ngram_join":
            want = {i for i, g in groups_of(text).items() if i == g}
        else:
            want = {i for i, t in text.items() if not any(x in plain(t) for x in items)}
        out = stage(spark, now, data).cache()
        assert out.columns == docs.columns
        assert {r["doc_id"] for r in out.collect()} == want, name
        now = out
    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    sizes = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in now.collect()}
    packed: dict = {}
    for r in corpus_pipeline.run(spark, data).collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == sizes


def test_labelled_sample_is_bounded_and_stable(spark):
    from docspark.llm.common import labelled_sample

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("quality"))
    sample = lambda d, n: {(r["doc_id"], r["target"]) for r in labelled_sample(d, labels.repartition(5), "quality", 5, {1, 2, 3, 4}, n).collect()}
    small, large = sample(docs, 100), sample(docs.repartition(3), 300)
    assert sum(t for _, t in small) == 100 and len(small) == 200 and len(large) == 600 and small < large
    assert all(zlib.crc32(str(i).encode()) % 5 for i, _ in large)
    every = sample(docs, 100_000)
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(4000))
