import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from kelpline.llm import language as G
from kelpline.llm import leakage as L
from kelpline.llm import tokenizer as T
from kelpline.tables import table


@pytest.fixture(scope="module")
def ranks():
    return T.read_ranks(T.default_path())


def test_ids_equal_the_library(spark, sf_dir, ranks):
    library = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(1).alias("ids2"))
    for r in T.with_ids(docs).collect():
        assert r.ids == (library.encode_ordinary(r.text) if r.text else [])


def test_ids_of_odd_texts(spark, ranks):
    library = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = T.encoder(ranks)
    rng = random.Random(4)
    texts = ["", " ", "\n\n  \t", "<|endoftext|>", "it's we'll", "日本語" * 3000, "a" * 20000, "🚢‍🌊", "\x00￾", "é" * 100]
    texts += ["".join(chr(rng.choice([32, 10, 65, 97, 233, 0x4E00, 0x1F300]) + rng.randrange(24)) for _ in range(rng.randrange(300))) for _ in range(200)]
    for t in texts:
        assert encode(t) == library.encode_ordinary(t)
    assert encode(None) == []
    word = "internationalisation".encode()
    assert T.merge_short(word, ranks) == T.merge_long(word, ranks)
    df = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id int, text string")
    assert [r.ids for r in T.with_ids(df).collect()] == [[], [], []]
    assert T.with_ids(df.limit(0)).count() == 0


BODY = [f"w{i}" for i in range(20, 62)]
OTHER = [f"v{i}" for i in range(20, 62)]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "Read this first please. " + " ".join(BODY) + ". Answer in one line."), (2, "Read this first please. " + " ".join(OTHER) + ". Answer in one line."), (3, None), (4, ""), (5, "too short to count."), (None, " ".join(BODY))]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_passages(spark, items):
    replaced = list(BODY[:24])
    for i in (3, 11, 19):
        replaced[i] = "other"
    shuffled = BODY[:]
    random.Random(1).shuffle(shuffled)
    split = " ".join(BODY[:20]).replace("w25", "w2-\n> 5")
    texts = {
        1: " ".join(BODY[5:20]), 2: "x " + " ".join(BODY[5:19]) + " y", 3: " ".join(replaced), 4: " ".join(shuffled), 5: "Read this first please. Answer in one line.",
        6: split, 7: " ".join(BODY[:20]).upper().replace(" ", ", <b>").replace("W30", "W3​0"), 8: "\\n".join(BODY[:16]) + " and " + "&nbsp;".join(OTHER[10:30]), 9: None, 10: "", 11: " ".join(BODY[:20]), 12: " ".join(BODY[:20]), 13: "filler " * 20000 + " ".join(OTHER),
    }
    docs = spark.createDataFrame([*texts.items(), (None, " ".join(BODY))], "doc_id bigint, text string").withColumn("item_id", F.lit(7)).withColumn("term", F.lit("x"))
    got = {(r.doc_id, r.item_id) for r in L.leaked_passages(docs, items).collect()}
    assert got == {(1, 1), (3, 1), (6, 1), (7, 1), (8, 1), (8, 2), (11, 1), (12, 1), (13, 2)}


def test_passages_of_empty_tables(spark, items):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert L.leaked_passages(docs.limit(0), items).count() == 0
    assert L.leaked_passages(docs, items.limit(0)).count() == 0


def test_longest_match_by_brute_force():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        same = (rng.random(40) < 0.8).astype(float)
        weight = rng.random(40)
        want = 0
        for i in range(40):
            for j in range(i + 15, 41):
                if same[i] and same[j - 1] and same[i:j].mean() >= 0.8 - 1e-9 and (weight * same)[i:j].sum() >= 0.45 * weight[i:j].sum() - 1e-9:
                    want = max(want, j - i)
        assert L.longest_match(np.flatnonzero(same), len(same), weight, 15, 0.8, 0.45) == want


def test_labels_in_other_notations(spark):
    rows = spark.createDataFrame([("en_US", "en"), (" English", "en"), ("deu", "de"), ("pt-BR", "pt"), ("XX", None), (None, None), ("", None), ("JA", "ja")], "lang string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", G.language_of_label(F.col("lang"))).collect())


def test_running_text_only():
    text = "---\nid: x\n---\n# A heading of several words\n```\nlet code = true in this block;\n```\n[03:54] Ann: This is a sentence of running text. And here another one!\nsrc/a/b.ts:12\nx = compute(y)\nこれは文です。次の文もあります。そして終わり。"
    assert [s for *_, s in G.sentences(text)] == ["This is a sentence of running text.", "And here another one!"]
    for start, end, s in G.sentences(text):
        assert text[start:end] == s
    assert G.sentences("") == [] and G.sentences("\n \n") == []


def test_languages_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    seen, held = docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0")
    found = G.document_languages(G.segments(G.cut(held), G.fit(seen, G.cut(seen))))
    one = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("lang").alias("lang")).filter("n = 1")
    label = held.select("doc_id", G.language_of_label(F.col("lang")).alias("label")).filter("label is not null")
    both = one.join(label, "doc_id").collect()
    assert len(both) > 100 and sum(r.lang == r.label for r in both) / len(both) > 0.88  # a part of the labels is wrong


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "This is a sentence of running text in a document.", None), (2, None, "en"), (3, "", "fr"), (None, "This is a sentence of running text.", "en")], "doc_id bigint, text string, lang string")
    assert G.labelled(docs).filter("doc_id is null").count() == 0
    assert G.labelled(docs.filter("doc_id is not null")).count() == 0
    assert G.labelled(docs.limit(0)).count() == 0
