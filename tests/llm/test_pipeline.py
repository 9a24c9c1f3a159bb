import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from seqloom.llm import bpe


def test_every_stage_takes_effect(spark, tmp_path):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdehinorst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(30))) for i in range(6)]
    rows, labels, bad, leaks = [], [], set(), set()
    for d in range(160):
        w = words(rng.randint(40, 120))
        if d % 4 == 3:
            w = [x + "***" for x in w]
            bad.add(d)
        elif d % 10 == 0:
            w += items[d // 10 % 6][1].split()
            leaks.add(d)
        if d % 6 == 1:
            w.insert(3, f"mail{d}@example.com")
        rows.append([d, " ".join(w), "en", "s"])
        labels.append((d, int(d not in bad), 0))
    near = rows[2][1].split()
    near[10] = "other"
    rows += [[200, rows[2][1], "en", "s"], [201, " ".join(near), "en", "s"], [202, None, "en", "s"], [202, None, "en", "s"]]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) - {202} == set(range(160)) - bad - leaks and docs.count() == len(got)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = {r[0]: r[1] for r in rows}
    for d, r in got.items():
        assert r.ids == e.encode_ordinary(r.text) and r.n_tokens == len(r.ids)
        if d % 6 == 1 and d < 160:
            assert f"mail{d}@" not in r.text and r.n_chars == len(r.text)
        elif d != 202:
            assert r.text == text[d]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, tuple(r.ids)) for r in whole.collect()} == {(d, tuple(r.ids)) for d, r in got.items()}


def tables(spark, path, rows, schema, labels=(), items=()):
    spark.createDataFrame(list(rows), schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_clashing_columns_null_and_repeated_ids(spark, tmp_path):
    text = lambda k, n=30: " ".join(f"w{k}x{i}" for i in range(n))
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(1, text(1)), (1, text(2)), (None, text(3)), (None, text(3)), (None, text(4)), (None, text(1)), (None, None), (2, ""), (3, text(5) + " ssn 123-45-6789"), (None, text(6) + " " + item), (4, text(7))]
    own = [(*r, "en", "s", 1, 7.5, 9, "k", 5, "i", 6, "d") for r in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, predicted int, kinds string, n_replaced int, ids string, n_tokens int, decoded string"
    docs = tables(spark, tmp_path, own, schema, items=[(1, item)])
    one, two, three, four, five = (f for _, f in corpus_pipeline.STAGES)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    good = one(spark, docs, str(tmp_path)).collect()
    assert sorted(good, key=key) == sorted(docs.collect(), key=key)
    left = sorted(two(spark, docs, str(tmp_path)).collect(), key=key)
    assert [(r.doc_id, r.text) for r in left] == sorted([(1, text(1)), (2, ""), (3, text(5) + " ssn 123-45-6789"), (4, text(7)), (None, None), (None, text(3)), (None, text(4)), (None, text(6) + " " + item)], key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    clean = three(spark, docs, str(tmp_path)).collect()
    assert len(clean) == len(rows) - 1 and all(item not in (r.text or "") for r in clean)
    hidden = four(spark, docs, str(tmp_path)).collect()
    assert {(r.kinds, r.n_replaced, r.score) for r in hidden} == {("k", 5, 7.5)} and "123-45-6789" not in next(r.text for r in hidden if r.doc_id == 3)
    last = five(spark, docs, str(tmp_path))
    assert {(r.own_ids, r.own_n_tokens, r.own_decoded) for r in last.collect()} == {("i", 6, "d")} and sorted(r.text for r in last.collect()) == sorted(r[1] or "" for r in rows)
    for stage in (one, two, three, four):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens"}
