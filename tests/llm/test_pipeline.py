"""The pipeline: contract of its stages, and each decision against its operator's plain form."""

import base64
import hashlib
import random
import re
from array import array

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from pyspark.sql import Row

from .test_decontaminate import brute as contaminated
from .test_lines import brute as repeated
from .test_simhash import fingerprint, linked


def test_stages(spark, tmp_path):
    r = random.Random(12)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = prose(14)
    docs = [(k, "\n".join([prose(40), prose(30)]), "en", "s", 1) for k in range(30)]
    docs += [(30 + k, docs[k][1].replace("wa", "wz", 1), "en", "s", 1) for k in range(3)]
    docs += [(40, "123 456", "en", "s", 1), (41, None, "en", "s", 1), (42, prose(20) + "\n" + item, "en", "s", 1), (43, "", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    names = d.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names, name
        out.write.parquet(str(tmp_path / f"out{k}"))
        d = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append(sorted(tuple(x) for x in d.collect()))
    assert [x[0] for x in kept[0]] == [x[0] for x in sorted(docs, key=lambda x: x[0]) if re.search(r"[^\W\d_]", x[1] or "")]
    gone = repeated([x[:2] for x in kept[0]])
    want = [(x[0], "\n".join(t for k, t in enumerate(x[1].split("\n")) if k not in gone.get(x[0], ()))) for x in kept[0]]
    assert [x[:2] for x in kept[1]] == want
    root = linked([fingerprint(t) for _, t in want])
    assert [x[:2] for x in kept[2]] == [x for k, x in enumerate(want) if root[k] == k]
    clean = {x[0] for x in contaminated([x[:2] for x in kept[2]], [(1, item)]) if not x[-1]}
    assert {x[0] for x in kept[3]} == clean and 42 not in clean
    assert {x[0] for x in kept[4]} == clean
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}, special_tokens={})
    for x, row in zip(kept[4], kept[3], strict=True):
        ids = encoding.encode_ordinary(row[1])
        assert x == (row[0], len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(row[1].encode()).hexdigest())
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == kept[4]


def test_unlabelled_corpus_stays(spark, tmp_path):
    text = lambda k: f"own words of document {'abcdefgh'[k]} and {'stuvwxyz'[k]} more here"
    rows = [(k, text(k), None, "s", 1) for k in range(5)] + [(5, "123 456", None, "s", 1), (6, None, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in kept) == [0, 1, 2, 3, 4]


def test_clashing_columns_repeated_rows_and_empty_tables(spark, tmp_path):
    text = "some words of a first line here\nand others of a second line there"
    names = ["doc_id", "text", "lang", "n_lines", "dropped", "key", "_key", "row", "hits", "items", "component_id", "score", "gone", "source"]
    rows = [(k, t, "en", *[f"{k}{n}" for n in names[3:]]) for k, t in ((1, text), (1, text), (2, "something else entirely stands in this one"), (None, "a row without an id has words too"))]
    schema = "doc_id long, " + ", ".join(f"`{n}` string" for n in names[1:])
    for k, own in enumerate((rows, [])):
        path = f"{tmp_path}/{k}"
        spark.createDataFrame(own, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        d = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, path)
            assert d.columns == names, name
        assert sorted(map(str, d.collect())) == sorted({str(Row(**dict(zip(names, x, strict=True)))) for x in own})
        assert corpus_pipeline.run(spark, path).count() == len(own[1:])
