"""Operators 5, 7, 9 and 10: held-out accuracy on made-up text, brute force, planted cases."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from veritrail.llm import language_crf, quality_compress, topk_postings
from veritrail.llm.batches import crc_of_id, spread
from veritrail.llm.language_crf import Chains, Labeller, Model, languages
from veritrail.llm.quality_compress import logistic, quality
from veritrail.llm.secret_worklist import find_secrets, secret_digests
from veritrail.llm.topk_postings import top_k, top_k_self

SYLLABLES = {"aa": ["tha", "ing", "er", "wh"], "bb": ["ção", "lh", "ão", "que"], "cc": ["sch", "ung", "ei", "ü"]}


def line(r, lang, n=12):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    r = random.Random(8)
    rows = [(k, "\n".join(line(r, lang) for _ in range(4)), lang) for k, lang in ((k, r.choice(list(SYLLABLES))) for k in range(300))]
    mixed = (900, "\n".join([line(r, "aa"), line(r, "bb"), line(r, "bb"), line(r, "bb")]), None)
    d = spark.createDataFrame([*rows, mixed, (901, None, "aa"), (902, "", "aa"), (903, "12 !?", "bb"), (None, line(r, "cc"), "cc"), rows[0]], "doc_id long, text string, lang string")
    got = languages(d).collect()
    assert len(got) == 306
    by = {x.doc_id: x for x in got}
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert all(by[i].lang_pred == lang for i, _, lang in rows) and by[900].lang_pred == "bb" and by[None].lang_pred == "cc"
    assert [by[k].lang_pred for k in (901, 902, 903)] == ["und"] * 3
    assert all(0 <= x.score <= 1 for x in got) and by[900].score < by[0].score


def test_languages_without_labels(spark):
    d = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {x.lang_pred for x in languages(d).collect()} == {"und"}
    assert languages(d.limit(0)).collect() == []
    one = spark.createDataFrame([(k, f"abc {k}", "xx") for k in range(9)], "doc_id long, text string, lang string")
    assert {x.lang_pred for x in languages(one).collect()} == {"xx"}


def test_forward_backward_sums_over_all_paths(monkeypatch):
    rng = np.random.default_rng(3)
    e, start, step = rng.normal(size=(5, 3)), rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3)
    gamma, pairs, first = Chains(np.array([0, 4]), 5).marginals(e, start, step, pairs=True)
    for part in (1, 2, 3):  # parts of a chain, joined by messages, are the chain
        monkeypatch.setattr(language_crf, "PART", part)
        for a, b in zip(Chains(np.array([0, 4]), 5).marginals(e, start, step, pairs=True), (gamma, pairs, first), strict=True):
            assert np.allclose(a, b)
    want, total = np.zeros((4, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        p = start[path[0]] * np.exp(e[0, path[0]])
        for t in range(1, 4):
            p *= step[path[t - 1], path[t]] * np.exp(e[t, path[t]])
        total += p
        for t in range(4):
            want[t, path[t]] += p
    assert np.allclose(gamma[:4], want / total) and np.isclose(pairs.sum(), 3) and np.isclose(first.sum(), 2)


def test_crf_learns_that_languages_last():
    r = random.Random(9)
    m = Model([(lang, "\n".join(line(r, lang) for _ in range(3))) for lang in SYLLABLES for _ in range(15)])
    assert (m.step.diagonal() > 0.5).all()


def switched(r, n):
    """Words with their languages: runs of 3 to 9 words."""
    words, truth = [], []
    while len(words) < n:
        lang = r.choice([x for x in SYLLABLES if not truth or x != truth[-1]])
        own = line(r, lang, r.randrange(3, 10)).split()
        words += own
        truth += [lang] * len(own)
    return words, truth


def test_words_of_code_switched_text_are_labelled():
    """Word by word, on words not seen in training, over switches; transitions alone would carry one language on."""
    r = random.Random(12)
    m = Model([(lang, "\n".join(line(r, lang) for _ in range(4))) for lang in SYLLABLES for _ in range(30)])
    label = Labeller(m)
    assert all(0 < m.step[i, j] < m.step[i, i] for i in range(3) for j in range(3) if i != j)
    right = total = 0
    for _ in range(30):
        words, truth = switched(r, 60)
        label.learn([w for w in set(words) if w not in label.ids])
        gamma, *_ = Chains(np.array([0]), len(words)).marginals(label.emission[[label.ids[w] for w in words]].astype(float), m.start, m.step)
        right += sum(m.languages[k] == t for k, t in zip(gamma.argmax(axis=1), truth, strict=True))
        total += len(words)
    assert right / total > 0.97


def test_predictions_match_plain_forward_backward(spark):
    """Whole result, from texts to scores, with loops over words and labels; one line is longer than a part."""
    r = random.Random(13)
    rows = [(k, "\n".join(line(r, lang) for _ in range(3)), lang, "x") for k in range(60) for lang in [r.choice(list(SYLLABLES))]]
    rows += [(100, " ".join(switched(r, 700)[0]), None, "x"), (101, "\n\n12 " + line(r, "aa", 2) + "\n" + line(r, "bb", 2), None, "x"), (100, " ".join(switched(r, 5)[0]), None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    m = language_crf.fit(d, ~(crc_of_id(F.col("doc_id")) % 5 == 0))
    features = language_crf.Features(m.lexicon)
    for x, (doc_id, text, *_) in zip(languages(d.coalesce(1)).collect(), d.coalesce(1).collect(), strict=True):
        total, words = np.zeros(3), 0
        for one in text.lower().split("\n"):
            own = re.findall(r"[^\W\d_]+", one)
            e = [np.exp(m.weights[features([w])[0]].astype(float).sum(axis=0)) for w in own]
            a, b = [], np.ones(3)
            for t, x_t in enumerate(e):
                v = (m.start if t == 0 else a[-1] @ m.step) * x_t
                a.append(v / v.sum())
            for t in range(len(e) - 1, -1, -1):
                g = a[t] * b
                total += g / g.sum()
                b = m.step @ (e[t] * b)
                b /= b.sum()
            words += len(own)
        assert x.doc_id == doc_id and x.lang_pred == m.languages[total.argmax()] and abs(x.score - total.max() / words) < 1e-6


def test_long_labelled_texts_teach_too(spark):
    r = random.Random(14)
    rows = [(k, line(r, lang, 9000), lang) for k, lang in enumerate(["aa", "bb"] * 4)] + [(50, line(r, "bb"), None)]
    got = {x.doc_id: x.lang_pred for x in languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[50] == "bb" and all(got[k] == ("aa", "bb")[k % 2] for k in range(8))


def ints(v):
    return [int(np.floor(256 * x)) for x in v]


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), [float(x) if rng.random() < 0.7 else 0.0 for x in rng.normal(size=8)]) for k in range(330)]
    rows[20] = (20, rows[10][1])  # a tie
    odd = [(400, None), (450, [1.0, None]), (401, [float("nan")] * 8), (402, [float("inf")] * 8), (None, [1.0] * 8), (403, []), rows[7], rows[50], rows[50]]  # repeated rows are queries and candidates of their own
    d = spark.createDataFrame([(*x, "z") for x in rows + odd], "vec_id long, embedding array<double>, score string").repartition(5)
    got = sorted(tuple(x) for x in top_k_self(d).collect())
    own = [*rows, (403, []), rows[7], rows[50], rows[50]]
    want = []
    for at, (q, of_q) in enumerate(own):
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(ints(of_q), ints(v))), k) for j, (k, v) in enumerate(own) if j != at)
            want += [(q, n + 1, k, -x) for n, (x, k) in enumerate(s[:5])]
    assert got == sorted(want)
    assert sorted(tuple(x) for x in top_k_self(d, buckets=1).collect()) == got
    # a table of queries: candidates with a query's id take no part
    asked = d.where("vec_id = 50").limit(1)
    assert [x.vec_id for x in top_k(d, asked).orderBy("rank").collect()] == [k for _, k in sorted((-sum(a * b for a, b in zip(ints(rows[50][1]), ints(v))), k) for k, v in own if k != 50)[:5]]


def test_top_k_in_a_grid(spark, monkeypatch):
    """Few query blocks meet at one key, and the result is that of one group."""
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(k, r.normal(size=16).tolist()) for k in range(600)], "vec_id long, embedding array<double>").repartition(40, "vec_id")
    want = sorted(map(tuple, top_k_self(df, 2, 3, 4).collect()))
    monkeypatch.setattr(topk_postings, "QUERY_BLOCKS", 6)
    assert sorted(map(tuple, top_k_self(df, 2, 3, 4).collect())) == want
    rows = topk_postings._taken(df, F.col("vec_id"))
    _, asked = topk_postings._grid(rows, rows, 20)
    assert asked.select("q_ids").distinct().count() > 30
    n = [x["count"] for x in asked.groupBy("group", "bucket").count().collect()]
    assert len(n) > 20 and max(n) <= 3 * 6


def test_top_k_orders_large_scores_exactly(spark):
    """2^62 + 1, 2^62 and 2^62 + 2 are one number as doubles."""
    q = [2.0**23, 1 / 256]
    rows = [(0, q)] + [(k, [2.0**23, x / 256]) for k, x in ((1, 1), (2, 0), (3, 2))]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(x.vec_id, x.score - 2**62) for x in top_k_self(d).orderBy("rank").collect()] == [(3, 2), (1, 1), (2, 0)]


def test_top_k_with_few_candidates_and_large_weights(spark):
    d = spark.createDataFrame([(0, [1e7, 1.0]), (1, [1e7, 2.0]), (2, [-3e8, 0.0])], "vec_id long, embedding array<double>")
    got = {x.vec_id: x.score for x in top_k_self(d).collect()}
    assert got[1] == 2560000000**2 + 256 * 512 and got[2] == max(-(1 << 63), -2560000000 * 76800000000)
    assert top_k(d.limit(0), d, 5).collect() == [] and top_k_self(d.limit(0)).collect() == []


def test_quality(spark):
    r = random.Random(10)
    good = lambda: "\n".join(line(r, "aa") for _ in range(6))
    bad = lambda: " ".join(r.choice(["%%%", "###", "$$$", "BUY!!", "NOW!!"]) for _ in range(60))
    rows = [(k, good() if k % 3 else bad()) for k in range(400)] + [(900, ""), (901, None), (None, good())]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(400)] + [(1, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality(d, labels).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(got) == 403 and all(got[k].held_out for k in held)
    assert sum(got[k].predicted == int(k % 3 > 0) for k in held) / len(held) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got.values())


def test_quality_scores_match_plain_compression(spark):
    """Dictionaries, differences and scores once more, step by step; length alone doesn't move a score."""
    r = random.Random(15)
    words = {q: ["".join(r.choice(letters) for _ in range(r.randrange(3, 9))) for _ in range(600)] for q, letters in ((1, "etaoinshrdlu"), (0, "qwxzkvjpyfhd"))}
    text_of = lambda q, n=70: " ".join(r.choice(words[q]) for _ in range(n))
    rows = [(k, text_of(k % 2), 1) for k in range(200)]
    rows += [(300, text_of(1, 30_000), 1), (302, text_of(0, 30_000), 1), (304, "", 1), (305, None, 1), (307, rows[1][1], 1), (307, rows[1][1], 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score int").coalesce(1)
    # ids 190 to 199 have labels that disagree
    labels = spark.createDataFrame([(k, k % 2, 0.5) for k in range(200)] + [(k, 1 - k % 2, 0.5) for k in range(190, 200)], "doc_id long, quality int, score double")
    order = [(x.doc_id, x.doc_id % 2) for x in labels.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").collect() if x.doc_id < 190 and zlib.crc32(str(x.doc_id).encode()) % 4 != 2]
    text = {k: t for k, t, _ in rows}
    own = {q: [text[k] for k, of in order if of == q] for q in (1, 0)}
    packs = {q: "\n".join(own[q][0::2]).encode() for q in own}
    limit = min(map(len, packs.values()))
    ways = {q: zstandard.ZstdCompressor(level=9, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(p[:limit], dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for q, p in packs.items()}
    size = lambda q, t: sum(len(ways[q].compress(t[k : k + 2048])) for k in range(0, len(t), 2048))
    difference = lambda t: (size(0, t) - size(1, t)) / (len(t) + 20)
    pairs = sorted((q, difference(t.encode())) for q in own for t in own[q][1::2])
    slope, offset = logistic(np.array([x for _, x in pairs]), np.array([float(q) for q, _ in pairs]))
    got = quality(d, labels).collect()
    assert len(got) == len(rows)
    for x in got:
        z = difference((text[x.doc_id] or "").encode()) * slope + offset
        assert abs(x.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
    by = {x.doc_id: x for x in got}
    assert by[300].predicted == 1 and by[302].predicted == 0 and by[304].score == by[305].score


def test_quality_without_both_classes(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x.score for x in quality(d, none).collect()} == {0.5}
    assert quality(d.limit(0), none).collect() == []


SECRET = 'password = "hunter2secret"'


def b64(x):
    return base64.b64encode(x).decode()


@pytest.mark.parametrize("coded", [
    b64(SECRET.encode()),
    b64(gzip.compress(SECRET.encode())),
    b64(zlib.compress(SECRET.encode())),
    b64(bz2.compress(SECRET.encode())),
    urllib.parse.quote(SECRET),
    "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "".join(f"&#{ord(c)};" for c in SECRET),
    b64(b64(SECRET.encode()).encode()),
    urllib.parse.quote(b64(zlib.compress(b64(SECRET.encode()).encode()))),
    b64(gzip.compress(bz2.compress(SECRET.encode()))),
])
def test_layers_are_unwrapped_and_placed(coded):
    text = f"é start {coded} end"
    found = [(s, k, e) for s, k, e, via in find_secrets(text) if via and k == 0]
    assert found
    s, _, e = found[0]
    # the span lies within the coded part, and covers the secret's value
    assert 8 <= s < e <= 8 + len(coded) and e - s >= len(coded) // 2


def test_long_layers_lose_nothing_at_borders(monkeypatch):
    import veritrail.llm.secret_worklist as m

    monkeypatch.setattr(m, "PIECE", 40)
    for pad in range(60):
        coded = b64(gzip.compress(("é" * pad + SECRET + "x" * 100).encode()))
        assert [x[:3] for x in find_secrets(coded) if x[1] == 0] == [(0, 0, len(coded))]
        nested = b64(gzip.compress(bz2.compress(("é" * pad + SECRET + " x" * 100).encode())))
        assert [x[:3] for x in find_secrets(nested) if x[1] == 0] == [(0, 0, len(nested))]


def test_partly_coded_line():
    assert find_secrets("tok%65n = abcdefgh") == [(0, 0, 18, "escapes/")]


def plain(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def test_base_spans_match_plain_patterns(spark):
    r = random.Random(11)
    bits = ["token", "Secret", " = ", ": ", '"', "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", " ", "API_KEY", "x", "abcdef", "=", "ſecret", "%41", "\\u0041"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 40))) for _ in range(300)] + ["", None]
    got = {x.doc_id: x for x in secret_digests(spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, spans int")).collect()}
    names = ("assign", "access", "hex")
    for k, t in enumerate(texts):
        own = plain(t or "")
        base = [f"{names[kind]}:{s}:{e}" for s, kind, e in own]
        x = got[k]
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(b.startswith(n) for b in base) for n in names)
        assert x.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(x.spans.split(",")) | {""}


def test_damaged_and_cyclic_layers_end():
    assert find_secrets("A" * 4001) == []
    assert find_secrets(b64(gzip.compress(b"x" * 100_000)[:-20])) == []
    deep = SECRET.encode()
    for _ in range(12):
        deep = b64(deep).encode()
    assert [x[1] for x in find_secrets(deep.decode())] == [0]


def test_a_repeated_blob_is_unwrapped_at_each_place():
    blob = b64(gzip.compress(SECRET.encode()))
    text = f"a {blob} b\nc {blob} d"
    n, second = len(blob), text.rindex(blob)
    assert [x[:3] for x in find_secrets(text) if x[1] == 0] == [(2, 0, 2 + n), (second, 0, second + n)]


@pytest.mark.parametrize("odd", ["\ufeff", "\u00a0", "\u3000", "\u200b", "\u00ad", "\x1b[0m"])
def test_layers_with_unusual_characters_are_scanned(odd):
    plain_text = f"{odd}été {SECRET} {odd}"
    for data in (plain_text.encode(), plain_text.encode("utf-8") + b"\xff\xfe", plain_text.encode() + b"\0"):
        for coded in (b64(data), b64(gzip.compress(data))):
            assert [x[1] for x in find_secrets(coded)] == [0]


def test_streams_end_to_end_are_all_scanned():
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        for first in (b"nothing here", b""):
            coded = b64(pack(first) + pack(SECRET.encode()) + b"\0\0\0\0" + pack(gzip.compress(b"token: abcdefgh")))
            # two secrets at one place are one span
            assert [x[:3] for x in find_secrets(coded) if "compressed" in x[3]] == [(0, 0, len(coded))]
        split = b64(pack(b"passwo") + pack(b"rd = hunter2secret"))
        assert (0, 0, len(split), "base64/compressed/") in find_secrets(split)
        nested = b64(pack(b"nothing") + pack(gzip.compress(b"token: abcdefgh")))
        assert (0, 0, len(nested), "base64/compressed/compressed/") in find_secrets(nested)
    coded = b64(zstandard.compress(b"x") + b"\x50\x2a\x4d\x18\x03\0\0\0abc" + zstandard.compress(SECRET.encode()))
    assert (0, 0, len(coded), "base64/compressed/") in find_secrets(coded)


def test_base64_over_line_ends():
    filler = "".join(random.Random(3).choice("abcdefghijklmnop qrstuvwxyz") for _ in range(900))
    for data, width in ((filler[:50] + SECRET + filler[50:]).encode(), 76), (gzip.compress((filler + SECRET).encode()), 64), (b64(filler.encode() + SECRET.encode()).encode(), 20):
        for end in ("\n", "\r\n", "\n    "):
            coded = b64(data)
            lines = end.join(coded[k : k + width] for k in range(0, len(coded), width))
            text = f"é certificate\n{lines}\nnext words here"
            found = [x for x in find_secrets(text) if x[1] == 0]
            assert found and all(text.index(lines) <= x[0] < x[2] <= text.index(lines) + len(lines) for x in found)
    coded = base64.encodebytes((filler[:50] + SECRET).encode()).decode()
    (s, _, e, via), = find_secrets(coded)
    assert via == "base64/" and s == 66 and coded[s:e].count("\n") == 1


@pytest.mark.parametrize("before", ["x/", "id_", "abc-", "a", "ab", "abc", "abcd", "path/to/x_"])
def test_base64_behind_characters_of_its_alphabet(before):
    for data in (SECRET.encode(), gzip.compress(SECRET.encode()), zlib.compress(SECRET.encode()), zstandard.compress(SECRET.encode() * 3)):
        coded = b64(data)
        found = [x[:3] for x in find_secrets(f"é {before}{coded} end") if x[1] == 0]
        start = 2 + len(before)
        assert found and all(start <= s < e <= start + len(coded) for s, _, e in found)


def test_fits_are_bounded_by_rows(spark, monkeypatch):
    """Two ids with very many texts each: one row of each is collected."""
    docs = spark.range(4000).selectExpr("id % 2 as doc_id", "concat('text of some words ', id) as text", "if(id % 2 = 0, 'aa', 'bb') as lang")
    seen = []
    monkeypatch.setattr(language_crf, "Model", lambda rows: seen.append(len(rows)))
    language_crf.fit(docs, F.lit(True), sample=1)
    assert seen == [2]
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    kept, real = [], quality_compress.dictionary
    monkeypatch.setattr(quality_compress, "dictionary", lambda texts, limit: kept.append(len(texts)) or real(texts, limit))
    quality_compress.fit(docs, labels, F.lit(True), sample=1)
    assert max(kept) == 1


def test_pieces_come_from_all_of_a_text(spark):
    text = "".join(chr(97 + k * 26 // 1000) for k in range(1000))
    short, long = spark.createDataFrame([("abc",), (text,)], "t string").select(spread(F.col("t"), 200).alias("x")).collect()
    assert short.x == "abc" and len(long.x) <= 220 and long.x[0] == "a" and long.x[-1] == "z" and len(set(long.x)) > 12
