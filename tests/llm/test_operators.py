"""Operators against brute force over a small corpus of odd rows, and over no rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from contourlake.llm import common, decontamination, language_id, line_dedup, lm_scoring, packing, quality_rules, queries, simhash, substring_dedup, token_output, url_filters

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def got(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def text(t):
    return (t or "").encode()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_simhash(docs, rows, empty):
    def fp(t):
        w = text(t).lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    key = lambda r: -(1 << 63) if r[0] is None else r[0]
    fps = [fp(r[1]) for r in rows]
    low = [key(r) for r in rows]
    while True:
        new = [min(low[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(rows))]
        if new == low:
            break
        low = new
    none = lambda x: None if x == -(1 << 63) else x
    want = Counter((r[0], f.to_bytes(8, "big"), none(x)) for r, f, x in zip(rows, fps, low, strict=True))
    assert {simhash.fingerprint(text(r[1])) for r in rows} == {f.to_bytes(8, "big") for f in fps}
    assert got(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_representatives(empty).count() == 0


def test_fingerprints_slice_long_texts(monkeypatch):
    rng = random.Random(9)
    body = " ".join(f"w{rng.randrange(500)}" for _ in range(3000)).encode()
    whole = simhash.fingerprint(body, 5, 192)
    assert whole[:8] == simhash.fingerprint(body, 5) and len(set(whole)) > 10
    monkeypatch.setattr(simhash, "SLICE", 21)
    assert simhash.fingerprint(body, 5, 192) == whole
    h = np.random.default_rng(1).integers(0, 1 << 64, (700, 2), np.uint64)
    assert simhash.set_bits(h).tolist() == [int((h[:, w] >> np.uint64(k) & np.uint64(1)).sum()) for w in range(2) for k in range(64)]


def test_shapes():
    for n in (0, 1, 10**5, 10**7, 10**9):
        s = simhash.shape_for(n, 0.8)
        assert s.segment % 2 == 0 and s.tables * s.segment <= s.bits and s.bits % 64 == 0 and abs(s.max_bits / s.bits - 0.1515) < 0.002
    assert simhash.shape_for(10**5, 0.8) == simhash.Shape(512, 16, 17, 77)


def families(rng, bits):
    """Fingerprints in dense families, chains and pairs, and some on their own."""
    out = set()
    for size, most in ((400, bits // 12), (60, bits // 6), (25, bits // 9)):
        centre = rng.getrandbits(bits)
        out |= {centre ^ sum(1 << b for b in rng.sample(range(bits), rng.randrange(1, most))) for _ in range(size)}
    for _ in range(30):
        x = rng.getrandbits(bits)
        for _ in range(rng.randrange(1, 5)):
            out.add(x)
            x ^= sum(1 << b for b in rng.sample(range(bits), bits // 8 if bits > 64 else 2))
    return sorted(out)


def partition_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("bits", [64, 512])
def test_links_of_hot_halves(spark, bits, monkeypatch):
    """Components lie between those of the pairs that a table shows and those of all pairs within the distance, however the halves are cut."""
    values = families(random.Random(bits), bits)
    shape = simhash.EXACT if bits == 64 else simhash.shape_for(10**4, 0.8)
    seg = lambda x, t: x >> (bits - (t + 1) * shape.segment) & (1 << shape.segment) - 1
    near = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= shape.max_bits]
    shown = [(i, j) for i, j in near if any((seg(values[i], t) ^ seg(values[j], t)).bit_count() <= 1 for t in range(shape.tables))]
    fine, coarse = partition_of(len(values), shown), partition_of(len(values), near)
    assert len(set(coarse)) > 20 and (bits > 64 or fine == coarse)
    fps = spark.createDataFrame([(bytearray(v.to_bytes(bits // 8, "big")),) for v in values], "fp binary")
    at = {v.to_bytes(bits // 8, "big"): k for k, v in enumerate(values)}
    for parts, block in (("2", 1 << 14), ("40", 16), ("40", 1 << 14)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        monkeypatch.setattr(simhash, "BLOCK", block)
        try:
            found = [(at[bytes(r["a"])], at[bytes(r["b"])]) for r in simhash.links(common.Tables(spark, "links"), fps, shape).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert set(map(frozenset, found)) <= set(map(frozenset, near))
        have = partition_of(len(values), found)
        assert len({(f, h) for f, h in zip(fine, have, strict=True)}) == len(set(fine)) and len({(h, c) for h, c in zip(have, coarse, strict=True)}) == len(set(have))


def test_representatives(spark):
    """Copies with few edits go, with the first by id kept whole; others stay."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(9000)}"
    rows, k = [], 0
    for size in (120, 300, 900):
        for _ in range(8):
            base = [word() for _ in range(size)]
            for edits in (0, 0, size // 150, size // 120):
                out = list(base)
                for at in rng.sample(range(size), edits):
                    out[at] = word()
                rows.append((1000 - k, " ".join(out), f"x{k}", k // 4))
                k += 1
    rows += [(2000, None, "n", 90), (2001, "", "n", 90), (None, " ", "n", 90), (1000, rows[0][1], "a", 0), (3000, "one two", "z", 91)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tkey string, family int").repartition(3)
    kept = simhash.keep_representatives(docs).collect()
    assert docs.columns == list(kept[0].asDict()) and sorted(r["family"] for r in kept) == sorted({r[3] for r in rows})
    by = {r["family"]: r for r in kept}
    for f in range(24):
        assert by[f]["doc_id"] == min(r[0] for r in rows if r[3] == f)
    assert by[0]["tkey"] == "x3" and by[90]["doc_id"] is None


def test_line_dedup(docs, rows, empty):
    key = lambda x: x.strip(b" \t\n\r\x0b\x0c").lower()
    split = [text(r[1]).split(b"\n") for r in rows]
    often = Counter(k for k, i in {(key(x), r[0]) for r, ls in zip(rows, split, strict=True) for x in ls} if k)
    want = Counter()
    for r, ls in zip(rows, split, strict=True):
        kept = [x for x in ls if not key(x) or often[key(x)] < 10]
        want[(r[0], len(ls), len(ls) - len(kept), sha(b"\n".join(kept)))] += 1
    assert sum(v for k, v in want.items() if k[2]) > 9
    assert got(line_dedup.line_digests(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert line_dedup.line_digests(empty).count() == 0
    out = line_dedup.drop_common_lines(docs)
    assert out.columns == docs.columns and Counter((r["doc_id"], sha(text(r["text"]))) for r in out.collect()) == Counter((k[0], k[3]) for k, n in want.items() for _ in range(n))
    assert line_dedup.drop_common_lines(empty).count() == 0


def test_a_hot_line_is_settled_across_cuts(spark):
    import pyarrow as pa

    n = 50
    hot = [(1, 1, i, 0, p, 3) for i in range(n) for p in (0, 2)]
    cold = [(0, 5, 7, 0, 1, 3), (2, 0, 3, 0, 1, 3)]
    every = sorted(cold + hot)
    cols = lambda part: pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in part], pa.int64()) for k in range(4)), *(pa.array([x[k] for x in part], pa.int32()) for k in (4, 5))], ["h1", "h2", "id", "tkey", "pos", "n_lines"])
    for cut in ((5,), (19, 20), (7, 15, 90), (1, 101)):
        edges = [0, *cut, len(every)]
        said = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = every[lo:hi]
            while edges and lo and part and part[0][:3] == every[lo - 1][:3]:  # a document's rows of a line stay together
                part = [*[x for x in every[:lo] if x[:3] == part[0][:3]], *part]
                said = [x for x in said if not (x[6] in (0, 1) and x[:3] == part[0][:3])]
                break
            for b in line_dedup._stream(10)(iter([cols(part[i : i + 7]) for i in range(0, len(part), 7)])):
                said += list(zip(*(c.to_pylist() for c in b.columns), strict=True))
        counts = Counter()
        for x in said:
            if x[6] == 2:
                counts[x[:2]] += x[4]
        drop = {x[2:5] for x in said if x[6] == 0} | {x[2:5] for x in said if x[6] == 1 and counts[x[:2]] >= 10}
        assert drop == {x[2:5] for x in hot}


@pytest.mark.parametrize("length", [50, 30, 7])
def test_substring_dedup(docs, rows, empty, length):
    words = [text(r[1]).split() for r in rows]
    low = lambda x: -1 if x is None else x
    first = {}
    for r, w in sorted(zip(rows, words, strict=True), key=lambda x: low(x[0][0])):
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), low(r[0]))
    want = Counter()
    for r, w in zip(rows, words, strict=True):
        gone = {j for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < low(r[0]) for j in range(k, k + length)}
        want[(r[0], len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone)))] += 1
    assert sum(1 for k in want if k[2]) > 3
    assert got(substring_dedup.remove_repeats(docs, length=length), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substring_dedup.remove_repeats(empty, length=length).count() == 0


def test_window_lengths_double():
    assert substring_dedup.levels(50) == [13, 25, 50] and substring_dedup.levels(7) == [7] and substring_dedup.levels(200) == [13, 25, 50, 100, 200]


def test_substrings_without_candidates(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(80))) for i in range(5)], "doc_id long, text string")
    assert {(r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(docs).collect()} == {(80, 0, None)}


def test_quality_rules(docs, rows, empty):
    def measure(t):
        w = [x.decode() for x in text(t).split()]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), failed

    out = quality_rules.judge_quality(docs)
    assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == Counter((r[0], *measure(r[1])) for r in rows)
    assert out.where("base_failed and kept").count() == 0 and out.where("kept").count() > 5
    assert quality_rules.judge_quality(empty).count() == 0
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and good.count() == out.where("kept").count() and quality_rules.keep_good(empty).count() == 0
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


def test_token_output(spark, docs, rows, empty):
    model = Tokenizer.from_file(BPE)
    extra = [(70, "a <|endoftext|> b", *rows[0][2:]), (70, "a <|endoftext|> b", *rows[0][2:]), (71, " ".join(f"long{k * k}text{k}," for k in range(40_000)), *rows[0][2:])]
    every, more = [*rows, *extra], docs.unionByName(spark.createDataFrame(extra, docs.schema))
    want, start = Counter(), 0
    signed = lambda t: np.uint64(xxhash.xxh64_intdigest(text(t), 42)).astype(np.int64).item()
    for r in sorted(every, key=lambda r: (-(1 << 63) if r[0] is None else r[0], signed(r[1]))):
        ids = [*model.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want[(r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    assert any(50256 in model.encode(r[1] or "", add_special_tokens=False).ids for r in every)
    for page_bytes in (token_output.PAGE_BYTES, 500):  # one page a run, and many
        assert got(token_output.token_digests(more, BPE, page_bytes=page_bytes), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_output.token_digests(empty, BPE).count() == 0
    folder = common.Tables(spark, "again").root
    token_output.write(more, folder, BPE, page_bytes=2000)
    pages = spark.read.parquet(f"{folder}/pages").collect()
    assert any(p["first"] for p in pages) and len({p["dict_hash"] for p in pages}) == 1
    back = {(r["id"], r["start"]): np.frombuffer(r["ids"], "<u4").tolist() for r in token_output.read(spark, folder).collect()}
    assert [v for (i, _), v in back.items() if i == 71] == [[*model.encode(extra[2][1], add_special_tokens=False).ids, 0]]


def test_encoder_cuts_as_the_library_does(tmp_path):
    model = Tokenizer.from_file(BPE)
    rng = random.Random(3)
    marks = ["don't", "x's", " ", "\n", "  ", "\t", "é", "漢", " ", "1,234", "...", "#$%", "\r\n", "ﬁ", "\u200b", "a", "<|endoftext|>", "\u0301", "\U0001f600", "\x00", "'s", "it's", "'", "ab'"]
    texts = [" ".join(rng.choice(["don't.", "Tone,", "x.", "ab).", "é.", "a,b", "1.", "end.\nNext", "漢,", "it's,", "x'", "7%%%", "s'.", "e\u0301.", ",", "«a».", "ﬂ,", "'s"]) for _ in range(9)) for _ in range(400)]
    texts += ["".join(rng.choice(marks) + (" " if rng.random() < 0.5 else "") for _ in range(rng.randrange(12))) for _ in range(1500)]
    want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    encoder = token_output.Encoder(BPE)
    assert encoder.cuts and [x.tolist() for x in encoder(pa.array(texts))] == want
    encoder.most = 0  # forgets all before each batch
    assert [x.tolist() for k in range(0, len(texts), 100) for x in encoder(pa.array(texts[k : k + 100]))] == want
    other = token_output.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.cuts and [x.tolist() for x in other(pa.array(texts[:50]))] == [e.ids for e in other.model.encode_batch(texts[:50], add_special_tokens=False)]


def test_language_id(docs, rows, empty, spark):
    out = language_id.predict(docs, PIECES)
    found = out.collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    for r in found:
        assert r["held_out"] == (common.crc_fold_of(r["doc_id"]) == 0) and 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und")
    und = Counter(r["doc_id"] for r in found if r["lang_pred"] == "und")
    assert und == Counter(r[0] for r in rows if not any(c.isalpha() for c in r[1] or ""))
    assert language_id.predict(empty, PIECES).count() == 0
    unlabelled = language_id.predict(docs.drop("lang").selectExpr("*", "cast(null as string) lang"), PIECES)
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def log_passes(index, word, prob, lang):
    """Logarithms of the sums over all segmentations of each beginning and of each end of a word."""
    p = lambda i, j: math.log(prob[index.get(word[i:j], -1)][lang])
    edge = lambda i, j: word[i:j] in index or j == i + 1
    n = len(word)
    longest = max(map(len, index))
    a, b = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for j in range(1, n + 1):
        a[j] = np.logaddexp.reduce([a[i] + p(i, j) for i in range(max(0, j - longest), j) if edge(i, j)])
    for i in range(n - 1, -1, -1):
        b[i] = np.logaddexp.reduce([b[j] + p(i, j) for j in range(i + 1, min(n, i + longest) + 1) if edge(i, j)])
    return a, b, [(i, j, p(i, j)) for j in range(1, n + 1) for i in range(max(0, j - longest), j) if edge(i, j)]


def test_forward_sums_all_segmentations(monkeypatch):
    """Short and long words against a sum over each way to cut them, one by one."""
    for long in (24, 5):
        monkeypatch.setattr(language_id, "LONG", long)
        pieces = language_id.Pieces(PIECES)
        rng = np.random.default_rng(1)
        prob = rng.random((len(pieces.texts) + 1, 2)) / 100
        words = ["tone", "a", "zürich", "漢字x", "contours", "reading", "the", "contour"]

        def cuts(w):
            if not w:
                yield []
            for k in range(1, len(w) + 1):
                if w[:k] in pieces.index or k == 1:
                    for rest in cuts(w[k:]):
                        yield [w[:k], *rest]

        want = [np.log(sum(np.prod([prob[pieces.index.get(p, -1)] for p in way], axis=0) for way in cuts(language_id.SPACE + w))) for w in words]
        assert np.allclose(language_id.word_scores(pieces, words, prob), want)
    words = ["reading" * 400, "漢字" * 33, "x" * 5000]
    assert np.allclose(language_id.word_scores(pieces, words, prob), [[log_passes(pieces.index, language_id.SPACE + w, prob, k)[0][-1] for k in (0, 1)] for w in words])


def fitted(pieces, counts, langs, rounds=4):
    """Expectation-maximisation, word by word and edge by edge."""
    v = len(pieces.texts)
    prob = np.full((v + 1, len(langs)), 1.0 / v)
    prob[v] = language_id.UNKNOWN
    for _ in range(rounds):
        new = np.full((v + 1, len(langs)), 0.05)
        for (lang, w), c in counts.items():
            k = langs.index(lang)
            a, b, edges = log_passes(pieces.index, language_id.SPACE + w, prob, k)
            for i, j, p in edges:
                new[pieces.index.get((language_id.SPACE + w)[i:j], -1), k] += c * math.exp(a[i] + p + b[j] - a[-1])
        prob = new / new[:v].sum(axis=0)
        prob[v] = language_id.UNKNOWN
    return prob


@pytest.mark.parametrize("long", [24, 5])
def test_language_model_and_posterior(spark, monkeypatch, long):
    """The fit and the predictions against plain expectation-maximisation and Bayes' rule; long words and texts without spaces, too."""
    monkeypatch.setattr(language_id, "LONG", long)
    pieces = language_id.Pieces(PIECES)
    rng = random.Random(8)
    vocab = {"en": ["the", "reading", "tone", "of"], "de": ["der", "lesen", "ton", "von"], "zz": ["漢字" * 9, "字漢漢" * 7, "thelesen" * 5]}
    rows = [(i, None if i == 7 else " ".join(rng.choices(vocab[lang], k=rng.randrange(1, 7))), lang) for i, lang in enumerate(rng.choices(sorted(vocab), k=60))]
    rows += [(100 + i, "".join(rng.choices(vocab["en"], k=3)), None) for i in range(5)]
    train = [r for r in rows if r[2] and common.crc_fold_of(r[0]) != 0]
    counts, docs = Counter((lang, w) for _, t, lang in train for w in (t or "").lower().split()), Counter(r[2] for r in train)
    langs = sorted(docs)
    prob = fitted(pieces, counts, langs)
    assert np.allclose(language_id.fit(pieces, counts, docs).prob, prob, rtol=1e-9)
    if long != 24:  # the workers have the module's own value
        return
    out = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    for i, t, _ in rows:
        if not t:
            assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
            continue
        log = [math.log(docs[x] / len(train)) + sum(log_passes(pieces.index, language_id.SPACE + w, prob, k)[0][-1] for w in t.lower().split()) for k, x in enumerate(langs)]
        p = np.exp(np.array(log) - max(log))
        p /= p.sum()
        assert out[i]["lang_pred"] == langs[int(p.argmax())] and math.isclose(out[i]["score"], p.max(), rel_tol=1e-6)


def test_the_sample_is_bounded_and_counts_short_documents(spark):
    rows = [(i, "the tone " + ("x " * 9000 if i % 3 else str(i)), "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    fit = language_id.fit
    try:
        language_id.fit = lambda pieces, counts, docs, rounds=4: seen.update(n=counts["en", "the"], docs=docs)
        language_id.train(docs, PIECES, "doc_id", "text", "lang", sample_docs=20, sample_bytes=100)
    finally:
        language_id.fit = fit
    assert seen == {"n": 20, "docs": {"en": sum(common.crc_fold_of(i) != 0 for i in range(300))}}


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = language_id.predict(docs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()


def test_lm_scoring(docs, rows, empty, monkeypatch):
    train = [r for r in rows if r[0] is not None and common.crc_fold_of(r[0]) != 1]
    c, tree = Counter(), defaultdict(lambda: [0, 0])
    for r in train:
        c.update(text(r[1]).lower().split())
        c[b""] += 1
    n, v = sum(c.values()), len(c)
    deep = lm_scoring.DEPTH
    path = lambda t: (b"\xff" * deep + text(t).lower() + b"\xff")

    def steps(b):
        for t in range(deep, len(b)):
            for k in range(8):
                yield [(b[t - d : t], (1 << k) | (b[t] >> (8 - k))) for d in range(deep + 1)], b[t] >> (7 - k) & 1

    for r in train:
        for nodes, bit in steps(path(r[1])):
            for node in nodes:
                tree[node][bit] += 1
    below, weight = defaultdict(float), {}
    for s, j in sorted(tree, key=lambda x: -len(x[0])):
        z, o = tree[s, j]
        own = math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)
        mixed = own if len(s) == deep else np.logaddexp(own, below[s, j]) + math.log(0.5)
        weight[s, j] = 1.0 if len(s) == deep else math.exp(own + math.log(0.5) - mixed)
        if s:
            below[s[1:], j] += mixed

    def log10(t):
        total = 0.0
        for nodes, bit in steps(path(t)):
            p = 0.5
            for node in reversed(nodes):
                if node in tree:
                    z, o = tree[node]
                    p = weight[node] * (o + 0.5) / (z + o + 1) + (1 - weight[node]) * p
            total += math.log10(p if bit else 1 - p)
        return total

    want = defaultdict(list)
    for r in rows:
        w = [*text(r[1]).lower().split(), b""]
        want[(r[0], r[0] is not None and common.crc_fold_of(r[0]) == 1, len(w), sum(c[x] > 0 for x in w), n)].append((sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), log10(r[1])))
    have = defaultdict(list)
    for r in lm_scoring.score(docs, block_bytes=2000, shards=5).collect():
        have[(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"])].append((r["base_score"], r["score"]))
    assert want.keys() == have.keys()
    for k in want:
        assert np.allclose(sorted(want[k]), sorted(have[k]), rtol=1e-9)
    assert lm_scoring.score(empty).count() == 0
    monkeypatch.setattr(lm_scoring, "MERGED_AT_ONCE", 2)
    monkeypatch.setattr(lm_scoring, "BLOCKS_AT_ONCE", 1)
    again = {(r["doc_id"], r["n_known"], round(r["score"], 3)) for r in lm_scoring.score(docs, block_bytes=20_000, shards=3).collect()}
    assert again == {(k[0], k[3], round(s, 3)) for k, v in have.items() for _, s in v}


def edits(item, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(4)
    items = [(k, t) for k, t in enumerate([rows[12][1][:120], "Quite another sentence, about the pitch of voices at sea.", "short", "", None, "x y z w v u t s r q p o n m l k", "What is a tone?", "is a tone", "no"])]
    changed = list(items[1][1])
    for _ in range(4):
        changed[rng.randrange(len(changed))] = "#"
    extra = [(900, f"before {''.join(changed).upper()}\n after", "en", "s", 1, "", 0, 0, "", ""), (901, "x y z w v u t s r q p o n m l k", "en", "s", 1, "", 0, 0, "", "")]
    extra += [(902 + k, t, "en", "s", 1, "", 0, 0, "", "") for k, t in enumerate(["So: what IS\na  tone? no", "somewhat is a tone?", "what is a tone", "(What is a tone?)y"])]
    all_docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for r in [*rows, *extra]:
        for k, t in items:
            n = decontamination.normal(t or "")
            if r[1] is not None and len(n) >= decontamination.MIN_CHARS and len(r[1]) < 5000:
                e = edits(n, decontamination.normal(r[1]))
                if e <= decontamination.budget(len(n)):
                    want[(r[0], k, e)] += 1
            elif r[1] is not None and len(n) >= decontamination.MIN_EXACT and re.search(rf"(?<![a-z]){re.escape(n)}", decontamination.normal(r[1])):
                want[(r[0], k, 0)] += 1
    assert {k for _, k, _ in want} == {0, 1, 5, 6} and {i for i, k, _ in want if k == 6} == {902, 905}
    assert {r["doc_id"] for r in decontamination.leaks(all_docs, bench, min_exact=1).where("item_id = 8").collect()} == {902} and decontamination.leaks(all_docs, bench, min_exact=1).where("item_id = 7").count() == 4
    assert got(decontamination.leaks(all_docs, bench), "doc_id", "item_id", "edits") == want
    assert got(decontamination.leaks(all_docs, bench, block_chars=30), "doc_id", "item_id", "edits") == want
    kept = decontamination.drop_leaks(all_docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 6 - sum({k[0]: n for k, n in want.items()}.values())
    for a, b in ((empty, bench), (all_docs, bench.limit(0))):
        assert decontamination.leaks(a, b).count() == 0 and decontamination.drop_leaks(a, b).count() == a.count()


def best_fit(lengths, caps, overhead):
    bins, left, count = [], sum(lengths), Counter(lengths)
    for x in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] - sum(b[1]) >= x]
        if not fit:
            smaller = x > min(lengths)
            holds = {c: min(left, c if smaller else c // x * x, left if smaller else count[x] * x) for c in caps if c >= x}
            bins.append((min(holds, key=lambda c: ((c + overhead) / holds[c], c)), []))
            fit = bins[-1:]
        min(fit, key=lambda b: b[0] - sum(b[1]))[1].append(x)
        left -= x
        count[x] -= 1
    return sorted((next(c for c in caps if c >= sum(b)), tuple(sorted(b))) for _, b in bins)


def filled(rows):
    bins = defaultdict(list)
    for b, size, offset, n in rows:
        bins[b].append((offset, n, size))
    out = []
    for v in bins.values():
        at = 0
        for offset, n, size in sorted(v):
            assert offset == at
            at += n
        assert at <= size
        out.append((size, tuple(sorted(n for _, n, _ in v))))
    return sorted(out)


@pytest.mark.parametrize("most", [packing.MOST_COUNTS, 0])
def test_packing(docs, rows, empty, monkeypatch, most):
    monkeypatch.setattr(packing, "MOST_COUNTS", most)
    caps, overhead = (16, 32, 64), 4
    out = packing.pack(docs, BPE, capacities=caps, overhead=overhead).collect()
    model = Tokenizer.from_file(BPE)
    ids = [[*model.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows]
    lengths = []
    for x in ids:
        lengths += [64] * ((len(x) - 1) // 64) + [len(x) - (len(x) - 1) // 64 * 64]
    assert filled((r["bin_id"], r["bin_capacity"], r["bin_offset"], r["length"]) for r in out) == best_fit(lengths, caps, overhead)
    by_doc, want = Counter(), Counter()
    for r in out:
        by_doc[r["doc_id"]] += r["length"]
    for r, x in zip(rows, ids, strict=True):
        want[r[0]] += len(x)
    assert by_doc == want and packing.pack(empty, BPE).count() == 0
    bins = packing.sequences(docs, BPE, capacities=caps, overhead=overhead).collect()
    pieces, cut = Counter(), Counter()
    for b in bins:
        assert len(b["ids"]) <= b["bin_capacity"] and b["offsets"][0] == 0
        for i, lo, hi in zip(b["doc_ids"], b["offsets"], [*b["offsets"][1:], len(b["ids"])], strict=True):
            pieces[(i, tuple(b["ids"][lo:hi]))] += 1
    for r, x in zip(rows, ids, strict=True):
        for k in range(0, len(x), 64):
            cut[(r[0], tuple(x[k : k + 64]))] += 1
    assert pieces == cut
    assert sorted((b["bin_capacity"], len(b["ids"])) for b in bins) == sorted((c, sum(v)) for c, v in best_fit(lengths, caps, overhead))
    assert packing.sequences(empty, BPE).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_item_by_item_best_fit(seed):
    rng = random.Random(seed)
    lengths = [min(64, int(rng.paretovariate(0.8))) if seed % 2 else rng.randrange(1, 65) for _ in range(rng.randrange(1, 120))]
    p = packing.plan(Counter(lengths), (16, 32, 64), 4)
    size = {f + j: c for f, b, c, _ in p.spans for j in range(b)}
    rows = [(f + j // e, size[f + j // e], o + j % e * n, n) for n, _, k, f, e, o in p.segments for j in range(k)]
    assert filled(rows) == best_fit(lengths, (16, 32, 64), 4)


def test_url_filters(spark):
    urls = [None, "", "nothing", "HTTP://WWW.Example.COM/en/71?x=1#y", "http://a.example.com/en/8", "https://x.net/de/8", "https://x.example.net/de/85", "ftp://org/es/", "http://notorg/es/", "http://o.org?x/es/"]
    urls += ["http://shop.fr/cart?x", "http://shop.fr/carts", "http://shop.fr/a?page=3&ref=x", "http://shop.fr/a.PNG", "http://ads.shop.fr/", "://", "http://docs.x.fr/a/cart?y", "http://x.fr/cart", "http://x.fr/tag/a/feed", "http://x.fr/tag/a/feeds", "http://m.casino-x.fr/", "http://m.casinos-x.fr/", "http://x.fr/robots.txt?.gif", "http://x.fr/a.gif?robots.txt", "http://x.fr/" + "very/long/" * 20_000 + "a.gif", "http://é.fr/ä?SESSIONID=1"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, host string")
    out = {r["page_id"]: tuple(r)[1:] for r in url_filters.judge_urls(df).collect()}
    for i, u in enumerate(urls):
        host, path = (re.match(r"[^/?#]*", u.partition("://")[2])[0].lower(), re.match(r"[^/?#]*([^?#]*)", u.partition("://")[2])[1]) if u and "://" in u else ("", "")
        rules = [r for r in url_filters.HOST_PATH_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(rules, key=lambda r: len(r.text), default=None)
        hits = {p.verdict for p in url_filters.PATTERNS if host + path and re.search(p.regex, (u or "").lower())}
        assert out[i] == (host, path, rule and rule.text, rule.verdict if rule else "block" if hits == {"block"} else "allow"), u
    assert out[len(urls)] == out[3] and {v[3] for v in out.values()} == {"block", "allow"}
    assert url_filters.judge_urls(df.limit(0)).count() == 0


def test_url_rules_are_found_by_derived_tokens(spark):
    assert url_filters.Pattern("@@://docs.*/cart^").tokens == ("docs", "cart") and url_filters.Pattern("^utm_source=feed^").tokens == ("utm", "source", "feed")
    assert url_filters.Pattern("ad*server.x|").tokens == ("x",) and url_filters.Pattern("/ad").tokens == ()
    rng = random.Random(6)
    words = sorted({t for p in url_filters.PATTERNS for t in p.tokens}) + ["a", "b1"]
    urls = ["http://" + "".join(rng.choice(words) + rng.choice("/.?&=;^-_") for _ in range(rng.randrange(1, 7))) + rng.choice(["", "1", "x"]) for _ in range(4000)]
    often = url_filters.token_counts(spark.createDataFrame([(u,) for u in urls], "url string"), url_filters.PATTERNS)
    assert often == Counter(t for u in urls for t in {*re.findall("[a-z0-9]+", u)} if t in words[:-2])
    index = url_filters.PatternIndex(url_filters.PATTERNS, often)
    ran = hit = 0
    for u in urls:
        matching = {(p.regex, p.verdict) for p in url_filters.PATTERNS if re.search(p.regex, u)}
        fetched = {(r.pattern, v) for r, v in index.fetched(u)}
        assert matching <= fetched
        ran, hit = ran + len(fetched), hit + len(matching)
    assert hit > 500 and ran < len(urls) * len(url_filters.PATTERNS) / 8
    with pytest.raises(ValueError):
        url_filters.PatternIndex([url_filters.Pattern("ads")], {})


def test_queries_are_named_for_their_operators():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))
    assert queries.ORACLE_SQL.keys() <= queries.QUERIES.keys()
